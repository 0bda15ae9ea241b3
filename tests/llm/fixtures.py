"""A small corpus with copies, near copies, shared passages and odd rows; and brute-force versions of the operators."""

import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for columns of their own.
CLASHES = ("id", "block", "bucket", "hit", "items", "n", "key", "part", "piece", "size", "spans", "norm", "words", "component", "grp", "label", "at")


def rows(seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    texts = [text(rng.randint(20, 150)) for _ in range(30)]
    passage = text(40)
    for k in range(12):
        words = texts[k].split()
        words[rng.randrange(len(words))] = f"x{k}"
        texts += [" ".join(words), texts[k]]
        if k % 3 == 0:
            texts.append(f"{text(15)} {passage} {text(10)}")
    for k in range(15):  # a chain of edits
        texts.append(" ".join((texts[2].split() + vocab)[k : k + 60]))
    texts += [text(6000)] * 2 + [None, None, "", " \n\t ", "one", "one", "a b c", "A B C", "a b c d", "é ü 漢字 ñ", "\x0b\x0c", "x" * 5000]
    texts += ["line one\nline one\nline two\n\nline one", " ".join(["same"] * 80), "mail a.b@c.de, b@@c.d 10.0.0.1 999.1.1.1 4111 1111 1111 1111 +49 (30) 1234-5678 +1-2", "See the GNU General Public License. All rights reserved; cc by CC-BY, all rights  reserved"]
    out = [(3 * k + 1, t, "en", "web", len(t or "")) for k, t in enumerate(texts)]
    rng.shuffle(out)
    return out + [(None, texts[0], "en", "web", 1), (None, None, None, None, None), (1, texts[0], "en", "web", 1)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(5)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


def space_words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", t or "")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def alnum_words(t):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))


def removed_words(data, window=13):
    """(doc_id, n_words, n_removed, kept words) of each row."""
    first, far = {}, float("inf")
    order = lambda i: far if i is None else i
    for i, t, *_ in data:
        w = space_words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, far), order(i))
    for i, t, *_ in data:
        w = space_words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < order(i):
                gone.update(range(k, k + window))
        yield i, len(w), len(gone), [x for k, x in enumerate(w) if k not in gone]


def components(data, size=5):
    """(doc_id, n_shingles, component_id) of each row."""
    sets = []
    for i, t, *_ in data:
        w = space_words(lower(t))
        sets.append((i, {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())))
    parent = {i: i for i, _ in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    known = [(i, s) for i, s in sets if i is not None and s]
    for k, (i, s) in enumerate(known):
        for j, t in known[:k]:
            if 100 * len(s & t) >= 80 * len(s | t):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [(i, len(s), None if i is None else root(i)) for i, s in sets]


def leaks(data, items, window=10):
    """(doc_id, n_words, n_hit, sorted names of the items that occur) of each row."""
    windows = {}
    for i, t in items:
        w = alnum_words(t)
        if i is not None and w:
            n = min(window, len(w))
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    lengths = {len(x) for x in windows}
    for i, t, *_ in data:
        w, hit, found = alnum_words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (names := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= names
        yield i, len(w), len(hit), sorted(found)


def base_measures(t):
    t = t or ""
    w = space_words(t)
    lines = [x for x in t.split("\n") if space_words(x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    again = {k + j for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def phrase_places(t):
    w = alnum_words(t)
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                yield k, label


def personal_data(t):
    """Base spans of a text, with the patterns as the contract states them."""
    t = t or ""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    )
    found = [(m.start(), k, kind, m.end()) for k, (kind, p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m[0])]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]

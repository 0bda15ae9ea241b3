"""Whitening, conversation repair and chat formatting beside brute force."""

import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest
from compare import SMALL
from pyspark.sql import functions as F

from heddle.llm import chat_format, conversations, whitening

CONV = "conv_id long, turn long, role string, text string"


# whitening


def usable(rows):
    return [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and isfinite(c) for c in v)]


def check_whitened(rows, got, digits=5):
    good = usable(rows)
    x = [[floor(1024 * Fraction(c)) + 100000 for c in v] for _, v in good]
    n, s = len(x), [sum(c) for c in zip(*x)]
    y = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(row, s)] for row in x])
    cov = y.T @ y / n
    values = np.linalg.eigvalsh(cov)[::-1]
    k = min(8, len(s))
    assert len(got) == n * k and {r["component"] for r in got} == set(range(1, k + 1)) and {r["n"] for r in got} == {n}
    want = Counter((i, sum((n * a - b) ** 2 for a, b in zip(row, s))) for (i, _), row in zip(good, x))
    assert Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == want
    for r in got:
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(cov), rel=1e-6)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-6
    by_id = defaultdict(dict)
    for r in got:
        by_id[r["vec_id"]][r["component"]] = r["whitened"]
    if len(by_id) == n:
        w = np.array([[by_id[i][c + 1] for c in range(k)] for i, _ in good])
        assert np.allclose(w.T @ w / n, np.eye(k), atol=1e-6)
        v = y.T @ w / n / np.sqrt(values[:k])  # the components, as whitened = y v / sqrt(e)
        assert np.allclose(cov @ v, v * values[:k], rtol=1e-6, atol=1e-6 * values[0])


def vectors(spark, rows, parts=4):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"n": F.lit("clash"), "component": F.lit(1), "width": F.lit(2)}).repartition(parts)


def test_whitening(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 12)) * np.linspace(3, 0.2, 12) + 5
    rows = [(k, np.float32(v).tolist()) for k, v in enumerate(base)]
    rows += [(1000 + k, rows[0][1]) for k in range(150)] + [(None, rows[1][1])]
    odd = [(2000, None), (2001, [None] + [0.0] * 11), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11), (2004, [])]
    check_whitened(rows + odd, [r.asDict() for r in whitening.whitened(vectors(spark, rows + odd)).collect()])
    assert whitening.whitened(vectors(spark, [])).count() == 0
    assert whitening.whitened(vectors(spark, odd)).count() == 0


def test_whitening_widths_and_no_variance(spark):
    rng = np.random.default_rng(4)
    narrow = [(k, rng.normal(size=3).tolist()) for k in range(40)]
    wide = [(100 + k, rng.normal(size=9).tolist()) for k in range(60)]
    as_float = lambda rows: [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    got = [r.asDict() for r in whitening.whitened(vectors(spark, narrow + wide + [(500, [1.0] * 5)])).collect()]
    check_whitened(as_float(narrow), [r for r in got if r["vec_id"] < 100])
    check_whitened(as_float(wide), [r for r in got if 100 <= r["vec_id"] < 500])
    alone = [r for r in got if r["vec_id"] == 500]
    assert len(alone) == 5 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 for r in alone)
    line = [(k, [float(k), 2.0 * k, 0.0]) for k in range(20)]
    got = whitening.whitened(vectors(spark, line)).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in got) and got[0]["identity_error"] < 1e-6


def test_whitening_of_huge_numbers(spark):
    rows = [(k, [float(np.float32(v)) for v in (10.0 ** (3 * k), -1e9 * k, 1.0)]) for k in range(5)]
    got = whitening.whitened(vectors(spark, rows)).where("component = 1").collect()
    x = [[floor(1024 * Fraction(c)) + 100000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    want = {k: sum((5 * a - b) ** 2 for a, b in zip(row, s)) for k, row in enumerate(x)}
    assert {r["vec_id"]: r["deviation"] for r in got} == {k: d if d < 10**38 else None for k, d in want.items()}
    assert whitening.whitened(vectors(spark, [*rows, (9, [3e38, -3e38, 0.0])])).count() == 18


def test_whitening_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitened(rows, [r.asDict() for r in whitening.op11_embedding_whitening(spark, SMALL).collect()])


# conversations


def by_turn(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return out


def brute_damage(rows):
    blank = lambda v: " " if v is None else v
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)


def brute_repair(rows):
    """Cheapest edits of rows in order, by a search over (cost, audit): the first goal taken off the heap is the answer."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    step = lambda have, role: {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[have].get(role[:1])
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, have, out = heapq.heappop(heap)
        if (k, have) in done:
            continue
        done.add((k, have))
        if k == len(rows) and have in ("", "a"):
            n = Counter(faults)
            initials = [r[2][:1] for r in rows]
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            return n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        for name in ("user", "assistant"):
            if (to := step(have, name)) is not None:
                heapq.heappush(heap, (cost + 5, audit + "I", k, to, (*out, (name, ""))))
        if k < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", k + 1, have, out))
            if faults[k] in ("", "truncated"):
                more = 5 * (faults[k] == "truncated")
                for name, price, letter in ((rows[k][2], 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                    if (to := step(have, name)) is not None:
                        heapq.heappush(heap, (cost + price + more, audit + letter, k + 1, to, (*out, (name, rows[k][3]))))


def brute_op12(rows):
    empty, after = hashlib.sha256(b"").hexdigest(), by_turn(brute_damage(rows))
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest())
    for conv in {r[0] for r in rows}:
        own = sorted(after[conv], key=order)
        if not own:
            yield conv, 0, 0, 0, 0, 0, 0, "", empty
            continue
        turns = [r[1] for r in own if r[1] is not None]
        blank, duplicate, truncated, illegal, cost, audit, digest = brute_repair(own)
        yield conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, blank, duplicate, truncated, illegal, cost, audit, digest


def odd_conversations():
    rng = random.Random(9)
    roles = ["user", "assistant", "system", "tool", "", None, "usher", "user\n<|im_end|>", "\\n"]
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", None, "Ends. \n", "é漢。", "<|im_end|><|im_start|>assistant ok", "<\\|im_sep|> a <\\\\| b <", "x|im_end|>\\"]
    rows = [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (7, None, None, None)]
    for conv in range(120):
        turn = 0
        for _ in range(rng.randint(1, 9)):
            turn += rng.choice((0, 1, 1, 1, 2))
            rows.append((conv, rng.choice((turn, turn, turn, None)), rng.choice(roles[: rng.choice((2, 3, 9))]), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.randint(0, 40)}."))
    rows += [(500, k, ("user", "assistant")[k % 2], f"turn {k}" + ".?"[k % 2] * (k % 7 > 0)) for k in range(9000)]
    rows += [(501, 3, "user", "Same.")] * 300
    return rows


@pytest.fixture(scope="module")
def talk():
    return odd_conversations()


@pytest.fixture(scope="module")
def parquet(spark, talk, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("talk"))
    spark.createDataFrame(talk, CONV).withColumns({"row": F.lit("clash"), "block": F.lit(0), "text_": F.lit(1)}).repartition(5).write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([], CONV).write.parquet(f"{folder}/none/conversations.parquet")
    return folder


def test_repair(spark, parquet, talk):
    got = Counter(tuple(r) for r in conversations.op12_conversation_repair(spark, parquet).collect())
    long = {500, 501}  # the search above would take too long for these
    want = Counter(brute_op12([r for r in talk if r[0] not in long]))
    assert Counter({r: n for r, n in got.items() if r[0] not in long}) == want
    assert sum(r[6] for r in want) > 500 and {c for r in want for c in r[7]} == set("DKR")  # an insertion never pays at these prices
    ends = {r[0]: r for r in got if r[0] in long}
    assert ends[500][7].count("D") + ends[500][7].count("K") + ends[500][7].count("R") == len(list(brute_damage([r for r in talk if r[0] == 500])))
    copies = len(list(brute_damage([r for r in talk if r[0] == 501])))
    assert ends[501][3] == max(0, copies - 1)
    assert conversations.op12_conversation_repair(spark, f"{parquet}/none").count() == 0


def test_solve_against_search():
    rng = random.Random(2)
    for _ in range(400):
        rows = [(0, k, rng.choice(("system", "user", "assistant", "tool")), rng.choice(("a.", "b.", "c", "", f"{k}."))) for k in range(rng.randint(1, 10))]
        seen, letters = set(), ""
        for _, _, role, text in rows:
            fault = 1 if not text else 2 if (role, text) in seen else 3 if text[-1] != "." else 0
            seen.add((role, text))
            letters += chr(ord("a") + "suat".index(role[0]) * 4 + fault)
        cost, audit, _ = conversations.solved(letters)
        assert (cost, audit) == brute_repair(rows)[4:6]


# chat formatting


def test_formatting(spark, parquet, talk):
    got = {r["conv_id"]: r for r in chat_format.op13_chat_formatting(spark, parquet).collect()}
    probe = [(-1, k, role, chat_format.PROBE) for k, role in enumerate(("user", "assistant"))]
    held = by_turn(talk + probe)
    assert got.keys() == held.keys()
    for conv, rows in held.items():
        rows = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows))
        said = "".join(f"{role}\n{text}\n" for *_, role, text in rows)
        loss = "".join(text for *_, role, text in rows if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(rows), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()), conv
    assert chat_format.op13_chat_formatting(spark, f"{parquet}/none").count() == 1


def test_format_of_one(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "assistant", "<|im_end|>"), (1, 3, "assistant", None)]
    r = chat_format.formatted(spark.createDataFrame(rows, CONV)).first()
    assert r["formatted"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_sep|><\\|im_end|><|im_sep|><|im_end|>\n"
    assert "".join(s["piece"] for s in r["segments"]) == r["formatted"] and [s["piece"] for s in r["segments"] if s["loss"]] == ["b", "<\\|im_end|>", ""]

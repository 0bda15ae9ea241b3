"""License scan: ordered signature rules over the words of a text.

Only DataFrame functions are used. A keyword prefilter picks the texts that may hold anything; these are
normalised to numbered words, so that a match carries its place, and of the rules only those whose keyword stands in
the text are tried, with all their places. Each keyword is one word, or a part of one, of every text that the rule
can match, so neither filter loses anything. Detections are sorted by place and swept once: one that lies inside a
longer one is suppressed, and of detections with the same span the one with the better priority stays (then the
earlier rule). Base phrases are counted apart and never suppressed. All steps are linear in the text, or nearly so.

The score is the chance that at least one detection is right, each being wrong with a chance that rises with
its priority number and falls with its length; base phrases count as general notices.

Nulls: a null text is empty: no words, no labels, score 0. Repeated rows are judged each for itself. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import END, RULES

BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WRONG = {1: 0.02, 2: 0.05, 3: 0.1, 4: 0.2, 5: 0.3, 6: 0.5}
BASE_WRONG = 0.5
SWEEP = 256  # detections in a run of the sweep


def _minimal(words: set[str]) -> tuple[str, ...]:
    """The words that no shorter one stands in: a text that holds a word holds one of these."""
    return tuple(sorted(w for w in words if not any(v != w and v in w for v in words)))


#: A text without any of these holds no rule's keyword and no base phrase.
GATE = _minimal({k for _, _, k, _ in RULES} | {max(phrase.split(), key=len) for phrase, _ in BASE})


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def numbered_pattern(pattern: str) -> str:
    """The pattern over numbered words: every word has its number and a colon before it."""
    return pattern.replace(" ?", "\0").replace(" ", r" \d+:").replace("\0", r"(?: \d+:)?") + END


def _places(pattern: str, rest: str) -> str:
    """SQL for the places of all matches in the numbered words, as structs of start, end and `rest`."""
    start = "cast(substring_index(ltrim(x), ':', 1) as int)"
    return f"""transform(regexp_extract_all(numbered, {_literal(numbered_pattern(pattern))}, 0), x ->
      named_struct('start', {start}, 'end', {start} + length(x) - length(replace(x, ' ', '')), {rest}))"""


def normalised(text: Column) -> Column:
    """Lower-case words with one space between, and one at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), GAP, " ")), F.lit(" "))


def _tried() -> str:
    """SQL for the detections of all rules whose keyword stands in the text. Each pattern is a literal, so it is compiled once."""
    by_keyword: dict[str, list[str]] = {}
    for i, (label, priority, keyword, pattern) in enumerate(RULES):
        by_keyword.setdefault(keyword, []).append(_places(pattern, f"'label', {_literal(label)}, 'priority', {priority}, 'rule', {i}"))
    none = "cast(array() as array<struct<start:int,end:int,label:string,priority:int,rule:int>>)"
    return "concat(" + ", ".join(f"if(contains(norm, {_literal(k)}), concat({', '.join(x)}), {none})" for k, x in sorted(by_keyword.items())) + ")"


def _swept(hits: str) -> str:
    """SQL for the detections that no other one suppresses. In the order of starts, then falling ends, priorities and rules, one stays if its end lies beyond all ends before. The order is cut into runs, for which the greatest end before is found first."""
    key = "transform({}, x -> named_struct('start', x.start, 'back', -x.end, 'priority', x.priority, 'rule', x.rule, 'label', x.label))".format(hits)
    runs = f"transform(sequence(0, greatest(0, (size(s) - 1) div {SWEEP})), c -> slice(s, c * {SWEEP} + 1, {SWEEP}))"
    before = "aggregate(r, named_struct('top', -1, 'out', cast(array() as array<int>)), (acc, run) -> named_struct('top', greatest(acc.top, coalesce(array_max(transform(run, x -> -x.back)), -1)), 'out', concat(acc.out, array(acc.top))), acc -> acc.out)"
    empty = "cast(array() as array<struct<start:int,back:int,priority:int,rule:int,label:string>>)"
    of_run = f"aggregate(run, named_struct('top', m, 'out', {empty}), (acc, x) -> if(-x.back <= acc.top, acc, named_struct('top', -x.back, 'out', concat(acc.out, array(x)))), acc -> acc.out)"
    swept = f"flatten(zip_with(r, {before}, (run, m) -> {of_run}))"
    whole = "transform({}, x -> named_struct('start', x.start, 'end', -x.back, 'label', x.label, 'priority', x.priority, 'rule', x.rule))".format(swept)
    # arrays of one element hold what is used more than once
    return f"element_at(transform(array(array_sort({key})), s -> element_at(transform(array({runs}), r -> {whole}), 1)), 1)"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, base, found): base and found are arrays of (start, end, label, ...) in words from 0, the end exclusive."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    low, gate = F.translate(text, UPPER, LOWER), F.lit(False)
    for word in GATE:
        gate = gate | low.contains(word)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), F.when(gate, normalised(text)).alias("norm"))
    words = F.transform(F.split(F.trim("norm"), " "), lambda w, i: F.concat(i.cast("string"), F.lit(":"), w))
    rows = rows.withColumn("numbered", F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")))
    base = F.expr("concat(" + ", ".join(_places(f" {phrase}", f"'label', {_literal(label)}") for phrase, label in BASE) + ")")
    empty = lambda kind: F.array().cast(f"array<struct<start:int,end:int,label:string{kind}>>")
    rows = rows.select("doc_id", "n_words", F.when(F.col("norm").isNotNull(), base).alias("base"), F.when(F.col("norm").isNotNull(), F.expr(_tried())).alias("hits"))
    kept = F.when(F.size("hits") > 1, F.expr(_swept("hits"))).otherwise(F.col("hits"))
    return rows.select("doc_id", "n_words", F.coalesce("base", empty("")).alias("base"), F.coalesce(kept, empty(",priority:int,rule:int")).alias("found"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document."""
    found = scan(docs)
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    base_names, starts = F.transform("base", lambda x: x["label"]), F.transform("base", lambda x: x["start"])
    of_found = F.aggregate("found", F.lit(1.0), lambda acc, x: acc * _wrong(x))
    of_base = F.when(F.size("base") > 0, F.lit(BASE_WRONG)).otherwise(F.lit(1.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        names(base_names).alias("base_labels"),
        names(F.concat(base_names, F.transform("found", lambda x: x["label"]))).alias("labels"),
        F.round(1 - of_found * of_base, 6).alias("score"),
    )


def _wrong(x: Column) -> Column:
    chance = F.lit(WRONG[6])
    for p, c in sorted(WRONG.items(), reverse=True)[1:]:
        chance = F.when(x["priority"] == p, F.lit(c)).otherwise(chance)
    return chance / F.sqrt((x["end"] - x["start"]).cast("double"))


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))

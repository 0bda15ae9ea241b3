"""Retrieval metrics (survey 2.K, E11, E12, F4, F5, J13, J14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stored import small, stored

MEANS = ("recall5", "hit5", "precision5", "mrr10", "ndcg10")
ALL_MEANS = ("recall5", "recall20", "hit5", "precision5", "mrr10", "ndcg10")
GATE = {"recall5": 0.90, "recall20": 0.98, "hit5": 0.90, "mrr10": 0.85, "ndcg10": 0.80}
ANCHOR = 8  # words
CASES = "array<struct<id:string,query:string,category:string,split:string,expectedDocuments:array<string>,expectedPassages:array<string>,mustNotReturn:array<string>,hardNegatives:array<string>,answerable:boolean>>"
DATASET = f"struct<name:string,version:int,minimumRecallAt5:double,minimumRecallAt20:double,minimumHitRateAt5:double,minimumMrrAt10:double,minimumNdcgAt10:double,cases:{CASES}>"


def per_case(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """Metrics of each case (qid, category, expected, passage, forbidden, hard, answerable) by its hits (qid, rank, file_name, passage_hit).

    Documents count once, at their first hit. A case without an answer scores 1 if nothing came back, else 0, and no reciprocal rank.
    """
    first = hits.groupBy("qid", "file_name").agg(F.min("rank").alias("r"), F.min_by("passage_hit", "rank").alias("p"))
    first = first.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("r", "file_name")))
    listed = first.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "file_name", "p"))).alias("docs"))  # a search's limit bounds it
    rows = cases.join(listed, "qid", "left").withColumn("docs", F.coalesce("docs", F.array().cast("array<struct<pos:int,file_name:string,p:boolean>>")))
    names = F.transform("docs", lambda d: d["file_name"])
    want, n = F.size("expected"), F.size("docs")
    hits5 = F.size(F.array_intersect(F.slice(names, 1, 5), F.col("expected")))
    ranks = F.transform(F.filter("docs", lambda d: F.array_contains("expected", d["file_name"])), lambda d: d["pos"])
    best = F.array_min(ranks)
    worst = F.array_min(F.transform(F.filter("docs", lambda d: F.array_contains("hard", d["file_name"])), lambda d: d["pos"]))
    gain = lambda rel, pos: (F.pow(F.lit(2.0), rel) - 1) / (F.log(pos + 1.0) / F.log(F.lit(2.0)))
    dcg = F.aggregate("docs", F.lit(0.0), lambda s, d: s + F.when((d["pos"] <= 10) & F.array_contains("expected", d["file_name"]), gain(F.when(d["p"], 2).otherwise(1), d["pos"])).otherwise(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.greatest(F.lit(1), want))), F.lit(0.0), lambda s, k: s + gain(F.when((k == 1) & F.col("passage"), 2).otherwise(1), k))
    none = F.when(n == 0, 1.0).otherwise(0.0)
    ok = lambda value: F.when(F.col("answerable"), F.coalesce(value, F.lit(0.0))).otherwise(none)
    return rows.select(
        "qid",
        "category",
        ok(hits5 / want).alias("recall5"),
        ok(F.size(F.array_intersect(F.slice(names, 1, 20), F.col("expected"))) / want).alias("recall20"),
        ok(F.when(hits5 > 0, 1.0)).alias("hit5"),
        ok(F.when(n > 0, hits5 / F.least(F.lit(5), n))).alias("precision5"),
        F.when(F.col("answerable") & (best <= 10), 1.0 / best).otherwise(0.0).alias("mrr10"),
        ok(F.least(F.lit(1.0), dcg / ideal)).alias("ndcg10"),
        F.arrays_overlap(F.slice(names, 1, 10), F.col("forbidden")).alias("forbidden_hit"),
        (worst.isNotNull() & (best.isNull() | (worst < best))).alias("outranked"),
    )


def grades(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(qid, file_name, grade) of the documents (file_name, content) in which the passages (qid, passage) stand, by their words of a-z and 0-9: 2 for a whole passage, 1 for its first `ANCHOR` words.

    The documents' word runs meet the passages' first words by equality; only where these meet is the whole passage looked for.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)
    wanted = items.select("qid", words("passage").alias("w")).where("size(w) > 0")
    wanted = stored(wanted.select("qid", F.array_join(F.slice("w", 1, ANCHOR), " ").alias("anchor"), F.least(F.lit(ANCHOR), F.size("w")).alias("n"), F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("whole")))
    texts = stored(documents.select("file_name", words("content").alias("w")))
    met = None
    for r in wanted.select("n").distinct().orderBy("n").collect():  # `ANCHOR` lengths at most
        n = r["n"]
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
        runs = texts.select("file_name", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))).alias("anchor"))  # noqa: B023
        found = runs.join(small(wanted.where(F.col("n") == n)), "anchor").select("qid", "file_name", "whole").distinct()
        met = found if met is None else met.unionByName(found)
    if met is None:
        return items.select("qid", F.lit("").alias("file_name"), F.lit(0).alias("grade")).limit(0)
    joined = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    return met.join(texts, "file_name").select("qid", "file_name", F.when(F.contains(joined, F.col("whole")), 2).otherwise(1).alias("grade"))


def dataset(spark, path: str) -> tuple[DataFrame, dict[str, float]]:
    """Cases (qid, id, query, category, passages, expected, forbidden, hard, answerable) and thresholds of a JSON dataset; one that is incomplete is refused."""
    read = spark.read.text(path, wholetext=True).select(F.from_json("value", DATASET, {"mode": "PERMISSIVE"}).alias("d")).select("d.*")
    row = read.drop("cases").first()
    least = {"recall5": row["minimumRecallAt5"], "recall20": row["minimumRecallAt20"], "hit5": row["minimumHitRateAt5"], "mrr10": row["minimumMrrAt10"], "ndcg10": row["minimumNdcgAt10"]}
    least = {m: (least["recall5"] if v is None and m in ("recall20", "hit5") else v) for m, v in least.items()}
    if not (row["name"] or "").strip() or (row["version"] or 0) < 1 or not all(v is not None and 0 <= v <= 1 for v in least.values()):
        raise ValueError("a dataset needs a name, a version of 1 or more, and thresholds from 0 to 1")
    none = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    cases = read.select(F.posexplode("cases").alias("k", "c")).select(F.col("k").cast("long").alias("qid"), "c.id", "c.query", "c.category", none("c.expectedPassages").alias("passages"), none("c.expectedDocuments").alias("expected"), none("c.mustNotReturn").alias("forbidden"), none("c.hardNegatives").alias("hard"), F.coalesce("c.answerable", F.lit(True)).alias("answerable"))
    cases = stored(cases.withColumn("passage", F.size("passages") > 0))
    if cases.isEmpty():
        raise ValueError("a dataset needs cases")
    return cases, least


def rollup(metrics: DataFrame, *by: str, means: tuple[str, ...] = MEANS) -> DataFrame:
    return metrics.groupBy(*by).agg(F.count("*").alias("cases"), *[F.round(F.avg(m), 6).alias(m) for m in means])


def failures(metrics: DataFrame, gate: dict[str, float] = GATE) -> list[str]:
    """What keeps the metrics from passing: means below the gate, a forbidden document, a hard negative before the answer."""
    row = metrics.agg(*[F.avg(m).alias(m) for m in gate], F.count_if("forbidden_hit").alias("f"), F.count_if("outranked").alias("o")).first()
    return [m for m, least in gate.items() if (row[m] or 0.0) < least] + ["forbidden"] * (row["f"] > 0) + ["outranked"] * (row["o"] > 0)


def report(metrics: DataFrame, name: str, strategy: str, gate: dict[str, float] = GATE) -> DataFrame:
    """One row: name, strategy, cases, the means, failures, and the cases' own rows as an array; to be written as JSON."""
    means = metrics.agg(F.count("*").alias("cases"), *[F.round(F.avg(m), 6).alias(m) for m in ALL_MEANS], F.array_sort(F.collect_list(F.struct("qid", "category", *ALL_MEANS, "forbidden_hit", "outranked"))).alias("results"))
    return means.select(F.lit(name).alias("name"), F.lit(strategy).alias("strategy"), "cases", *ALL_MEANS, F.array(*[F.lit(x) for x in failures(metrics, gate)]).cast("array<string>").alias("failures"), "results")


def nearest_rank(rows: DataFrame, key: str, value: str, percents: tuple[int, ...]) -> DataFrame:
    """(key, n, p<percent>...) by key: the number of values that aren't null, and of each percentile the least value with at least that share of them at or below it.

    Values are counted first and dealt by range of (key, value), so a key with many rows spreads over tasks; only the ranges that hold a percentile are gone through value by value.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(F.count(value).alias("c"))
    dealt = stored(counts.repartitionByRange(parts, "key", "value").withColumn("part", F.spark_partition_id()))
    of_part = dealt.groupBy("key", "part").agg(F.sum("c").alias("c"))
    in_order = Window.partitionBy("key").orderBy("part")  # a row for each range
    of_part = of_part.select("key", "part", (F.sum("c").over(in_order) - F.col("c")).alias("before"), F.sum("c").over(in_order).alias("upto"), F.sum("c").over(Window.partitionBy("key")).alias("n"))
    reached = lambda p, c: F.col(c) * 100 >= F.col("n") * p
    holds = F.lit(False)
    for p in percents:
        holds = holds | (reached(p, "upto") & ~reached(p, "before"))
    wanted = stored(of_part.where(holds).select(F.col("key").alias("_key"), F.col("part").alias("_part"), "before", "n"))
    found = dealt.where("value IS NOT NULL").join(small(wanted), F.col("key").eqNullSafe(F.col("_key")) & (F.col("part") == F.col("_part")))
    found = found.withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("key", "part").orderBy("value")))
    least = [F.min(F.when(reached(p, "upto"), F.col("value"))).alias(f"p{p}") for p in percents]
    ranked = found.groupBy(F.col("key").alias("_key")).agg(*least)
    totals = dealt.groupBy("key").agg(F.sum("c").alias("n"))
    return totals.join(ranked, F.col("key").eqNullSafe(F.col("_key")), "left").select(F.col("key").alias(key), "n", *[f"p{p}" for p in percents])

"""Highlights (survey C4, G5, I26, J12, J25): spans of a chunk that are closest to a query, and places of the query's words.

A chunk is a table of lines with their offsets, which running sums of lengths give; paragraphs are groups of lines between
blank ones, sentences are pieces of paragraphs, windows are lines taken four at a time. All candidates lie in one table of
offsets, each distinct text of which is embedded once; they are ranked by columns, and the best that don't overlap are
taken by a fold over each pair's ranked array, which the limits below bound.

Offsets count characters from 0, the end exclusive. White space is that of the pattern `\\s`. A null text has no spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import Embedder, Histogram
from ..plans.stored import stored
from . import embedding as E

# fixed values: characters of a span, spans after which no paragraph or window is begun, lines, lines of a window and between windows, places of words
SHORTEST, LONGEST, UNTIL_PARAGRAPH, UNTIL_WINDOW, LINES, WINDOW_LINES, WINDOW_STEP, PLACES = 8, 700, 80, 120, 120, 4, 2, 80
# fixed values: least similarity, and what long spans lose in the ranking
LEAST_SIMILARITY, LENGTH_UNIT, LENGTH_WEIGHT, MOST_LOST = 0.18, 90.0, 0.018, 0.055
_LINE_END = r"(?<=\n)|(?<=\r)(?!\n)"
_SENTENCE_END = r"(?<=[.!?][\"')\]]{0,4})(?=\s)|(?<=[。！？])(?![。！？])"
SPANS = "array<struct<start:int,end:int,similarity:double>>"


def _pieces(rows: DataFrame, keys: list[str], text: str, pattern: str, base: Column | None = None) -> DataFrame:
    """keys, number, start, end of the pieces of a text, without white space at their ends; blank ones have start = end."""
    each = rows.select(*keys, (F.lit(0) if base is None else base).alias("base"), F.posexplode(F.split(F.col(text), pattern, -1)).alias("number", "piece"))
    upto = F.sum(F.length("piece")).over(Window.partitionBy(*keys).orderBy("number"))
    lead = F.length("piece") - F.length(F.regexp_replace("piece", r"^\s+", ""))
    body = F.length(T.strip(F.col("piece")))
    start = F.col("base") + F.col("upto") - F.length("piece") + F.when(body > 0, lead).otherwise(0)
    placed = each.withColumn("upto", upto).select(*keys, "number", start.cast("int").alias("start"), body.alias("body"))
    return placed.select(*keys, "number", "start", (F.col("start") + F.col("body")).cast("int").alias("end"))


def candidates(texts: DataFrame) -> DataFrame:
    """chunk_id, start, end, turn of the candidate spans of the chunks (chunk_id, content), each place once; turn orders equal ranks."""
    fits = (F.col("end") - F.col("start")).between(SHORTEST, LONGEST)
    texts = texts.where(F.length("content") > 0)
    lines = stored(_pieces(texts, ["chunk_id"], "content", _LINE_END))
    in_order = Window.partitionBy("chunk_id").orderBy("number")
    full = F.col("end") > F.col("start")
    # paragraphs: a line belongs to the one that the blank lines before it have begun
    parted = lines.withColumn("paragraph", F.sum(F.when(full, 0).otherwise(1)).over(in_order)).where(full)
    paragraphs = parted.groupBy("chunk_id", "paragraph").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    own = paragraphs.join(texts, "chunk_id").select("chunk_id", "paragraph", "start", F.expr("substring(content, start + 1, end - start)").alias("body"))
    sentences = _pieces(own, ["chunk_id", "paragraph"], "body", _SENTENCE_END, F.col("start")).select("chunk_id", "paragraph", "start", "end")
    prose = paragraphs.select("chunk_id", "paragraph", "start", "end").unionByName(sentences).where(fits).distinct()
    # a paragraph counts if those before it hold fewer spans than the bound
    before = F.count("*").over(Window.partitionBy("chunk_id").orderBy("paragraph").rangeBetween(Window.unboundedPreceding, -1))
    prose = prose.withColumn("paragraph", F.col("paragraph").cast("long")).withColumn("before", before).where(F.col("before") < UNTIL_PARAGRAPH)
    prose = prose.select("chunk_id", "start", "end", F.struct(F.lit(0).alias("kind"), F.col("paragraph").alias("of"), (-F.col("end") + F.col("start")).alias("size"), "start").alias("turn"))
    kth = lines.where(full).withColumn("k", (F.row_number().over(in_order) - 1).cast("long")).where(F.col("k") < LINES)
    turn = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col("k").alias("of"), F.lit(0).alias("size"), "start").alias("turn")
    single = kth.where(fits).select("chunk_id", "start", "end", turn(1))
    once = prose.unionByName(single).groupBy("chunk_id", "start", "end").agg(F.min("turn").alias("turn"))
    # windows, as long as there are fewer spans than the bound
    ahead = Window.partitionBy("chunk_id").orderBy("k").rowsBetween(0, WINDOW_LINES - 1)
    windows = kth.withColumns({"end": F.max("end").over(ahead), "held": F.count("*").over(ahead)}).where((F.col("held") > 1) & (F.col("k") % WINDOW_STEP == 0))
    new = windows.where(fits).select("chunk_id", "start", "end", turn(2)).join(once.select("chunk_id", "start", "end"), ["chunk_id", "start", "end"], "left_anti")
    n = once.groupBy("chunk_id").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("chunk_id").orderBy("turn"))
    new = new.join(n, "chunk_id", "left").withColumn("nth", nth).where(F.coalesce("n", F.lit(0)) + F.col("nth") <= UNTIL_WINDOW).select("chunk_id", "start", "end", "turn")
    found = once.unionByName(new)
    # a text without any is a span itself, if its length allows
    whole = _pieces(texts.join(found.select("chunk_id").distinct(), "chunk_id", "left_anti"), ["chunk_id"], "content", r"\z").where((F.col("number") == 0) & fits)
    return found.unionByName(whole.select("chunk_id", "start", "end", F.struct(F.lit(3).alias("kind"), F.lit(0).cast("long").alias("of"), F.lit(0).alias("size"), "start").alias("turn")))


def nearest_spans(pairs: DataFrame, limit: int, embedder: Embedder = Histogram()) -> DataFrame:
    """(qid, chunk_id, spans): for each pair (qid, chunk_id, query, content) its best spans that don't overlap, in the order of the text; no row where there are none."""
    asked = pairs.select("qid", T.strip(F.col("query")).alias("text")).where("text <> ''").dropDuplicates(["qid"])
    asked = E.embedded(asked, "qid", embedder).withColumnRenamed("embedding", "q")
    texts = stored(pairs.select("chunk_id", "content").where("content IS NOT NULL").dropDuplicates(["chunk_id"]))
    spans = candidates(texts).join(texts, "chunk_id").withColumn("text", F.expr("substring(content, start + 1, end - start)")).drop("content")
    spans = stored(spans.withColumn("hash", E.text_hash(F.col("text"))))
    vectors = E.embedded(spans.select("hash", "text").dropDuplicates(["hash"]), "hash", embedder)
    placed = stored(spans.drop("text").join(vectors, "hash").drop("hash"))
    both = pairs.select("qid", "chunk_id").distinct().join(asked, "qid").join(placed, "chunk_id")
    similarity = F.greatest(F.lit(0.0), F.aggregate(F.zip_with("q", "embedding", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    lost = F.least(F.lit(MOST_LOST), F.log1p((F.col("end") - F.col("start")) / LENGTH_UNIT) * LENGTH_WEIGHT)
    ranked = both.withColumn("similarity", similarity).where(F.col("similarity") >= LEAST_SIMILARITY)
    ranked = ranked.select("qid", "chunk_id", F.struct((lost - F.col("similarity")).alias("behind"), "turn", "start", "end", "similarity").alias("s"))
    best = ranked.groupBy("qid", "chunk_id").agg(F.array_sort(F.collect_list("s")).alias("ranked"))
    plain = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["similarity"].alias("similarity"))

    def taken(chosen: Column, s: Column) -> Column:
        free = ~F.exists(chosen, lambda c: (c["start"] < s["end"]) & (s["start"] < c["end"]))
        return F.when((F.size(chosen) < limit) & free, F.concat(chosen, F.array(plain(s)))).otherwise(chosen)

    return best.select("qid", "chunk_id", F.array_sort(F.aggregate("ranked", F.array().cast(SPANS), taken)).alias("spans"))


def word_places(pairs: DataFrame) -> DataFrame:
    """(qid, chunk_id, terms): places of the query's words in the text, whatever their case, the first `PLACES` by word and place, in the order of the text."""
    low = pairs.where("content IS NOT NULL").select("qid", "chunk_id", F.lower("content").alias("low"), F.posexplode(T.query_terms(F.col("query"))).alias("word", "term"))
    cut = low.select("qid", "chunk_id", "word", F.length("term").alias("size"), F.posexplode(F.split("low", F.concat(F.lit(r"\Q"), "term", F.lit(r"\E")), -1)).alias("k", "piece"), F.length("low").alias("whole"))
    upto = F.sum(F.length("piece")).over(Window.partitionBy("qid", "chunk_id", "word").orderBy("k")) + F.col("k") * F.col("size")
    places = cut.withColumn("start", upto).where(F.col("start") + F.col("size") <= F.col("whole"))  # after the last piece there is none
    nth = F.row_number().over(Window.partitionBy("qid", "chunk_id").orderBy("word", "k"))
    place = F.struct(F.col("start").cast("int").alias("start"), (F.col("start") + F.col("size")).cast("int").alias("end"))
    return places.withColumn("nth", nth).where(F.col("nth") <= PLACES).groupBy("qid", "chunk_id").agg(F.array_sort(F.collect_list(place)).alias("terms"))


def highlights(pairs: DataFrame, limit: int = 3, embedder: Embedder = Histogram()) -> DataFrame:
    """(qid, chunk_id, spans, terms) of every pair (qid, chunk_id, query, content)."""
    pairs = stored(pairs.select("qid", "chunk_id", "query", "content"))
    rows = pairs.select("qid", "chunk_id").distinct().join(nearest_spans(pairs, limit, embedder), ["qid", "chunk_id"], "left").join(word_places(pairs), ["qid", "chunk_id"], "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return rows.select("qid", "chunk_id", none("spans", SPANS), none("terms", "array<struct<start:int,end:int>>"))

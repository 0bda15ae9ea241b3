"""Iterative retrieval (survey J10, J20, D7, D8, F9, H3): rounds of searches for all open questions at once.

A round is one search job over the queries that are due, then a fold of its results into each question's citations.
What a question holds is bounded (`TOTAL` citations, `ROUNDS` searches, `QUERIES` a round), so the fold of a question is small.
"""

from __future__ import annotations

import errno
import re
from collections.abc import Callable

from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.stored import stored

ROUNDS, QUERIES, QUERY_CHARS = 4, 3, 500
TOTAL, FIRST, FOLLOW_UP, PER_PATH = 12, 6, 3, 3
PLACE = "chunk_id string, path string, source_location string, start_line int, end_line int, score double"
CITED = f"qid long, number int, {PLACE}"
DISK = (errno.ENOSPC, errno.EDQUOT, errno.EIO, errno.EROFS)  # what a full or broken disk says
_NAMES = [c.split()[0] for c in PLACE.split(", ")]


def _alike(a: Column, b: Column) -> Column:
    """The same place, or two of one path that share half of the shorter one or more."""
    shared = F.least(a["end_line"], b["end_line"]) - F.greatest(a["start_line"], b["start_line"]) + 1
    shorter = F.greatest(F.lit(1), F.least(a["end_line"] - a["start_line"], b["end_line"] - b["start_line"]) + 1)
    return (a["path"] == b["path"]) & (((a["chunk_id"] == b["chunk_id"]) & (a["source_location"] == b["source_location"])) | ((shared > 0) & (2 * shared >= shorter)))


def cited(held: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """CITED: the citations held (CITED) and what each search of (qid, search, rank, PLACE) adds to them, at most `most` a search: no place twice, none that is alike, few of one path. A fold over each question's results in their order, which a search's limit bounds."""
    place = lambda search: F.struct(*_NAMES, search.cast("int").alias("search"))
    ordered = lambda rows, *by: F.transform(F.array_sort(F.collect_list(F.struct(*by, rows.alias("p")))), lambda x: x["p"])
    old = held.groupBy("qid").agg(ordered(place(F.lit(-1)), "number").alias("old"))
    new = found.groupBy("qid").agg(ordered(place(F.col("search")), "search", "rank").alias("new"))
    none = F.array().cast(f"array<struct<{PLACE.replace(' ', ':').replace(',:', ',')},search:int>>")

    def step(kept: Column, r: Column) -> Column:
        of_path = F.size(F.filter(kept, lambda x: x["path"] == r["path"]))
        of_search = F.size(F.filter(kept, lambda x: x["search"] == r["search"]))
        free = (F.size(kept) < TOTAL) & (of_search < most) & (of_path < PER_PATH) & ~F.exists(kept, lambda x: _alike(x, r))
        return F.when(free, F.concat(kept, F.array(r))).otherwise(kept)

    both = old.join(new, "qid", "full_outer").select("qid", F.coalesce("old", none).alias("old"), F.coalesce("new", none).alias("new"))
    kept = both.select("qid", F.posexplode(F.aggregate("new", F.col("old"), step)).alias("k", "p"))
    return kept.select("qid", (F.col("k") + 1).alias("number"), *[f"p.{c}" for c in _NAMES])


def tried(query) -> F.Column:
    """What makes two queries the same: white space and case don't count."""
    return F.lower(F.regexp_replace(T.strip(query), r"\s+", " "))


def planned(decisions: DataFrame, attempts: DataFrame) -> DataFrame:
    """(qid, search, query) of the decisions (qid, action, queries) to search: trimmed, new, at most `QUERIES` of a question."""
    each = decisions.where("action = 'SEARCH'").select("qid", F.posexplode("queries").alias("search", "query")).withColumn("query", F.substring(T.strip(F.col("query")), 1, QUERY_CHARS)).where("query <> ''")
    each = each.withColumn("key", tried(F.col("query")))
    once = each.withColumn("n", F.row_number().over(Window.partitionBy("qid", "key").orderBy("search"))).where("n = 1")
    few = once.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("search"))).where(F.col("n") <= QUERIES)
    return few.join(attempts.select("qid", "key"), ["qid", "key"], "left_anti").select("qid", "search", "query")


def _kinds(kind: type) -> set[str]:
    return {kind.__name__}.union(*map(_kinds, kind.__subclasses__()))


def unreachable(failure: Exception) -> bool:
    """Whether a planner's failure says that it can't be reached: an OSError of its own, or of a kind of OSError that the driver knows, raised when it is called or by its code in a task. A disk's errors are none, nor is any other failure of the job."""
    if isinstance(failure, OSError):
        return failure.errno not in DISK
    if not isinstance(failure, PythonException):
        return False
    # the worker's trace is a text: what was raised stands in the first line that isn't set in
    raised = re.search(r"^([\w.]+)(?:: (?:\[Errno (\d+)\])?|$)", str(failure).rpartition("Traceback (most recent call last):")[2], re.MULTILINE)
    return bool(raised) and raised[1].rpartition(".")[2] in _kinds(OSError) and int(raised[2] or 0) not in DISK


def collect(questions: DataFrame, search: Callable[[DataFrame], DataFrame], plan: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Citations (qid, number, ..., planner_unavailable) of the questions (qid, query).

    search: queries (qid, search, query) to results (qid, search, rank, chunk_id, path, source_location, start_line, end_line,
    score). plan: citations and attempts so far to decisions (qid, action, queries). Without it, or where it can't be reached, be
    it when it is called or in a task, the citations so far stand: that costs recall, not the answer. planner_unavailable tells
    the questions that wanted a decision and got none, so that what they have isn't taken for the whole. Any other failure, be it
    of the planner, of a job or of the disk, is raised.
    """
    spark = questions.sparkSession
    due = stored(questions.select("qid", F.lit(0).alias("search"), "query"))
    held, attempts = spark.createDataFrame([], CITED), spark.createDataFrame([], "qid long, key string, query string")
    lost = spark.createDataFrame([], "qid long")
    for k in range(ROUNDS):
        most = FIRST if k == 0 else FOLLOW_UP
        found = search(due).select("qid", "search", "rank", F.col("chunk_id").cast("string").alias("chunk_id"), "path", "source_location", "start_line", "end_line", "score")
        held = stored(cited(held, found, most))
        attempts = stored(attempts.unionByName(due.select("qid", tried(F.col("query")).alias("key"), "query")))
        if plan is None or k + 1 == ROUNDS:
            break
        full = held.groupBy("qid").count().where(F.col("count") >= TOTAL).select("qid")
        # only questions of the last round go on
        waiting = due.select("qid").distinct().join(full, "qid", "left_anti")
        try:
            decisions = stored(plan(held, attempts))  # made here, as a lazy frame would fail later
        except (OSError, PythonException) as failure:
            if not unreachable(failure):
                raise
            lost = lost.unionByName(waiting)
            break
        lost = lost.unionByName(waiting.join(decisions.where("action IN ('SEARCH', 'ANSWER')"), "qid", "left_anti"))
        due = stored(planned(decisions, attempts).join(waiting, "qid", "left_semi"))
        if due.isEmpty():
            break
    lost = lost.distinct().withColumn("planner_unavailable", F.lit(True))
    return held.join(lost, "qid", "left").select(*held.columns, F.coalesce("planner_unavailable", F.lit(False)).alias("planner_unavailable"))


def decision(reply) -> F.Column:
    """A planner's reply as struct(action, queries): the JSON between the first and the last brace; UNAVAILABLE if it is none."""
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    got = F.from_json(body, "action string, query string, queries array<string>")
    queries = F.filter(F.coalesce(got["queries"], F.array(got["query"])), lambda q: q.isNotNull() & (T.strip(q) != ""))
    action = F.upper(got["action"])
    ok = (action == "ANSWER") | ((action == "SEARCH") & (F.size(queries) > 0))
    return F.struct(F.when(ok, action).otherwise("UNAVAILABLE").alias("action"), F.when(action == "SEARCH", queries).otherwise(F.array().cast("array<string>")).alias("queries"))

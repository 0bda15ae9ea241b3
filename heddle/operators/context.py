"""Context selection (survey J9, D9-D11, G4, I15, I16, H2): diversity among a pool, and neighbours. Citations are in iterate."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.stored import small, stored

ANSWER_CHARS, PLANNER_CHARS = 24_000, 6_000  # of a prompt
RELEVANCE, SIMILARITY, SAME_DOCUMENT, SAME_PATH_FLOOR, PER_DOCUMENT = 0.78, 0.22, 0.08, 0.35, 2
EXPANDED = 2800
_TERM = re.compile(r"[^\W]{2,}")
PICKED = "qid long, pick int, chunk_id string, path string, score double"


def diverse(pool: pd.DataFrame, limit: int) -> list[int]:
    """Rows picked by marginal relevance, two of a document at most; ties keep the earlier row. The likeness of all rows of the pool is one product of their terms' incidence."""
    n = len(pool)
    rows = [(k, t) for k, c in enumerate(pool["content"]) for t in set(_TERM.findall((c or "").lower()))]
    at, term = np.array([k for k, _ in rows], np.int64), pd.factorize(pd.Series([t for _, t in rows], dtype=object))[0]
    held = np.zeros((n, int(term.max(initial=-1)) + 1))
    held[at, term] = 1
    shared, size = held @ held.T, held.sum(1)
    document = pd.factorize(pool["path"], use_na_sentinel=False)[0]
    same = document[:, None] == document
    like = np.maximum(shared / np.maximum(1, size[:, None] + size - shared), SAME_PATH_FLOOR * same)
    worth, taken, closest, picked = RELEVANCE * pool["score"].to_numpy(float), np.zeros(n, bool), np.zeros(n), []
    for _ in range(min(limit, n)):
        of_document = (same & taken).sum(1)
        value = np.where(taken | (of_document >= PER_DOCUMENT), -np.inf, worth - SIMILARITY * closest - SAME_DOCUMENT * (of_document > 0))
        best = int(value.argmax())
        if value[best] == -np.inf:
            break
        picked.append(best)
        taken[best], closest = True, np.maximum(closest, like[best])
    return picked


def select(candidates: DataFrame, limit: int) -> DataFrame:
    """(qid, pick, chunk_id, path, score) from the candidates (qid, rank, chunk_id, path, score, content). A query's pool is bounded by its search's limit."""

    def of_query(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values("rank").reset_index(drop=True)
        out = pool.loc[diverse(pool, limit), ["qid", "chunk_id", "path", "score"]]
        return out.assign(pick=range(1, len(out) + 1), chunk_id=out["chunk_id"].astype(str))[["qid", "pick", "chunk_id", "path", "score"]]

    return candidates.select("qid", "rank", "chunk_id", "path", "score", "content").groupBy("qid").applyInPandas(of_query, PICKED)


def section():
    """Chunks of one section share it: the path, and the location up to its last separator."""
    return F.concat_ws("\0", "path", F.regexp_extract("source_location", "^(.*) · ", 1))


def neighbours(chunks: DataFrame) -> DataFrame:
    """chunk_id, before, after of each chunk: the adjoining chunks' ids if they do not overlap and the texts together stay within `EXPANDED` characters. The texts aren't moved: their lengths tell."""
    chunks = chunks.select("chunk_id", section().alias("section"), "start_line", "end_line", F.length("content").alias("size"))
    over = Window.partitionBy("section").orderBy("start_line", "end_line", "chunk_id")
    size, room = F.col("size"), F.lit(EXPANDED - 2)
    before_ok = (F.lag("end_line").over(over) < F.col("start_line")) & (size + F.lag(size).over(over) <= room)
    rows = chunks.withColumns({"before": F.when(before_ok, F.lag("chunk_id").over(over)), "_size": size + F.when(before_ok, F.lag(size).over(over) + 2).otherwise(0)})
    after_ok = (F.lead("start_line").over(over) > F.col("end_line")) & (F.col("_size") + F.lead(size).over(over) <= room)
    return rows.withColumn("after", F.when(after_ok, F.lead("chunk_id").over(over))).select("chunk_id", "before", "after")


EXPANDED_ROW = "qid long, pick int, chunk_id string, path string, start_line int, end_line int, source_location string, content string, score double"


def _joined(picks: pd.DataFrame) -> pd.DataFrame:
    """Picks of a query in turn with the chunks before and after; a pick that an earlier one has taken in is left out."""
    taken, out = set(), []
    for r in picks.sort_values("pick").to_dict("records"):
        if r["chunk_id"] in taken:
            continue
        parts = [r[k] for k in ("prior", "own", "next") if isinstance(r[k], dict)]
        taken.update(p["chunk_id"] for p in parts)
        first, last = parts[0], parts[-1]
        place = first["source_location"] if first["source_location"] == last["source_location"] else f"{first['source_location']} — {last['source_location']}"
        name = r["chunk_id"] if len(parts) == 1 else f"{r['chunk_id']}:context"
        out.append((r["qid"], len(out) + 1, name, r["path"], first["start_line"], last["end_line"], place, "\n\n".join(p["content"] for p in parts)[:EXPANDED], r["score"]))
    return pd.DataFrame(out, columns=[c.split()[0] for c in EXPANDED_ROW.split(", ")])


def expanded(picks: DataFrame, chunks: DataFrame) -> DataFrame:
    """The picks (qid, pick, chunk_id, path, score) with their neighbouring chunks, as one passage each. A query has few picks."""
    named = stored(neighbours(chunks).join(small(stored(picks.select("chunk_id").distinct())), "chunk_id", "left_semi"))
    # only the chunks that are picked or next to one go on with their contents
    near = stored(named.select(F.explode(F.array("chunk_id", "before", "after")).alias("chunk_id")).where("chunk_id IS NOT NULL").distinct())
    body = F.struct("chunk_id", "start_line", "end_line", "source_location", "content")
    bodies = stored(chunks.join(small(near), "chunk_id", "left_semi").select("chunk_id", body.alias("body")))
    part = lambda key, name: bodies.select(F.col("chunk_id").alias(key), F.col("body").alias(name))
    rows = picks.join(named, "chunk_id").join(part("chunk_id", "own"), "chunk_id").join(part("before", "prior"), "before", "left").join(part("after", "next"), "after", "left")
    return rows.select("qid", "pick", "chunk_id", "path", "score", "prior", "own", "next").groupBy("qid").applyInPandas(_joined, EXPANDED_ROW)


def evidence(citations: DataFrame, planner: bool = False, used: int = 0) -> DataFrame:
    """(qid, number, block, chars) of the citations (qid, number, path, source_location, score, content) that fit a prompt: whole blocks in their order up to the first that would exceed the budget, of which `used` characters are spent. A block for an answer holds a cut passage, one for a planner a digest and the score."""
    head = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), "path", F.lit(" · "), "source_location")
    if planner:
        block = F.concat(head, F.lit(" (relevance "), F.format_string("%.2f", F.col("score").cast("double")), F.lit(")\n    "), T.digest_prompt(F.col("content")), F.lit("\n"))
    else:
        block = F.concat(head, F.lit("\n"), T.cut_passage(F.col("content")), F.lit("\n"))
    upto = Window.partitionBy("qid").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    rows = citations.select("qid", "number", block.alias("block")).withColumn("chars", F.sum(F.length("block")).over(upto) + used)
    return rows.where(F.col("chars") <= (PLANNER_CHARS if planner else ANSWER_CHARS))

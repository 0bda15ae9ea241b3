"""Sharding by Karmarkar-Karp differencing.

Documents with equal texts form a group that stays in one shard. Groups are dealt to parts by hash; in each
part the differencing method starts from a partial partition for each group and repeatedly combines the two
with the largest spread, the shards of one in the opposite order of the other's, until one is left. The parts'
partial partitions, one row for each part and shard, are combined in the same way in tasks, `FAN_IN` parts to one,
level by level until one is left: the driver holds none of them. Shard sizes in bytes come out nearly equal (law
`bytes`), whatever the sizes of the groups, unless one group alone is too large.

Nulls: a null text is an empty one; null doc_ids are sharded by their text like all others. Repeated rows all
get a slot. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B

SHARDS = 8
GROUPS_PER_PART = 50_000
FAN_IN = 4096


def differencing(states: list[tuple[tuple[int, ...], tuple]]) -> tuple[tuple[int, ...], tuple]:
    """Combine partial partitions, each (sizes of the shards in falling order, their contents), into one. Contents are nested pairs, None if empty."""
    heap = [(sizes[-1] - sizes[0], i, sizes, held) for i, (sizes, held) in enumerate(states)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, s, a = heapq.heappop(heap)
        _, _, t, b = heapq.heappop(heap)
        both = [(x + y, p if q is None else q if p is None else (p, q)) for x, y, p, q in zip(s, reversed(t), a, reversed(b))]
        both.sort(key=lambda z: -z[0])
        sizes, held = tuple(z[0] for z in both), tuple(z[1] for z in both)
        heapq.heappush(heap, (sizes[-1] - sizes[0], n, sizes, held))
        n += 1
    return heap[0][2:]


def _leaves(node):
    stack = [node] if node is not None else []
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack += x
        else:
            yield x


def _part(shards: int):
    def of_part(table: pa.Table) -> pa.Table:
        key, size = table["key"].to_numpy(), table["size"].to_numpy()
        order = np.lexsort((key, -size))  # the same outcome in whatever order the rows come
        rest = (0,) * (shards - 1), (None,) * (shards - 1)
        sizes, held = differencing([((int(size[i]), *rest[0]), (int(i), *rest[1])) for i in order.tolist()])
        place = np.zeros(len(key), np.int32)
        for k, node in enumerate(held):
            place[list(_leaves(node))] = k
        total = np.bincount(place, size, minlength=shards).astype(np.int64)
        return pa.table({"part": table["part"], "key": key, "place": place, "total": pa.array(total[place])})

    return of_part


def _combined(shards: int):
    """Of the parts of one group: the place in the combined partition of each part's places, and its total there."""

    def of_group(table: pa.Table) -> pa.Table:
        part, place, total = (table[c].to_numpy() for c in ("part", "place", "total"))
        parts, row = np.unique(part, return_inverse=True)
        sums = np.zeros((len(parts), shards), np.int64)
        sums[row, place] = total
        falling = np.argsort(-sums, axis=1, kind="stable")
        states = [(tuple(sums[k, o].tolist()), tuple((k * shards + o).tolist())) for k, o in enumerate(falling)]
        sizes, held = differencing(states)
        to = np.zeros(sums.size, np.int32)
        for k, node in enumerate(held):
            to[list(_leaves(node))] = k
        to = to[row * shards + place]
        return pa.table({"group": table["group"], "part": part, "place": place, "to": to, "total": np.array(sizes, np.int64)[to]})

    return of_group


def _shards_of(placed: DataFrame, parts: int, shards: int) -> DataFrame:
    """(part, place, shard) from (part, place, total): the parts combined `FAN_IN` at a time, level by level."""
    level = placed.groupBy("part", "place").agg(F.max("total").alias("total"))
    up = None
    while True:
        grouped = level.withColumn("group", F.expr(f"part div {FAN_IN}").cast("int"))
        made = B.saved(grouped.groupBy("group").applyInArrow(_combined(shards), "group int, part int, place int, to int, total long"))
        step = made.select("part", "place", F.col("group").alias("in"), "to")
        up = step if up is None else up.join(step.select(F.col("part").alias("in"), F.col("place").alias("to"), F.col("in").alias("next"), F.col("to").alias("then")), ["in", "to"]).select("part", "place", F.col("next").alias("in"), F.col("then").alias("to"))
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            return up.select("part", "place", F.col("to").alias("shard"))
        level = made.groupBy("group", "to").agg(F.max("total").alias("total")).select(F.col("group").alias("part"), F.col("to").alias("place"), "total")


def assigned(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard) of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"))
    rows = B.saved(rows)
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"))
    parts = max(1, -(-rows.count() // GROUPS_PER_PART))
    placed = B.saved(groups.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")).groupBy("part").applyInArrow(_part(shards), "part int, key long, place int, total long"))
    keyed = placed.join(_shards_of(placed, parts, shards), ["part", "place"]).select("key", "shard")
    return rows.join(keyed, "key").select("doc_id", "size", "text_crc32", "shard")


def slotted(rows: DataFrame) -> DataFrame:
    """Adds slot, gapless from 0 in each shard. A shard is numbered in pieces: no task holds a whole one."""
    pieces = B.partitions(rows.sparkSession)
    rows = B.saved(rows.withColumn("row", F.monotonically_increasing_id()))  # saved, so that retries agree; repeated rows go to many pieces
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("row"), F.lit(pieces)).cast("int"))
    counts = rows.groupBy("shard", "piece").count()
    before = counts.select("shard", "piece", (F.sum("count").over(Window.partitionBy("shard").orderBy("piece")) - F.col("count")).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("row"))
    return rows.withColumn("number", number).join(before, ["shard", "piece"]).withColumn("slot", F.col("before") + F.col("number") - 1).drop("row", "piece", "before", "number")


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    rows = slotted(assigned(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

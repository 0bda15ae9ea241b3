"""Repair of the structure of conversations by signature deduplication.

A row's role and fault make one letter, the letters of a conversation its signature. Each distinct signature is solved
once by memoised recursion; the cheapest edits are joined back to the conversations and replayed on their rows.

No conversation is gathered with its texts: rows are sorted over ranges of (conversation, turn, role, text), so a long
conversation lies in many tasks; the sorted rows make blocks of at most 4096 letters, the blocks of a conversation its
signature, which is a byte a row. Texts meet the edits again by row number.

Faults, the first that holds: blank (no character but spaces), duplicate (role and text stand in an earlier row),
truncated (the last character but spaces isn't one of `.!?`). Edits: keep a row (free; not if blank or duplicate), give
it the role user or assistant (1), delete it (2), insert an empty turn of the user or the assistant (5); a truncated row
that stays costs 5 more. The initials of the roles left must be `(s?(ua)+)?`. Of the cheapest edits, the audit, a letter
for each edit in order, is the least by ASCII.

Nulls: a null role or text is one space; null turns come first; rows of a null conv_id are a conversation. Rows of one
turn are ordered by role, then by the text's SHA-256, by which texts are also told apart; repeated rows are duplicates.
A role counts by its first character, so an empty or unknown one can't be kept. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B

ROLES = "sua"  # initials; any other is one kind
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLOCK_BITS = 12  # of letters in a block
SPACES = r"[\x20\x09-\x0D]"
SOLVED = "signature string, cost long, audit string, plan array<string>, blank long, duplicate long, truncated long, illegal long"

# states of what has been put out: nothing, a system turn, a user's turn last, an assistant's turn last
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (START, ASSISTANT)
NEXT = {(START, "s"): SYSTEM} | {(state, "u"): USER for state in (START, SYSTEM, ASSISTANT)} | {(USER, "a"): ASSISTANT}
DUE = ("u", "u", "a", "u")  # the only turn that can be made in each state


def solved(signature: str) -> tuple[int, str, list[str]]:
    """Cost, audit and plan of a signature. The plan has a string for each row: its edit (K, D, or the new role's initial), with U or A before it for each turn inserted there, after it for those at the end."""
    n = len(signature)
    rows = [(("s", "u", "a", "")[x >> 2], x & 3) for x in (ord(c) - ord("a") for c in signature)]
    least: list = [None] * (n + 1)

    def options(k: int, state: int):
        """(letter of the audit, of the plan, cost, next row, next state), in the order of the audit's letters."""
        if k < n:
            role, fault = rows[k]
            stays = TRUNCATED if fault == 3 else 0
            yield "D", "D", DELETE, k + 1, state
        yield "I", DUE[state].upper(), INSERT, k, NEXT[state, DUE[state]]
        if k < n and fault not in (1, 2):
            if (state, role) in NEXT:
                yield "K", "K", stays, k + 1, NEXT[state, role]
            yield "R", DUE[state], RENAME + stays, k + 1, NEXT[state, DUE[state]]

    def rest(k: int) -> list[float]:
        """Least cost of the rows from k on, for each state before them."""
        if least[k] is None:
            cost = [0.0 if k == n and state in ACCEPTED else float("inf") for state in range(4)]
            after = rest(k + 1) if k < n else None
            for state in range(4):
                for _, _, price, then, to in options(k, state):
                    if then > k:
                        cost[state] = min(cost[state], price + after[to])
            for _ in range(3):  # insertions lead from state to state
                for state in range(4):
                    cost[state] = min(cost[state], INSERT + cost[NEXT[state, DUE[state]]])
            least[k] = cost
        return least[k]

    for k in range(n, -1, -1):  # from the end, so that the recursion stays shallow
        rest(k)
    audit, plan, k, state = [], [""] * n, 0, START
    while k < n or state not in ACCEPTED:
        letter, own, _, then, to = next(o for o in options(k, state) if o[2] + least[o[3]][o[4]] == least[k][state])
        audit.append(letter)
        plan[min(k, n - 1)] += own
        k, state = then, to
    return int(least[0][START]), "".join(audit), plan


def _solve(batches):
    for batch in batches:
        out = []
        for s in batch.column("signature").to_pylist():
            roles = ["sua?"[(ord(c) - ord("a")) >> 2] for c in s]
            faults = [(ord(c) - ord("a")) & 3 for c in s]
            out.append((s, *solved(s), *(faults.count(k) for k in (1, 2, 3)), sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))))
        names = [c.split()[0] for c in SOLVED.split(", ")]
        kinds = (pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], schema=pa.schema(list(zip(names, kinds))))


def _turn_order(*more):
    return F.struct(F.col("turn").isNotNull().alias("known"), "turn", *more)


def _lettered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, row, letter of saved rows (row is their number): a duplicate is a row that isn't the first of its role and text."""
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min(_turn_order("row")).alias("first"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("conv_id", "role", "digest")]
    both = rows.select("conv_id", "turn", "role", "digest", "row", "blank", "truncated").alias("r").join(first.alias("f"), same)
    order = F.struct(F.col("r.turn").isNotNull().alias("known"), F.col("r.turn").alias("turn"), "row")
    fault = F.when(F.col("blank"), 1).when(order != F.col("first"), 2).when(F.col("truncated"), 3).otherwise(0)
    initial, role = F.substring("r.role", 1, 1), F.lit(len(ROLES))
    for k, letter in enumerate(ROLES):
        role = F.when(initial == letter, k).otherwise(role)
    return both.select("r.conv_id", "r.turn", "r.role", "r.digest", "row", F.char(F.lit(ord("a")) + role * 4 + fault).alias("letter"))


def _blocks(lettered: DataFrame) -> DataFrame:
    """(conv_id, block, letters, rows) of the rows in order, at most 4096 in each; saved. A block lies in one range of the order."""
    by = ("conv_id", "turn", "role", "digest", "row")
    spark = lettered.sparkSession
    ordered = lettered.repartitionByRange(B.partitions(spark), *by).sortWithinPartitions(*by)
    ordered = B.saved(ordered.select("conv_id", "row", "letter", F.monotonically_increasing_id().alias("number")))
    held = ordered.groupBy("conv_id", F.shiftright("number", BLOCK_BITS).alias("block")).agg(F.array_sort(F.collect_list(F.struct("number", "letter", "row"))).alias("held"))
    return B.saved(held.select("conv_id", "block", F.array_join("held.letter", "").alias("letters"), F.col("held.row").alias("rows")))


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audits (conv_id, gaps, cost, audit, blank, duplicate, truncated, illegal), one for each conversation with rows, and the repaired rows (conv_id, block, place, turn, roles, texts): what stands for a row, in order of block and place; of a row that's deleted nothing."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    ends = F.regexp_extract(text, rf"([^\x20\x09-\x0D]){SPACES}*\z", 1)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"digest": F.unhex(F.sha2("text", 256)), "last": ends, "row": F.monotonically_increasing_id()})
    rows = B.saved(rows.withColumns({"blank": F.col("last") == "", "truncated": ~F.col("last").isin(".", "!", "?")}).drop("last"))
    blocks = _blocks(_lettered(rows))
    before = F.sum(F.size("rows")).over(Window.partitionBy("conv_id").orderBy("block")) - F.size("rows")
    parts = F.array_sort(F.collect_list(F.struct("block", "letters", "before", F.size("rows").alias("size"))))
    signatures = blocks.withColumn("before", before).groupBy("conv_id").agg(parts.alias("parts"))
    signatures = B.saved(signatures.select("conv_id", F.array_join("parts.letters", "").alias("signature"), F.transform("parts", lambda p: p.dropFields("letters")).alias("parts")))
    answers = B.saved(signatures.select("signature").distinct().mapInArrow(_solve, SOLVED))
    known = B.saved(signatures.join(answers, "signature").drop("signature"))

    wide = lambda c: c.cast("decimal(20,0)")
    gaps = F.least(wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.countDistinct("turn"), wide(F.lit(2**63 - 1)))
    turns = rows.groupBy("conv_id").agg(F.when(F.max("turn").isNull(), 0).otherwise(gaps).cast("long").alias("gaps"))
    audits = known.drop("plan", "parts").alias("k").join(turns.alias("t"), F.col("k.conv_id").eqNullSafe(F.col("t.conv_id"))).drop(F.col("t.conv_id"))

    # the plan, cut into the blocks' parts, beside the blocks' rows
    cut = known.select("conv_id", F.explode(F.transform("parts", lambda p: F.struct(p["block"].alias("block"), F.slice("plan", p["before"] + 1, p["size"]).alias("plan")))).alias("p"))
    both = blocks.alias("b").join(cut.alias("k"), (F.col("b.block") == F.col("k.p.block")) & F.col("b.conv_id").eqNullSafe(F.col("k.conv_id")))
    cut = both.select("b.conv_id", "b.block", F.explode(F.arrays_zip("rows", F.col("p.plan").alias("plan"), F.sequence(F.lit(1), F.size("rows")).alias("place"))).alias("x"))
    edits = cut.select("conv_id", "block", "x.place", F.col("x.rows").alias("row"), F.col("x.plan").alias("edits")).where("edits <> 'D'")
    letters = F.filter(F.split("edits", ""), lambda c: (c != "") & (c != "D"))
    kept = edits.join(rows.select("row", "turn", "role", "text"), "row")
    new = lambda c: F.when(F.lower(c) == "u", "user").otherwise("assistant")
    repaired = kept.select(
        "conv_id", "block", "place", "turn",
        F.transform(letters, lambda c: F.when(c == "K", F.col("role")).otherwise(new(c))).alias("roles"),
        F.transform(letters, lambda c: F.when(c.isin("U", "A"), "").otherwise(F.col("text"))).alias("texts"),
    )
    return audits, repaired


def _digest(batches):
    """conv_id and the SHA-256 of its lines joined by newlines, from rows sorted by conversation: no more than a batch is held."""
    at, digest, schema = None, None, pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    for batch in batches:
        out = []
        for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist()):
            if digest is None or conv != at:
                if digest is not None:
                    out.append((at, digest.hexdigest()))
                at, digest = conv, hashlib.sha256(line.encode())
            else:
                digest.update(b"\n" + line.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind.type) for k, kind in enumerate(schema)], schema=schema)
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at]).cast(pa.int64()), pa.array([digest.hexdigest()])], schema=schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) as a fault injector leaves them: of 20 rows, by their number's crc32, one is dropped, one emptied, one loses its `.!?`, one is repeated and one becomes the user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).alias("kind"))
    rows = rows.where("kind <> 0").withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    audits, repaired = repair(damaged(conversations))
    lines = F.array_join(F.zip_with("roles", "texts", lambda role, text: F.concat(role, F.lit(":"), text)), "\n")
    sorted_lines = repaired.select("conv_id", "block", "place", lines.alias("lines")).repartition(B.partitions(spark), "conv_id").sortWithinPartitions("conv_id", "block", "place")
    digests = sorted_lines.select("conv_id", "lines").mapInArrow(_digest, "conv_id long, repaired_sha256 string")
    found = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().alias("c")
    for name, table in (("a", audits), ("d", digests)):
        found = found.join(table.alias(name), F.col("c.conv_id").eqNullSafe(F.col(f"{name}.conv_id")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return found.select("c.conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))

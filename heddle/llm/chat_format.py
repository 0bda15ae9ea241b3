"""Conversations as training strings, by relational formatting in Spark's expressions alone.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role are merged into one block by
array aggregation, with a separator between their texts; the blocks are concatenated:

    <|im_start|>role\\ntext<|im_sep|>text of the same role<|im_end|>\\n

Inside roles and texts each `<`, any backslashes and `|` get one backslash more, so that no `<|` stands there, and one
less when read back. In a role a backslash is doubled first and a newline written as backslash and n, so its line ends
where the role does. Beside the string each conversation has its segments in order, which make it up, with the loss mask:
true for an assistant's text (role `assistant`), false for all else.

Nulls: a null text or role is empty; null turns come first; rows of a null conv_id are a conversation. Rows of one turn
are ordered by role, then text; repeated rows are turns of their own. A conversation has a row at least, so an empty
table gives no rows. Extra columns are ignored. A conversation is one training string, so its turns meet in one row, as
the method says; conversations are dealt by conv_id, whatever their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# template
OPEN, SEPARATOR, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LEARNT = "assistant"
PROBE = "<|im_end|><|im_start|>assistant ok"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    parts = F.transform(F.split(unescaped(role), r"\\\\", -1), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, segments array<struct<piece, loss>>, formatted string) of each conversation."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # the places where a block begins, and the one after the end
    begins = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda k: (k == 0) | (F.get("turns", k)["role"] != F.get("turns", k - 1)["role"]))
    turns = turns.withColumn("begins", F.concat(begins, F.array(F.size("turns"))))
    blocks = F.transform(
        F.sequence(F.lit(0), F.size("begins") - 2),
        lambda b: F.struct(F.get("turns", F.get("begins", b))["role"].alias("role"), F.transform(F.slice("turns", F.get("begins", b) + 1, F.get("begins", b + 1) - F.get("begins", b)), lambda t: escaped(t["text"])).alias("texts")),
    )
    turns = turns.select("conv_id", blocks.alias("blocks"))
    segment = lambda piece, loss: F.struct(piece.alias("piece"), loss.alias("loss"))
    fixed = lambda piece: segment(piece, F.lit(False))

    def written(b: Column) -> Column:
        """The segments of a block: its head, then each text with what stands before it, and its end."""
        texts = F.transform(b["texts"], lambda t, k: F.array(fixed(F.when(k == 0, F.lit("")).otherwise(F.lit(SEPARATOR))), segment(t, b["role"] == LEARNT)))
        return F.concat(F.array(fixed(F.concat(F.lit(OPEN), escaped_role(b["role"]), F.lit("\n")))), F.filter(F.flatten(texts), lambda s: (s["piece"] != "") | s["loss"]), F.array(fixed(F.lit(CLOSE))))

    made = turns.select("conv_id", F.flatten(F.transform("blocks", written)).alias("segments"))
    return made.select("conv_id", "segments", F.array_join("segments.piece", "").alias("formatted"))


def turns_of(formatted: Column) -> Column:
    """The turns (role, text), array of structs, that a formatted string says."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda b: b != "")

    def read(b: Column) -> Column:
        role = unescaped_role(F.substring_index(b, "\n", 1))
        body = F.substring(b, F.locate("\n", b) + 1, F.length(b))
        texts = F.split(F.substring(body, F.lit(1), F.length(body) - len(CLOSE)), r"<\|im_sep\|>", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, read))


def learnt(segments: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["piece"])), "")


def op13_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, read back from what was written."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNT).alias("role"), F.lit(PROBE).alias("text"))
    read = formatted(rows.unionByName(probe)).select("conv_id", turns_of(F.col("formatted")).alias("turns"), learnt(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")

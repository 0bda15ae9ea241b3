"""The freshness machine: event by event, over a table, and as a stream."""

import datetime as dt

import pytest

from heddle.streaming import freshness as W

T0 = dt.datetime(2026, 1, 1)


def table(spark, rows):
    """rows: (kb, epoch, milliseconds, kind, hash, base)"""
    return spark.createDataFrame([(kb, e, k, T0 + dt.timedelta(milliseconds=ms), kind, h, b) for k, (kb, e, ms, kind, h, b) in enumerate(rows)], W.EVENTS)


CASES = [
    ([("start", "h", None), ("reconciled", "h", 0)], "VERIFIED"),
    ([("start", "h", None), ("reconciled", "other", 0)], "CHANGED"),
    # a certain change stays, even if the hash is the old one again
    ([("start", "h", None), ("modify", None, None), ("reconciled", "h", 1)], "CHANGED"),
    # a folder alone is only checked
    ([("start", "h", None), ("touched", None, None), ("reconciled", "h", 1)], "VERIFIED"),
    # a check that was overtaken doesn't count
    ([("start", "h", None), ("touched", None, None), ("reconciled", "h", 0)], "VERIFYING"),
    ([("start", "h", None), ("overflow", None, None)], "VERIFYING"),
    ([("start", "h", None), ("unreadable", None, None)], "UNAVAILABLE"),
    ([("start", "h", None), ("reconciled", "h", 0), ("stop", None, None), ("modify", None, None)], "STOPPED"),
    ([("modify", None, None)], None),
]


@pytest.mark.parametrize("events,want", CASES)
def test_steps(events, want):
    state = W.NEW
    for kind, found, base in events:
        got = W.step(state, 1, kind, found, base, 0)
        state = got[0] if got else state
    assert state[4] == (want or "STOPPED")


def test_late_epochs_and_pauses(spark):
    events = table(spark, [("a", 2, 0, "start", "h", None), ("a", 1, 5, "modify", None, None), ("a", 2, 10, "touched", None, None), ("a", 2, 100, "touched", None, None), ("a", 2, 600, "touched", None, None), ("b", 1, 0, "start", "g", None), ("b", 1, 1, "overflow", None, None)])
    got = sorted((r["kb"], r["seq"], r["reason"], r["check"]) for r in W.replayed(events).collect())
    assert got == [("a", 0, "started", True), ("a", 2, "event", False), ("a", 3, "event", False), ("a", 4, "check due", True), ("a", 4, "event", False), ("b", 5, "started", True), ("b", 6, "overflow", True)]


def test_stream_equals_table(spark, tmp_path):
    rows = [("a", 1, 0, "start", "h", None), ("a", 1, 50, "reconciled", "h", 0), ("b", 1, 60, "start", "g", None), ("a", 1, 90, "modify", None, None), ("b", 1, 95, "reconciled", "x", 0), ("a", 1, 99, "reconciled", "h", 1)]
    events = table(spark, rows)
    for k, part in enumerate((events.where("seq < 3"), events.where("seq >= 3"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"batch={k}"))
    stream = W.watched(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("fresh").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    last = lambda df: {r["kb"]: r["state"] for r in df.where("seq IS NOT NULL").orderBy("seq").collect()}
    assert last(spark.table("fresh")) == last(W.replayed(events)) == {"a": "CHANGED", "b": "CHANGED"}


def test_changes_between_listings(spark):
    before = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], "path string, size long, modified_at long")
    now = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("d", 1, 1)], "path string, size long, modified_at long")
    assert {(r["path"], r["kind"]) for r in W.changes(before, now, 1).collect()} == {("b", "modify"), ("c", "delete"), ("d", "create")}

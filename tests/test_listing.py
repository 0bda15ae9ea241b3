"""Files written, changed and removed while a stream runs; a batch run again; what the freshness makes of it."""

import json
import os
import time

from pyspark.sql import functions as F

from heddle.streaming import freshness, listing


def test_changes_during_a_stream(spark, tmp_path):
    root, state = tmp_path / "src", tmp_path / "state"
    (root / "old").mkdir(parents=True)
    (root / "keep.txt").write_text("kept")
    (root / "old" / "gone.txt").write_text("soon gone")
    (root / "node_modules").mkdir()
    spark.dataSource.register(listing.Changes)
    stream = spark.readStream.format("listing_changes").options(kb="k", epoch="4", roots=json.dumps([str(root)]), state=str(state)).load()
    query = stream.writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="200 milliseconds").start()
    try:
        seen = lambda: [(r["kind"], os.path.relpath(r["path"], root)) for r in spark.table("changes").orderBy("ts", "seq").collect()]

        def wait(what):
            until = time.time() + 60
            while what not in seen() and time.time() < until:
                time.sleep(0.2)
            assert what in seen(), (what, seen())

        until = time.time() + 60
        while (query.lastProgress is None) and time.time() < until:
            time.sleep(0.2)
        assert seen() == []
        (root / "late" / "deep").mkdir(parents=True)
        (root / "late" / "deep" / "new.txt").write_text("new")
        (root / "node_modules" / "ignored.js").write_text("x")
        wait(("create", "late/deep/new.txt"))
        (root / "late" / "deep" / "new.txt").write_text("changed")
        wait(("modify", "late/deep/new.txt"))
        (root / "old" / "gone.txt").unlink()
        wait(("delete", "old/gone.txt"))
        files = [x for x in seen() if x[0] != "touched"]
        assert files == [("create", "late/deep/new.txt"), ("modify", "late/deep/new.txt"), ("delete", "old/gone.txt")]
        assert ("touched", "late") in seen() and not any("node_modules" in p or "keep" in p for _, p in seen())
    finally:
        query.stop()
    start = spark.createDataFrame([("k", 4, 0, "start", "h"), ("k", 4, 1, "reconciled", "h")], "kb string, epoch long, seq long, kind string, hash string")
    start = start.select("kb", "epoch", "seq", F.to_timestamp(F.lit("2020-01-01")).alias("ts"), "kind", "hash", F.lit(None).cast("long").alias("base"))
    states = [r["state"] for r in freshness.replayed(start.unionByName(spark.table("changes").drop("path"))).orderBy("generation").collect()]
    assert states[:2] == ["VERIFYING", "VERIFIED"] and states[-1] == "CHANGED"


def test_a_batch_run_again_gives_the_same_rows(tmp_path):
    root, state = tmp_path / "src", tmp_path / "state"
    root.mkdir()
    reader = listing.Reader({"kb": "k", "roots": json.dumps([str(root)]), "state": str(state)})
    rows = lambda a, b: [r[2:] for p in reader.partitions({"ms": a}, {"ms": b}) for r in reader.read(p)]
    assert rows(0, 10) == []
    (root / "a.txt").write_text("a")
    first = rows(10, 20)
    (root / "a.txt").unlink()
    assert rows(10, 20) == first and [r[2] for r in first] == ["create"]
    assert [r[2] for r in rows(20, 30)] == ["delete"]
    os.rmdir(root)
    assert [r[2] for r in rows(30, 40)] == ["unreadable"]
    reader.commit({"ms": 40 + listing.KEPT_MS})
    assert not [f for d in state.iterdir() if d.is_dir() for f in d.iterdir() if f.name in ("10.json", "20.json", "30.json")]

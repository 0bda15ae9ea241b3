"""Sessions of conversations: over a table beside a plain fold, and as a stream beside the table."""

import datetime as dt
import random

import pytest

from heddle.operators import conversation as V
from heddle.streaming import sessions as S

T0 = dt.datetime(2026, 1, 1)


def table(spark, rows):
    """rows: (kb, seconds, revision, kind, request, text)"""
    return spark.createDataFrame([(kb, k, None if s is None else T0 + dt.timedelta(seconds=s), r, kind, req, t) for k, (kb, s, r, kind, req, t) in enumerate(rows)], S.EVENTS)


def folded(rows, ttl=S.TTL, most=V.MESSAGES):
    """Plainly, event by event."""
    out, held = [], {}
    order = sorted((s, k, kb, r, kind, req, t) for k, (kb, s, r, kind, req, t) in enumerate(rows) if s is not None and kind in S.KINDS)
    for s, k, kb, r, kind, req, t in order:
        kb, req, t = (kb or "").strip(), req or "", t or ""
        h = held.setdefault(kb, {"session": 0, "revision": "none yet", "said": [], "open": {}, "asks": 0, "last": s})
        if s - h["last"] > ttl or kind == "clear" or (kind == "ask" and r != h["revision"]):
            h |= {"session": h["session"] + 1, "said": [], "open": {}, "asks": 0}
        h["last"], history = s, None
        if kind == "ask":
            outcome, history = "continued" if h["asks"] else "opened", h["said"][-most:]
            h["revision"], h["asks"] = r, h["asks"] + 1
            h["open"][req] = t
        elif kind == "answer":
            outcome = "committed" if req in h["open"] else "discarded"
            if req in h["open"]:
                h["said"] = [*h["said"], ("user", h["open"].pop(req)), ("assistant", t)]
        elif kind == "fail":
            outcome = "failed"
            h["open"].pop(req, None)
        else:
            outcome = "cleared"
        out.append((kb, k, h["session"], outcome, history))
    return sorted(out)


def plain(frame):
    return sorted((r["kb"], r["seq"], r["session"], r["outcome"], None if r["history"] is None else [(m["role"], m["text"]) for m in r["history"]]) for r in frame.collect())


CASES = {
    "committed on success only": [("a", 0, 1, "ask", "q1", "one"), ("a", 1, 1, "fail", "q1", None), ("a", 2, 1, "ask", "q2", "two"), ("a", 3, 1, "answer", "q2", "yes"), ("a", 4, 1, "ask", "q3", "three")],
    "another revision replaces": [("a", 0, 1, "ask", "q1", "one"), ("a", 1, 1, "answer", "q1", "yes"), ("a", 2, 2, "ask", "q2", "two"), ("a", 3, 1, "ask", "q3", "three")],
    "a reply to a replaced session": [("a", 0, 1, "ask", "q1", "one"), ("a", 1, 2, "ask", "q2", "two"), ("a", 2, 1, "answer", "q1", "late"), ("a", 3, 2, "answer", "q2", "yes"), ("a", 4, 2, "ask", "q3", "three")],
    "cleared while asked": [("a", 0, 1, "ask", "q1", "one"), ("a", 1, 1, "clear", None, None), ("a", 2, 1, "answer", "q1", "late"), ("a", 3, 1, "ask", "q2", "two")],
    "expired": [("a", 0, 1, "ask", "q1", "one"), ("a", 1, 1, "answer", "q1", "yes"), ("a", 1801, 1, "ask", "q2", "two"), ("a", 3602, 1, "ask", "q3", "three")],
    "answered twice, asked again": [("a", 0, 1, "ask", "q1", "one"), ("a", 1, 1, "answer", "q1", "yes"), ("a", 2, 1, "answer", "q1", "again"), ("a", 3, 1, "ask", "q1", "more"), ("a", 4, 1, "answer", "q1", "sure"), ("a", 5, 1, "ask", "q2", "end")],
    "nulls and other kinds": [(None, 0, None, "ask", None, None), ("", 1, None, "answer", None, None), (" ", 2, None, "ask", "x", "y"), ("a", None, 1, "ask", "q", "no time"), ("a", 3, 1, "other", "q", "t"), ("a", 4, 1, "answer", "q", "unasked")],
}


def drawn(seed, n=120):
    r, t, rows = random.Random(seed), 0, []
    for _ in range(n):
        t += r.choice([1, 5, 60, 900, 2000])
        rows.append((r.choice("aaab"), t, r.choice([1, 1, 1, 1, 2]), r.choice(["ask", "ask", "answer", "answer", "answer", "fail", "clear"] if r.random() < 0.3 else ["ask", "answer"]), r.choice(["x", "y", "z"]), f"t{r.randrange(9)}"))
    return rows


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    assert plain(S.replayed(table(spark, CASES[name]))) == folded(CASES[name])


@pytest.mark.parametrize("seed", range(3))
def test_drawn_events(spark, seed):
    rows = drawn(seed)
    got = folded(rows)
    assert plain(S.replayed(table(spark, rows))) == got
    assert {"opened", "continued", "committed", "discarded", "failed", "cleared"} == {r[3] for r in got}


def test_history_is_the_last_messages_that_fit(spark):
    rows = [x for k in range(9) for x in (("a", 2 * k, 1, "ask", f"q{k}", f"question {k}"), ("a", 2 * k + 1, 1, "answer", f"q{k}", f"reply {k}" + " long" * (900 if k == 5 else 0)))] + [("a", 50, 1, "ask", "end", "end")]
    found = S.replayed(table(spark, rows))
    last = {r["seq"]: r["history"] for r in found.collect()}[18]
    assert [" ".join(m["text"].split()[:2]) for m in last] == [f"{w} {k}" for k in range(3, 9) for w in ("question", "reply")]
    told = [r["text"] for r in S.told(found).where("seq = 18").orderBy("turn").collect()]
    assert told == [f"{w} {k}" for k in range(6, 9) for w in ("question", "reply")]
    assert S.replayed(table(spark, rows).limit(0)).isEmpty()


def test_stream_equals_table(spark, tmp_path):
    rows = drawn(7, 60)
    events = table(spark, rows)
    for k in range(3):
        events.where(f"seq >= {20 * k} AND seq < {20 * k + 20}").coalesce(1).write.parquet(str(tmp_path / "in" / f"batch={k}"))
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = S.live(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")))
        run = stream.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination(180)
    finally:
        spark.conf.set(name, before)
    assert run.exception() is None
    assert plain(spark.table("sessions")) == plain(S.replayed(events)) == folded(rows)

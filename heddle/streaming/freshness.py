"""Freshness of sources as a stream (survey L1-L8): change events folded into the state of each knowledge base.

Events (kb, epoch, seq, ts, kind, hash) come from a listing or a watcher: start (hash: the expected one), create,
modify, delete (certain changes), touched (a folder only), overflow, reconciled (hash: what a full check found; base:
the generation it started from), unreadable, stop. An uncertain event asks for a check after a pause without events; an
overflow asks at once. A check that was overtaken by an event is discarded and asked for again. A certain change, or a
check that finds another hash, stays until the next start, even if the sources are put back. Events of an older epoch
are late and dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "kb string, epoch long, seq long, ts timestamp, kind string, hash string, base long"
STATE = "epoch long, generation long, expected string, invalidated boolean, state string, due_ms long"
OUT = "kb string, epoch long, seq long, generation long, state string, reason string, check boolean"
CERTAIN, PAUSE_MS = ("create", "modify", "delete"), 250
NEW = (-1, 0, "", False, "STOPPED", 0)


def step(state: tuple, epoch: int, kind: str, found: str | None, base: int | None, now_ms: int) -> tuple[tuple, str, bool] | None:
    """The next state, the reason and whether a check is due at once; None for a late event."""
    old, generation, expected, invalidated, name, due = state
    if epoch < old or (kind != "start" and (epoch > old or name == "STOPPED")):
        return None
    if kind == "start":
        return (epoch, 0, found or "", False, "VERIFYING", 0), "started", True
    if kind == "stop":
        return (epoch, generation, expected, invalidated, "STOPPED", 0), "stopped", False
    if kind == "unreadable":
        return (epoch, generation, expected, invalidated, "UNAVAILABLE", 0), "sources can't be read", False
    if kind == "reconciled":
        if base is not None and base != generation:
            return (epoch, generation + 1, expected, invalidated, "VERIFYING", now_ms + PAUSE_MS), "changed during the check", False
        invalidated = invalidated or found != expected
        return (epoch, generation, expected, invalidated, "CHANGED" if invalidated else "VERIFIED", 0), "changed" if invalidated else "verified", False
    certain, at_once = kind in CERTAIN, kind == "overflow"
    return (epoch, generation + 1, expected, invalidated or certain, "CHANGED" if certain else "VERIFYING", 0 if at_once else now_ms + PAUSE_MS), "overflow" if at_once else "event", at_once


def _rows(kb: str, state: tuple, events: pd.DataFrame) -> tuple[tuple, list[tuple]]:
    out = []
    for e in events.sort_values(["ts", "seq"]).itertuples():
        now = int(e.ts.timestamp() * 1000)
        if state[5] and now >= state[5]:  # the pause was long enough: the check was due before this event
            out.append((kb, state[0], int(e.seq), state[1], state[4], "check due", True))
            state = (*state[:5], 0)
        base = None if pd.isna(e.base) else int(e.base)
        got = step(state, int(e.epoch), e.kind, e.hash, base, now)
        if got:
            state, reason, check = got
            out.append((kb, state[0], int(e.seq), state[1], state[4], reason, check))
    return state, out


def _update(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    state, out = held.get if held.exists else NEW, []
    if held.hasTimedOut:
        if state[5]:
            out.append((key[0], state[0], None, state[1], state[4], "check due", True))
            state = (*state[:5], 0)
    else:
        parts = list(frames)
        if parts:
            state, out = _rows(key[0], state, pd.concat(parts))
    held.update(state)
    if state[5]:
        held.setTimeoutTimestamp(max(state[5], held.getCurrentWatermarkMs() + 1))
    names = [c.split()[0] for c in OUT.split(", ")]
    if out:
        yield pd.DataFrame(out, columns=names).astype({"seq": "Int64"})


def watched(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The states of a stream of events, in append mode. A pause is measured in event time."""
    return events.withWatermark("ts", late).groupBy("kb").applyInPandasWithState(_update, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def replayed(events: DataFrame) -> DataFrame:
    """The same over a table of events: one row for each that counted, and one for each check that fell due before a later event. A base has its events of one table in a task, as its states follow from each other."""

    def of_kb(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in OUT.split(", ")]
        return pd.DataFrame(_rows(key[0], NEW, frame)[1], columns=names)

    return events.groupBy("kb").applyInPandas(of_kb, OUT)


def changes(before: DataFrame, now: DataFrame, seq: int) -> DataFrame:
    """(kind, path) between two listings (path, size, modified_at): what a watcher would have told."""
    old = before.select("path", F.struct("size", "modified_at").alias("was"))
    new = now.select("path", F.struct("size", "modified_at").alias("is"))
    kind = F.when(F.col("was").isNull(), "create").when(F.col("is").isNull(), "delete").when(F.col("was") != F.col("is"), "modify")
    return old.join(new, "path", "full_outer").select("path", kind.alias("kind"), F.lit(seq).cast("long").alias("seq")).where("kind IS NOT NULL")

"""Conversation sessions (survey L13): the history that a question is asked with, by knowledge base and revision.

Events (kb, seq, ts, revision, kind, request, text), in the order of ts and seq:

- ask (text: the question) opens a session, continues the open one, or replaces it if its revision is another than that of
  the question before; it is told the last `messages` messages of the session;
- answer (text: the reply) ends the request that was asked last under that name, and commits question and reply to the
  history, if the session is still the one that was asked in; else, or without such a request, it is discarded;
- fail ends a request and leaves the history as it was;
- clear ends the session, as do more than `ttl` seconds without an event.

Sessions of a knowledge base are numbered; a number may be passed over. `replayed` finds them in a table by windows and a
join; `live` keeps them as keyed state of a stream, and gives the same rows. The stream needs the RocksDB state store
(spark.sql.streaming.stateStore.providerClass). What has expired is dropped from the state but for two numbers.

Nulls: a null kb or request is the empty one, as is a null text; a kb is trimmed; a null revision equals only itself; events
with a null ts or another kind are ignored. Ties in ts and seq are taken by kind, request and text. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators import conversation as V

EVENTS = "kb string, seq long, ts timestamp, revision long, kind string, request string, text string"
OUT = "kb string, seq long, session long, kind string, request string, outcome string, history array<struct<role: string, text: string>>"
KINDS = ("ask", "answer", "fail", "clear")
TTL = 1800
ORDER = ("ms", "seq", "kind", "request", "text")


def _cleaned(events: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = events.where(F.col("kind").isin(*KINDS) & F.col("ts").isNotNull())
    return rows.select(F.trim(text(F.col("kb"))).alias("kb"), "seq", "ts", F.unix_millis("ts").alias("ms"), "revision", "kind", text("request").alias("request"), text("text").alias("text"))


def replayed(events: DataFrame, ttl: int = TTL, messages: int = V.MESSAGES) -> DataFrame:
    """What each event of a table came to (OUT)."""
    order = [F.col(c) for c in ORDER]
    all_of, before = Window.partitionBy("kb").orderBy(*order), Window.partitionBy("kb").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = _cleaned(events)
    asked = F.last(F.when(F.col("kind") == "ask", F.struct("revision")), ignorenulls=True).over(before)
    rows = rows.withColumn("asked", asked).withColumn("pause", F.col("ms") - F.lag("ms").over(all_of))
    other = (F.col("kind") == "ask") & (F.col("asked").isNull() | ~F.col("asked.revision").eqNullSafe(F.col("revision")))
    ends = other | (F.col("kind") == "clear") | F.coalesce(F.col("pause") > ttl * 1000, F.lit(False))
    rows = rows.withColumn("session", F.sum(ends.cast("long")).over(all_of.rowsBetween(Window.unboundedPreceding, 0)))
    # the request that an answer belongs to, and whether it is its first end
    named = Window.partitionBy("kb", "request").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ask = F.when(F.col("kind") == "ask", F.struct("session", "text"))
    rows = rows.withColumn("of", F.last(ask, ignorenulls=True).over(named)).withColumn("nth", F.count(ask).over(named))
    ended = F.sum(F.col("kind").isin("answer", "fail").cast("long")).over(Window.partitionBy("kb", "request", "nth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    done = (F.col("kind") == "answer") & F.coalesce(F.col("of.session") == F.col("session"), F.lit(False))
    rows = rows.withColumn("ended", ended).withColumn("committed", done & (F.col("ended") == 1))
    within = Window.partitionBy("kb", "session").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("n", F.sum(F.col("committed").cast("long")).over(within)).withColumn("asks", F.count(ask).over(within))
    # the last exchanges before a question, by their numbers
    said = F.array(F.struct(F.lit("user").alias("role"), F.col("of.text").alias("text")), F.struct(F.lit("assistant").alias("role"), F.col("text").alias("text")))
    exchanges = rows.where("committed").select("kb", "session", F.col("n").alias("number"), said.alias("said"))
    most = -(-messages // 2)
    due = rows.where("kind = 'ask' AND n > 0").select("kb", "session", *ORDER, F.explode(F.sequence(F.greatest(F.col("n") - most + 1, F.lit(1)), F.col("n"))).alias("number"))
    parts = F.array_sort(F.collect_set(F.struct("number", "said")))  # questions that are equal in all are asked with one history
    told = due.join(exchanges, ["kb", "session", "number"]).groupBy("kb", "session", *ORDER).agg(F.flatten(F.transform(parts, lambda p: p["said"])).alias("told"))
    names = ("kb", "session", *ORDER)
    left, right = rows.alias("l"), told.alias("r")
    joined = left.join(right, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in names], "left").select("l.*", "r.told")
    none = F.array().cast("array<struct<role: string, text: string>>")
    history = F.when(F.col("kind") == "ask", F.coalesce(F.slice("told", F.greatest(F.size("told") - messages + 1, F.lit(1)), messages), none))
    outcome = F.when(F.col("kind") == "ask", F.when(F.col("asks") == 1, "opened").otherwise("continued")).when(F.col("kind") == "answer", F.when(F.col("committed"), "committed").otherwise("discarded")).when(F.col("kind") == "fail", "failed").otherwise("cleared")
    return joined.select("kb", "seq", "session", "kind", "request", outcome.alias("outcome"), history.alias("history"))


class _Sessions(StatefulProcessor):
    """The state of a knowledge base: where its numbering is, the messages that the next question may be told, open requests."""

    def __init__(self, ttl: int, messages: int):
        self.ttl, self.messages = ttl * 1000, messages

    def init(self, handle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "session long, asked boolean, revision long, open boolean, last long")
        self.said = handle.getListState("said", "role string, text string")
        self.requests = handle.getMapState("requests", "request string", "question string")

    def _forget(self) -> None:
        self.said.clear()
        self.requests.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        session, asked, revision, is_open, last = tuple(self.head.get()) if self.head.exists() else (0, False, None, False, None)
        for e in sorted(rows, key=lambda r: (r.ms, r.seq is not None, r.seq or 0, r.kind, r.request, r.text)):
            other = e.kind == "ask" and (not asked or revision != e.revision)
            if other or e.kind == "clear" or (last is not None and e.ms - last > self.ttl):
                session, is_open = session + 1, False
                self._forget()
            last, history = e.ms, None
            if e.kind == "ask":
                outcome = "continued" if is_open else "opened"
                asked, revision, is_open = True, e.revision, True
                history = [Row(role=m[0], text=m[1]) for m in self.said.get()]
                self.requests.updateValue((e.request,), (e.text,))
            elif e.kind == "clear":
                outcome = "cleared"
            else:
                held = self.requests.containsKey((e.request,))
                outcome = "failed" if e.kind == "fail" else "committed" if held else "discarded"
                if outcome == "committed":
                    said = [(m[0], m[1]) for m in self.said.get()] + [("user", self.requests.getValue((e.request,))[0]), ("assistant", e.text)]
                    self.said.put(said[-self.messages :])
                if held:
                    self.requests.removeKey((e.request,))
            yield Row(kb=key[0], seq=e.seq, session=session, kind=e.kind, request=e.request, outcome=outcome, history=history)
        self.head.update((session, asked, revision, is_open, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.ttl + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """No event can come any more that would find the session open."""
        self._forget()
        session, asked, revision, _, last = tuple(self.head.get())
        self.head.update((session, asked, revision, False, last))
        return iter(())

    def close(self) -> None:
        pass


def live(events: DataFrame, ttl: int = TTL, messages: int = V.MESSAGES, late: str = "10 minutes") -> DataFrame:
    """The same over a stream of events, in append mode. Events that come later than `late` are dropped; those of one trigger are put in order, so what follows from each other must not come in the wrong triggers."""
    rows = _cleaned(events.withWatermark("ts", late))
    return rows.groupBy("kb").transformWithState(_Sessions(ttl, messages), OUT, "Append", "EventTime")


def told(outcomes: DataFrame, most: int = V.MESSAGES, budget: int = V.BUDGET) -> DataFrame:
    """(kb, seq, turn, role, text): of each question's history what fits the budget of tokens."""
    rows = outcomes.where("kind = 'ask'").select(F.struct("kb", "seq").alias("conv_id"), F.posexplode("history").alias("turn", "m")).select("conv_id", "turn", "m.role", "m.text")
    return V.trimmed(rows, most, budget).select("conv_id.kb", "conv_id.seq", "turn", "role", "text")

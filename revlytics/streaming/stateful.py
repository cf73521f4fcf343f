"""Streams with state that outlives a batch: rollouts of candidates, and deliveries that are retried by timers.

Both are state machines of a key, kept in Spark's state store (RocksDB) and recovered from the stream's checkpoint. Events of one key
that come in one batch are taken in the order of their numbers, so that a key holds a batch's events in memory: bound the batch at
the source (maxFilesPerTrigger). Events that come in a later batch are taken as later.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a rollout holds, in the state and in each row that it gives.
ROLLOUT = "status string, candidate long, stable long, samples long, errors long, shadow_samples long, disagreements long"
_ROLLOUT_ROW = Row("key", "event_id", "what", *(c.split()[0] for c in ROLLOUT.split(", ")))
_DELIVERY_ROW = Row("message_id", "attempt", "status", "wait_s", "payload")
ROLLOUT_EVENT = "event_id, kind, candidate, failed, disagreement"


@contextmanager
def state_store(spark: SparkSession):
    """The session's state store is RocksDB inside."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


class Rollout:
    """Limits, and what an event does to a rollout.

    stage: a candidate starts with its evidence at zero, unless one is running (the same one: nothing to do; another: refused). result:
    a canary's sample; beyond `most_errors` of `least` samples or more a running rollout is rolled back. shadow: a compared sample; a running
    rollout is promoted, if `promotes`, once it has `least` of them and neither rate is beyond its limit, at a sample that didn't fail. What was
    rolled back or promoted stays so, though samples still count; events before any stage have no effect. promote: a decision made elsewhere for one
    candidate; it holds only if that one is still running, and keeps the evidence.
    """

    def __init__(self, least: int, most_errors: float, most_disagreement: float, promotes: bool):
        self.least, self.most_errors, self.most_disagreement, self.promotes = least, most_errors, most_disagreement, promotes

    def step(self, state: tuple | None, e: Row) -> tuple[tuple | None, str]:
        """The new state and what happened."""
        if e["kind"] == "stage":
            if state and state[0] == "running":
                return state, "already running" if state[1] == e["candidate"] else "refused"
            return ("running", e["candidate"], state[2] if state else None, 0, 0, 0, 0), "staged"
        if state is None:
            return None, "ignored"
        if e["kind"] == "promote":
            if state[0] != "running" or state[1] != e["candidate"]:
                return state, "refused"
            return ("promoted", state[1], state[1], *state[3:]), "promoted"
        status, candidate, stable, n, errors, shadow, differ = state
        what, failed = "counted", bool(e["failed"])
        if e["kind"] == "result":
            n, errors = n + 1, errors + failed
            if status == "running" and n >= self.least and errors / n > self.most_errors:
                status = what = "rolled_back"
        else:
            shadow, differ = shadow + 1, differ + ((e["disagreement"] or 0) > 0)
            fine = differ / shadow <= self.most_disagreement and (errors / n if n else 0) <= self.most_errors
            if status == "running" and self.promotes and shadow >= self.least and fine and not failed:
                status, stable, what = "promoted", candidate, "promoted"
        return (status, candidate, stable, n, errors, shadow, differ), what


class _Rollouts(StatefulProcessor):
    def __init__(self, rules: Rollout, every: bool):
        self.rules, self.every = rules, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("rollout", ROLLOUT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state, last = tuple(self.held.get()) if self.held.exists() else None, None
        for e in sorted(rows, key=lambda r: r["event_id"]):
            state, what = self.rules.step(state, e)
            if self.every or what not in ("counted", "ignored"):
                yield _ROLLOUT_ROW(key[0], e["event_id"], what, *(state or [None] * 7))
            last = e["event_id"]
        if state is not None:
            self.held.update(state)
            if not self.every:
                yield _ROLLOUT_ROW(key[0], last, "batch", *state)

    def close(self) -> None:
        pass


def rollouts(events: DataFrame, rules: Rollout, every: bool = False) -> DataFrame:
    """key, event_id, what, and the rollout's state: a row for each change and, at a batch's end, each key that had events; `every`: for each event.

    events: key, event_id, kind (stage, result, shadow, promote), candidate, failed, disagreement; a stream, or a table (then one batch).
    """
    rows = events.selectExpr("key", *ROLLOUT_EVENT.split(", "))
    return rows.groupBy("key").transformWithState(_Rollouts(rules, every), f"key {dict(events.dtypes)['key']}, event_id long, what string, {ROLLOUT}", "Append", "None")


#: Seconds before the n-th retry: doubled each time, up to this.
MOST_WAIT = 10


class _Deliveries(StatefulProcessor):
    def __init__(self, handler: Callable, most: int, second_ms: int):
        self.handler, self.most, self.second_ms = handler, most, second_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("delivery", "attempt int, payload string, status string")

    def _deliver(self, key, attempt: int, payload, now: int) -> Iterator[Row]:
        attempt += 1
        outcome = self.handler(payload, attempt)
        dead = outcome == "permanent" or (outcome != "ok" and attempt >= self.most)
        status = "done" if outcome == "ok" else "dead" if dead else "retry"
        wait = min(2 ** (attempt - 1), MOST_WAIT) if status == "retry" else None
        self.held.update((attempt, None if status != "retry" else payload, status))
        if wait is not None:
            self.handle.registerTimer(now + wait * self.second_ms)
        yield _DELIVERY_ROW(key[0], attempt, status, wait, payload if status == "dead" else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            if not self.held.exists():  # a message that comes again is the same message
                yield from self._deliver(key, 0, r["payload"], timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        attempt, payload, status = self.held.get()
        if status == "retry":
            yield from self._deliver(key, attempt, payload, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def deliveries(messages: DataFrame, handler: Callable, most: int = 3, second_ms: int = 1000) -> DataFrame:
    """message_id, attempt, status (done, dead, retry), wait_s, payload (of dead ones) for every attempt to handle a message.

    messages: stream of message_id, payload. handler(payload, attempt) gives ok, permanent or anything else; what is neither ok nor permanent is tried again
    after 1, 2, 4 ... up to 10 seconds by a processing-time timer, `most` times in all. A message id is handled once, however often it comes.
    An attempt may be repeated if an executor is lost meanwhile, so a handler must bear that.
    """
    kind = dict(messages.dtypes)["message_id"]
    return messages.select("message_id", "payload").groupBy("message_id").transformWithState(_Deliveries(handler, most, second_ms), f"message_id {kind}, attempt int, status string, wait_s int, payload string", "Append", "ProcessingTime")

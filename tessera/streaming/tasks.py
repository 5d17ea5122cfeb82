"""Task states as a keyed state machine over a stream of task events, with timers for back-off and expiry.

A task is in the state that its newest event (by time, then id) names. Events may come late, in any order and more
than once: an event id counts once, and a late one adds to the counts without undoing a newer state.

* ``retry``: due again ``backoff`` * 2 ** (retries - 1) after the event, ``longest`` at most. When the watermark passes that
  time and nothing newer has come, the task is ``pending`` again (reason ``due``).
* ``processing`` without a newer event for ``expiry`` is ``failed`` (reason ``expired``).

Event ids are kept as long as Spark lets events of their age through; those behind the watermark are dropped by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state that an event brings a task into.
STATES = {"received": "pending", "started": "processing", "succeeded": "indexed", "failed": "failed", "retried": "retry", "revoked": "revoked"}
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "task_id long, state string, reason string, since timestamp, due timestamp, n_events long, n_retries long, n_failures long"
#: OUT as the processor gives it: times in microseconds, so that an update costs no conversion of its own.
_RAW = OUT.replace("timestamp", "long")
#: Event ids that a task keeps before it looks for some that it can forget.
MANY = 1000
_KEPT = ["state", "reason", "at", "id", "due", "n_events", "n_retries", "n_failures", "seen"]


@dataclass(frozen=True)
class TaskConfig:
    """Seconds. watermark: how late an event may come, in Spark's words."""

    backoff: float = 60.0
    longest: float = 3600.0
    expiry: float = 1800.0
    watermark: str = "1 hour"


class TaskMachine(StatefulProcessor):
    def __init__(self, config: TaskConfig):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", "state string, reason string, at long, id long, due long, n_events long, n_retries long, n_failures long, seen binary")

    def _row(self, key, x: dict) -> Row:
        return Row(task_id=key[0], state=x["state"], reason=x["reason"], since=x["at"], due=x["due"], n_events=x["n_events"], n_retries=x["n_retries"], n_failures=x["n_failures"])

    def _read(self) -> dict | None:
        kept = self.task.get()
        return dict(zip(_KEPT, kept)) if kept is not None else None

    def _keep(self, x: dict) -> None:
        self.task.update(tuple(x[c] for c in _KEPT))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """The state is read once and written once, with the ids seen so far as one array: a call for each event, or a
        data frame for each task, would take most of the time."""
        x = self._read() or {"state": None, "reason": None, "at": None, "id": None, "due": None, "n_events": 0, "n_retries": 0, "n_failures": 0, "seen": b""}
        before = (x["at"], x["id"])
        held = np.frombuffer(x["seen"], np.int64).reshape(2, -1)  # ids, times
        known, new = set(held[0].tolist()), {}
        for row in rows:
            event, at, state = row["event_id"], row["at"], row["state"]
            if event in known or event in new:
                continue
            new[event] = at
            x["n_events"] += 1
            x["n_retries"] += state == "retry"
            x["n_failures"] += state == "failed"
            if x["at"] is None or (at, event) > (x["at"], x["id"]):
                x |= {"at": at, "id": event, "state": state, "reason": None}
        if not new:
            return
        if (x["at"], x["id"]) != before or x["state"] == "retry":
            self._set_timer(x)
        x["seen"] = self._remembered(np.concatenate([held, np.array([list(new), list(new.values())], np.int64)], axis=1), timerValues.getCurrentWatermarkInMs())
        self._keep(x)
        yield self._row(key, x)

    def _set_timer(self, x: dict) -> None:
        wait = None
        if x["state"] == "retry":
            wait = min(self.config.backoff * 2 ** min(x["n_retries"] - 1, 60), self.config.longest)
        elif x["state"] == "processing":
            wait = self.config.expiry
        x["due"] = None if wait is None else x["at"] + int(wait * 1_000_000)
        if x["due"] is not None:
            self.handle.registerTimer(x["due"] // 1000)

    def _remembered(self, seen: np.ndarray, watermark: int) -> bytes:
        """Without the ids of events that the watermark would drop if they came again, once there are MANY."""
        return (seen if seen.shape[1] <= MANY else seen[:, seen[1] // 1000 >= watermark]).tobytes()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        x = self._read()
        # a timer of an older state has nothing to say
        if x and x["due"] is not None and x["due"] // 1000 == expiredTimerInfo.getExpiryTimeInMs():
            x |= {"state": "pending", "reason": "due"} if x["state"] == "retry" else {"state": "failed", "reason": "expired"}
            x["due"] = None
            self._keep(x)
            yield self._row(key, x)

    def close(self) -> None:
        pass


def task_stream(events: DataFrame, config: TaskConfig = TaskConfig()) -> DataFrame:
    """Updates (OUT) of the states of tasks. events: a stream of (task_id, event_id, ts, signal), signals as in STATES.

    Rows without task, id or time, or with an unknown signal, are left out. The session's state store has to be STORE.
    """
    state = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])[F.col("signal")]
    rows = events.select(F.col("task_id").cast("long").alias("task_id"), F.col("event_id").cast("long").alias("event_id"), "ts", F.unix_micros("ts").alias("at"), state.alias("state"))
    rows = rows.where("task_id is not null and event_id is not null and ts is not null and state is not null").withWatermark("ts", config.watermark)
    updates = rows.groupBy("task_id").transformWithState(TaskMachine(config), _RAW, "Update", "eventTime")
    return updates.withColumns({c: F.timestamp_micros(c) for c in ("since", "due")})


def run_tasks(spark: SparkSession, events: DataFrame, target: str, checkpoint: str, config: TaskConfig = TaskConfig()) -> None:
    """Takes what the stream has, and appends the updates to the table at target."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        updates = task_stream(events, config)
        write = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/number={number}")
        updates.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def latest_states(spark: SparkSession, target: str) -> DataFrame:
    """Each task's last update."""
    rows = spark.read.schema(f"{OUT}, batch long").parquet(target)
    names = [c for c in rows.columns if c not in ("task_id", "batch", "number")]
    # a timer that fires in the batch of an event comes after it; it changes the state and keeps the counts
    order = F.struct("batch", "n_events", F.coalesce(F.col("reason").isNotNull(), F.lit(False)))
    return rows.groupBy("task_id").agg(F.max_by(F.struct(*names), order).alias("x")).select("task_id", "x.*")

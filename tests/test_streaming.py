"""Ingest with states of documents, and the state machine of tasks."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.streaming import ingest, tasks

T0 = datetime(2024, 1, 1)


def test_ingest_states(spark, tmp_path):
    target = str(tmp_path / "t")
    run = ingest.upsert_batch(target)
    batch = lambda *rows: spark.createDataFrame([(d, x, "en", T0 + timedelta(hours=h)) for d, x, h in rows], ingest.LANDING_SCHEMA)
    run(batch((1, "first text.", 0), (2, None, 0), (3, "  ", 0), (1, "older", -1), (None, "x", 0)), 0)
    state = lambda: {r.doc_id: (r.state, r.error, r.version) for r in ingest.statuses(spark, target).collect()}
    assert state() == {1: ("indexed", None, 0), 2: ("failed", "no text", 0), 3: ("failed", "no chunks", 0)}
    run(batch((1, "first text.", 5), (2, "now with text.", 5)), 1)
    assert state()[1] == ("indexed", None, 0) and state()[2] == ("indexed", None, 1)  # 1 was skipped
    for _ in range(2):  # a batch run again
        run(batch((1, "second text.", 6), (3, None, 6)), 2)
    assert sorted((r.doc_id, r.text) for r in ingest.current(spark, target).collect()) == [(1, "second text."), (2, "now with text.")]
    assert ingest.chunk_table(spark, target).log.versions() == [1, 2, 3]


def states(spark, tmp_path, batches, config):
    """Each batch is a file, taken one after another."""
    source, n = str(tmp_path / "events"), 0
    schema = "task_id long, event_id long, ts timestamp, signal string"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        tasks.run_tasks(spark, stream, str(tmp_path / "out"), str(tmp_path / "mark"), config)
        n += 1
    return {r.task_id: r for r in tasks.latest_states(spark, str(tmp_path / "out")).collect()}


@pytest.fixture(autouse=True)
def few_batches(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_late_and_repeated_events(spark, tmp_path):
    rng = random.Random(3)
    events = [(rng.randrange(6), i, T0 + timedelta(seconds=rng.randrange(2000)), rng.choice([*tasks.STATES, "unknown"])) for i in range(150)]
    events += [(None, 900, T0, "started"), (1, None, T0, "started"), (1, 901, None, "started")]
    shuffled = events + rng.sample(events, 60)
    rng.shuffle(shuffled)
    got = states(spark, tmp_path, [shuffled[i::3] for i in range(3)], tasks.TaskConfig(expiry=1e9, backoff=1e9, longest=1e9))
    for task in range(6):
        mine = [(ts, i, tasks.STATES[s]) for t, i, ts, s in events if t == task and i is not None and ts is not None and s in tasks.STATES]
        ts, _, state = max(mine)
        r = got[task]
        assert (r.state, r.since, r.n_events, r.n_retries, r.n_failures) == (state, ts, len(mine), sum(x[2] == "retry" for x in mine), sum(x[2] == "failed" for x in mine))
    assert len(got) == 6


def test_timers(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    first = [(1, 1, at(0), "retried"), (2, 2, at(0), "started"), (3, 3, at(0), "retried"), (3, 4, at(5), "started"), (4, 5, at(0), "succeeded"), (5, 6, at(1), "retried"), (5, 7, at(2), "retried"), (5, 8, at(90), "retried")]
    later = [(9, 20, at(400), "received")]  # moves the watermark on
    last = [(9, 21, at(401), "received"), (3, 22, at(402), "succeeded")]
    got = states(spark, tmp_path, [first, later, last], tasks.TaskConfig(backoff=100, longest=1000, expiry=200, watermark="10 seconds"))
    found = {k: (r.state, r.reason) for k, r in got.items()}
    assert found == {1: ("pending", "due"), 2: ("failed", "expired"), 3: ("indexed", None), 4: ("indexed", None), 5: ("retry", None), 9: ("pending", None)}
    assert got[5].due == at(490) and got[5].n_retries == 3  # 90 + 100 * 2 * 2


def test_state_is_read_and_written_once_a_batch():
    """However many events of a task come: each call goes to another process."""

    class Value:
        kept, calls = None, 0

        def get(self):
            self.calls += 1
            return self.kept

        def update(self, value):
            self.calls += 1
            self.kept = value

    class Handle:
        timers = 0

        def getValueState(self, *_):
            self.value = Value()
            return self.value

        def registerTimer(self, _):
            self.timers += 1

    class Now:
        def getCurrentWatermarkInMs(self):
            return 0

    handle, machine = Handle(), tasks.TaskMachine(tasks.TaskConfig())
    machine.init(handle)
    events = [{"event_id": i % 700, "at": 1000 + i % 700, "state": "retry"} for i in range(1000)]
    for batch in (events[:500], events[500:]):
        (row,) = machine.handleInputRows((1,), iter(batch), Now())
    assert (row["n_events"], row["n_retries"], row["state"]) == (700, 700, "retry")
    assert handle.value.calls == 4 and handle.timers == 2
    assert not list(machine.handleInputRows((1,), iter(events), Now()))

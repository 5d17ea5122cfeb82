"""Pfair mixing: windows, deviations and whole results."""

from collections import Counter

import numpy as np
import pytest

from tessera.llm import mixing as mx


def check(rows, config):
    """Windows are met, slots are used once, and within a phase no source strays by a block."""
    slots = {}
    for r in rows:
        assert r.release <= r.slot < r.deadline
        assert slots.setdefault(r.slot, (r.component, r.block)) == (r.component, r.block)
        assert r.position == r.slot * config.block + r.place
    assert sorted(slots) == list(range(len(slots)))
    assert len({r.position for r in rows}) == len(rows)
    return slots


@pytest.mark.parametrize("weights", [None, (("a", 0.5), ("b", 0.3), (None, 0.2)), (("a", 1.0),)])
def test_schedule(spark, weights):
    rng = np.random.default_rng(1)
    rows = [(i, f"t{i}", str(rng.choice(["a", "a", "a", "b", "c", "d"])) if i % 9 else None, 5) for i in range(1500)] + [(1, "t1", "a", 5), (None, "", "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, block int")
    config = mx.MixConfig(weights=weights, block=8, period=100, bucket=100)
    got = mx.schedule(docs, config).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[2]) for r in rows)
    slots = check(got, config)
    first = min((r.phase for r in got), default=0)
    end = max(r.slot for r in got if r.phase == first) + 1
    shares = {c: Counter(slots[s][0] for s in range(end))[c] / end for c in {v[0] for v in slots.values()}}
    if weights and len(weights) == 3:
        by_source = {r.source: r.component for r in got}
        # the part of a phase follows the weights to within a block (and the step of a period)
        assert abs(shares[by_source["a"]] - 0.5) < 0.04 and abs(shares[by_source["b"]] - 0.3) < 0.04


def test_deviation():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(1, 12))
        shares = mx.whole_shares({i: float(rng.random() ** 3) for i in range(n)}, 200)
        assert sum(shares.values()) == 200 and min(shares.values()) >= 1
        done = Counter()
        for t, (c, i) in enumerate(mx.edf(shares, 200), 1):
            assert i == done[c]
            done[c] += 1
            assert all(abs(done[k] - shares[k] * t / 200) < 1 for k in shares)


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = mx.schedule(docs).collect()
    assert len(got) == docs.count()
    check(got, mx.MixConfig())
    order = [r.doc_id for r in mx.mixed(docs).collect()]
    assert order == [r.doc_id for r in sorted(got, key=lambda r: r.position)]
    assert mx.schedule(docs.limit(0)).count() == 0
    many = spark.range(300).selectExpr("id doc_id", "cast(id as string) source", "'x' text")
    few = mx.schedule(many, mx.MixConfig(components=4, block=2)).collect()
    assert len(few) == 300 and len({r.component for r in few}) == 4


def test_many_sources(spark):
    """Small sources have their own targets: listed ones as components, others within the last component."""
    rows = [(i, f"s{i % 80}") for i in range(8000)] + [(10_000 + i, "tiny") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    config = mx.MixConfig(weights=(("tiny", 0.5), ("s1", 0.5)), block=2, period=100)
    got = mx.schedule(docs, config).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter(rows)
    check(got, config)
    assert max(r.position for r in got if r.source == "tiny") < 90  # half of the first 80

    rows = [(i * 1000 + k, f"h{i}") for i, n in enumerate([400] * 4 + [100] * 20 + [4] * 40) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    config = mx.MixConfig(components=5, block=2, bucket=100)
    got = mx.schedule(docs, config).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter(rows)
    check(got, config)
    # weights 20, 10 and 2: in the first half of the time of a source of four all have their shares
    order = [r.source for r in sorted(got, key=lambda r: r.position)]
    first = Counter(order[: int(0.9 * 2 * (4 * 20 + 20 * 10 + 40 * 2))])
    for i in range(64):
        share = 1.8 * (20 if i < 4 else 10 if i < 24 else 2)
        assert abs(first[f"h{i}"] - share) <= 4, (i, first[f"h{i}"], share)


def test_weights_of_zero_come_last(spark):
    rows = [(i, "abc"[i % 3]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    config = mx.MixConfig(weights=(("a", 0.7), ("b", 0.3)), block=4, bucket=50)
    got = mx.schedule(docs, config).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter(rows)
    check(got, config)
    assert min(r.position for r in got if r.source == "c") > max(r.position for r in got if r.source != "c")


def test_whole_schedule(spark):
    """Every slot against a plain earliest-deadline-first run over all blocks."""
    rows = [(i, "aaaabbbccd"[i % 10]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    config = mx.MixConfig(block=4, period=400, bucket=100)
    got = {(r.component, r.block): r for r in mx.schedule(docs, config).collect()}
    sizes = Counter(s for _, s in rows)
    order = sorted(sizes, key=lambda s: (-sizes[s], s))
    left = {c: -(-sizes[s] // 4) for c, s in enumerate(order)}
    weights = {c: sizes[s] ** 0.5 for c, s in enumerate(order)}
    done, slot = Counter(), 0
    while active := [c for c in left if left[c]]:
        shares, start, own = mx.whole_shares({c: weights[c] for c in active}, 400), slot, Counter()
        while all(left[c] for c in active):
            at = slot - start
            ready = [(-(-(own[c] + 1) * 400 // shares[c]), c) for c in active if own[c] * 400 // shares[c] <= at]
            deadline, c = min(ready)
            r = got[c, done[c]]
            assert (r.slot, r.deadline, r.release) == (slot, start + deadline, start + own[c] * 400 // shares[c])
            own[c] += 1
            done[c] += 1
            left[c] -= 1
            slot += 1
    assert slot == len(got)


def test_clashing_columns_nulls_and_repeats(spark):
    rows = [(1, "x", "a", 7, 1, 2), (1, "x", "a", 7, 1, 2), (1, "y", "a", 8, 1, 2), (None, None, None, 9, 1, 2), (2, "", "", 0, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, Position int, j int, at int")
    got = mx.mixed(docs, mx.MixConfig(block=1))
    assert got.columns == docs.columns
    assert Counter(map(tuple, got.collect())) == Counter(rows)
    assert mx.mixed(docs.limit(0)).count() == 0

"""Seed chaining: planted passages, plain dynamic programmes and edge cases."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tessera.llm import chaining as ch


def test_lcs():
    rng = np.random.default_rng(0)
    for _ in range(50):
        x, y = rng.integers(0, 4, int(rng.integers(0, 30))), rng.integers(0, 4, int(rng.integers(0, 30)))
        table = np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(len(x)):
            for j in range(len(y)):
                table[i + 1, j + 1] = table[i, j] + 1 if x[i] == y[j] else max(table[i, j + 1], table[i + 1, j])
        assert ch.common_words(x, y) == table[-1, -1]


def test_chain_score():
    rng = np.random.default_rng(1)
    for _ in range(200):
        anchors = sorted({(int(a), int(b), 3) for a, b in rng.integers(0, 40, (int(rng.integers(1, 14)), 2))}, key=lambda x: (x[1], x[0]))
        best = [0.0] * len(anchors)
        for i, (a, b, w) in enumerate(anchors):
            before = [best[j] - 0.1 * (a - aj - wj + b - bj - wj) for j, (aj, bj, wj) in enumerate(anchors) if aj + wj <= a and bj + wj <= b]
            best[i] = w + max(0.0, *before, 0.0)
        got = ch.chains_of(anchors, 0.1)
        assert abs(max(s for s, _ in got) - max(best)) < 1e-9
        assert sorted(x for _, c in got for x in c) == sorted(anchors)


def test_anchors():
    rng = np.random.default_rng(4)
    for _ in range(100):
        n = int(rng.integers(1, 30))
        found = {(int(a), int(a + d), int(k)) for a, d, k in zip(rng.integers(0, 60, n), rng.integers(-3, 4, n), rng.choice([3, 9], n)) if a + d >= 0}
        if not found:
            continue
        want = []
        for d in {b - a for a, b, _ in found}:
            covered = sorted({x for a, b, k in found if b - a == d for x in range(2 * a, 2 * (a + k) + 1)})  # half steps: touching counts
            starts = [x for x in covered if x - 1 not in covered]
            for x in starts:
                end = x
                while end + 1 in covered:
                    end += 1
                want.append((x // 2, x // 2 + d, (end - x) // 2))
        assert sorted(ch.anchors_of(*(np.array(c) for c in zip(*found)))) == sorted(want)


def made(seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    draw = lambda n: rng.choice(vocabulary, n).tolist()
    planted = [draw(int(rng.integers(55, 90))) for _ in range(5)]
    rows, truth = [], {}
    for i in range(80):
        words = draw(int(rng.integers(0, 300)))
        if i % 2:
            p = list(planted[i % 5])
            for _ in range(i % 4):  # a few words of the passage are changed, dropped or put in
                at = int(rng.integers(len(p)))
                p[at : at + int(rng.integers(0, 2))] = draw(int(rng.integers(0, 2)))
            at = int(rng.integers(len(words) + 1))
            words[at:at] = p
            truth.setdefault(i % 5, []).append(i)
        rows.append((i, " ".join(words)))
    return rows, truth


def test_planted(spark):
    rows, truth = made(3)
    rows += [(200, rows[1][1].upper()), (201, ""), (202, None), (203, "x " * 5000), (204, "x " * 5000), (None, rows[1][1]), (205, "one two"), (206, rows[0][1]), (206, rows[0][1])]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, start int, rep_id int")
    got = ch.passages(docs).collect()
    seen = {r.doc_id for r in got} | {r.rep_id for r in got}
    assert {i for v in truth.values() for i in v} <= seen and {200, 203, 204} <= seen
    # rows without doc_id come after all others
    assert any(r.doc_id is None and r.rep_id == 1 and r.identity == 1.0 for r in got)
    for r in got:
        assert r.rep_id is not None and (r.doc_id is None or r.rep_id < r.doc_id) and r.identity >= 0.7 and r.end - r.start >= 40
    linked = {(r.rep_id, r.doc_id) for r in got if r.doc_id is not None}
    of = {i: k for k, v in truth.items() for i in v}
    assert all(of.get(a, a) == of.get(b, b) or b >= 200 for a, b in linked)
    words = dict(rows)[1].lower().split()
    for r in got:
        if r.doc_id == 200 and r.rep_id == 1:
            assert r.end - r.start == len(words)
    assert ch.passages(docs.limit(0)).count() == 0


def test_repeated_ids_and_hot_seeds(spark):
    """Every row is searched, whatever its doc_id, and hot seeds give the same matches as others."""
    rng = np.random.default_rng(8)
    draw = lambda n: " ".join(f"v{i}" for i in rng.integers(0, 50_000, n))
    common, other = draw(60), draw(60)
    rows = [(i, f"{draw(20)} {common} {draw(20)}") for i in range(60)] + [(7, f"{other} {draw(5)}"), (7, "zzz"), (100, other), (None, other), (None, other), (-5, f"{common} x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    config = ch.ChainConfig(hot=0.1)
    got = {tuple(r) for r in ch.passages(docs, config).collect()}
    assert got == {tuple(r) for r in ch.passages(docs, ch.ChainConfig(hot=2.0)).collect()}
    pairs = {(r[0], r[3]) for r in got}
    assert {(i, 0) for i in range(1, 60)} <= pairs and {(7, 100), (None, 100), (-5, 0)} <= pairs


def test_stock_sentences(spark):
    """Passages whose parts all occurred earlier, in different documents."""
    rng = np.random.default_rng(6)
    stock = [[f"s{i}_{j}" for j in range(15)] for i in range(12)]
    fresh = iter(range(1 << 30))
    rows = []
    for i in range(300):  # every two sentences in a row are common, 30 words
        parts = [stock[a] + stock[b] + [f"u{next(fresh)}" for _ in range(15)] for a, b in rng.integers(0, 12, (4, 2))]
        rows.append((i, " ".join(sum(parts, []))))
    planted = [sum((stock[k] for k in rng.permutation(12)[:4]), []) for _ in range(10)]
    for i, p in enumerate(planted):
        for d in (1000 + i, 2000 + i):
            rows.append((d, " ".join([f"u{next(fresh)}" for _ in range(20)] + p + [f"u{next(fresh)}" for _ in range(20)])))
    grams, want = {}, set()
    for d, t in rows:
        w = t.split()
        for at in range(len(w) - 39):
            if grams.setdefault(tuple(w[at : at + 40]), d) < d:
                want.add((d, at))
    got = {}
    for r in ch.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
    assert len({d for d, _ in want}) >= 10
    assert all(any(a <= at and at + 40 <= b for a, b in got.get(d, [])) for d, at in want)


def test_words_around_chains_take_little_memory():
    """A batch of 8 MB of text is hashed piece by piece; rows without chains and empty texts keep their places."""
    texts = ["", *(" ".join(f"w{i}x{j}" for j in range(1000)) for i in range(1000))]
    chains = [[{"a": i, "b0": 70 + k, "b1": 120, "a0": 0, "a1": 50, "score": 1.0, "anchors": 1} for k in range(i % 3)] for i in range(len(texts))]
    kind = pa.list_(pa.struct([("a", pa.int64()), *((n, pa.int32()) for n in ("b0", "b1", "a0", "a1")), ("score", pa.float64()), ("anchors", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array(chains, kind)], ["b", "text", "chains"])
    tracemalloc.start()
    got = [row for out in ch._cut_words(batch, ch.ChainConfig()) for row in zip(*(c.to_pylist() for c in (out[0], out[1], *out[-3:])))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20, peak
    want = []
    for i, own in enumerate(chains):
        words = ch.word_hashes([texts[i].encode()])[0] if own else None
        want += [(i, c["b0"], i, c["b0"] - 64, words[c["b0"] - 64 : 184].astype("<u4").tobytes()) for c in own]
    assert got == want

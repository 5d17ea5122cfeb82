"""Sorted projection passes against brute force."""

import numpy as np
import pytest

from tessera.llm import projection as pr


def brute(rows, similarity=0.98):
    n = len(rows)
    ok = [l is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    parent, links = list(range(n)), [0] * n

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    unit = [np.array(v) / np.linalg.norm(v) if o else None for (_, v, _), o in zip(rows, ok)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= similarity:
                links[i] += 1
                links[j] += 1
                parent[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(r[0], least.get(top(i), r[0]))
    return [(r[0], links[i], least.get(top(i))) for i, r in enumerate(rows)]


def made(seed, n=150, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 3, dim))
    rows = [(i, (base[i % len(base)] + rng.normal(0, [0.0, 0.02, 0.08][i % 3], dim)).astype(np.float32).tolist(), int(i % 2)) for i in range(n)]
    odd = [[0.0] * dim, None, [], [1.0, None] + [0.0] * (dim - 2), [float("nan")] * dim, [float("inf")] * dim]
    rows += [(500 + i, v, 1) for i, v in enumerate(odd)]
    hot = rows[0][1]
    rows += [(600 + i, hot, rows[0][2]) for i in range(40)] + [(700, hot, None), (701, [2 * x for x in hot], rows[0][2]), (702, hot[:5], 0), (None, hot, 0), (None, [5.0] + [0.0] * (dim - 1), 7), (0, hot, 0)]
    return rows


@pytest.mark.parametrize("config", [pr.ProjectionConfig(window=4, block=16), pr.ProjectionConfig()])
def test_links(spark, config):
    rows = made(1)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, cid int")
    got = [tuple(r)[:3] for r in pr.deduplicate(df, config).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert pr.deduplicate(df.limit(0), config).count() == 0


def test_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 64))
    x = np.concatenate([centres[i] + rng.normal(0, s, (30, 64)) for i in range(60) for s in [0.02 + 0.12 * i / 60]] + [rng.standard_normal((1500, 64))]).astype(np.float32)
    label = rng.integers(0, 3, len(x))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))], "vec_id long, embedding array<float>, label int")
    got = pr.deduplicate(df).collect()
    assert sum(r.n_links for r in got) >= 0.95 * linked.sum() > 0
    assert all(r.n_links <= linked[r.vec_id].sum() for r in got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_dense_label(spark):
    """One label whose vectors are all alike: planted pairs are found however many windows it has."""
    rng = np.random.default_rng(4)
    n, dim, planted = 5000, 64, 200
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(np.sqrt(0.9) * unit(rng.standard_normal(dim)) + np.sqrt(0.1) * unit(rng.standard_normal((n, dim))))
    x[n - planted :] = unit(x[:planted] + np.sqrt(2 - 2 * 0.983) * unit(rng.standard_normal((planted, dim))))
    linked = x @ x.T >= 0.98
    np.fill_diagonal(linked, False)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = pr.deduplicate(df, pr.ProjectionConfig(window=8)).collect()
    assert sum(r.n_links for r in got) >= 0.98 * linked.sum() > 0, (sum(r.n_links for r in got), linked.sum())
    assert all(r.n_links <= linked[r.vec_id].sum() for r in got)

"""The vector index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval as r
from tessera.operators.vector_index import IndexConfig, VectorIndex, k_means

CONFIG = IndexConfig(cells=12, parts=4, codes=16, nprobe=4, group_rows=60)


def table(spark, seed=1, n=600, d=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, d)) * 2
    x = centres[rng.integers(0, 20, n)] + rng.normal(size=(n, d)) * 0.6
    x[: n // 3] = x[0]  # a third are copies
    rows = [(i * 7, v.tolist(), str(i % 3)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, embedding array<double>, tag string")


def asked(vectors):
    return vectors.where("id % 5 = 0").withColumnRenamed("id", "qid")


def rows(df):
    return sorted((x.qid, x["rank"], x.id, round(x.score, 5) + 0.0) for x in df.collect())


@pytest.mark.parametrize("metric,same", [("cosine", False), ("l2", False), ("cosine", True)])
def test_all_cells_are_brute_force(spark, tmp_path, metric, same):
    vectors = table(spark)
    index = VectorIndex.create(vectors, str(tmp_path), IndexConfig(**{**CONFIG.__dict__, "metric": metric}))
    assert rows(index.search(asked(vectors), 5, nprobe=12, same=same)) == rows(r.dense_top_k(asked(vectors), vectors, 5, metric, same))


def test_recall_and_pruning(spark, tmp_path):
    vectors = table(spark, 3).where("id > 1500")
    index = VectorIndex.create(vectors, str(tmp_path / "few"), CONFIG)
    q = asked(vectors)
    best = {(a, c) for a, _, c, _ in rows(r.dense_top_k(q, vectors, 5))}
    got = {(a, c) for a, _, c, _ in rows(index.search(q, 5))}
    assert len(best & got) >= 0.9 * len(best)
    fine = VectorIndex.create(vectors, str(tmp_path / "fine"), IndexConfig(cells=12, parts=8, codes=64, nprobe=4))
    able = fine.candidates(q, 5, nprobe=12)
    assert able.count() < 0.3 * q.count() * vectors.count()  # the bounds leave out most
    found = index.search(q.where("qid = 1505"), 5, nprobe=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell#" in plan


def test_groups_of_a_hot_cell(spark, tmp_path):
    index = VectorIndex.create(table(spark), str(tmp_path), CONFIG)
    sizes = [x["count"] for x in index.codes.groupBy("cell", "group").count().collect()]
    assert sum(sizes) == 600 and max(sizes) <= 90


def test_added_rows(spark, tmp_path):
    vectors = table(spark, 4)
    index = VectorIndex.create(vectors.where("id % 2 = 0"), str(tmp_path), CONFIG)
    index.add(vectors.where("id % 2 = 1"))
    again = VectorIndex(spark, str(tmp_path), CONFIG)
    assert rows(again.search(asked(vectors), 3, nprobe=12)) == rows(r.dense_top_k(asked(vectors), vectors, 3))


def test_odd_rows(spark, tmp_path):
    odd = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (None, [1.0, 0.0]), (2**60 + 1, [1e300, 1e299]), (1, [1.0, 0.0]), (9, [])]
    vectors = spark.createDataFrame(odd, "id long, embedding array<double>")
    index = VectorIndex.create(vectors, str(tmp_path / "a"), CONFIG)
    got = rows(index.search(vectors.withColumnRenamed("id", "qid").where("qid = 2"), 5))
    assert [x[2] for x in got] == [2**60 + 1, 1, 1] or [x[2] for x in got] == [2**60 + 1, 1]
    empty = VectorIndex.create(vectors.where("id < 0"), str(tmp_path / "b"), CONFIG)
    assert rows(empty.search(vectors.withColumnRenamed("id", "qid"), 5)) == []


def test_k_means():
    x = np.array([[0.0], [0.1], [5.0], [5.1], [9.0]])
    assert np.allclose(np.sort(k_means(x, 3, 10).ravel()), [0.05, 5.05, 9.0])
    assert len(k_means(np.ones((5, 2)), 3, 3)) == 1


def test_search_passes_on_k_rows_a_group(spark, tmp_path):
    """What a group leaves is scored where it lies: nothing is joined again, however loose the bounds are."""
    vectors = table(spark)
    index = VectorIndex.create(vectors, str(tmp_path), IndexConfig(cells=12, parts=1, codes=1, nprobe=12, group_rows=60))
    assert rows(index.search(asked(vectors), 5)) == rows(r.dense_top_k(asked(vectors), vectors, 5))
    assert "Join" not in index.search(asked(vectors), 5)._jdf.queryExecution().optimizedPlan().toString()
    found = index._met(asked(vectors), 5, None, False, True)
    assert found.groupBy("qid").count().agg(F.max("count")).first()[0] <= 5 * int(index.model.groups.sum())

"""Queries over documents that must measure or scan each text once."""

import random

from tessera.operators import corpus as c
from tessera.plans import registry

SF = "/root/testdata/sf0.001"


def test_spearman_reads_texts_once(spark):
    out = registry.QUERIES["spearman_matrix"](spark, SF)
    assert "text#" not in out._jdf.queryExecution().executedPlan().toString()


def test_quoting_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    words = ["a", "ab", "abc", "b", "ba", "cab", ""]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 9))) for _ in range(80)] + [None]
    quotes = [" ".join(rng.choices(words, k=rng.randrange(1, 5))) for _ in range(40)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string").repartition(3)
    items = spark.createDataFrame(list(enumerate(quotes)), "item_id long, q string")
    want = sorted((i, d) for i, q in enumerate(quotes) for d, t in enumerate(texts) if q and t is not None and q in t)
    for most in (1000, 7):
        monkeypatch.setattr(c, "QUOTES", most)
        found = c.quoting(docs, items)
        assert sorted(map(tuple, found.collect())) == want != []
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()

"""The tiered index against scores of all documents."""

import math
import random
import re
from collections import Counter

import pytest

from tessera.llm import tiered_index as t
from tessera.llm.common import Stage

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    counts = [Counter(terms(text)) for _, text in docs]
    sizes = [sum(c.values()) for c in counts]
    n, total = sum(x > 0 for x in sizes), sum(sizes)
    df = Counter(w for c in counts for w in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, _), c, size in zip(docs, counts, sizes):
            m = 75 + 25 * size * n // total if total else 75
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in terms(text) if c[w])
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, i + 1, None if none else doc, -s) for i, (s, none, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, **kw):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, term string, rank int")
    i = spark.createDataFrame([(*r, 3) for r in items], "item_id long, text string, qid int")
    return sorted((tuple(r) for r in t.rank_documents(d, i, Stage(spark, "test-tiers"), **kw).collect()), key=str)


def corpus(seed, n, vocabulary=60):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(vocabulary)] + ["ÉTÉ", "été", "a_b", "X1", "中文"]
    weights = [1 / (i + 1) for i in range(len(pool))]
    text = lambda most: rng.choice([" ", ", ", "\n"]).join(rng.choices(pool, weights, k=rng.randrange(0, most)))
    docs = [(i, text(60)) for i in range(n)]
    return docs, [(i, text(12)) for i in range(15)]


@pytest.mark.parametrize("seed,tiers", [(1, (4, 16)), (2, (64, 256)), (3, (1, 2)), (4, (1024, 8192))])
def test_against_all_scores(spark, seed, tiers):
    docs, items = corpus(seed, 250)
    assert found(spark, docs, items, tiers=tiers) == brute(docs, items)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(t, "SLICE", 10)
    monkeypatch.setattr(t, "BLOCK", 2)
    docs, items = corpus(9, 60)
    docs += [(7, "w1 w2 w3")] * 40 + [(None, "w1 w2 w3"), (None, None), (99, ""), (100, "!!"), (101, "w0 " * 20_000)]  # a large group of copies
    items += [(3, "W1 w1, w2"), (3, None), (None, "w3"), (50, ""), (51, "nowhere"), (52, "w0")]
    assert found(spark, docs, items, tiers=(8, 30)) == brute(docs, items)


def test_terms_by_join(spark, monkeypatch):
    monkeypatch.setattr(t, "VOCABULARY", 0)
    docs, items = corpus(5, 80)
    assert found(spark, docs, items, tiers=(8, 30)) == brute(docs, items)


def test_empty(spark):
    docs, items = corpus(6, 30)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [], []) == []


def test_each_tier_proves_some(spark):
    """Every way to a result is taken: both upper tiers and the scan."""
    docs, items = corpus(8, 400)
    stage = Stage(spark, "test-tiers")
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (77, "中文"), (78, "w50 w51")], "qid long, text string")
    wanted = stage.write(t.item_terms(i), "terms")
    index = t.build_index(d, stage, wanted.select("term"), (40, 60))
    assert index.postings.groupBy("tier", "term").count().groupBy("tier").agg({"count": "max"}).where("`max(count)` > 60").isEmpty()
    weights = wanted.join(index.lexicon, "term").selectExpr("qid", "term", "cast(times * w as long) as weight", "residuals")
    _, left = t._by_tier(index, weights, 1, 5, stage)
    _, rest = t._by_tier(index, weights, 2, 5, stage)
    assert 0 < rest.count() < left.count() < 17

"""The pipeline's stages, one after the other, against plain versions."""

import zlib

import numpy as np
import pytest

import corpus_pipeline as cp
from tessera.llm.common import Stage

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    stage, docs, out = Stage(spark, "test"), spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, function in cp.STAGES:
        docs = out[name] = stage.write(function(spark, docs, SF), name)
    return out


def test_columns(stages):
    for name, _ in cp.STAGES[:-1]:
        assert stages[name].columns == stages["documents"].columns
        assert stages[name].schema.simpleString() == stages["documents"].schema.simpleString()


def test_quality_stage(stages, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in stages["quality"].collect()}
    rows = labels.collect()
    assert np.mean([(r.doc_id in kept) == (r.quality == 1) for r in rows]) > 0.98


def test_near_duplicate_stage(stages):
    rows = [(r.doc_id, (r.text or "").lower().split()) for r in stages["quality"].collect()]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for _, w in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by: dict = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    for i, j in {(a, b) for v in by.values() for a in v for b in v if a < b}:
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = top(i), top(j)
            parent[max(a, b)] = min(a, b)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(d, least.get(top(i), d))
    got = {r.doc_id for r in stages["near_duplicates"].select("doc_id").collect()}
    assert set(least.values()) <= got and len(got) <= 1.01 * len(least)


def test_later_stages(stages):
    before = {r.doc_id: r.text for r in stages["near_duplicates"].collect()}
    after = {r.doc_id: r.text for r in stages["decontaminated"].collect()}
    assert set(after) <= set(before) and len(after) > 0.95 * len(before)
    assert any(before[d] != after[d] for d in after)
    mixed = [(r.doc_id, r.text) for r in stages["mixture"].collect()]
    assert sorted(mixed) == sorted(after.items())
    from tessera.llm import mixing

    order = [r.doc_id for r in mixing.mixed(stages["decontaminated"]).collect()]
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(map(tuple, stages["tokens"].collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == order
    start = 0
    for d, at, n, crc in got:
        ids = library.encode(after[d], add_special_tokens=False).ids + [1]
        assert (at, n, crc) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n


def test_run(spark):
    got = cp.run(spark, "/root/testdata/sf0.001").collect()
    assert got and set(got[0].asDict()) == {"doc_id", "start", "n_tokens", "ids_crc32"}

"""Quality classifier, token output and decontamination against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from tessera.llm import decontaminate as dc
from tessera.llm import quality as qu
from tessera.llm import token_output as to
from tessera.llm.common import Stage

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, items string"
SF = "/root/testdata/sf0.001"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None, 1.0, "x") for i, t in texts], DOCS)


ODD = [(0, None), (1, ""), (2, "  \n"), (3, "a"), (4, "word " * 30_000), (5, "Ünï çödé — 漢字 \U0001f600 ﬁ é"), (5, "Ünï çödé — 漢字 \U0001f600 ﬁ é"), (None, "no id"), (7, "see <|endoftext|> here"), (8, "it's 3.14!! don't stop now")]


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = qu.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert ((got.score >= 0.3) == (got.quality == 1)).mean() > 0.97
    assert (got.predicted == (got.score >= 0.3)).all()


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (4, 0, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = qu.classify(docs_of(spark, ODD), labels).toPandas()
    assert len(got) == len(ODD) and got.score.between(0, 1).all()
    assert not got[got.doc_id.isna()].held_out.any()
    empty = qu.classify(docs_of(spark, ODD), labels.limit(0)).toPandas()
    assert (empty.score.round(6) == 0.5).all()
    assert qu.classify(docs_of(spark, []), labels).count() == 0


def test_stream_coding():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        c, d = to.encode_ranks(x)
        assert len(c) == -(-n // 4)
        assert (to.decode_ranks(c, d, n) == x).all()
        assert (to.unpack(to.pack(x)) == x).all()


@pytest.mark.parametrize("block_ids", [50, 1 << 17])
def test_tokens_against_library(spark, block_ids):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = ODD + [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    stage = Stage(spark, "test")
    blocks, ranks = to.write_tokens(docs_of(spark, rows), to.TokenConfig(path, block_ids=block_ids), stage)
    got = sorted(map(tuple, to.token_digest(blocks, ranks).toPandas().fillna(-1).astype("int64").values.tolist()))
    library, want, start = Tokenizer.from_file(path), [], 0
    ids = {}
    for i, t in rows:
        ids.setdefault(-1 if i is None else i, []).append(library.encode(t or "", add_special_tokens=False).ids + [1])
    for i in sorted(ids):
        for x in ids[i]:
            want.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
            start += len(x)
    assert got == want
    whole = to.read_tokens(blocks, ranks).where("doc_id = 105").collect()[0]
    assert list(whole.ids) == ids[105][0]
    assert to.token_digest(*to.write_tokens(docs_of(spark, []), to.TokenConfig(path), Stage(spark, "test"))).count() == 0


def test_word_encoder():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, words = Tokenizer.from_file(path), to.WordEncoder(path)
    rng = np.random.default_rng(2)
    alphabet = list("abcXYZ019'!.,-_ \n\t\x0b\x1c\x85\xa0ÀÿßÖ×÷µªİıΣςе\u0301漢ﬁ½²\U0001f600") + ["'s", "'ll", "'RE", "  ", "don't", "</w>", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet, int(rng.integers(0, 30)))) for _ in range(4000)]
    for text, got in zip(texts, words.encode(texts)):
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def plain_contamination(docs, items, window=10):
    rx = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: rx.findall((t or "").encode().lower())
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if (g := grams.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= g
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def random_case(seed):
    rng = np.random.default_rng(seed)
    draw = lambda n: " ".join(rng.choice(list("abcd") if seed % 2 else ["A", "b", "é", "c1"], n))
    items = [(int(i), draw(int(rng.integers(0, 9)))) for i in range(12)] + [(3, "a b"), (99, None), (100, "")]
    return [(i, draw(int(rng.integers(0, 60)))) for i in range(40)] + [(90, None), (91, "")], items


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("shard_words", [15, 10_000])
def test_contamination_random(spark, seed, shard_words):
    docs, items = random_case(seed)
    window = 3 + seed
    table = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contamination(docs_of(spark, docs), table, dc.DecontamConfig(window=window, shard_words=shard_words)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_contamination(docs, items, window))


def test_contamination_tables(spark):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = dc.contamination(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    assert sorted(map(tuple, got)) == sorted(plain_contamination(docs, items)) and any(r.contaminated for r in got)


def test_decontaminate_edges(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (None, "x")], "item_id long, text string")
    text = "Keep this. One two, THREE four five six seven eight nine ten! And all of this stays as it was, more words than were cut from it."
    docs = docs_of(spark, [*ODD, (20, text), (21, "one two three four five six seven eight nine ten")])
    got = {r.doc_id: r for r in dc.remove_spans(docs, items).collect()}
    assert got[20].text == "Keep this. ! And all of this stays as it was, more words than were cut from it." and got[20].n_chars == len(got[20].text)
    assert 21 not in got and got[4].text == "word " * 30_000 and got[0].text is None and got[20]["items"] == "x"
    assert dc.contamination(docs, items.limit(0)).where("contaminated").count() == 0
    assert dc.contamination(docs_of(spark, []), items).count() == 0


@pytest.mark.parametrize("shard_words", [4, 10_000])
def test_items_without_id_count(spark, shard_words):
    own = "p q r s t u v w x1 y1 z1 a1"
    items = spark.createDataFrame([(None, own), (None, "lone"), (7, "a b c"), (7, "lone")], "item_id long, text string")
    docs = spark.createDataFrame([(1, own), (1, own), (2, "Lone words"), (3, None), (None, "d a b c e")], "doc_id long, text string")
    config = dc.DecontamConfig(shard_words=shard_words)
    got = dc.contamination(docs, items, config).orderBy("doc_id").collect()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(None, 5, 3, 1, digest("7"), True)] + [(1, 12, 12, 1, digest(""), True)] * 2 + [(2, 2, 1, 2, digest("7"), True), (3, 0, 0, 0, digest(""), False)]
    assert list(map(tuple, got)) == want
    left = sorted((r.doc_id or 0, r.text) for r in dc.remove_spans(docs, items, config).collect() if r.doc_id != 3)
    assert left == [(2, " words")]

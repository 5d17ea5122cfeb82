"""Token counts against the library on whole texts."""

import random

import public_tokenizers
import pytest
import sentencepiece

from tessera.llm import token_counts as t

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def counter():
    return t.Counter(t.vocabulary(PATH))


def test_proofs(counter, library):
    known = counter.known
    assert known.cuts and known.anchor == "\n"
    assert len(known.single) > 30_000 and " the" in known.single and "the" in known.single
    for s in random.Random(1).sample(sorted(known.single), 500):
        if s[0] == " " and s.strip():
            assert len(library.encode(s[1:])) == 1


ODD = ["", " ", "  ", " a", "a ", "a  b", "▁a▁▁b", "<s> </s> <unk> <0x41>", "a\0b", "\r\n\r\n x\r", "é é 中文 \U0001f600", " x　y", "__init__ a_b 1_000", "12 345,678.90", "\n\n  \n x", "f(x);\r\n\t\treturn", "٠١ ² Ⅷ", "a\tb \t c", "x" * 5000, " " * 70, "▁" * 40]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(counter, library, text):
    assert counter.count(text) == len(library.encode(text))


def test_random_texts(counter, library, monkeypatch):
    monkeypatch.setattr(t, "SLICE", 50)
    monkeypatch.setattr(t, "MEMO", 100)
    rng = random.Random(5)
    letters = "aeiou tnrsTHE  .,;:()'\"-_\n\t\r0123 éüßЖ中▁<>/{}\\$"
    pieces = [p.replace("▁", " ") for p in map(library.id_to_piece, rng.sample(range(300, 32000), 400))]
    for _ in range(500):
        text = "".join(rng.choice(letters) if rng.random() < 0.6 else rng.choice(pieces) for _ in range(rng.randrange(0, 260)))
        assert counter.count(text) == len(library.encode(text)), repr(text)


def test_whole_texts_where_nothing_is_proved(counter, library):
    known = t.vocabulary(PATH)
    known.cuts = False
    assert t.Counter(known).count("a  b, c") == len(library.encode("a  b, c"))


def test_tables(spark, library):
    rows = [(1, "a b", 5, "x"), (1, "a b", 5, "x"), (None, "The end.", 5, "x"), (2, None, 5, "x"), (3, "", None, None), (4, "the " * 9000, 0, "")]
    schema = "doc_id long, text string, n_tokens int, over_limit string"
    got = t.count_tokens(spark.createDataFrame(rows, schema), PATH)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    n = [len(library.encode(r[1] or "")) for r in rows]
    assert sorted(map(str, got.collect())) == sorted(str(x) for x in spark.createDataFrame([(r[0], len((r[1] or "").encode()), k, k > 4096) for r, k in zip(rows, n)], got.schema).collect())
    assert not t.count_tokens(spark.createDataFrame([], schema), PATH).collect()


def test_query(spark, library):
    from tessera.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op13_token_counts"](spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {d: (len(x.encode()), n := len(library.encode(x)), n > 4096) for d, x in texts.items()} and len(got) == len(texts)

"""Formulas and edge cases of the core operators on small frames."""

import math
import random
import re
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import patterns as p
from tessera.functions import text as t
from tessera.functions import udf_text as u
from tessera.operators import corpus, hooks, metrics, qa, retrieval, tables
from tessera.sources import readers
from tessera.streaming import ingest


def values(spark, column, texts):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_strip_and_ratios(spark):
    texts = ["\t a ", "", None, "a1 b", "...", "é 漢"]
    assert values(spark, t.strip("text"), texts) == [None if x is None else x.strip() for x in texts]
    assert values(spark, t.alpha_ratio("text"), texts)[:2] == [1.0, 0.0]
    assert values(spark, t.letter_ratio("text"), ["a1 b"]) == [0.5]
    stats = values(spark, t.char_stats("text"), ["aab b", "", None])
    assert (round(stats[0].entropy, 6), stats[0].max_ratio) == (1.0, 0.5) and (stats[1].entropy, stats[1].max_ratio) == (0.0, 1.0) and stats[2].entropy is None
    assert values(spark, t.repetition_ratio("text"), ["a\nb\n a \n\nc", "", "\n"]) == [0.5, 0.0, 0.0]


def test_uuid_and_fingerprint(spark):
    import hashlib

    names = ["1\x000", "é"]
    got = values(spark, t.uuid5(corpus.CHUNK_NAMESPACE, F.col("text")), names)
    assert got == [str(uuid.uuid5(uuid.UUID(corpus.CHUNK_NAMESPACE), n)) for n in names]
    assert values(spark, t.sha_fingerprint("text"), [" x\n"]) == ["sha256:" + hashlib.sha256(b"x").hexdigest()]


def test_collapse_phrase():
    rx = re.compile(p.REPEATED_PHRASE)
    rng = random.Random(3)

    def plain(line):
        before = None
        while before != line:
            before, line = line, rx.sub(r"\1", line)
        return line

    for _ in range(3000):
        line = "".join(rng.choice("ab  c\t") for _ in range(rng.randrange(30)))
        assert u.collapse_phrase(line) == plain(line), repr(line)
    assert u.collapse_phrase("one two one two one two") == "one two"


def test_collapse_long_phrase(monkeypatch):
    phrase = " ".join(f"word{i}" for i in range(60))
    assert len(phrase) > 400 and u.collapse_phrase(f"x {phrase} {phrase} y") == f"x {phrase} y"
    assert u.collapse_phrase(f"{phrase} {phrase} {phrase}") == phrase
    rx = re.compile(p.REPEATED_PHRASE)
    rng = random.Random(5)
    monkeypatch.setattr(u, "NEAR", 4)
    monkeypatch.setattr(u, "ANCHOR", 3)
    for _ in range(3000):
        line = "".join(rng.choice("ab  c") for _ in range(rng.randrange(60)))
        before, want = None, line
        while before != want:
            before, want = want, rx.sub(r"\1", want)
        assert u.collapse_phrase(line) == want, repr(line)


def test_breaks_before_headers(spark):
    lines = ["text", "PHASE 1 begins", "", "Setup:", "more", "  Глава 2 ", "end"]
    got = values(spark, corpus.break_before_headers("text"), ["\n".join(lines), "Setup", ""])
    assert got == ["text\n\nPHASE 1 begins\n\nSetup:\nmore\n\n  Глава 2 \nend\n", "Setup\n", "\n"]
    rows = [(i, f"Common footer line\n{'some words of text ' * 20}\nPHASE {i}\n{'other words of text ' * 20}{i}", "en") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    config = u.CleanConfig(boilerplate_min=3)
    one = sorted(map(tuple, corpus.clean_report(docs, config).collect()))
    assert all("Common footer" not in r[3] and "\n\nPHASE" in r[3] for r in one)
    before, corpus.BOILERPLATE = corpus.BOILERPLATE, 0
    try:
        assert sorted(map(tuple, corpus.clean_report(docs, config).collect())) == one
    finally:
        corpus.BOILERPLATE = before


def test_cleaner():
    text = "Page 3\n-----\n12\nSome words of the rules are bro-\nken here\nand go on.\n\nCREDITS\nAnn\nBob\n\nSETUP:\n• one item\n• one item\nA\nall rights reserved by nobody at all, a line of rights only\nlast line"
    assert u.LineCleaner().clean(text) == "Some words of the rules are broken here and go on.\n\nSETUP:\n• one item\nlast line\n"
    assert u.LineCleaner(frozenset({"last line"})).clean("x y\nlast line") == "x y\n"
    assert u.LineCleaner().clean("") == "\n"


def test_clean_report(spark):
    good = " ".join(f"Sentence {w} has quite other words {w[::-1]} than the one before." for w in ("alpha", "bravo", "delta", "gamma"))
    rows = [(1, good, "en"), (2, "1234 5678 9012 3456 " * 20, " "), (3, "", None), (4, None, "en")]
    got = {r.doc_id: r for r in corpus.clean_report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[1].quarantine == 0 and got[2].quarantine == 1 and got[3].quarantine == 1 and got[2].lang == "unknown" and got[3].bad_ratio == 1.0
    assert len(got) == 4


def test_clean_report_by_row(spark):
    """Rows without doc_id, and rows that share one, are cleaned by themselves."""
    text = lambda i: f"Sentence {i} has quite other words than the one before, it is said.\n\nAnother paragraph {i} with some more words in it."
    rows = [(None, text(1), "en"), (None, text(2), "en"), (5, text(3), "en"), (5, None, "en"), (5, text(3), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((str(r.doc_id), r.raw_len or 0, r.clean_text, r.survival, r.quarantine) for r in corpus.clean_report(docs).collect())
    assert got == sorted((str(d), len(x or ""), x or "", 1.0 if x else 0.0, 0 if x else 1) for d, x, _ in rows)
    sums = sorted((str(r.doc_id), r.total, r.bad, r.bad_ratio, r.kept_chars) for r in corpus.paragraph_quality(docs).collect())
    assert sums == sorted((str(d), 2 if x else 0, 0, 0.0 if x else 1.0, len(x) - 2 if x else 0) for d, x, _ in rows)
    merged = corpus.merge_lines(spark.createDataFrame([(1, "a\nb\n\nc:\nd\ne"), (1, "x"), (None, "y\nz"), (2, None), (3, "")], "doc_id long, text string"))
    assert sorted(map(str, map(tuple, merged.collect()))) == sorted(map(str, [(1, 0, "a b"), (1, 1, ""), (1, 2, "c:"), (1, 3, "d e"), (1, 0, "x"), (None, 0, "y z"), (3, 0, "")]))


def test_source_filename(spark):
    from tessera.functions import names

    cases = [("Catan: Seafarers 2", "PDF", 1, "catan_seafarers_2_rules.pdf"), ("Мафия", ".pdf", 1, "mafiia_rules.pdf"), ("", "", 7, "game_7_rules.bin"), (None, "txt", None, "game_rules.txt"), ("Ёлка & Щит", "txt", 1, "iolka_shchit_rules.txt"), ("_Café 1,000_", "txt", 1, "cafe_1000_rules.txt"), ("日本", "txt", 3, "game_3_rules.txt")]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, title string, ext string, game long")
    got = [r[0] for r in df.orderBy("i").select(names.source_filename(F.col("title"), F.col("ext"), F.col("game"))).collect()]
    assert got == [c[3] for c in cases]
    long = spark.createDataFrame([("a" * 400,)], "title string").select(names.source_filename(F.col("title"), "pdf")).first()[0]
    assert len(long) == 255 and long.endswith("a_rules.pdf")


def test_chrf():
    assert u.chrf("ab", "abcdefghij") == pytest.approx(0.125, abs=5e-4) and u.chrf("a b c d", "a b c d e f g") == pytest.approx(0.521, abs=5e-4)
    assert u.chrf("The end.", ["other", "the end."]) == pytest.approx(1.0) and u.chrf("x", []) == 0.0 and u.chrf("x", [None, " "]) == 0.0
    assert u._scored_words('"Yes," he said (twice). a .') == ['"Yes,', '"', "he", "said", "(twice)", ".", "a", "."]


def test_may_repeat():
    """Lines that are passed over have no repeated phrase."""
    rng, rx = random.Random(11), re.compile(p.REPEATED_PHRASE)
    for _ in range(20_000):
        line = " ".join("".join(rng.choice("ab") for _ in range(rng.randrange(1, 3))) for _ in range(rng.randrange(1, 9)))
        assert u._may_repeat(line) or not rx.search(line), line


def test_chunks():
    text = "First sentence here. Second one is longer, with a clause; and more. " * 30
    out = u.chunk_spans(text, 40, 8)
    assert all(len(re.findall(r"\w+|[^\w\s]", c)) <= 40 for c in out) and len(out) > 10
    assert set(re.findall(r"\w+", text)) == set(re.findall(r"\w+", " ".join(out)))
    assert u.chunk_spans("", 10, 2) == [] and u.chunk_spans("w " * 25, 10, 0) == [("w " * 10).strip()] * 2 + [("w " * 5).strip()]


def test_ranking_metrics(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    ranked = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 10), (1, 4, 12), (2, 1, 5)], "qid long, rank int, id long")
    gold = spark.createDataFrame([(1, 10), (1, 12), (1, 99), (2, 6)], "qid long, id long")
    got = {r.qid: r for r in metrics.ranking_metrics(queries, ranked, gold, 4).collect()}
    assert got[1].recall == pytest.approx(2 / 3) and got[1].precision == 0.5 and got[1].ap == pytest.approx((1 + 2 / 4) / 3)
    ideal = sum(1 / math.log2(i + 1) for i in (1, 2, 3))
    assert got[1].ndcg == pytest.approx((1 + 1 / math.log2(5)) / ideal)
    assert got[2].hit == 0 and got[3].recall == 0 and got[3].ndcg == 0


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1, 10, 0.9), (1, 2, 11, 0.8), (2, 1, 7, 0.5)], "qid long, rank int, id long, score double")
    b = spark.createDataFrame([(1, 1, 12, 3.0), (1, 2, 10, 2.0)], "qid long, rank int, id long, score double")
    got = [tuple(r) for r in retrieval.rrf([a, b], 2).orderBy("qid", "rank").collect()]
    assert [g[:3] for g in got] == [(1, 1, 10), (1, 2, 12), (2, 1, 7)]
    assert got[0][3] == pytest.approx(1 / 61 + 1 / 62) and got[2][3] == 0.5
    w = [tuple(r) for r in retrieval.weighted_fusion(a, b, 3, 0.7).orderBy("qid", "rank").collect()]
    assert [x[2] for x in w if x[0] == 1] == [10, 12, 11] and w[-1][3] == 0.5  # rows of one branch only stay what they are


def test_dense_blocks(spark):
    rows = [(i, [float(i % 5), 1.0, float(i)]) for i in range(30)] + [(30, None), (31, [0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = vectors.where("id < 12").withColumnRenamed("id", "qid")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    whole = key(retrieval.dense_top_k(queries, vectors, 3))
    assert len(whole) == 36 and key(retrieval.dense_top_k(queries, vectors, 3, block=5)) == whole
    assert retrieval.dense_top_k(queries, vectors, 2, metric="l2").count() == 24
    assert retrieval.dense_top_k(queries.limit(0), vectors, 2).count() == 0


def test_text_scores():
    assert u.chrf("same words", "Same words") == pytest.approx(1.0) and u.chrf("", "x") == 0.0 and 0 < u.chrf("same word", "same words") < 1
    assert u.lcs_length(list("abcde"), list("xaxcxe")) == 3


def test_qa(spark):
    replies = ['```json\n{"question": "q", "ground_truths": ["a", "b", "c"],}\n```', '{"question": "q", "reference": "r"}', "nothing", '{"score": 4}', '{"score": true}', '{"score": 9}']
    parsed = values(spark, qa.parse_reply("text"), replies)
    assert parsed[0].ground_truths == ["a", "b"] and parsed[1].ground_truths == ["r"] and parsed[2] is None
    assert values(spark, qa.judge_score("text"), replies)[3:] == [4, None, None]
    rows = [("Catan", "How many points win Catan?", ["ten points"], "ten points", "You need ten points, always."), ("Catan", "What?", ["x"], "q", "c"), ("Catan", "Catan?", ["3-5"], "q", "c"), ("Catan", "Catan?", ["x"], "not there", "c"), ("Catan", " ", ["x"], "q", "c")]
    df = spark.createDataFrame(rows, "title string, question string, ground_truths array<string>, quote string, context string")
    assert [r.reason for r in qa.validate(df, letters=r"\p{IsLatin}").collect()] == ["ok", "no_title", "bare_number", "quote_not_in_context", "no_question"]
    groups = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, "a"), (3, "b"), (4, None), (4, "a")], "doc_id long, title string")
    assert [r.doc_id for r in qa.single_title_groups(groups).collect()] == [1]


def test_tables(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, v string, n int")
    new = spark.createDataFrame([(2, "c", None)], "k long, v string, n int")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"]).collect())) == [(1, "a", 1), (2, "c", None)]
    assert sorted(map(tuple, tables.overlay(old, new, ["k"]).collect())) == [(1, "a", 1), (2, "c", 2)]
    wanted = spark.createDataFrame([(" Catan ",), ("catan",), ("Go",)], "title string")
    there = spark.createDataFrame([("GO",)], "title string")
    assert [r.title.strip().lower() for r in tables.get_or_create(there, wanted, "title").collect()] == ["catan"]
    with pytest.raises(Exception, match="not unique"):
        corpus.unique_key(old.union(old), "k").collect()
    children = spark.createDataFrame([(1, 1), (2, 2)], "id long, parent long")
    left, right = tables.delete_cascade(old, children, "k", "parent", old.where("k = 1"))
    assert left.count() == 1 and right.count() == 1


def test_hooks():
    assert hooks.hash_embed(pd.Series(["a b", None]), 8).map(len).tolist() == [8, 8]
    assert hooks.lexical_score(pd.Series(["a b"]), pd.Series(["b c"])).tolist() == [0.5]
    assert hooks.extractive_answer(pd.Series(["ten points"]), pd.Series(["No. You need ten points. Yes."])).tolist() == ["You need ten points."]


def test_sources(spark, tmp_path):
    (tmp_path / "qa.jsonl").write_text('{"id": "1", "question": "q", "ground_truths": "no list", "gold_contexts": [{"text": " x "}]}\n\n{"id": "2"}\n')
    got = readers.qa_records(spark, str(tmp_path / "qa.jsonl")).orderBy("id").collect()
    assert [r.id for r in got] == ["1", "2"] and got[1].ground_truths == [] and got[1].question == ""
    folder = tmp_path / "texts" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_text("one\ntwo")
    assert [r.text for r in readers.texts(spark, str(tmp_path / "texts")).collect()] == ["one\ntwo"]
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k long, v string")
    for _ in range(2):
        readers.append_new(spark, df, str(tmp_path / "out"), ["k"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_ingest(spark, tmp_path):
    landing, target, mark = (str(tmp_path / x) for x in ("landing", "target", "mark"))
    rows = lambda text, ts: spark.createDataFrame([(1, text, "en"), (2, "kept as it is.", "en"), (None, "x", "en")], "doc_id long, text string, lang string").withColumn("ts", F.lit(ts).cast("timestamp"))
    rows("old text.", "2024-01-01").write.parquet(landing)
    ingest.start(spark, landing, target, mark).awaitTermination()
    rows("new text, quite new.", "2024-01-02").limit(1).write.mode("append").parquet(landing)
    ingest.start(spark, landing, target, mark).awaitTermination()
    got = {r.doc_id: r.text for r in ingest.current(spark, target).collect()}
    assert got == {1: "new text, quite new.", 2: "kept as it is."}

"""Catalogue rules, set generation, composed retrieval, storage and archives."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import names as n
from tessera.operators import catalog as c
from tessera.operators import generation as g
from tessera.operators import reports as rp
from tessera.operators import search as s
from tessera.sources import storage as st


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_rules(spark):
    games = spark.createDataFrame([(1, "Chess"), (2, "Go")], "game_id long, title string")
    docs = spark.createDataFrame([(10, 1, "done"), (11, 2, "processing")], "doc_id long, game_id long, status string")
    new = spark.createDataFrame([(3, " chess ")], "game_id long, title string")
    with pytest.raises(c.RuleError):
        c.insert_unique(games, new, "title")
    ok = spark.createDataFrame([(3, "Shogi")], "game_id long, title string")
    assert c.insert_unique(games, ok, "title").count() == 3
    with pytest.raises(c.RuleError):
        c.delete_game(games, docs, 2)
    left, rest = c.delete_game(games, docs, 1)
    assert rows(left) == [(2, "Go")] and rows(rest) == [(11, 2, "processing")]
    with pytest.raises(c.RuleError):
        c.upload(docs, 2, spark.createDataFrame([(12,)], "doc_id long"))
    assert rows(c.upload(docs, 1, spark.createDataFrame([(12,)], "doc_id long"))) == [(11, 2, "processing"), (12, 1, "pending")]
    for name, content in (("a.exe", b"x"), ("a.pdf", b"")):
        with pytest.raises(c.RuleError):
            c.check_file(name, content)
    created, documents = c.create_with_document(games, docs, ok, spark.createDataFrame([(13,)], "doc_id long"), "Rules.PDF", b"x")
    assert created.count() == 3 and documents.count() == 3
    assert [df.count() for df in c.emptied(games, docs)] == [0, 0]
    assert rows(c.game_documents(games, docs, 1)) == [(10, 1, "done")]
    with pytest.raises(c.RuleError):
        c.game_documents(games, docs, 9)
    users = spark.createDataFrame([(1, True), (2, False)], "user_id long, is_admin boolean")
    with pytest.raises(c.RuleError):
        c.delete_user(users, 1)
    assert rows(c.delete_user(users, 2)) == [(1, True)]


def test_bulk_load(spark):
    files = spark.createDataFrame([("a.txt", bytearray(b"rules")), ("b.txt", bytearray(b""))], "path string, content binary")
    games = spark.createDataFrame([], "game_id long, title string")
    manifest = spark.createDataFrame([("Chess", "en", "a.txt"), ("chess ", "en", "a.txt"), ("Go", "en", "b.txt"), ("No", "en", "../a.txt"), (" ", "en", "a.txt"), ("Gone", "en", "c.txt")], "game_title string, lang string, text_path string")
    new, docs = c.bulk_load(manifest, files, games)
    assert new.count() == 1 and {r.text for r in docs.collect()} == {"rules"}
    with pytest.raises(c.RuleError):
        c.bulk_load(manifest.drop("lang"), files, games)
    with pytest.raises(c.RuleError):
        c.bulk_load(manifest.withColumn("text_sha256", F.lit("00")), files, games)
    with pytest.raises(c.RuleError):
        c.bulk_load(manifest, files, spark.createDataFrame([(1, "x")], games.schema))


def test_sentences_and_roles(spark):
    rx = re.compile(r"(?<!\d)[.!?]+(?!\d)(?=(?:\s|$))")
    texts = ["One. Two! Three?", "Version 1.2 is out. Yes", "3. is a number", "", "...", "a.b c. d"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    got = [r[0] for r in df.orderBy("i").select(rp.sentences(F.col("text"))).collect()]
    assert got == [len([x for x in rx.split(t) if x.strip()]) for t in texts]
    users = spark.createDataFrame([(True, True), (False, True), (None, None)], "a boolean, m boolean")
    assert [r[0] for r in users.select(n.user_role(F.col("a"), F.col("m"))).collect()] == ["admin", "moderator", "none"]
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    assert spark.range(1).select(n.expires_at(now, 30) - F.unix_timestamp(now)).first()[0] == 1800


def chunks(spark, k=12):
    texts = [(i // 3, f"Игра {i // 3}", f"Первое правило номер {i}. Второе правило.", f"f{i}") for i in range(k)]
    return spark.createDataFrame(texts, "doc_id long, title string, text string, fingerprint string")


def test_generation(spark, tmp_path):
    def write(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    made = g.build_set(chunks(spark), 6, 0.5, 1, write).collect()
    assert sorted(r.id for r in made) == [f"{i:06d}" for i in range(1, 7)]
    assert sorted(r.question_type for r in made) == ["multi_hop"] * 3 + ["single_hop"] * 3
    single = {r.fingerprints[0] for r in made if r.question_type == "single_hop"}
    assert len(single) == 3 and all(2 <= len(r.fingerprints) <= 3 for r in made if r.question_type == "multi_hop")
    one = g.single_contexts(chunks(spark), 4, 7)
    assert rows(one) == rows(g.single_contexts(chunks(spark), 4, 7)) and one.count() == 4


def test_evidence_rules(spark):
    item = "title string, question string, ground_truths array<string>, evidence array<struct<fragment:int,quote:string>>, fragments array<string>"
    two = ["Первый фрагмент текста", "Второй фрагмент"]
    cases = [
        (("Го", "В игре Го что?", ["да"], [(1, "первый"), (2, "второй")], two), "ok"),
        (("Го", "что сказано?", ["да"], [(None, "Первый"), (None, "второй")], two), "ok"),
        (("Go", "English words only here", ["да"], [(1, "x"), (2, "y")], two), "language"),
        (("Го", "Какая тактика лучше в игре Го?", ["да"], [(1, "первый"), (2, "второй")], two), "forbidden_words"),
        (("Го", "В игре Го сколько?", ["12"], [(1, "первый"), (2, "второй")], two), "bare_number"),
        (("Го", "В игре Го что?", ["да"], [(1, "первый")], two), "evidence_length"),
        (("Го", "В игре Го что?", ["да"], [(1, " "), (2, "второй")], two), "quote_empty"),
        (("Го", "В игре Го что?", ["да"], [(1, "первый"), (3, "второй")], two), "bad_fragment"),
        (("Го", "В игре Го что?", ["да"], [(1, "первый"), (2, "первый")], two), "quote_not_in_fragment"),
    ]
    got = g.validate_evidence(spark.createDataFrame([x for x, _ in cases], item)).collect()
    assert [r.reason for r in got] == [y for _, y in cases] and got[1].question == "В игре Го что сказано?"
    records = spark.createDataFrame([(1, "a", "about a", ["f"]), (2, "zz", "about a", ["f"]), (3, "", "x", ["f"]), (4, "a", "a", [])], "ord int, title string, question string, fingerprints array<string>")
    assert {r.ord: r.verdict for r in g.criticise(records).collect()} == {1: "accepted", 2: "no title", 3: "unverified"}
    assert sorted(r.ord for r in g.critic_pass(records, 2).collect()) == [1, 2, 3]


def test_search(spark):
    with pytest.raises(ValueError):
        s.SearchConfig(mode="hybrid", hybrid_index=False)
    assert s.branch_sizes(s.SearchConfig(dense_k=3, sparse_k=30), 10) == (10, 30, 10)
    assert set(s.two_stage_grid(s.SearchConfig(), [3, 10], [3, 5])) == {"two_stage_3_3", "two_stage_10_3", "two_stage_10_5"}
    assert len(s.hybrid_grid(s.SearchConfig(), [5, 10], [0.3, 0.7])) == 6
    passages = spark.createDataFrame([(i, f"{w} common text", [1.0, float(i)], f"T{i}") for i, w in enumerate(["one", "two", "three", "four", "five", "six"])], "id long, text string, embedding array<double>, title string")
    questions = spark.createDataFrame([(100, "four common", [1.0, 0.1])], "qid long, text string, embedding array<double>")
    for fusion in ("rrf", "weighted"):
        got = s.retrieve(questions, passages, s.SearchConfig(mode="hybrid", fusion=fusion), top_k=3).collect()
        assert [r["rank"] for r in got] == [1, 2, 3] and 3 in {r["id"] for r in got}
    context = s.retrieve_with_context(questions, passages, s.SearchConfig(two_stage=True, first_k=6, second_k=2))
    said = s.answer(questions, context).first()
    assert "T3" in said["context"] and said["history"] == s.NO_HISTORY and said["answer"]
    assert s.answer(questions).first()["context"] == ""
    answers = spark.createDataFrame([(1, "q", "a b"), (2, "q", None), (3, "", "x"), (4, "q", "x")], "qid long, question string, answer string")
    refs = spark.createDataFrame([(1, ["a b", "c"]), (2, ["a"]), (3, ["a"])], "qid long, references array<string>")
    row = s.evaluate_answers(answers, refs).first()
    assert (row.rouge1_recall, row.rougeL_f1, row.answered, row.failed, row.skipped) == (1.0, 1.0, 1, 1, 2)


def test_storage(spark, tmp_path):
    store = st.Storage(spark, str(tmp_path))
    key, document = store.upload(b"abc", "Rules.PDF")
    assert key == f"rules/sources/by-hash/{document}.pdf" and store.get(key) == b"abc" and store.exists(key)
    assert store.upload_text("x")[0].startswith("rules/processed/by-hash/")
    assert store.delete([key, "none"]) == ["none"] and not store.exists(key)
    table = f"{tmp_path}/t"
    assert st.create_table(spark, table, "id long").count() == 0 and st.create_table(spark, table, "id long").columns == ["id"]
    assert st.drop_table(spark, table) and not st.drop_table(spark, table)
    archive = st.write_zip({"b/x.txt": b"1", "a.txt": b"2"}, ("manifest.csv", "h"))
    assert list(st.read_zip(archive)) == ["a.txt", "b/x.txt", "manifest.csv"]
    (tmp_path / "zips").mkdir()
    (tmp_path / "zips" / "one.zip").write_bytes(archive)
    assert sorted((r.path, bytes(r.content)) for r in st.archives(spark, f"{tmp_path}/zips").collect()) == [("a.txt", b"2"), ("b/x.txt", b"1"), ("manifest.csv", b"h")]
    with pytest.raises(ValueError):
        st.read_zip(st.write_zip({"../x": b"1"}))
    (tmp_path / "l.jsonl").write_text("{}\n\n  \n{}\n")
    assert st.nonblank_lines(spark, str(tmp_path / "l.jsonl")) == 2
    stored = spark.createDataFrame([("f1", "EN "), ("f2", "ru")], "fingerprint string, lang string")
    assert st.chunks_for_evaluation(stored, None, "en").count() == 1
    assert st.chunks_for_evaluation(stored.limit(0), lambda: stored).count() == 2


def test_prompt_parts(spark):
    """Title before the question, a placeholder where nothing is found, history in the prompt."""
    from tessera.operators import hooks, tables

    chunks = spark.createDataFrame([(100, "the fox runs", "a"), (101, "the cow eats", "b")], "id long, text string, tag string").withColumn("embedding", hooks.embed(F.col("text")))
    queries = spark.createDataFrame([(1, "who runs", " Chess ", "a"), (2, "who eats", None, "b"), (3, "who", "Go", "none")], "qid long, text string, title string, tag string")
    assert [r.text for r in s.titled(queries).orderBy("qid").collect()] == ["Игра: Chess. who runs", "who eats", "Игра: Go. who"]
    got = {r.qid: r.context for r in s.question_contexts(queries, chunks, embedder=hooks.embed, same=True).collect()}
    assert got[1].startswith("[1] Игра: Chess\nРелевантность: ") and "the fox runs" in got[1] and got[2].startswith("[1] Игра: Unknown") and got[3] == s.NOT_FOUND
    pairs = spark.createDataFrame([(1, i, f" q{i} ", "a" * 40 if i == 3 else f"a{i}") for i in range(1, 5)] + [(2, 1, "x" * 200, "y"), (3, 1, None, "z")], "conv_id long, turn long, q string, a string")
    history = {r.conv_id: r.history for r in tables.qa_history(pairs, turns=3, each=30, total=110).collect()}
    assert history[1] == tables.HISTORY_HEAD + "QUESTION1: q2\nANSWER1: a2\n\nQUESTION2: q3\nANSWER2: " + "a" * 30 + "\n...[обрезано]"
    assert history[3] == tables.HISTORY_HEAD + "QUESTION1: \nANSWER1: z" and set(history) == {1, 2, 3}
    assert set(tables.qa_history(pairs, each=500, total=50).select("conv_id").toPandas().conv_id) == {1, 3}

    def echo(prompts):
        return prompts.where(~prompts.str.contains("mute"), "")

    asked = spark.createDataFrame([(1, "who runs"), (2, "mute")], "qid long, text string")
    told = spark.createDataFrame([(1, "QUESTION1: before")], "qid long, history string")
    got = {r.qid: r for r in s.answer(asked, None, told, generator=echo).collect()}
    assert got[1].answer == "CONTEXT:\n\n\nHISTORY:\nQUESTION1: before\n\nQUESTION:\nwho runs" and got[2].answer == s.NO_ANSWER and got[2].history == s.NO_HISTORY

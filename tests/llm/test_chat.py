"""Chat formatting: exact round trips and reply trees."""

import hashlib

import numpy as np

from tessera.llm import chat
from tessera.llm.common import Stage


def test_round_trip():
    rng = np.random.default_rng(0)
    alphabet = ["<s>", "</s>", "</S>", "[INST]", "[/inst]", "\\", "\\l", "\\b", "<", "[", "s>", "a", " ", "\n", "é", "\U0001f600", ""]
    for _ in range(3000):
        turns = [("".join(rng.choice(alphabet, 3)) if rng.random() < 0.3 else "assistant", "".join(rng.choice(alphabet, int(rng.integers(0, 9))))) for _ in range(int(rng.integers(0, 5)))]
        text, mask = chat.format_turns(turns)
        assert chat.parse_turns(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]
        assert text.count("</s>") == text.count("<s>") == len(turns)


def test_paths(spark):
    rows = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 5.0), (1, 4, 2, 1.0), (1, 5, 2, 9.0), (2, 1, 7, None), (2, 3, 3, 0.0), (2, 4, 9, 0.0), (2, 9, 4, 0.0), (3, 1, 1, 0.0)]
    rows += [(4, i, i - 1, 1.0) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "tree long, msg long, parent long, score double")
    got = {}
    for r in chat.reply_paths(df, Stage(spark, "paths")).orderBy("place").collect():
        got.setdefault((r.tree, r.path), []).append(r.msg)
    assert got == {(1, 0): [1, 2, 5], (1, 1): [1, 3], (1, 2): [1, 2, 4], (2, 0): [1], (2, 1): [3], (2, 2): [4, 9], (3, 0): [1], (4, 0): list(range(1, 40))}
    best = chat.reply_paths(df, Stage(spark, "paths"), best=1)
    assert best.where("path > 0").count() == 0
    assert chat.reply_paths(df.limit(0), Stage(spark, "paths")).count() == 0


def test_digest(spark):
    rows = [(1, 2, "assistant", "b\\</s>"), (1, 1, "user", None), (2, 0, None, "x"), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, 1, "assistant", "n"), (3, None, "assistant", "é" * 50_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, msg string")
    got = {r.conv_id: r for r in chat.conversations_digest(df, Stage(spark, "chat")).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert set(got) == {1, 2, 3, None, -1}
    assert got[1].turns_sha256 == sha("user\n\nassistant\nb\\</s>\n") and got[1].loss_sha256 == sha("b\\</s>") and got[1].loss_chars == 6
    assert got[2].n_turns == 3 and got[2].loss_chars == 0 and got[3].loss_chars == 50_000
    assert got[-1].turns_sha256 == sha("user\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n") and got[-1].loss_chars == 21
    only = chat.conversations_digest(df.limit(0), Stage(spark, "chat")).collect()
    assert [r.conv_id for r in only] == [-1]


def test_sql(spark):
    import duckdb

    from tessera.llm import queries

    got = queries.QUERIES["op5_chat"](spark, "/root/testdata/sf0.001").collect()
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(queries.ORACLE_SQL["op5_chat"]).fetchall())


def test_long_conversation(spark):
    """Storage grows with the turns: no message holds its ancestors."""
    n = 3000
    rows = spark.range(n).selectExpr("7L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "cast(id as string) text")
    got = {r.conv_id: r for r in chat.conversations_digest(rows, Stage(spark, "long")).collect()}
    whole = "".join(f"{'assistant' if i % 2 else 'user'}\n{i}\n" for i in range(n))
    assert got[7].n_turns == n and got[7].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and set(got) == {-1, 7}

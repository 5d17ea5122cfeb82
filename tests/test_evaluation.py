"""The whole evaluation against plain Python, and what its memo runs anew."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from tessera.functions import udf_text as u
from tessera.operators import evaluation as e
from tessera.operators import hooks
from tessera.operators.search import SearchConfig
from tessera.sources.snapshots import SnapshotTable

SAMPLES = "qid long, question string, context string, answer string, references array<string>"


def values(df):
    return {r.metric: r.value for r in df.collect()}


def test_scores_and_judge(spark):
    rows = [(1, "who?", "the red fox ran", "the fox ran", ["a red fox", " the fox ran "]), (2, "what?", "", "blue", ["green"]), (3, "why?", "c", None, ["x"]), (4, "", "c", "a", ["x"]), (5, "q", "c", "bad", ["x"]), (6, "q", "c", "y", []), (7, "q", "c", "", [None, " "])]
    samples = spark.createDataFrame(rows, SAMPLES)

    def judge(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: None if "answer: bad" in p else 9 if "relevance" in p and "blue" in p else 5 if "fox" in p else 2).astype("Int64")

    got = values(e.evaluate(samples, judge=judge))
    used = [r for r in rows if r[1] and r[4] and r[3] is not None]
    cos = lambda a, b: float(np.dot(a, b)) if a.any() and b.any() else 0.0
    vec = lambda x: np.array(hooks.hash_embed(pd.Series([x]))[0], float)
    truths = lambda r: [x.strip() for x in r[4] if x and x.strip()]
    assert got["n_evaluated"] == len(used) == 4 and got["errors"] == 1
    assert got["chrfpp"] == pytest.approx(np.mean([u.chrf(r[3], truths(r)) for r in used]))
    assert got["similarity"] == pytest.approx(np.mean([max([0.0, *(cos(vec(r[3]), vec(x)) for x in truths(r))]) for r in used]), abs=1e-6)
    assert got["rouge1_recall"] == pytest.approx(1 / 4) and got["rougeL_f1"] == pytest.approx(1 / 4)
    judged = {(r.qid, r.metric): (r.state, r.score) for r in e.judged(samples.where("qid in (1, 2, 5, 7)"), judge).collect()}
    assert judged[(1, "faithfulness")] == ("scored", 5) and judged[(2, "faithfulness")] == ("n/a", None) and judged[(2, "relevance")] == ("error", None)
    assert judged[(5, "correctness")] == ("error", None) and judged[(7, "correctness")] == ("n/a", None) and judged[(2, "correctness")] == ("scored", 2)
    assert (got["judge_faithfulness"], got["judge_n_scored_faithfulness"], got["judge_n_na_faithfulness"], got["judge_errors_faithfulness"]) == (1.0, 1, 2, 1)
    assert got["judge_correctness"] == pytest.approx((1 + 0.25) / 2)
    assert "judge_relevance" not in values(e.evaluate(samples, judge=None))


def test_memo(spark, tmp_path):
    rng = np.random.default_rng(2)
    texts = [f"passage {i} says that item {i} costs {i * 3} coins" for i in range(30)]
    chunks = SnapshotTable(spark, str(tmp_path / "chunks"), "id", "id long, text string, title string, embedding array<double>")
    chunks.append(spark.createDataFrame([(100 + i, x, "t", rng.normal(size=8).tolist()) for i, x in enumerate(texts)], chunks.schema))
    questions = spark.createDataFrame([(i, f"what does item {i} cost", rng.normal(size=8).tolist()) for i in range(5)], "qid long, text string, embedding array<double>")
    gold = spark.createDataFrame([(i, 100 + i) for i in range(5)], "qid long, id long")
    references = spark.createDataFrame([(i, [f"{i * 3} coins"]) for i in range(5)], "qid long, references array<string>")

    def run(root="memo", config=SearchConfig(), gold=gold, **how):
        memo = e.Memo(spark, str(tmp_path / root))
        out = e.full_evaluation(memo, questions, chunks, gold, references, config, **how)
        return {(r.section, r.metric): r.value for r in out.collect()}, memo.ran

    first, ran = run()
    assert ran == ["ranking", "retrieval", "answers", "scores"] and ("retriever", "recall") in first and ("pipeline", "judge_correctness") in first
    again, ran = run()
    assert again == first and ran == []
    assert run(trials=3)[1] == ["scores"]
    assert run(gold=gold.where("qid > 0"))[1] == ["retrieval"]
    assert run(gold=gold.orderBy("id", ascending=False).repartition(3))[1] == []
    assert run(config=replace(SearchConfig(), top_k=3))[1] == ["ranking", "retrieval", "answers", "scores"]
    chunks.upsert(spark.createDataFrame([(100, "passage 0 changed", "t", [0.5] * 8)], chunks.schema))
    changed, ran = run()
    assert ran == ["ranking", "retrieval", "answers", "scores"] and changed == run(root="other")[0]

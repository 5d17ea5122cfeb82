"""One evaluation of retrieval and answers, with a judge, over memoised steps.

Scores are computed for each sample as columns and averaged once. The judge is a hook: a function of a Series of prompts
that gives scores from 1 to 5 or null. A metric for which a sample lacks a part is not available (n/a) and isn't
asked; a judge that gives no valid score counts as an error.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import asdict

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..functions import udf_text as u
from ..sources.snapshots import SnapshotTable
from ..sources.storage import Storage
from . import hooks
from . import search as s

#: What each metric of the judge needs, and what it is shown.
JUDGED: dict[str, tuple[str, ...]] = {"faithfulness": ("question", "context", "answer"), "relevance": ("question", "answer"), "correctness": ("question", "truths", "answer")}
SCORES = ("chrfpp", "rouge1_recall", "rouge2_recall", "rougeL_f1", "similarity")
_WORDS = r"([0-9]+|[a-zа-яё]+)"


def _tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(_WORDS), 1)


def _texts(c: str) -> Column:
    """The texts of an array that aren't blank, stripped."""
    return F.coalesce(F.filter(F.transform(c, t.strip), lambda x: x != ""), F.array().cast("array<string>"))


def answer_scores(samples: DataFrame, embedder: Callable = hooks.hash_embed) -> DataFrame:
    """samples (qid, answer, references) with SCORES: for each measure the best of the references, 0 where there are none."""
    rows = samples.withColumn("truth", _texts("references")).withColumn("chrfpp", u.chrf_pp("answer", "truth"))

    def embedded(texts: pd.Series) -> pd.Series:
        return embedder(texts)

    vector = hooks.as_column(embedded, T.ArrayType(T.FloatType()))
    one = rows.select("qid", _tokens(F.coalesce("answer", F.lit(""))).alias("a"), F.transform("truth", _tokens).alias("r"))
    rouge = s.best_rouge(one, "qid", "a", "r")
    pairs = rows.select("qid", vector(F.coalesce("answer", F.lit(""))).alias("p"), F.explode_outer("truth").alias("x")).select("qid", "p", vector(F.coalesce("x", F.lit(""))).alias("v"))
    return rows.drop("truth").join(rouge, "qid").join(s.best_similarity(pairs, "qid", "p", "v"), "qid")


def overlap_judge(prompts: pd.Series) -> pd.Series:
    """A stand-in for a judge: 1 to 5 by the share of the answer's words that the prompt's other parts have."""
    out = []
    for prompt in prompts:
        *rest, answer = prompt.lower().split("\nanswer: ")
        words, seen = set(answer.split()), set(" ".join(rest).split())
        out.append(1 + round(4 * len(words & seen) / len(words)) if words else None)
    return pd.Series(out, dtype="Int64")


def judged(samples: DataFrame, judge: Callable = overlap_judge, trials: int = 1) -> DataFrame:
    """(qid, metric, state, score): state is scored, n/a or error; score the median of the valid trials.

    samples (qid, question, context, answer, references). The judge sees the metric's name and the parts it needs.
    """
    parts = {"question": F.col("question"), "context": F.col("context"), "answer": F.col("answer"), "truths": F.array_join(F.transform(_texts("references"), lambda x: F.concat(F.lit("- "), x)), "\n")}
    rows = None
    for metric, needs in JUDGED.items():
        able = F.lit(True)
        for name in needs:
            able = able & (F.coalesce(parts[name], F.lit("")) != "")
        prompt = F.concat_ws("\n", F.lit(f"metric: {metric}"), *[F.concat(F.lit(f"{name}: "), parts[name]) for name in needs])
        one = samples.select("qid", F.lit(metric).alias("metric"), F.when(able, prompt).alias("prompt"))
        rows = one if rows is None else rows.unionByName(one)
    ask = hooks.as_column(judge, T.LongType())
    asked = rows.where("prompt is not null").select("qid", "metric", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"), "prompt")
    given = asked.select("qid", "metric", ask("prompt").alias("score")).withColumn("score", F.when(F.col("score").between(1, 5), F.col("score")))
    scores = s.judge(given, ["qid", "metric"])
    state = F.when(F.col("prompt").isNull(), "n/a").when(F.col("score").isNull(), "error").otherwise("scored")
    return rows.join(scores, ["qid", "metric"], "left").select("qid", "metric", state.alias("state"), "score")


def evaluate(samples: DataFrame, embedder: Callable = hooks.hash_embed, judge: Callable | None = overlap_judge, trials: int = 1) -> DataFrame:
    """(metric, value): means over the answered samples, their numbers, and the judge's metrics from 0 to 1 with numbers.

    samples (qid, question, context, answer, references); a null answer has failed. Samples without a question or
    references aren't evaluated. With judge None there are no judge's metrics.
    """
    usable = (F.coalesce("question", F.lit("")) != "") & (F.coalesce(F.size("references"), F.lit(0)) > 0)
    used = samples.where(usable)
    done = used.where("answer is not null")
    means = answer_scores(done.select("qid", "answer", "references"), embedder).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in SCORES], F.count("*").cast("double").alias("n_evaluated"))
    counts = used.agg(F.count_if(F.col("answer").isNull()).cast("double").alias("errors"))
    out = _long(means, [*SCORES, "n_evaluated"]).unionByName(_long(counts, ["errors"]))
    if judge is None:
        return out
    states = judged(done, judge, trials).groupBy("metric").agg(
        F.coalesce(F.avg((F.col("score") - 1) / 4), F.lit(0.0)).alias("mean"), F.count_if(F.col("state") == "scored").cast("double").alias("n_scored"),
        F.count_if(F.col("state") == "n/a").cast("double").alias("n_na"), F.count_if(F.col("state") == "error").cast("double").alias("n_error"),
    )
    names = F.create_map(*[F.lit(x) for pair in (("mean", "judge_"), ("n_scored", "judge_n_scored_"), ("n_na", "judge_n_na_"), ("n_error", "judge_errors_")) for x in pair])
    long = states.unpivot(["metric"], ["mean", "n_scored", "n_na", "n_error"], "kind", "value")
    return out.unionByName(long.select(F.concat(names[F.col("kind")], "metric").alias("metric"), "value"))


def _long(row: DataFrame, names: list[str]) -> DataFrame:
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("x")).select("x.*")


class Memo:
    """Results of steps as Parquet under a root, each found by what made it.

    A step's key is a digest of its name, its parameters in canonical form and the keys of its inputs. An input is another
    step, a snapshot table at its newest version, or any frame, whose key is a digest of its rows in any order. So a
    changed table or parameter runs anew only the steps that depend on it. A step whose writing failed isn't found.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.storage, self.ran = Storage(spark, self.root), []

    def key_of(self, source: DataFrame | SnapshotTable | Step) -> str:
        if isinstance(source, Step):
            return source.key
        if isinstance(source, SnapshotTable):
            return f"{source.path}@{source.log.read().version}"
        h = F.xxhash64(*[F.col(f"`{c}`") for c in source.columns])
        wide = h.cast("decimal(38,0)")
        row = source.agg(F.count("*").alias("n"), F.sum(wide).alias("s"), F.bit_xor(h).alias("x"), F.sum(F.pmod(wide * 1_000_003, F.lit(2_147_483_647).cast("decimal(38,0)"))).alias("m")).first()
        return hashlib.sha256(f"{source.schema.simpleString()}|{row.n}|{row.s}|{row.x}|{row.m}".encode()).hexdigest()

    def step(self, name: str, make: Callable[..., DataFrame], params: Mapping | object = (), **inputs) -> Step:
        """The step's result, from before if there is one. make(**inputs) gets frames; params are what else decides the result."""
        plain = asdict(params) if hasattr(params, "__dataclass_fields__") else dict(params)
        keys = {k: self.key_of(v) for k, v in sorted(inputs.items())}
        key = hashlib.sha256(json.dumps([name, plain, keys], sort_keys=True, default=str, ensure_ascii=False).encode()).hexdigest()
        if not self.storage.exists(f"{key}/_SUCCESS"):
            frames = {k: v.frame if isinstance(v, Step) else v.read() if isinstance(v, SnapshotTable) else v for k, v in inputs.items()}
            make(**frames).write.mode("overwrite").parquet(f"{self.root}/{key}")
            self.ran.append(name)
        return Step(key, self.spark.read.parquet(f"{self.root}/{key}"))


class Step:
    def __init__(self, key: str, frame: DataFrame):
        self.key, self.frame = key, frame


def full_evaluation(memo: Memo, questions, chunks, gold, references, config: s.SearchConfig = s.SearchConfig(), generator: Callable = hooks.extractive_answer, judge: Callable | None = overlap_judge, trials: int = 1) -> DataFrame:
    """(section, metric, value): retrieval against gold, then the answers made from what was retrieved.

    questions (qid, text, embedding), chunks (id, text, title, embedding), gold (qid, id), references (qid, references):
    frames or snapshot tables. Ranking, retrieval metrics, answers and their scores are steps of their own; hooks count by name.
    """
    ranked = memo.step("ranking", lambda questions, chunks: s.retrieve(questions, chunks, config), config, questions=questions, chunks=chunks)
    k = config.second_k if config.two_stage else config.top_k

    def measured(ranked: DataFrame, questions: DataFrame, gold: DataFrame) -> DataFrame:
        per = s.m.ranking_metrics(questions, ranked, gold, k)
        row = s.m.macro_average(per)
        return _long(row, row.columns)

    def answered(ranked: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
        contexts = s.r.context(ranked.join(chunks.select("id", "text", "title"), "id"))
        return s.answer(questions.select("qid", "text"), contexts, generator=generator).join(questions.select("qid", F.col("text").alias("question")), "qid").select("qid", "question", "context", "answer")

    retrieval = memo.step("retrieval", measured, {"k": k}, ranked=ranked, questions=questions, gold=gold)
    answers = memo.step("answers", answered, {"generator": generator.__name__}, ranked=ranked, questions=questions, chunks=chunks)
    how = {"judge": judge.__name__ if judge else None, "trials": trials}
    scores = memo.step("scores", lambda answers, references: evaluate(answers.join(references, "qid", "left"), judge=judge, trials=trials), how, answers=answers, references=references)
    return retrieval.frame.select(F.lit("retriever").alias("section"), "metric", "value").unionByName(scores.frame.select(F.lit("pipeline").alias("section"), "metric", "value"))

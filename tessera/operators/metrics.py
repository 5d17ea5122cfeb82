"""Scores of rankings, generated texts and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ngrams


def ranking_metrics(queries: DataFrame, ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(qid, recall, precision, ap, ndcg, hit) for every query (qid); without gold all are 0.

    ranked (qid, rank, id), gold (qid, id). A repeated answer counts at its first rank only.
    """
    gold = gold.select("qid", "id").distinct()
    marked = ranked.where(F.col("rank") <= k).join(gold.withColumn("gold", F.lit(1)), ["qid", "id"], "left")
    return _measured(queries, marked, gold.groupBy("qid").agg(F.count("*").alias("relevant")), k)


def tag_metrics(queries: DataFrame, ranked: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """ranking_metrics with all chunks (id, tag) of a query's (qid, tag) tag but itself as gold, which are counted instead of listed:
    the rows of this step are those of the ranking and of the chunks."""
    asked = queries.where("tag is not null").select("qid", F.col("tag").alias("qt"))
    known = chunks.where("id is not null and tag is not null").select("id", F.col("tag").alias("qt")).distinct().withColumn("gold", F.lit(1))
    marked = ranked.where(F.col("rank") <= k).join(asked, "qid", "left").join(known, ["id", "qt"], "left").withColumn("gold", F.when(F.col("qid") != F.col("id"), F.col("gold")))
    own = known.select(F.col("id").alias("qid"), "qt", F.col("gold").alias("own"))
    sizes = known.groupBy("qt").agg(F.count("*").alias("all"))
    relevant = asked.join(sizes, "qt").join(own, ["qid", "qt"], "left").select("qid", (F.col("all") - F.coalesce("own", F.lit(0))).alias("relevant"))
    return _measured(queries, marked, relevant, k)


def _measured(queries: DataFrame, marked: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """The measures from answers (qid, rank, id, gold: null or 1) and (qid, relevant)."""
    hits = marked.withColumn("nth", F.row_number().over(Window.partitionBy("qid", "id").orderBy("rank"))).withColumn("hit", F.when((F.col("nth") == 1) & F.col("gold").isNotNull(), 1).otherwise(0))
    so_far = F.sum("hit").over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    per = hits.withColumn("so_far", so_far).groupBy("qid").agg(
        F.sum("hit").alias("hits"), F.sum(F.col("hit") * F.col("so_far") / F.col("rank")).alias("gains"), F.sum(F.col("hit") / F.log2(F.col("rank") + 1)).alias("dcg")
    )
    rows = queries.select("qid").join(per, "qid", "left").join(sizes, "qid", "left").na.fill(0)
    top = F.least(F.col("relevant"), F.lit(k)).cast("int")
    ideal = F.when(top > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(top, F.lit(1))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1)))
    zero = F.lit(0.0)
    return rows.select(
        "qid",
        F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).otherwise(zero).alias("recall"),
        (F.col("hits") / k).alias("precision"),
        F.when(top > 0, F.col("gains") / top).otherwise(zero).alias("ap"),
        F.coalesce(F.col("dcg") / ideal, zero).alias("ndcg"),
        F.when(F.col("hits") > 0, 1.0).otherwise(zero).alias("hit"),
    )


def macro_average(per_query: DataFrame, names: list[str] = ["recall", "precision", "ap", "ndcg", "hit"]) -> DataFrame:
    return per_query.agg(*[F.avg(n).alias(n) for n in names], F.count("*").alias("n"))


def latency_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, population deviation and exact linear 50th and 95th percentiles."""
    return rows.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"), F.count(value).alias("n")
    )


def rouge_recall(pairs: DataFrame, n: int, key: list[str], predicted: str, reference: str) -> DataFrame:
    """key and rouge: clipped n-gram matches over the reference's n-grams; 0 without any. Tokens are arrays."""

    def counted(side: str, name: str) -> DataFrame:
        return pairs.select(*key, F.explode(ngrams(F.col(side), n)).alias("gram")).groupBy(*key, "gram").agg(F.count("*").alias(name))

    both = counted(reference, "r").join(counted(predicted, "p"), [*key, "gram"], "left")
    sums = both.groupBy(*key).agg((F.sum(F.least(F.coalesce("p", F.lit(0)), F.col("r"))) / F.sum("r")).alias("rouge"))
    return pairs.select(*key).join(sums, key, "left").select(*key, F.coalesce("rouge", F.lit(0.0)).alias("rouge"))


def judge_means(scores: DataFrame, metric: str = "metric", score: str = "score") -> DataFrame:
    """Mean of (s - 1) / 4 over the scores that aren't null, with their number and that of the missing ones."""
    return scores.groupBy(metric).agg(F.avg((F.col(score) - 1) / 4).alias("mean"), F.count(score).alias("n_scored"), F.count_if(F.col(score).isNull()).alias("n_na"))


def compare_runs(base: DataFrame, best: DataFrame) -> DataFrame:
    """metric, baseline, best, delta from two tables (metric, value); missing values stay null."""
    a, b = base.select("metric", F.col("value").alias("baseline")), best.select("metric", F.col("value").alias("best"))
    return a.join(b, "metric", "full").select("metric", "baseline", "best", (F.col("best") - F.col("baseline")).alias("delta"))

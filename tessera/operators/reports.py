"""Reports on corpora, evaluation sets and experiments."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as p
from ..functions import text as t


def flag_share(df: DataFrame, flag: str, key: str) -> DataFrame:
    """One row: mean of a 0/1 flag, its count, all rows and distinct keys."""
    return df.agg(F.avg(flag).alias("share"), F.count_if(F.col(flag) == 1).alias("flagged"), F.count("*").alias("n"), F.count_distinct(key).alias("keys"))


def worst(df: DataFrame, by: str, key: str, n: int = 15) -> DataFrame:
    return df.orderBy(by, key).limit(n)


def extremes(df: DataFrame, text: str, key: str, n: int = 3, preview: int = 100) -> DataFrame:
    """The n shortest and n longest texts (end: shortest or longest), with a preview."""
    from ..functions.names import cut

    rows = df.select(key, F.length(text).cast("long").alias("chars"), cut(F.col(text), preview).alias("preview"))
    low = rows.orderBy("chars", key).limit(n).withColumn("end", F.lit("shortest"))
    return low.unionByName(rows.orderBy(F.desc("chars"), key).limit(n).withColumn("end", F.lit("longest")))


def array_counts(df: DataFrame, array: str) -> DataFrame:
    """(value, n): how many rows each distinct member of an array column occurs in."""
    return df.select(F.explode(F.array_distinct(array)).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def size_histogram(df: DataFrame, by: str, array: str) -> DataFrame:
    return df.groupBy(by, F.size(array).cast("long").alias("size")).agg(F.count("*").alias("n"))


def length_stats(question: Column, truths: Column, contexts: Column) -> Column:
    """struct of lengths: question, first truth (0 if none), all contexts together."""
    total = F.aggregate(contexts, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(F.length(x), F.lit(0)))
    first = F.coalesce(F.length(F.try_element_at(truths, F.lit(1))), F.lit(0))
    return F.struct(F.length(question).cast("long").alias("question"), first.cast("long").alias("truth"), total.alias("contexts"))


def top_reasons(df: DataFrame, reasons: str, n: int = 10) -> DataFrame:
    rows = df.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "reason").limit(n)


def dataset_state(records: DataFrame) -> DataFrame:
    """One row: the greatest numeric id (0 if none), records of one and of several contexts, distinct fingerprints."""
    number = F.col("id").try_cast("long")
    several = F.coalesce(F.col("question_type") == "multi_hop", F.lit(False))
    prints = F.transform("gold_contexts", lambda g: F.coalesce(g["fingerprint"], t.sha_fingerprint(g["text"])))
    return records.select(number.alias("number"), several.alias("several"), prints.alias("prints")).agg(
        F.coalesce(F.max("number"), F.lit(0)).alias("last_id"), F.count_if(~F.col("several")).alias("single"), F.count_if("several").alias("multi"),
        F.size(F.array_distinct(F.flatten(F.collect_set("prints")))).cast("long").alias("fingerprints"),
    )


def exists(df: DataFrame) -> bool:
    return not df.isEmpty()


def winner(runs: DataFrame, by: list[str], excluded: Column) -> DataFrame:
    """The best run of those that aren't excluded."""
    return runs.where(~excluded).orderBy(*[F.desc(c) for c in by], "run").limit(1)


def corpus_tokens(c: Column | str) -> Column:
    """Words with hyphens, section numbers, numbers and ranges, in lower case."""
    return F.transform(F.regexp_extract_all(c, F.lit(f"({p.CORPUS_TOKEN})"), 1), F.lower)


def sentences(c: Column) -> Column:
    """Number of sentences: parts between runs of .!? that don't touch digits and end a word, without blank ones."""
    return F.size(F.filter(F.split(c, p.SENTENCE_END), lambda x: t.strip(x) != ""))


def grid(spark: SparkSession, axes: dict[str, list], keep: str | None = None) -> DataFrame:
    """One row per combination of the listed values that meets ``keep`` (an SQL condition), as run and the axes."""
    rows = [(",".join(f"{k}={v}" for k, v in zip(axes, values)), *values) for values in product(*axes.values())]
    df = spark.createDataFrame(rows, ["run", *axes])
    return df.where(keep) if keep else df


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))

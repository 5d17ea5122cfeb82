"""Sources and sinks: texts, CSV and JSONL with explicit schemas, vector tables, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t

QA_SCHEMA = (
    "id string, question_type string, game_title string, question string, ground_truths array<string>, "
    "gold_contexts array<struct<text: string, fingerprint: string, metadata: struct<game_titles: array<string>, lang: string, source_doc_id: string>>>, "
    "evidence_quote string, evidence array<struct<fragment: int, quote: string>>"
)
MANIFEST_SCHEMA = "doc_id string, game_title string, lang string, text_path string, source_path string, source_sha256 string, source_mime string"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of every text file below path."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, length, content) of every file below path."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return df.select("path", F.sha2("content", 256).alias("sha256"), "length", "content")


def manifest(spark: SparkSession, path: str, schema: str = MANIFEST_SCHEMA) -> DataFrame:
    """All columns as strings; rows with a blank key or path are dropped."""
    df = spark.read.option("header", "true").schema(schema).csv(path)
    return df.where(F.coalesce(t.strip("text_path"), F.lit("")) != "")


def last_wins(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row per trimmed key that isn't blank: the last by ordinal."""
    rest = [c for c in df.columns if c != key]
    keyed = df.withColumn(key, t.strip(key)).where(F.col(key) != "")
    return keyed.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("r")).select(key, "r.*")


def qa_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """QA records of JSONL files; missing strings read as empty, missing arrays too."""
    df = spark.read.schema(QA_SCHEMA).json(paths)
    empty = [F.coalesce(c, F.lit("")).alias(c) for c in ("id", "question_type", "game_title", "question")]
    arrays = [F.coalesce(c, F.array().cast(df.schema[c].dataType)).alias(c) for c in ("ground_truths", "gold_contexts")]
    return df.where("id is not null or question is not null").select(*empty, *arrays, "evidence_quote", "evidence")


def gold_fingerprints(records: DataFrame) -> DataFrame:
    """Distinct fingerprints of the gold contexts; worked out from the text where there is none."""
    gold = records.select(F.explode("gold_contexts").alias("g"))
    return gold.select(F.coalesce("g.fingerprint", t.sha_fingerprint("g.text")).alias("fingerprint")).where("fingerprint is not null").distinct()


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line): distinct trimmed lines that aren't blank."""
    return spark.read.text(path).select(t.strip("value").alias("line")).where("line <> ''").distinct()


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """A report with a header: the named fields only."""
    df.select(*fields).write.mode("overwrite").option("header", "true").csv(path)


def append_new(spark: SparkSession, df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose keys the Parquet table doesn't have yet."""
    try:
        there = spark.read.parquet(path).select(*keys)
    except Exception as e:  # the table may not exist yet; any other error goes on
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        there = None
    new = df.dropDuplicates(keys)
    (new if there is None else new.join(there, keys, "left_anti")).write.mode("append").parquet(path)

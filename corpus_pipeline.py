"""A corpus pipeline out of the llm operators: each stage works on all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, quality, simhash, token_output
from tessera.llm.common import Stage, read_table

#: The first stages are models and set joins over whole texts; rows-only checks and brute force test them.
ORACLE_SQL = None


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on these documents' labels, doesn't reject.

    Null and empty texts go by the bias alone; repeated rows stay or go together; an empty table stays empty.
    """
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return quality.score(docs, model).where("predicted = 1").select(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingle sets are 0.8 or more alike: that with the smallest doc_id.

    Documents without words are one group; rows that share doc_id and text count once; a null doc_id comes last.
    """
    return simhash.keep_one(docs, stage=Stage(spark, "pipeline-similar"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark's passages; those mostly made of them go. Null and empty texts have none."""
    return decontaminate.remove_spans(docs, read_table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture of their sources; the order is that of files and rows.

    A null source is a source; rows that share a doc_id are placed one by one.
    """
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the mixture: doc_id, start, n_tokens and ids_crc32 as read back from them.

    A null text is empty; rows that repeat a doc_id are documents of their own.
    """
    config = token_output.TokenConfig(public_tokenizers.path("word_bpe_49k.json"))
    blocks, ranks = token_output.write_tokens(_in_file_order(docs), config, Stage(spark, "pipeline-tokens"), order="file_order")
    return token_output.token_digest(blocks, ranks)


def _in_file_order(docs: DataFrame) -> DataFrame:
    """Adds ``file_order``: the number of the part file, then the row in it. Other frames go by doc_id."""
    part = F.lpad(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1), 10, "0")
    place = F.concat_ws("/", part, F.col("_metadata.file_name"), F.lpad(F.col("_metadata.row_index").cast("string"), 20, "0"))
    try:
        return docs.select("doc_id", "text", place.alias("file_order"))
    except AnalysisException:  # not read from files
        return docs.select("doc_id", "text", F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("file_order"))


STAGES = [("quality", classify), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("mixture", mixture), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, writing each to the shared folder."""
    stage = Stage(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage.write(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Incremental ingest: a landing folder of documents becomes a chunk table that a document's new version replaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as t
from ..operators import corpus as c
from ..operators import tables
from ..sources.snapshots import SnapshotTable

LANDING_SCHEMA = "doc_id long, text string, lang string, ts timestamp"


def landing(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of landed Parquet files."""
    return spark.readStream.schema(LANDING_SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(path)


CHUNKS = "doc_id long, chunk int, chunk_id string, text string, fingerprint string, version long"
#: state: indexed or failed, with the error. sha256: of the text that was taken.
STATUS = "doc_id long, state string, error string, sha256 string, n_chunks long, version long"


def chunk_table(spark: SparkSession, target: str) -> SnapshotTable:
    return SnapshotTable(spark, f"{target}/chunks", "doc_id", CHUNKS)


def status_table(spark: SparkSession, target: str) -> SnapshotTable:
    return SnapshotTable(spark, f"{target}/status", "doc_id", STATUS)


def prepared(batch: DataFrame, size: int = 128, overlap: int = 20) -> DataFrame:
    """Chunks of the documents, with ids that stay the same on a retry."""
    return c.chunk_documents(batch, size, overlap, "\n").withColumn("fingerprint", t.sha_fingerprint("text"))


def upsert_batch(target: str):
    """A foreachBatch function. Of each document the newest row of the batch counts; rows without doc_id are left out.

    Documents whose text is indexed already are skipped; one without text or without chunks fails with a row that says why, and
    the others go on. The chunks of a document replace its earlier ones. Both tables are committed under the
    batch's number, so that a batch that is run again, as a whole or from between the two commits, changes nothing more.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, number = batch.sparkSession, ("ingest", batch_id)
        chunks, status = chunk_table(spark, target), status_table(spark, target)
        newest = tables.latest(batch.where("doc_id is not null"), ["doc_id"], ["ts"]).withColumn("sha256", F.sha2("text", 256))
        known = status.read().where("state = 'indexed'").select("doc_id", "sha256")
        todo = newest.join(known, ["doc_id", "sha256"], "left_anti")
        made = prepared(todo.where("text is not null")).withColumn("version", F.lit(batch_id).cast("long"))
        chunks.upsert(made, number, gone=todo)
        counts = made.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
        rows = todo.join(counts, "doc_id", "left").fillna(0, ["n_chunks"])
        error = F.when(F.col("text").isNull(), "no text").when(F.col("n_chunks") == 0, "no chunks")
        rows = rows.select("doc_id", F.when(error.isNull(), "indexed").otherwise("failed").alias("state"), error.alias("error"), "sha256", "n_chunks", F.lit(batch_id).cast("long").alias("version"))
        status.upsert(rows, number)

    return run


def current(spark: SparkSession, target: str) -> DataFrame:
    """The chunks of each document's newest version. Only folders of the newest manifest are read."""
    return chunk_table(spark, target).read()


def statuses(spark: SparkSession, target: str) -> DataFrame:
    """One row a document: indexed, or failed and why."""
    return status_table(spark, target).read()


def start(spark: SparkSession, source: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts the ingest; with ``once`` it takes what is there and ends."""
    writer = landing(spark, source).writeStream.foreachBatch(upsert_batch(target)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def task_states(log: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """A stream of task events (user_id, event_type, ts) as the newest state of each task."""
    return log.withWatermark("ts", watermark).groupBy("user_id").agg(F.max_by("event_type", "ts").alias("state"), F.max("ts").alias("since"))

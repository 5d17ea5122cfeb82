"""Shared plumbing: staged tables in the shared folder, Arrow helpers, small joins."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows in one Arrow batch handed to Python; bounds a worker's memory with long texts.
ARROW_ROWS = 1024
ARROW_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is absent a temporary folder is made, for a session whose executor is the driver itself
    only; on a cluster the setting has to be there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tessera.local.checkpoint", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        spark.conf.set("tessera.local.checkpoint", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small enough for texts of any length, by rows and by bytes.

    The setting stays: a DataFrame that an operator returns runs later, in the caller's hands.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


class Stage:
    """Tables that one operator call writes to the shared folder; each cuts the lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
        small_batches(spark)

    def write(self, df: DataFrame, name: str, codec: str = "zstd", partition_by: list[str] | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite").option("compression", codec)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return self.read(name, None if partition_by else df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Removes tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null reads as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of consecutive rows whose sizes add up to ``most`` or a single larger row."""
    a = total = 0
    i = -1
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if i >= a:
        yield a, i + 1


def int64(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64), pa.int64())


def key_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only the named columns; other columns, whatever their names, are left out."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def schema_with(df: DataFrame, more: str) -> StructType:
    """The schema of df and further fields given as DDL."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


#: Bits of a key filter: 4 MB whatever the number of keys.
FILTER_BITS = 25


def _filter_places(key: str) -> str:
    mask = (1 << FILTER_BITS) - 1
    return f"array(xxhash64({key}) & {mask}L, shiftrightunsigned(xxhash64({key}), {FILTER_BITS}) & {mask}L)"


def key_filter(keys: DataFrame) -> DataFrame:
    """One row (bits: array of 2**FILTER_BITS bits as longs): a Bloom filter of the column ``key``.

    It is of a fixed size and so may be broadcast. With very many keys it lets more rows through than it
    should; an exact join follows it wherever it is used.
    """
    words = keys.selectExpr(f"explode({_filter_places('key')}) AS i").selectExpr("cast(shiftright(i, 6) as int) AS w", "shiftleft(1L, cast(i & 63 as int)) AS b")
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[np.asarray(found.column("w"))] = np.asarray(found.column("b"))
    return keys.sparkSession.createDataFrame(pa.table({"bits": pa.array([bits], pa.list_(pa.int64()))}))


def may_be_in(df: DataFrame, key: str, bits: DataFrame, inside: bool = True) -> DataFrame:
    """The rows of df whose key (an SQL expression, not null) passes the filter, or those that certainly don't."""
    test = f"forall({_filter_places(key)}, i -> (shiftrightunsigned(element_at(bits, cast(shiftright(i, 6) as int) + 1), cast(i & 63 as int)) & 1L) = 1L)"
    return df.join(F.broadcast(bits), F.expr(test), "left_semi" if inside else "left_anti")

"""Folders for tables that an operator writes and reads again, where driver and executors both reach them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

LOCAL = "tessera.local.workspace"
#: Rows and bytes of one Arrow batch of texts: a Python worker holds a batch several times over.
ARROW_ROWS, ARROW_BYTES = 512, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Keeps the batches of texts that go to Python small. The settings stay, as a DataFrame runs in the caller's hands."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) not in range(1, ARROW_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir. Without that setting a local session gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(LOCAL, None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-workspace-")
        spark.conf.set(LOCAL, base)
    return f"{base.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"

"""Snapshot tables: Parquet folders under a log of manifests, with tombstones, optimistic commits and compaction.

``<path>/log/<version>.json`` is a manifest: the folders of rows and of deleted keys that make up that version, each with
the sequence number of the commit that brought it, and the last batch of each writer. A commit writes its folders
first, under new names, and then the next manifest, which is moved into place and must not be there yet: of two writers
one succeeds, the other reads the new manifest and tries again on top of it. A failed commit leaves folders that
no manifest names; ``vacuum`` removes them. Readers take one version and see nothing of later ones.

A tombstone hides rows of its key that came with earlier commits; an upsert is a commit of rows and of their keys as
tombstones. ``compact`` writes the visible rows anew as one entry of the same sequence number, so that commits that came
meanwhile still apply; after it the replaced folders are read no more.

Works on every file system that Spark reaches and that refuses to move a file onto another.
Rows with a null key are appended and never replaced.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError


@dataclass
class Manifest:
    """rows and gone: [folder, sequence number]; batches: the last batch of each writer."""

    version: int = 0
    rows: list = field(default_factory=list)
    gone: list = field(default_factory=list)
    batches: dict = field(default_factory=dict)
    operation: str = ""

    @property
    def last(self) -> int:
        return max([s for _, s in [*self.rows, *self.gone]], default=0)


class ManifestLog:
    """The numbered manifests of a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = lambda name: hadoop.Path(f"{self.path}/{name}")
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        if not self._fs.exists(self._at("log")):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._at("log")))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int | None = None) -> Manifest:
        """The manifest of a version, or the newest; an empty one where there is none."""
        known = self.versions()
        if version is None and not known:
            return Manifest()
        if version is not None and version not in known:
            raise ValueError(f"no version {version} of {self.path}")
        stream = self._fs.open(self._at(f"log/{version if version is not None else known[-1]:020d}.json"))
        try:
            text = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def _publish(self, manifest: Manifest) -> bool:
        """Moves the manifest into place; false if its version is there already."""
        fresh, place = self._at(f"log/.{uuid.uuid4().hex}"), self._at(f"log/{manifest.version:020d}.json")
        stream = self._fs.create(fresh, False)
        stream.write(bytearray(json.dumps(manifest.__dict__).encode()))
        stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        rename = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(fresh, place, rename)
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            self._fs.delete(fresh, False)
            return False
        return True

    def commit(self, change: Callable[[Manifest], Manifest | None], tries: int = 20) -> int:
        """Publishes change(newest manifest) as the next version; on a conflict again, on top of what came first.

        change returns None if there is nothing to commit. The version that holds the change is returned.
        """
        for _ in range(tries):
            base = self.read()
            new = change(Manifest(**json.loads(json.dumps(base.__dict__))))
            if new is None:
                return base.version
            new.version = base.version + 1
            if self._publish(new):
                return new.version
        raise RuntimeError(f"{tries} commits to {self.path} met others")

    def vacuum(self, keep_versions: int = 1, older_than: float = 3600) -> list[str]:
        """Removes folders that none of the newest versions names and that are older than so many seconds."""
        newest = [self.read(v) for v in self.versions()[-keep_versions:]]
        kept = {folder for m in newest for folder, _ in [*m.rows, *m.gone]}
        removed = []
        if self._fs.exists(self._at("data")):
            for s in self._fs.listStatus(self._at("data")):
                name = f"data/{s.getPath().getName()}"
                if name not in kept and s.getModificationTime() / 1000 <= time.time() - older_than:
                    self._fs.delete(s.getPath(), True)
                    removed.append(name)
        for v in self.versions()[:-keep_versions]:
            self._fs.delete(self._at(f"log/{v:020d}.json"), False)
        return removed


class SnapshotTable:
    """A table of rows with a key column, in versions."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self.spark, self.key, self.schema = spark, key, schema
        self.log = ManifestLog(spark, path)
        self.path = self.log.path
        self.columns = spark.createDataFrame([], schema).columns

    def _write(self, df: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def _commit(self, operation: str, rows: DataFrame | None, gone: DataFrame | None, batch: tuple[str, int] | None) -> int:
        if batch and self.log.read().batches.get(batch[0], -1) >= batch[1]:
            return self.log.read().version  # a repeated batch
        held = self._write(rows.select(*[F.col(f"`{c}`") for c in self.columns])) if rows is not None else None
        keys = self._write(gone.select(F.col(f"`{self.key}`")).where(F.col(f"`{self.key}`").isNotNull()).distinct()) if gone is not None else None

        def change(m: Manifest) -> Manifest | None:
            if batch and m.batches.get(batch[0], -1) >= batch[1]:
                return None
            seq = m.last + 1
            m.rows += [[held, seq]] if held else []
            m.gone += [[keys, seq]] if keys else []
            if batch:
                m.batches[batch[0]] = batch[1]
            m.operation = operation
            return m

        return self.log.commit(change)

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """batch: (writer, number, ascending); a number that is there already isn't committed again."""
        return self._commit("append", rows, None, batch)

    def upsert(self, rows: DataFrame, batch: tuple[str, int] | None = None, gone: DataFrame | None = None) -> int:
        """The rows replace all earlier ones of their keys, and of the keys in ``gone``."""
        own = rows.select(F.col(f"`{self.key}`"))
        return self._commit("upsert", rows, own if gone is None else own.unionByName(gone.select(F.col(f"`{self.key}`"))), batch)

    def delete(self, keys: DataFrame, batch: tuple[str, int] | None = None) -> int:
        return self._commit("delete", None, keys, batch)

    def _entries(self, folders: list, columns: str) -> DataFrame:
        """Rows of folders with their sequence number, in one scan."""
        if not folders:
            return self.spark.createDataFrame([], f"{columns}, _seq int")
        seqs = F.create_map(*[F.lit(x) for folder, s in folders for x in (folder.rpartition("/")[2], s)])
        read = self.spark.read.schema(columns).option("recursiveFileLookup", "true").parquet(*[f"{self.path}/{f}" for f, _ in folders])
        return read.withColumn("_seq", seqs[F.element_at(F.split("_metadata.file_path", "/"), -2)])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, or of the newest. Only folders that its manifest names are read."""
        return self._visible(self.log.read(version))

    def _visible(self, m: Manifest) -> DataFrame:
        rows = self._entries(m.rows, self.schema)
        oldest = min([s for _, s in m.rows], default=0)
        gone = [x for x in m.gone if x[1] > oldest]
        if not gone:
            return rows.drop("_seq")
        kind = next(f.dataType.simpleString() for f in rows.schema if f.name == self.key)
        last = self._entries(gone, f"`{self.key}` {kind}").groupBy(F.col(f"`{self.key}`").alias("_key")).agg(F.max("_seq").alias("_gone"))
        # several rows may share a key; a tombstone has each key once
        return rows.join(last, (F.col(f"`{self.key}`") == F.col("_key")) & (F.col("_seq") < F.col("_gone")), "left_anti").drop("_seq")

    def compact(self) -> int:
        """One folder in place of all that are there now. Commits that come meanwhile stay on top of it."""
        base = self.log.read()
        folder = self._write(self._visible(base)) if base.rows else None
        seq, old = base.last, {f for f, _ in [*base.rows, *base.gone]}

        def change(m: Manifest) -> Manifest | None:
            if not old <= {f for f, _ in [*m.rows, *m.gone]}:
                return None  # another compaction came first
            m.rows = ([[folder, seq]] if folder else []) + [x for x in m.rows if x[0] not in old]
            m.gone = [x for x in m.gone if x[0] not in old]
            m.operation = "compact"
            return m

        return self.log.commit(change)

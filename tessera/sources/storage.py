"""Object storage, archives and table folders through Hadoop's file systems; page texts by a hook."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.names import PROCESSED, SOURCES


class Storage:
    """Objects under a root folder on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, key: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def put(self, key: str, content: bytes) -> str:
        fs, path = self._path(key)
        stream = fs.create(path, True)
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()
        return key

    def get(self, key: str) -> bytes:
        rows = self.spark.read.format("binaryFile").load(f"{self.root}/{key}").select("content").collect()  # one object
        return bytes(rows[0][0])

    def upload(self, content: bytes, filename: str, prefix: str = SOURCES) -> tuple[str, str]:
        """(key, document id): the object's key is its digest, so that equal contents are one object."""
        document = hashlib.sha256(content).hexdigest()
        extension = filename.rpartition(".")[2].lower() if "." in filename else "bin"
        return self.put(f"{prefix}{document}.{extension}", content), document

    def upload_text(self, text: str) -> tuple[str, str]:
        return self.upload(text.encode(), "text.txt", PROCESSED)

    def delete(self, keys: Iterable[str]) -> list[str]:
        """Deletes what it can; the keys that it could not."""
        failed = []
        for key in keys:
            fs, path = self._path(key)
            try:
                if not fs.delete(path, True):
                    failed.append(key)
            except Exception:  # noqa: BLE001  best effort: a store's own errors are of many kinds, and are reported
                failed.append(key)
        return failed

    def exists(self, key: str) -> bool:
        fs, path = self._path(key)
        return fs.exists(path)


def create_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at path, made empty if there is none."""
    root, _, name = path.rstrip("/").rpartition("/")
    if not Storage(spark, root).exists(name):
        spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> bool:
    root, _, name = path.rstrip("/").rpartition("/")
    return not Storage(spark, root).delete([name])


def nonblank_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(t.strip("value") != "").count()


def chunks_for_evaluation(stored: DataFrame | None, manifest: Callable[[], DataFrame], language: str | None = None, most: int | None = None, seed: int = 0) -> DataFrame:
    """Chunks (fingerprint, lang, ...) of the store; of the manifest if there is no store or it is empty."""
    from ..operators.qa import sample

    source = stored if stored is not None and not stored.isEmpty() else manifest()
    rows = source if language is None else source.where(F.lower(t.strip("lang")) == language)
    return rows if most is None else sample(rows, "fingerprint", most, seed)


def write_zip(files: dict[str, bytes], manifest: tuple[str, str] | None = None) -> bytes:
    """A ZIP of the files in the order of their names, and the manifest (name, text) if there is one."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files):
            z.writestr(name, files[name])
        if manifest is not None:
            z.writestr(*manifest)
    return out.getvalue()


def read_zip(content: bytes) -> dict[str, bytes]:
    """The files of a ZIP; an entry that would leave its folder is an error."""
    out = {}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for entry in z.infolist():
            parts = entry.filename.replace("\\", "/").split("/")
            if entry.filename.startswith(("/", "\\")) or ".." in parts or ":" in parts[0]:
                raise ValueError(f"an entry leaves the archive: {entry.filename}")
            if not entry.is_dir():
                out[entry.filename] = z.read(entry)
    return out


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, path, content) of the files of every ZIP below path, unpacked by the executors."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for archive, content in zip(batch.path, batch.content):
                files = read_zip(bytes(content))
                yield pd.DataFrame({"archive": archive, "path": list(files), "content": list(files.values())})

    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path)
    return df.select("path", "content").mapInPandas(run, "archive string, path string, content binary")


#: Characters of native text below which a page is read by OCR.
LEAST_NATIVE = 50


def needs_ocr(native: Column) -> Column:
    return F.length(F.coalesce(t.strip(native), F.lit(""))) < LEAST_NATIVE


def page_texts(pages: DataFrame, ocr: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, text) of pages (doc_id, page, native, image): native text, or OCR's where there is too little of it;
    pages are parted by blank lines. The OCR hook is a function from the image column to a text column."""
    text = F.when(needs_ocr(F.col("native")), ocr(F.col("image"))).otherwise(F.col("native"))
    ordered = F.array_sort(F.collect_list(F.struct("page", text.alias("text"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: F.coalesce(x["text"], F.lit(""))), "\n\n").alias("text"))


#: Frequent English words, for the stand-in of a language model.
ENGLISH = ["the", "and", "of", "to", "in", "is", "that", "for", "with", "a"]


def detect_language(c: Column) -> Column:
    """A stand-in for a language model: ru by script, en by frequent words; unknown below 50 characters or a share of 0.7
    of the script."""
    count = lambda outside: F.length(F.regexp_replace(c, outside, ""))  # noqa: E731 - no array of single characters
    measured = F.struct(count(r"[^\p{L}]+").alias("letters"), count("[^Ѐ-ӿ]+").alias("ru"), count("[^A-Za-z]+").alias("en"))
    share = lambda x, script: F.when(x["letters"] > 0, x[script] / x["letters"]).otherwise(0.0)
    words = F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-z]+", " ")), " ")
    # the words and counts are variables of functions of one value, so that each is made once a text
    common = F.transform(F.array(words), lambda w: F.size(F.filter(w, lambda x: x.isin(ENGLISH))) / F.greatest(F.size(w), F.lit(1)))[0]
    judged = F.transform(F.array(measured), lambda x: F.when(share(x, "ru") >= 0.7, "ru").when((share(x, "en") >= 0.7) & (common >= 0.02), "en").otherwise("unknown"))[0]
    return F.when(F.length(c) < 50, "unknown").otherwise(judged)

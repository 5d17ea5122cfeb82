"""ZIP archives as a data source: members in parallel partitions, and a writer without partial output.

    spark.dataSource.register(ZipSource)
    spark.read.format("zip_members").load("s3://bucket/rules.zip")
    df.write.format("zip_members").mode("append").save("/shared/out")

Reading. The driver reads the archives' directories; members are dealt into partitions of about ``partition_bytes`` compressed
bytes by their place in the file, and a task reads its own members by offset, so that one large archive is read by many
tasks. Columns are those of the schema that is asked for: without ``content`` no member is opened. Filters on ``member`` (equal, in, starts
with) leave out members before partitions are made, with the option pushdown and spark.sql.python.filterPushdown.enabled.
Members whose name would leave the folder (absolute, a drive, ``..``), encrypted ones and those over ``member_bytes`` fail the query; directories
are left out. Options: path (an archive or a folder of them), partition_bytes, member_bytes, pushdown.

Writing. Rows (member, content) become one archive a task, under a hidden name; the commit moves all of them into place, an
abort removes them. Unsafe and repeated names (within a task) fail the task. Mode overwrite removes older archives in the commit.

Files are reached through pyarrow, that is locally, on HDFS, S3 or GCS, by their URIs.
"""

from __future__ import annotations

import posixpath
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("archive", StringType()), StructField("member", StringType()), StructField("size", LongType()), StructField("crc32", LongType()), StructField("content", BinaryType())])
#: Bytes of contents in one batch of rows.
BATCH = 8 << 20
#: Signature and length of a member's own header.
LOCAL, LOCAL_BYTES = b"PK\x03\x04", 30


def unsafe(member: str) -> bool:
    """Whether a name leads out of the folder that an archive is unpacked to."""
    parts = member.replace("\\", "/").split("/")
    return not member or member.startswith(("/", "\\")) or ".." in parts or bool(re.match(r"[A-Za-z]:", member)) or "\0" in member


def located(uri: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[a-z0-9]+:/", uri):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return fs.LocalFileSystem(), uri


@dataclass
class Member:
    name: str
    at: int
    packed: int
    size: int
    crc: int
    method: int


@dataclass
class Members(InputPartition):
    archive: str = ""
    members: list[Member] = field(default_factory=list)


class ZipReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.uri, self.columns, self.schema = options["path"], schema.names, schema
        self.partition_bytes = int(options.get("partition_bytes", 32 << 20))
        self.member_bytes = int(options.get("member_bytes", 1 << 30))
        self.filters: list[Filter] = []

    def _wanted(self, name: str) -> bool:
        return all(name == f.value if isinstance(f, EqualTo) else name in f.value if isinstance(f, In) else name.startswith(f.value) for f in self.filters)

    def _archives(self) -> list[str]:
        files, path = located(self.uri)
        info = files.get_file_info(path)
        if info.type == fs.FileType.Directory:
            return sorted(x.path for x in files.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.File and x.path.endswith(".zip") and not posixpath.basename(x.path).startswith((".", "_")))
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.uri)
        return [path]

    def _members(self, archive: str) -> list[Member]:
        files, _ = located(self.uri)
        with files.open_input_file(archive) as f, zipfile.ZipFile(f) as z:
            infos = [x for x in z.infolist() if not x.is_dir()]
        for x in infos:
            if unsafe(x.filename):
                raise ValueError(f"{archive}: {x.filename!r} leads out of the folder")
            if x.flag_bits & 1 or x.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                raise ValueError(f"{archive}: {x.filename!r} is encrypted or packed in another way")
            if x.file_size > self.member_bytes:
                raise ValueError(f"{archive}: {x.filename!r} has {x.file_size} bytes, over {self.member_bytes}")
        found = [Member(x.filename, x.header_offset, x.compress_size, x.file_size, x.CRC, x.compress_type) for x in infos if self._wanted(x.filename)]
        return sorted(found, key=lambda m: m.at)

    def partitions(self) -> list[InputPartition]:
        out = []
        for archive in self._archives():
            held, total = [], 0
            for m in self._members(archive):
                if held and total + m.packed > self.partition_bytes:
                    out.append(Members(archive, held))
                    held, total = [], 0
                held.append(m)
                total += m.packed
            if held:
                out.append(Members(archive, held))
        return out or [Members("", [])]

    def _content(self, f, m: Member) -> bytes:
        f.seek(m.at)
        head = f.read(LOCAL_BYTES)
        if head[:4] != LOCAL:
            raise ValueError(f"{m.name!r} has no header at {m.at}")
        names, extra = struct.unpack("<HH", head[26:30])
        f.seek(m.at + LOCAL_BYTES + names + extra)
        data = f.read(m.packed)
        if m.method == zipfile.ZIP_DEFLATED:
            data = zlib.decompressobj(-15).decompress(data, m.size + 1)  # no more than it claims
        if len(data) != m.size or zlib.crc32(data) != m.crc:
            raise ValueError(f"{m.name!r} is damaged")
        return data

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        files, _ = located(self.uri)
        opened = files.open_input_file(partition.archive) if "content" in self.columns and partition.members else None
        kinds = {"archive": pa.string(), "member": pa.string(), "size": pa.int64(), "crc32": pa.int64(), "content": pa.binary()}

        def batch(members: list[Member], contents: list[bytes]) -> pa.RecordBatch:
            values = {"archive": [partition.archive] * len(members), "member": [m.name for m in members], "size": [m.size for m in members], "crc32": [m.crc for m in members], "content": contents}
            return pa.RecordBatch.from_arrays([pa.array(values[c], kinds[c]) for c in self.columns], self.columns)

        held, contents, total = [], [], 0
        try:
            for m in partition.members:
                held.append(m)
                if opened:
                    contents.append(self._content(opened, m))
                    total += m.size
                if total >= BATCH or len(held) >= 10_000:
                    yield batch(held, contents)
                    held, contents, total = [], [], 0
            if held:
                yield batch(held, contents)
        finally:
            if opened:
                opened.close()


class PruningReader(ZipReader):
    """Takes filters; Spark wants them to be enabled in the session for that."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        self.filters = [f for f in filters if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == ("member",)]
        return iter(filters)  # Spark applies them all the same


@dataclass
class Written(WriterCommitMessage):
    hidden: str
    members: int


class ZipWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.uri, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.at = [schema.names.index(c) for c in ("member", "content")]
        files, path = located(self.uri)
        files.create_dir(path, recursive=True)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        files, path = located(self.uri)
        hidden, seen = f"{path}/.{self.job}-{uuid.uuid4().hex}.zip", set()
        try:
            with files.open_output_stream(hidden) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
                for row in rows:
                    name, content = (row[i] for i in self.at)
                    if name is None or unsafe(name) or name in seen:
                        raise ValueError(f"{name!r} is no safe name, or is there twice")
                    seen.add(name)
                    z.writestr(zipfile.ZipInfo(name), bytes(content or b""), zipfile.ZIP_DEFLATED)
        except BaseException:
            files.delete_file(hidden)
            raise
        return Written(hidden, len(seen))

    def commit(self, messages: list) -> None:
        files, path = located(self.uri)
        old = [x.path for x in files.get_file_info(fs.FileSelector(path)) if x.path.endswith(".zip") and not posixpath.basename(x.path).startswith(".")] if self.overwrite else []
        kept = [m for m in messages if m is not None]
        for i, m in enumerate(kept):
            if m.members:
                files.move(m.hidden, f"{path}/part-{i:05d}-{self.job}.zip")
        for name in old:
            files.delete_file(name)
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        """Hidden files of this job, also of attempts that lost."""
        files, path = located(self.uri)
        for x in files.get_file_info(fs.FileSelector(path)):
            if posixpath.basename(x.path).startswith(f".{self.job}-"):
                files.delete_file(x.path)


class ZipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        for f in schema.fields:
            if f.name not in SCHEMA.names or SCHEMA[f.name].dataType != f.dataType:
                raise ValueError(f"columns are {SCHEMA.simpleString()}")
        kind = PruningReader if self.options.get("pushdown", "false").lower() == "true" else ZipReader
        return kind(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ZipWriter(dict(self.options), schema, overwrite)

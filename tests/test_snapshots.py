"""Snapshot tables: versions, conflicts, failed commits, repeated batches, compaction."""

import pytest
from pyspark.sql import functions as F

from tessera.sources.snapshots import SnapshotTable

SCHEMA = "id long, text string"


@pytest.fixture
def table(spark, tmp_path):
    return SnapshotTable(spark, str(tmp_path / "t"), "id", SCHEMA)


def frame(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_versions(spark, table):
    assert rows(table.read()) == []
    assert table.append(frame(spark, (1, "a"), (1, "b"), (2, "c"), (None, "n"))) == 1
    assert table.upsert(frame(spark, (1, "new"), (3, "d"))) == 2
    assert table.delete(frame(spark, (2, ""), (None, ""))) == 3
    assert rows(table.read()) == [(1, "new"), (3, "d"), (None, "n")]
    assert rows(table.read(1)) == [(1, "a"), (1, "b"), (2, "c"), (None, "n")]
    assert rows(table.read(2)) == [(1, "new"), (2, "c"), (3, "d"), (None, "n")]
    table.append(frame(spark, (2, "again")))
    assert (2, "again") in rows(table.read())  # a tombstone hides earlier rows only
    with pytest.raises(ValueError):
        table.read(99)


def test_repeated_batch(spark, table):
    for _ in range(2):
        table.upsert(frame(spark, (1, "a")), batch=("w", 0))
        table.append(frame(spark, (1, "b")), batch=("w", 1))
    table.append(frame(spark, (1, "c")), batch=("other", 0))
    assert rows(table.read()) == [(1, "a"), (1, "b"), (1, "c")] and table.log.versions() == [1, 2, 3]


def test_conflict(spark, table):
    """Another writer commits between reading the manifest and publishing."""
    table.append(frame(spark, (1, "a")))
    other = SnapshotTable(spark, table.path, "id", SCHEMA)
    publish, met = table.log._publish, []

    def late(manifest):
        if not met:
            met.append(other.upsert(frame(spark, (1, "theirs"), (2, "theirs"))))
        return publish(manifest)

    table.log._publish = late
    assert table.upsert(frame(spark, (1, "mine"))) == 3 and met == [2]
    assert rows(table.read()) == [(1, "mine"), (2, "theirs")]
    table.log._publish = lambda m: False
    with pytest.raises(RuntimeError):
        table.append(frame(spark, (9, "x")))


def test_failed_commit_and_vacuum(spark, table):
    table.append(frame(spark, (1, "a")))
    broken = frame(spark, (2, "b")).withColumn("text", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        table.append(broken)
    assert rows(table.read()) == [(1, "a")] and table.log.versions() == [1]
    removed = table.log.vacuum(older_than=0)
    assert len(removed) == 1 and rows(table.read()) == [(1, "a")]


def test_compaction(spark, table):
    for i in range(4):
        table.upsert(frame(spark, (i, f"{i}"), (0, f"zero {i}")))
    table.delete(frame(spark, (2, "")))
    before = rows(table.read())
    late = SnapshotTable(spark, table.path, "id", SCHEMA)
    write = table._write

    def slow(df):
        folder = write(df)
        late.upsert(frame(spark, (1, "meanwhile")))  # comes while the compaction writes
        return folder

    table._write = slow
    table.compact()
    table._write = write
    expected = sorted([(1, "meanwhile"), *[r for r in before if r[0] != 1]], key=str)
    assert rows(table.read()) == expected
    manifest = table.log.read()
    assert len(manifest.rows) == 2 and len(manifest.gone) == 1
    read = {f.rsplit("/", 2)[-2] for f in table.read().inputFiles()}
    assert read <= {f.rpartition("/")[2] for f, _ in [*manifest.rows, *manifest.gone]}  # old folders aren't read
    table.compact()
    assert len(table.log.vacuum(older_than=0)) >= 8 and rows(table.read()) == expected and len(table.log.versions()) == 1


def test_two_compactions(spark, table):
    table.append(frame(spark, (1, "a")))
    table.append(frame(spark, (2, "b")))
    write, other = table._write, SnapshotTable(spark, table.path, "id", SCHEMA)

    def slow(df):
        other.compact()
        return write(df)

    table._write = slow
    table.compact()
    assert rows(table.read()) == [(1, "a"), (2, "b")] and len(table.log.read().rows) == 1

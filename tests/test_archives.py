"""The ZIP data source: parallel reads, escapes, damaged members, pruning, and no partial output."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sources.archives import ZipSource, unsafe


@pytest.fixture(autouse=True)
def source(spark):
    spark.dataSource.register(ZipSource)


def archive(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members:
            z.writestr(name, content)
    return str(path)


def load(spark, path, schema=None, **options):
    reader = spark.read.format("zip_members").options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def test_one_archive_in_many_tasks(spark, tmp_path):
    members = [(f"d/{i}.txt", os.urandom(2000) if i % 2 else f"text {i} é".encode() * (i + 1)) for i in range(60)] + [("empty", b""), ("d/sub/", b"")]
    path = archive(tmp_path / "a.zip", members)
    df = load(spark, path, partition_bytes="8000")
    assert df.rdd.getNumPartitions() >= 7
    got = {r.member: (r.size, bytes(r.content), r.crc32) for r in df.collect()}
    assert got == {n: (len(c), c, zipfile.crc32(c)) for n, c in members if not n.endswith("/")}
    archive(tmp_path / "b.zip", [("b", "x")])
    assert load(spark, f"file://{tmp_path}").count() == 62  # a folder of archives, by URI


def test_unsafe_names(spark, tmp_path):
    for name in ("../x", "/x", "a/../../x", "C:\\x", "..\\x"):
        assert unsafe(name)
        with pytest.raises(Exception, match="leads out"):
            load(spark, archive(tmp_path / "a.zip", [("ok", "1"), (name, "2")])).collect()
    assert not unsafe("a..b/c.txt")
    with pytest.raises(Exception, match="over 10"):
        load(spark, archive(tmp_path / "a.zip", [("big", "x" * 11)]), member_bytes="10").collect()
    with pytest.raises(Exception, match="gone.zip"):
        load(spark, str(tmp_path / "gone.zip")).collect()


def test_columns_and_filters(spark, tmp_path):
    path = archive(tmp_path / "a.zip", [(f"{i}.txt", f"content {i} " * 50) for i in range(20)])
    data = bytearray(open(path, "rb").read())
    with zipfile.ZipFile(path) as z:
        at = z.getinfo("3.txt").header_offset + 30 + len("3.txt")
    data[at : at + 5] = b"\xff" * 5
    open(path, "wb").write(data)
    assert load(spark, path, "member string, size long").count() == 20  # contents aren't opened
    with pytest.raises(Exception):
        load(spark, path).collect()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = load(spark, path, pushdown="true")
        assert read.where("member = '5.txt'").collect()[0].content == b"content 5 " * 50  # the damaged one isn't read
        assert read.where("member in ('5.txt', '6.txt')").count() == 2 and read.where("size > 0 and startswith(member, '1')").count() == 11 and read.where("member like '1%'").count() == 11
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception, match="columns are"):
        load(spark, path, "member string, other int").collect()


def test_writing(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.range(40).selectExpr("concat('m/', id) AS member", "encode(concat('text ', id), 'utf-8') AS content").repartition(3)
    rows.write.format("zip_members").mode("append").save(out)
    names = sorted(os.listdir(out))
    assert len(names) == 3 and all(n.startswith("part-") for n in names)
    assert sorted(map(tuple, load(spark, out).select("member", "content").collect())) == sorted(map(tuple, rows.collect()))
    broken = rows.withColumn("member", F.when(F.col("member") == "m/7", "../7").otherwise(F.col("member")))
    with pytest.raises(Exception):
        broken.write.format("zip_members").mode("append").save(out)
    assert sorted(os.listdir(out)) == names  # nothing of the failed job
    rows.limit(5).coalesce(1).write.format("zip_members").mode("overwrite").save(out)
    assert load(spark, out).count() == 5

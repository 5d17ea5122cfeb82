"""Exact repeated byte strings, found with a sparse suffix array, and their removal.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else. Every window of
that many bytes is owned by one suffix: of the suffixes that start in it and have their first ``lead`` bytes in
it, the one whose lead has the least hash (the leftmost of equals). Equal windows are owned by suffixes with
equal leads at equal places, so that only one suffix in about ``length / 2`` enters the array.

1. Owners are range-partitioned by their leading bytes, with splitters from a sample; the lead is followed by
   a hash of the owned stretch (all windows of the suffix together) and by the place, so that a lead that a
   third of all suffixes share is still dealt to many buckets.
2. Buckets are sorted by multikey quicksort, eight bytes at a time, and neighbours are compared. Suffixes with
   equal stretches cover them whole. Equal leads with different stretches stay open. Leads that touch a
   bucket's boundary are compared with those of the buckets beside it.
3. Of open suffixes the stretches' bytes are fetched and compared window by window, each lead by itself. The
   stretches of a lead with many different ones are cut first, by how far before the lead a window starts: windows
   of one piece share most of their bytes, by which the pieces are dealt out. Of equal pieces, which are covered
   whole, one is compared. If very many are left, they are dealt out by window.
4. Covered intervals come together at their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import Stage, as_bytes, int64, key_filter, may_be_in, partitions, slices
from .grouping import groups

LEAD = 32
#: Pieces of a stretch whose lead has many.
PIECES = 8
#: Bytes of text that numpy works on at once: its arrays of eight bytes a letter stay small.
CHUNK = 1 << 16
#: Stands for a null doc_id in joins.
NO_ID = -(1 << 63)
WORDS = ["k0", "k1", "k2", "k3"]


@dataclass(frozen=True)
class RepeatConfig:
    """length: bytes of a repeated string, at least 33. many: most different stretches of one lead that aren't
    cut into pieces. group: most of one lead, or pieces that share their middle, that are compared in one task;
    more are dealt out by window. bucket: about the most suffixes of a bucket."""

    length: int = 400
    many: int = 512
    group: int = 4096
    bucket: int = 200_000


def lead_hashes(buf: np.ndarray) -> np.ndarray:
    """A mixed hash of buf[i : i + LEAD] for every i that has so many bytes."""
    table = wh.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(wh.BASE))
    h, width = table[buf], 1
    with np.errstate(over="ignore"):
        while width < LEAD:
            h = h[:-width] * np.uint64(pow(wh.BASE, width, 1 << 64)) + h[width:]
            width *= 2
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
    return h


def owners(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(document, owner, first window, last window), places within the document, for all owners of windows."""
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(sizes) - sizes
    found = [np.zeros((4, 0), np.int64)]
    step = 1 << 22  # window starts at a time, so that a place fits 24 bits
    buf = np.frombuffer(b"".join(texts), np.uint8)
    for a in range(0, len(buf) - length + 1, step):
        part = buf[a : a + step + length - 1]
        width, span = 1, length - LEAD + 1
        m = (lead_hashes(part) & ~np.uint64(0xFFFFFF)) | np.arange(len(part) - LEAD + 1, dtype=np.uint64)
        while width * 2 <= span:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        m = np.minimum(m[: len(m) - (span - width)], m[span - width :])
        owner = (m & np.uint64(0xFFFFFF)).astype(np.int64)
        starts = np.arange(len(owner)) + a
        doc = np.searchsorted(base + sizes, starts, side="right")
        inside = starts + length <= (base + sizes)[np.minimum(doc, len(sizes) - 1)]
        starts, owner, doc = starts[inside], owner[inside] + a, doc[inside]
        if not len(starts):
            continue
        cut = np.concatenate([[True], (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])])
        at = np.flatnonzero(cut)
        last = np.concatenate([at[1:], [len(starts)]]) - 1
        d = doc[at]
        found.append(np.stack([d, owner[at] - base[d], starts[at] - base[d], starts[last] - base[d]]))
    return tuple(np.concatenate(found, axis=1))


def _rows(docs: DataFrame) -> DataFrame:
    """(doc, row, text): row tells apart rows that share a doc_id (null: NO_ID) but not the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text.alias("text")).select("doc", F.xxhash64("text").alias("row"), "text")


def _suffixes(docs: DataFrame, config: RepeatConfig) -> DataFrame:
    """One row per owner: four words of the lead, hash of its stretch, doc, row (text key), place, lo, hi."""
    names = [*WORDS, "span", "doc", "row", "place", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_digest
        for batch in batches:
            texts, ids, rows = as_bytes(batch.column("text")), np.asarray(batch.column("doc")), np.asarray(batch.column("row"))
            for a, b in slices(map(len, texts), CHUNK):
                part = texts[a:b]
                doc, place, lo, hi = owners(part, config.length)
                if not len(doc):
                    continue
                leads = b"".join([part[d][p : p + LEAD] for d, p in zip(doc.tolist(), place.tolist())])
                words = np.frombuffer(leads, ">i8").reshape(-1, 4).astype(np.int64)
                spans = np.frombuffer(b"".join([digest(part[d][x : y + config.length]) for d, x, y in zip(doc.tolist(), lo.tolist(), hi.tolist())]), ">i8").astype(np.int64)
                columns = [int64(words[:, k]) for k in range(4)] + [int64(spans), int64(ids[a:b][doc]), int64(rows[a:b][doc])]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x.astype(np.int32)) for x in (place, lo, hi))], names)

    return _rows(docs).mapInArrow(run, "k0 long, k1 long, k2 long, k3 long, span long, doc long, row long, place int, lo int, hi int")


def multikey_quicksort(words: list[np.ndarray]) -> np.ndarray:
    """An order of the rows by the words, first word first.

    A range is parted around a pivot of its current word into smaller, equal and greater rows; the equal
    rows go on with the next word. Short ranges are sorted directly.
    """
    order = np.arange(len(words[0]))
    todo = [(0, len(order), 0)]
    while todo:
        a, b, depth = todo.pop()
        if b - a < 2 or depth == len(words):
            continue
        rows = order[a:b]
        if b - a <= 512:
            order[a:b] = rows[np.lexsort([w[rows] for w in reversed(words[depth:])])]
            continue
        x = words[depth][rows]
        pivot = np.sort(x[:: max(1, len(x) // 31)])[len(x[:: max(1, len(x) // 31)]) // 2]
        less, more = x < pivot, x > pivot
        n, m = int(less.sum()), int(more.sum())
        order[a:b] = np.concatenate([rows[less], rows[~(less | more)], rows[more]])
        todo += [(a, a + n, depth), (a + n, b - m, depth + 1), (b - m, b, depth)]
    return order


def _sorted_buckets(suffixes: DataFrame, config: RepeatConfig) -> DataFrame:
    """Covered (kind 0), open (1) and boundary (2) suffixes; those whose lead occurs once are gone.

    An open lead keeps one suffix of each stretch that is covered as well, to compare with. Stretches can go
    on in the next bucket only from a bucket's last one, and in the one before only from its first: these give
    a boundary row each, with the copies in the bucket and whether their lead has other stretches there.
    """
    spark = suffixes.sparkSession
    names = suffixes.columns
    buckets = max(partitions(spark), -(-suffixes.count() // config.bucket))  # a written table
    dealt = suffixes.repartitionByRange(buckets, *WORDS, "span", "doc", "row", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        column = {c: np.asarray(table.column(c).combine_chunks()) for c in [*WORDS, "span"]}
        order = multikey_quicksort([column[c] for c in [*WORDS, "span"]])
        words = [column[c][order] for c in WORDS]
        new_lead = np.concatenate([[True], np.any([w[1:] != w[:-1] for w in words], axis=0)])
        span = column["span"][order]
        new_span = new_lead | np.concatenate([[True], span[1:] != span[:-1]])
        lead_no, span_no = np.cumsum(new_lead) - 1, np.cumsum(new_span) - 1
        copies = np.bincount(span_no)[span_no]
        several = np.bincount(lead_no[new_span])[lead_no] > 1
        edge = (span_no == 0) | (span_no == span_no[-1])
        taken = [(0, copies > 1), (1, ~edge & several & ((copies == 1) | new_span)), (2, edge & new_span)]
        for kind, mask in taken:
            at = np.flatnonzero(mask)
            for a in range(0, len(at), 1 << 14):
                some = at[a : a + (1 << 14)]
                rows = table.take(pa.array(order[some]))
                columns = [c.combine_chunks() for c in rows.columns]
                columns = [pa.array(np.full(len(some), kind, np.int32)), int64(copies[some]), pa.array(several[some]), *columns]
                yield pa.RecordBatch.from_arrays(columns, ["kind", "copies", "several", *names])

    return dealt.mapInArrow(run, "kind int, copies long, several boolean, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in suffixes.schema))


def _settle_edges(edges: DataFrame) -> DataFrame:
    """The boundary suffixes, two a bucket at most, as covered or open: runs are compared across the buckets."""
    per_span = edges.groupBy(*WORDS, "span").agg(F.sum("copies").alias("all"), F.min(F.struct("doc", "row", "place")).alias("one"))
    here = edges.groupBy(*WORDS).agg(F.max("several").alias("any"))
    per_lead = per_span.groupBy(*WORDS).agg(F.count("*").alias("spans")).join(here, WORDS)
    known = edges.join(per_span.join(per_lead, WORDS), [*WORDS, "span"])
    covered = known.where("copies = 1 and `all` > 1").withColumn("kind", F.lit(0)).select(edges.columns)
    one = F.struct("doc", "row", "place") == F.col("one")
    return covered.unionByName(known.where((F.col("any") | (F.col("spans") > 1)) & one).withColumn("kind", F.lit(1)).select(edges.columns))


def _pieces(text: bytes, lead: int, place: int, lo: int, hi: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(lead, lo, hi, same) of the pieces of a stretch: equal windows are in pieces of equal lead, equal pieces have equal same.

    A piece has the windows that start at distances from the lead in one range; ``lead`` is a hash of the lead, the
    range and the bytes that all windows of the range have.
    """
    width = -(-(length - LEAD + 1) // PIECES)
    for k in range(PIECES):
        first, last = place - (k + 1) * width + 1, place - k * width
        a, b = max(lo, first), min(hi, last)
        if a <= b:
            shared = xxhash.xxh3_64_intdigest(text[last : first + length], (lead + k) & (1 << 64) - 1)
            same = xxhash.xxh3_64_intdigest(text[a : b + length], place - a)
            yield shared - (1 << 63), a, b, same - (1 << 63)


def _with_bytes(docs: DataFrame, open_: DataFrame, config: RepeatConfig, cut_up: bool = False) -> DataFrame:
    """(lead, doc, row, place, lo, hi, same, data) of open suffixes, or of their pieces: data are the bytes."""
    per_row = open_.groupBy("doc", "row").agg(F.collect_list(F.struct("lead", "place", "lo", "hi")).alias("items"))
    names = ["lead", "doc", "row", "place", "lo", "hi", "same", "data"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, row, text, items in zip(batch.column("doc").to_pylist(), batch.column("row").to_pylist(), as_bytes(batch.column("text")), batch.column("items").to_pylist()):
                for a, b in slices([i["hi"] - i["lo"] + config.length for i in items], 1 << 17 if cut_up else 1 << 20):
                    out = []
                    for i in items[a:b]:
                        lead, place, lo, hi = i["lead"], i["place"], i["lo"], i["hi"]
                        pieces = _pieces(text, lead, place, lo, hi, config.length) if cut_up else [(lead, lo, hi, 0)]
                        out += [(key, doc, row, place, x, y, same, text[x : y + config.length]) for key, x, y, same in pieces]
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    # rows that repeat a text give its suffixes again; texts without open suffixes stay where they are
    bits = key_filter(open_.select(F.col("row").alias("key")).distinct())
    joined = may_be_in(_rows(docs), "row", bits).join(per_row, ["doc", "row"]).select("doc", "row", "text", "items")
    return joined.mapInArrow(cut, "lead long, doc long, row long, place int, lo int, hi int, same long, data binary")


def _stretches(docs: DataFrame, open_: DataFrame, stage: Stage, config: RepeatConfig) -> tuple[DataFrame, DataFrame]:
    """The stretches and pieces to compare, and the intervals (doc, row, a, b) of pieces that occur twice."""
    open_ = open_.select(F.xxhash64(*WORDS).alias("lead"), "doc", "row", "place", "lo", "hi")
    many = open_.groupBy("lead").agg(F.count("*").alias("n")).where(F.col("n") > config.many).select("lead")
    few = _with_bytes(docs, open_.join(F.broadcast(many), "lead", "left_anti"), config)
    pieces = stage.write(_with_bytes(docs, open_.join(F.broadcast(many), "lead", "left_semi"), config, True), "pieces")
    one = F.min(F.struct("doc", "row", "place", "lo", "hi", "data")).alias("one")
    each = pieces.groupBy("lead", "same").agg(one).select("lead", "same", "one.*")
    twice = pieces.groupBy("lead", "same").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    covered = pieces.join(twice, ["lead", "same"]).select("doc", "row", F.col("lo").cast("long").alias("a"), (F.col("hi") + config.length).cast("long").alias("b"))
    return few.unionByName(each), covered


def _window_keys(lead: np.ndarray, place: np.ndarray, lo: np.ndarray, data: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of the stretches: its item, its start, and a hash of lead, alignment and bytes."""
    sizes = np.array([len(d) for d in data], np.int64)
    windows = sizes - length + 1
    base = np.cumsum(sizes) - sizes
    item = np.repeat(np.arange(len(data)), windows)
    offset = np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
    buf = np.frombuffer(b"".join(data), np.uint8)
    at = base[item] + offset
    body = wh.span_hashes(buf, at, at + length)
    start = lo[item] + offset
    align = (place[item] - start).astype(np.uint64)
    return item, start, wh.mix(body + align * np.uint64(wh.BASE) + wh.mix(lead[item].astype(np.uint64)))


def _compare_open(stretches: DataFrame, stage: Stage, config: RepeatConfig) -> DataFrame:
    """Intervals (doc, row, a, b) covered by windows of open suffixes that occur twice."""
    spark = stretches.sparkSession
    length = config.length
    names, keys = ["key", "doc", "row", "a", "b"], ["doc", "row", "place", "lo", "data"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list) -> Iterator[pa.RecordBatch]:
            lead, (doc, row, place, lo, data) = np.concatenate([np.full(len(v[0]), k) for k, v in held]), [np.concatenate(x) for x in zip(*(v for _, v in held))]
            item, start, key = _window_keys(lead, place, lo, list(data), length)
            _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
            twice = counts[inverse] > 1
            item, start = item[twice], start[twice]
            if len(item):
                cut = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (start[1:] != start[:-1] + 1)]))
                last = np.concatenate([cut[1:], [len(item)]]) - 1
                who = item[cut]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(cut), pa.int64()), int64(doc[who]), int64(row[who]), int64(start[cut]), int64(start[last] + length)], names)

        held, size = [], 0
        for (lead,), values, first, last in groups(batches, ["lead"], keys, config.group):
            if not (first and last):  # a lead with very many stretches: to be dealt out by window
                doc, row, place, lo, data = values
                for a in range(0, len(doc), 512):
                    item, start, key = _window_keys(np.full(len(doc[a : a + 512]), lead), place[a : a + 512], lo[a : a + 512], list(data[a : a + 512]), length)
                    yield pa.RecordBatch.from_arrays([int64(key.view(np.int64)), int64(doc[a : a + 512][item]), int64(row[a : a + 512][item]), int64(start), int64(start + length)], names)
                continue
            if len(values[0]) > 1:
                held.append((lead, values))
                size += sum(map(len, values[4]))
                if size > CHUNK:
                    yield from done(held)
                    held, size = [], 0
        if held:
            yield from done(held)

    dealt = stretches.repartition(partitions(spark), "lead").sortWithinPartitions("lead", "doc", "row", "place")
    found = stage.write(dealt.mapInArrow(search, "key long, doc long, row long, a long, b long"), "windows")
    many = found.where("key is not null")
    twice = many.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return found.where("key is null").drop("key").unionByName(many.join(twice, "key").drop("key"))


def covered_intervals(docs: DataFrame, stage: Stage, config: RepeatConfig = RepeatConfig()) -> DataFrame:
    """(doc, row, a, b): stretches of bytes, which may overlap, that repeated strings cover."""
    suffixes = stage.write(_suffixes(docs, config), "suffixes")
    sorted_ = stage.write(_sorted_buckets(suffixes, config), "sorted")
    stage.drop("suffixes")
    settled = stage.write(sorted_.where("kind < 2").unionByName(_settle_edges(sorted_.where("kind = 2"))), "settled")
    stage.drop("sorted")
    stretches, pieces = _stretches(docs, settled.where("kind = 1"), stage, config)
    opened = pieces.unionByName(_compare_open(stretches, stage, config))
    whole = settled.where("kind = 0").select("doc", "row", F.col("lo").cast("long").alias("a"), (F.col("hi") + config.length).cast("long").alias("b"))
    return whole.unionByName(opened)


def _united(intervals: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, config: RepeatConfig = RepeatConfig(), stage: Stage | None = None, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary), or with ``digest`` kept_sha256, for every row.

    kept are the bytes that are left; they may end inside a character. A null text is empty; texts shorter than
    ``length`` bytes stay whole, longer ones are searched whole, whatever their length. Rows that repeat doc_id and
    text repeat each other's strings like any others, and rows without doc_id are documents like any others. Of
    equal strings all go, the first one too, so that there are no ties. An empty table gives no rows; other columns
    of docs, whatever their names, are left out.
    """
    stage = stage or Stage(docs.sparkSession, "repeats")
    found = stage.write(covered_intervals(docs, stage, config).groupBy("doc", "row").agg(F.collect_set(F.struct("a", "b")).alias("found")), "found")
    bits = key_filter(found.select(F.col("row").alias("key")))
    untouched = may_be_in(_rows(docs), "row", bits, False).withColumn("found", F.lit(None).cast(found.schema["found"].dataType))
    joined = may_be_in(_rows(docs), "row", bits).join(found, ["doc", "row"], "left").select("doc", "row", "text", "found")
    joined = untouched.unionByName(joined).select("doc", "text", "found")
    last = "kept_sha256 string" if digest else "kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            for text, found in zip(as_bytes(batch.column("text")), batch.column("found").to_pylist()):
                cut: list[tuple[int, int]] = []
                if found:
                    cut = _united([(f["a"], f["b"]) for f in found])
                parts, at = [], 0
                for a, b in cut:
                    parts.append(text[at:a])
                    at = b
                parts.append(text[at:])
                rest = b"".join(parts)
                sizes.append(len(text))
                removed.append(len(text) - len(rest))
                spans.append(len(cut))
                kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), int64(sizes), int64(removed), int64(spans), pa.array(kept, pa.string() if digest else pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", last.split()[0]],
            )

    out = joined.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))

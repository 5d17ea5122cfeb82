"""Embedding near-dedup by sorted projection passes.

In every pass a vector's key is a row of bits, one for the side of each of ``bits`` random hyperplanes that
it lies on. Vectors are ordered by key, so that vectors that agree on the first bits stand near each other,
and each is compared with the ``window`` vectors before it. Verified pairs of all passes are united.

Labels with more vectors than a window are centred before they are projected, so that vectors that are all
alike fall apart too. Rounds of ``passes`` passes go on until there have been as many passes as the largest and
densest label needs (``passes_needed``) and a round has united nothing more.

A vector that occurs many times is compared once. Within the components that the passes found, every pair
is then compared in blocks, so that the numbers of links are exact there even if a component is much larger
than a window; only sums leave the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, int64, partitions
from .components import components
from .grouping import Forest, groups


@dataclass(frozen=True)
class ProjectionConfig:
    """similarity: least cosine. passes, bits, window: see above. missed: share of pairs of the least cosine that
    the passes needed may miss. block: vectors in a block of the exact count."""

    similarity: float = 0.98
    passes: int = 12
    bits: int = 48
    window: int = 256
    missed: float = 0.01
    block: int = 1024
    seed: int = 20


def _is_valid() -> Column:
    """Whether a row can have links: label and vector not null, all components finite, not all zero."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(F.col("label").isNotNull() & e.isNotNull() & fine & F.exists(e, lambda x: x != 0), F.lit(False))


def _classes(vectors: DataFrame) -> DataFrame:
    """One row per distinct (label, vector): cid, kind (label and dimension), copies, embedding."""
    named = vectors.where(_is_valid()).select(F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    grouped = named.groupBy("label", "embedding").agg(F.count("*").alias("copies"))
    return grouped.select(F.xxhash64("label", "embedding").alias("cid"), F.xxhash64("label", F.size("embedding")).alias("kind"), "copies", "embedding")


def _matrix(data: list[bytes]) -> np.ndarray:
    """Vectors of one dimension as unit rows in double precision."""
    x = np.frombuffer(b"".join(data), "<f8").reshape(len(data), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _packed(classes: DataFrame) -> DataFrame:
    """(cid, kind, copies, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = [np.array(r, "<f8").tobytes() for r in batch.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("kind"), batch.column("copies"), pa.array(vec, pa.binary())], ["cid", "kind", "copies", "vec"])

    return classes.mapInArrow(run, "cid long, kind long, copies long, vec binary")


def _centres(packed: DataFrame, config: ProjectionConfig) -> DataFrame:
    """(kind, n, centre): the mean of the unit vectors of each kind that has more of them than a window."""
    names, types = ["kind", "n", "centre"], "kind long, n long, centre binary"

    def record(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([int64([k for k, _, _ in rows]), int64([n for _, n, _ in rows]), pa.array([v.tobytes() for _, _, v in rows], pa.binary())], names)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            kind, vec = np.asarray(batch.column("kind")), batch.column("vec").to_numpy(zero_copy_only=False)
            for k in np.unique(kind).tolist():
                x = _matrix(list(vec[kind == k]))
                n, total = held.get(k, (0, 0.0))
                held[k] = (n + len(x), total + x.sum(axis=0))
            if len(held) > 2048:
                yield record([(k, n, v) for k, (n, v) in held.items()])
                held = {}
        if held:
            yield record([(k, n, v) for k, (n, v) in held.items()])

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind,), (n, centre), _, _ in groups(batches, ["kind"], ["n", "centre"], 1 << 30):
            if n.sum() > config.window:
                total = np.frombuffer(b"".join(centre), "<f8").reshape(len(n), -1).sum(axis=0)
                yield record([(int(kind), int(n.sum()), total / n.sum())])

    parts = packed.select("kind", "vec").mapInArrow(sums, types)
    return parts.repartition(partitions(packed.sparkSession), "kind").sortWithinPartitions("kind", "n").mapInArrow(means, types)


def passes_needed(n: int, spread: float, config: ProjectionConfig) -> float:
    """Passes after which all but ``missed`` of the pairs of the least cosine have met in a window, among n
    vectors with a mean squared distance ``spread`` from their centre.

    A pair agrees on a bit if its centred vectors lie on one side, and on as many bits as part n vectors from
    a window. Where vectors are nearly all linked (centred cosine under 0.5) chains of links stand for pairs.
    """
    bits = max(0.0, np.log2(n / config.window))
    cosine = max(0.5, 1 - (1 - config.similarity) / max(spread, 1e-9))
    found = (1 - np.arccos(min(1.0, cosine)) / np.pi) ** bits
    return 1.0 if found >= 1 else float(np.log(config.missed) / np.log1p(-found))


def _most_passes(centres: DataFrame, config: ProjectionConfig) -> int:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = [passes_needed(n, 1 - float((np.frombuffer(c, "<f8") ** 2).sum()), config) for n, c in zip(batch.column("n").to_pylist(), batch.column("centre").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(most, pa.float64())], ["most"])

    return int(np.ceil(centres.mapInArrow(run, "most double").agg(F.max("most")).first()[0] or 1))


def _keyed(packed: DataFrame, centres: DataFrame, round_: int, config: ProjectionConfig) -> DataFrame:
    """(cid, kind, vec, keys): keys has one long for each pass of the round."""
    salts = partitions(packed.sparkSession)  # a centre comes to many tasks, however large its label
    salted = centres.select("kind", "centre", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    joined = packed.select("cid", "kind", "vec", F.pmod(F.xxhash64("cid", F.lit(2)), F.lit(salts)).cast("int").alias("salt")).join(salted, ["kind", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weight = 1 << np.arange(config.bits - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            vec, centre = batch.column("vec").to_pylist(), batch.column("centre").to_pylist()
            keys = [None] * len(vec)
            for size in {len(v) for v in vec}:
                at = [i for i, v in enumerate(vec) if len(v) == size]
                if size not in planes:
                    planes[size] = np.random.default_rng([config.seed, size // 8, round_]).standard_normal((size // 8, config.passes * config.bits))
                x = _matrix([vec[i] for i in at])
                x -= np.frombuffer(b"".join(centre[i] or bytes(size) for i in at), "<f8").reshape(x.shape)
                side = (x @ planes[size] > 0).reshape(len(at), config.passes, config.bits)
                for i, k in zip(at, (side * weight).sum(axis=2)):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("kind"), batch.column("vec"), pa.array(keys, pa.list_(pa.int64()))], ["cid", "kind", "vec", "keys"])

    return joined.select("cid", "kind", "vec", "centre").mapInArrow(run, "cid long, kind long, vec binary, keys array<long>")


def _roots(packed: DataFrame, config: ProjectionConfig, stage: Stage) -> DataFrame:
    """(id, root) of every linked vector, by rounds of passes."""
    centres = stage.write(_centres(packed, config), "centres")
    needed, round_, united, roots = _most_passes(centres, config), 0, 0, None
    while True:
        links = _pass_links(_keyed(packed, centres, round_, config), config, stage)
        if roots is not None:
            links = links.unionByName(roots.select(F.col("id").alias("a"), F.col("root").alias("b")))
        roots = stage.write(components(links, stage, f"components-{round_}"), f"roots-{round_}")
        now = roots.where("id <> root").count()
        round_ += 1
        if now == united and round_ * config.passes >= needed:
            return roots
        united = now


def _close(a: np.ndarray, b: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of the pairs whose cosine in double precision is high enough."""
    i, j = np.nonzero(a.astype(np.float32) @ b.astype(np.float32).T >= similarity - 1e-4)
    fine = np.einsum("ij,ij->i", a[i], b[j]) >= similarity
    return i[fine], j[fine]


def _pass_links(keyed: DataFrame, config: ProjectionConfig, stage: Stage) -> DataFrame:
    """Links (a, b) between cids that span the components of all verified pairs."""
    spark = keyed.sparkSession
    rows = keyed.select(F.posexplode("keys").alias("pass", "key"), "kind", "cid", "vec")
    ordered = rows.repartitionByRange(partitions(spark), "pass", "kind", "key", "cid").sortWithinPartitions("pass", "kind", "key", "cid")
    names = ["a", "b", "part", "side", "pass", "kind", "vec"]
    types = "a long, b long, part int, side int, pass int, kind long, vec binary"

    def compare(old: list, new: list, forest: Forest) -> list[tuple[int, int]]:
        """Links between each new vector and the window before it; rows are (cid, unit vector)."""
        if not new:
            return []
        both = old[-config.window :] + new
        base = len(both) - len(new)
        x = np.stack([v for _, v in both])
        i, j = _close(x[base:], x, config.similarity)
        i += base
        near = (j < i) & (i - j <= config.window)
        return list(forest.spanning((both[p][0], both[q][0]) for p, q in zip(i[near].tolist(), j[near].tolist())))

    def edge(rows: list, part: int, side: int) -> pa.RecordBatch:
        ps, kinds, cids, vecs = zip(*rows)
        n = len(rows)
        return pa.RecordBatch.from_arrays([int64(cids), pa.nulls(n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([side] * n, pa.int32()), pa.array(ps, pa.int32()), int64(kinds), pa.array(vecs, pa.binary())], names)

    def found(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        n = len(pairs)
        return pa.RecordBatch.from_arrays([int64([p for p, _ in pairs]), int64([q for _, q in pairs]), *[pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())]], names)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, head, tail = TaskContext.get().partitionId(), [], []
        old: list = []
        old_key, forest = None, Forest()
        for key, (cid, vec), _, _ in groups(batches, ["pass", "kind"], ["cid", "vec"], 512):
            if key != old_key:
                old, old_key, forest = [], key, Forest()
            new = list(zip(cid.tolist(), _matrix(list(vec))))
            if pairs := compare(old, new, forest):
                yield found(pairs)
            old = (old + new)[-config.window :]
            raw = [(*map(int, key), c, v) for c, v in zip(cid.tolist(), vec)]
            head += raw[: config.window - len(head)]
            tail = (tail + raw)[-config.window :]
        if head:  # the windows reach over the ends of the partition
            yield edge(head, part - 1, 1)
            yield edge(tail, part, 0)

    swept = stage.write(ordered.mapInArrow(sweep, types), "swept")
    ends = swept.where("part is not null").repartition(partitions(spark), "part").sortWithinPartitions("part", "side")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (side, ps, kinds, cid, vec), _, _ in groups(batches, ["part"], ["side", "pass", "kind", "a", "vec"], 1 << 30):
            if side[0] or not side[-1]:
                continue
            last = int(np.flatnonzero(side == 0)[-1])
            left = (side == 0) & (ps == ps[last]) & (kinds == kinds[last])
            right = (side == 1) & (ps == ps[last]) & (kinds == kinds[last])
            if right.any():
                rows = [list(zip(cid[m].tolist(), _matrix(list(vec[m])))) for m in (left, right)]
                if pairs := compare(rows[0], rows[1], Forest()):
                    yield found(pairs).select(["a", "b"])

    return swept.where("part is null").select("a", "b").unionByName(ends.mapInArrow(across, "a long, b long"))


def _link_counts(members: DataFrame, config: ProjectionConfig) -> DataFrame:
    """(cid, links): copies of other vectors linked with each, by all pairs of blocks of its component."""
    spark = members.sparkSession
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / config.block).cast("int").alias("blocks"))
    dealt = members.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("blocks")).cast("int"))
    others = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = others.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "cid", "copies", "vec")
    keys = ["root", "i", "j"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (side, cid, copies, vec), _, _ in groups(batches, keys, ["side", "cid", "copies", "vec"], 1 << 30):
            x = _matrix(list(vec))
            if key[1] == key[2]:
                i, j = _close(x, x, config.similarity)
                other = i != j
                total = np.bincount(i[other], copies[j[other]], len(x))
            else:
                a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                i, j = _close(x[a], x[b], config.similarity)
                total = np.bincount(a[i], copies[b[j]], len(x)) + np.bincount(b[j], copies[a[i]], len(x))
            yield pa.RecordBatch.from_arrays([int64(cid), int64(total)], ["cid", "links"])

    sorted_pairs = pairs.repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "side", "cid")
    return sorted_pairs.mapInArrow(count, "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))


def deduplicate(vectors: DataFrame, config: ProjectionConfig = ProjectionConfig(), stage: Stage | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label).

    Rows without label, or whose vector is null, empty, zero or holds null or non-finite components, link
    with nothing, and so do vectors of different length. Rows with equal vectors and labels are linked.
    A null vec_id is kept and is no component's smallest id unless it is the only one.
    Other columns are left out. An empty table gives no rows.
    """
    stage = stage or Stage(vectors.sparkSession, "projection")
    vectors = vectors.select("vec_id", "embedding", "label")
    packed = stage.write(_packed(_classes(vectors)), "packed")
    roots = _roots(packed, config, stage).withColumnRenamed("id", "cid")
    members = stage.write(roots.join(packed.select("cid", "copies", "vec"), "cid"), "members")
    counts = _link_counts(members, config)
    ids = stage.write(vectors.where(_is_valid()).select("vec_id", F.xxhash64(F.col("label").cast("string"), F.col("embedding").cast("array<double>")).alias("cid")), "ids")
    least = ids.groupBy("cid").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    rooted = least.join(members.select("cid", "root"), "cid", "left").join(counts, "cid", "left")
    rooted = rooted.select("cid", "least", F.coalesce("root", "cid").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    rooted = stage.write(rooted, "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("cid", "n_links", "component_id")
    linked = ids.join(named, "cid").select("vec_id", "n_links", "component_id")
    rest = vectors.where(~_is_valid()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))

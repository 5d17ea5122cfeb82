"""SimHash near-duplicates with BK-trees.

Two fingerprints within ``radius`` bits agree on all but ``radius`` of any blocks that the 64 bits are cut
into, so every choice of the remaining blocks is the key of a shard, and linked fingerprints meet in one
shard at least. A shard's fingerprints stand in a BK-tree: the children of a node are keyed by their
integer Hamming distance to it, and a search follows only edges within the radius of the query's distance.
Shards come to the tasks by a shuffle on their keys; the trees together grow with the corpus, so that they
aren't broadcast. A shard that is too large for one tree is cut anew into finer blocks, which is exact for
the same reason and ends with shards of at most 2**14 fingerprints (the most that the free bits allow).

``near_duplicates`` works on shingle sets: shards are keyed by sketches of small parts of the set, the
BK-tree of each proposes links, and only links whose Jaccard similarity is high enough count. Small shards
propose all pairs within the radius. Large ones propose a forest, nearest first; where verified links leave a
large shard in several components, its sets come together, and all pairs within the radius that are still
apart are verified, piece against piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import Stage, as_bytes, int64, key_filter, may_be_in, partitions
from .components import components
from .grouping import Forest, groups


#: Stands for a null doc_id in joins.
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class SimHashConfig:
    """words: words in a shingle. radius: most differing bits of a link. tree: most fingerprints in a BK-tree
    before its shard is cut anew."""

    words: int = 3
    radius: int = 2
    tree: int = 4096


@dataclass(frozen=True)
class SimilarConfig:
    """words: words in a shingle. similarity: least Jaccard similarity of a link. radius: most differing bits
    of proposed links. routes: parts of a set that a document is looked up by, at each of two sizes. small:
    most sets of a shard that proposes all pairs. piece, piece_bytes: most sets, and about the most bytes of
    them, that are compared with as many others in one task."""

    words: int = 5
    similarity: float = 0.8
    radius: int = 20
    routes: int = 12
    tree: int = 2048
    small: int = 32
    piece: int = 1024
    piece_bytes: int = 1 << 24


class BKTree:
    """Fingerprints by integer Hamming distance to their parents."""

    __slots__ = ("root",)

    def __init__(self):
        self.root: list | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while True:
            d = (value ^ node[0]).bit_count()
            if not d:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = [value, {}]
                return
            node = child

    def within(self, value: int, radius: int) -> Iterator[tuple[int, int]]:
        """(distance, fingerprint) of all that differ by at most ``radius`` bits."""
        todo = [self.root] if self.root is not None else []
        while todo:
            node = todo.pop()
            d = (value ^ node[0]).bit_count()
            if d <= radius:
                yield d, node[0]
            edges = node[1]
            if len(edges) > 2 * radius:
                todo += [edges[k] for k in range(d - radius, d + radius + 1) if k in edges]
            else:
                todo += [child for k, child in edges.items() if -radius <= k - d <= radius]


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of the shingles, repeats included; no words: 0."""
    parts = text.lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), 42)
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(b" ".join(t), 42) for t in zip(*(parts[k:] for k in range(words)))])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    counts = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(bits)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signed(fingerprint(t, config.words)) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), int64(found)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int, radius: int) -> list[int]:
    """Masks of the block choices that two fingerprints within the radius must agree on in one case."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    bits = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(bits, blocks - radius)]


def _sharded(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(table, key, fp) for every mask."""
    keys = F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("key")) for i, m in enumerate(masks)])
    return fps.select(F.explode(keys).alias("k"), "fp").select("k.table", "k.key", "fp")


def _tree_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning set of the links among the fingerprints of one shard."""
    mask = (1 << 64) - 1
    plain = [int(v) & mask for v in values]
    if len(plain) == 2:
        return [(plain[0], plain[1])] if (plain[0] ^ plain[1]).bit_count() <= radius else []
    tree, forest, out = BKTree(), Forest(), []
    for v in plain:
        out += forest.spanning((v, u) for _, u in tree.within(v, radius))
        tree.add(v)
    return out


def links(fps: DataFrame, stage: Stage, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose components are those of all links within the radius."""
    n = fps.count()
    blocks = config.radius + 1
    while blocks < config.radius + 8 and n > 4 << (64 * (blocks - config.radius) // blocks):
        blocks += 1
    found, level = None, 0
    while True:
        masks = block_masks(blocks, config.radius)
        last = blocks >= config.radius + 8
        most = max(1 << (64 - mask.bit_count()) for mask in masks) if last else config.tree

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, (values,), first, end in groups(batches, ["table", "key"], ["fp"], most):
                if first and end:
                    if len(values) > 1 and (got := _tree_links(values, config.radius)):
                        yield pa.RecordBatch.from_arrays([int64([signed(a) for a, _ in got]), int64([signed(b) for _, b in got])], ["a", "b"])
                else:  # too many for a tree: to be cut anew
                    yield pa.RecordBatch.from_arrays([int64(values), pa.nulls(len(values), pa.int64())], ["a", "b"])

        spark = fps.sparkSession
        shards = _sharded(fps, masks).repartition(partitions(spark), "table", "key").sortWithinPartitions("table", "key", "fp")
        out = stage.write(shards.mapInArrow(search, "a long, b long"), f"links-{level}")
        here = out.where("b is not null")
        found = here if found is None else found.unionByName(here)
        hot = out.where("b is null").select(F.col("a").alias("fp")).distinct()
        if last or hot.isEmpty():
            return found
        fps, blocks, level = stage.write(hot, f"hot-{level}"), min(blocks + 3, config.radius + 8), level + 1


def deduplicate(docs: DataFrame, config: SimHashConfig = SimHashConfig(), stage: Stage | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs.

    Rows with one fingerprint are linked; so are rows whose fingerprints differ by at most ``radius`` bits.
    component_id is the smallest doc_id reachable. A null text has no words and fingerprint zero; texts of any
    length are read whole. A null doc_id is kept, and isn't a component's smallest id unless there is no other.
    Rows that repeat doc_id are rows of their own. An empty table gives no rows; other columns of docs, whatever
    their names, are left out.
    """
    stage = stage or Stage(docs.sparkSession, "simhash")
    all_fps = stage.write(fingerprints(docs, config), "fingerprints")
    distinct = stage.write(all_fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), stage, config), stage)
    rooted = distinct.join(roots.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return all_fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# -- near duplicates by shingle sets


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of A-Z-lowered words; fewer words: of all of them."""
    buf = wh.LOWER[np.frombuffer(text, np.uint8)]
    starts, ends = wh.spans(buf)
    if not len(starts):
        return np.zeros(0, np.uint64)
    hashes = wh.span_hashes(buf, starts, ends)
    return np.unique(wh.ngram_hashes(hashes, min(words, len(hashes))))


def _sketch(shingles: np.ndarray) -> int:
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(shingles)).tobytes(), "little")


def _routes(shingles: np.ndarray, most: int) -> list[int]:
    """Keys of shards: a hash of each of the first parts of the set, at two part sizes.

    The parts of a set are fixed by the shingles' hashes, 2 to 8 shingles each on average, so that two sets
    of similarity 0.8 have parts in common; the number of parts is a power of two, and sets of nearby sizes
    share one of the two numbers.
    """
    out: list[int] = []
    spread = wh.mix(shingles + np.uint64(0x51ED27))
    level = max(0, int(np.log2(max(1, len(shingles)) / 4)))
    for parts in (1 << level, 2 << level):
        part = (spread & np.uint64(parts - 1)).astype(np.int64)
        chosen = part < most
        n = min(parts, most)
        sizes = np.bincount(part[chosen], minlength=n)
        # sums and products of mixed hashes stand for the part's set
        total = np.zeros(n, np.uint64)
        np.add.at(total, part[chosen], wh.mix(shingles[chosen]))
        key = wh.mix(total + wh.mix(np.arange(n, dtype=np.uint64) + np.uint64(parts << 20)))
        out += [int(k) for k, s in zip(key, sizes) if s]
    return out


def _profiles(docs: DataFrame, config: SimilarConfig) -> DataFrame:
    """doc_id, whole (hash of the set), fp, routes, set (the shingles, four bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, fps, routes, sets = [], [], [], []
            for t in as_bytes(batch.column("text")):
                s = shingle_set(t, config.words)
                with np.errstate(over="ignore"):
                    whole.append(signed(int(wh.mix(np.array([wh.mix(s + np.uint64(3)).sum() if len(s) else 0], np.uint64))[0])))
                fps.append(signed(_sketch(s)) if len(s) else 0)
                routes.append([signed(x) for x in _routes(s, config.routes)] if len(s) else [])
                sets.append((s >> np.uint64(32)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), int64(whole), int64(fps), pa.array(routes, pa.list_(pa.int64())), pa.array(sets, pa.binary())],
                ["doc_id", "whole", "fp", "routes", "set"],
            )

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return base.mapInArrow(run, "doc_id long, whole long, fp long, routes array<long>, set binary")


def near_duplicates(docs: DataFrame, config: SimilarConfig = SimilarConfig(), stage: Stage | None = None) -> DataFrame:
    """(whole, component): each distinct shingle set that is not alone in its component, and the component's id.

    Components are those of all pairs that share a shard, differ by at most ``radius`` bits and have a
    Jaccard similarity of at least ``similarity``. Documents with one set (exact copies among them) share a row.
    """
    stage = stage or Stage(docs.sparkSession, "similar")
    spark = docs.sparkSession
    profiles = stage.write(_profiles(docs, config), "profiles")
    sets = profiles.groupBy("whole").agg(F.first("fp").alias("fp"), F.first("routes").alias("routes"))
    shards = sets.select(F.explode("routes").alias("key"), "whole", "fp").repartition(partitions(spark), "key").sortWithinPartitions("key", "fp", "whole")

    names = ["a", "b", "key", "fp"]

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = None
        for (key,), (whole, fp), first, last in groups(batches, ["key"], ["whole", "fp"], config.tree):
            large = not (first and last) or len(whole) > config.small
            pairs = _nearest(whole, fp, config.radius) if large else _all_pairs(whole, fp, config.radius)
            if not first and ahead is not None:  # a guess that saves later work: near copies stand in all pieces
                pairs.append((ahead, int(whole[0])))
            ahead = int(whole[0])
            if pairs:
                none = pa.nulls(len(pairs), pa.int64())
                yield pa.RecordBatch.from_arrays([int64([a for a, _ in pairs]), int64([b for _, b in pairs]), none, none], names)
            if large:  # its members, for the pairs that the forest leaves out
                yield pa.RecordBatch.from_arrays([int64(whole), pa.nulls(len(whole), pa.int64()), int64(np.full(len(whole), key)), int64(fp)], names)

    out = stage.write(shards.mapInArrow(propose, "a long, b long, key long, fp long"), "shards")
    proposed = stage.write(out.where("b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "proposed")
    needed = proposed.select(F.explode(F.array("a", "b")).alias("whole")).distinct()
    sets_of = may_be_in(profiles, "whole", key_filter(needed.select(F.col("whole").alias("key"))))
    data = stage.write(sets_of.join(needed, "whole", "left_semi").groupBy("whole").agg(F.first("set").alias("set")), "sets")
    both = proposed.join(data.select(F.col("whole").alias("a"), F.col("set").alias("x")), "a").join(data.select(F.col("whole").alias("b"), F.col("set").alias("y")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())):
                p, q = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                common = len(np.intersect1d(p, q))
                if common >= config.similarity * (len(p) + len(q) - common):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    linked = stage.write(both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "linked")
    found = components(linked, stage, "similar")
    rooted = out.where("b is null").select("key", F.col("a").alias("whole"), "fp").join(found.withColumnRenamed("id", "whole"), "whole", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "whole"))
    open_ = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    open_ = stage.write(rooted.join(open_, "key", "left_semi"), "open")
    if not open_.isEmpty():
        found = components(linked.unionByName(_open_links(open_, profiles, config, stage)), stage, "similar-open")
    return found.select(F.col("id").alias("whole"), F.col("root").alias("component"))


def _open_links(open_: DataFrame, profiles: DataFrame, config: SimilarConfig, stage: Stage) -> DataFrame:
    """Links (a, b) that span all verified pairs within the radius among the members (key, whole, fp, root) of
    each shard, given those within a root. Pieces of a shard are compared two by two."""
    spark = open_.sparkSession
    needed = open_.select("whole").distinct()
    data = may_be_in(profiles, "whole", key_filter(needed.select(F.col("whole").alias("key")))).join(needed, "whole", "left_semi")
    members = open_.join(data.groupBy("whole").agg(F.first("set").alias("set")), "whole")
    sizes = open_.join(data.groupBy("whole").agg(F.length(F.first("set")).alias("size")), "whole").groupBy("key")
    sizes = sizes.agg(F.ceil(F.greatest(F.count("*") / config.piece, F.sum("size") / config.piece_bytes)).cast("int").alias("pieces"))
    dealt = members.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("whole"), F.col("pieces")).cast("int"))
    others = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
    keys, values = ["key", "i", "j"], ["side", "whole", "fp", "root", "set"]
    pairs = others.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), *values[1:])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), (side, whole, fp, root, sets), _, _ in groups(batches, keys, values, 1 << 30):
            links = _apart(whole, fp, root, [np.frombuffer(s, "<u4") for s in sets], None if i == j else side == 1, config)
            if links:
                yield pa.RecordBatch.from_arrays([int64([a for a, _ in links]), int64([b for _, b in links])], ["a", "b"])

    dealt = pairs.repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "side", "whole")
    return stage.write(dealt.mapInArrow(compare, "a long, b long"), "open-links")


def _apart(whole: np.ndarray, fp: np.ndarray, root: np.ndarray, sets: list[np.ndarray], right: np.ndarray | None, config: SimilarConfig) -> list[tuple[int, int]]:
    """A spanning set of the links between members that are not yet of one root; right: the side of each
    member, of which only pairs across count (None: all pairs count)."""
    group = np.unique(root, return_inverse=True)[1]
    size = np.array([len(s) for s in sets], np.int64)
    shingles = np.concatenate(sets)
    order = np.argsort(shingles, kind="stable")
    owner, shingles = np.repeat(np.arange(len(sets)), size)[order], shingles[order]
    fp = fp.astype(np.int64).view(np.uint64)
    out = []
    for i, s in enumerate(sets if right is None else sets[: len(sets) - int(right.sum())]):
        near = (np.bitwise_count(fp ^ fp[i]) <= config.radius) & (group != group[i])
        if right is None:
            near[:i] = False
        else:
            near &= right
        if not near.any():
            continue
        starts, ends = np.searchsorted(shingles, s), np.searchsorted(shingles, s, "right")
        counts = ends - starts
        at = np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts)
        common = np.bincount(owner[at], minlength=len(sets))
        for j in np.flatnonzero(near & (common >= config.similarity * (size + size[i] - common))).tolist():
            if group[j] != group[i]:
                out.append((int(whole[i]), int(whole[j])))
                group[group == group[j]] = group[i]
    return out


def _all_pairs(whole: np.ndarray, fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """All pairs of a small shard within the radius."""
    if len(whole) < 2:
        return []
    tree, members, out = BKTree(), {}, []
    for w, v in zip(whole.tolist(), fp.tolist()):
        v &= (1 << 64) - 1
        out += [(u, w) for _, f in tree.within(v, radius) for u in members[f]]
        members.setdefault(v, []).append(w)
        tree.add(v)
    return out


def _nearest(whole: np.ndarray, fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Proposals of one shard: a spanning forest of its members, nearest fingerprints first."""
    if len(whole) < 2:
        return []
    mask = (1 << 64) - 1
    plain = [int(v) & mask for v in fp]
    by_fp: dict[int, int] = {}
    out, tree, found = [], BKTree(), []
    for i, v in enumerate(plain):
        if v in by_fp:
            out.append((int(whole[by_fp[v]]), int(whole[i])))
            continue
        near = sorted(tree.within(v, radius))[:8] if len(plain) > 64 else list(tree.within(v, radius))
        found += [(d, by_fp[u], i) for d, u in near]
        by_fp[v] = i
        tree.add(v)
    found.sort()
    out += [(int(whole[a]), int(whole[b])) for a, b in Forest().spanning((a, b) for _, a, b in found)]
    return out


def keep_one(docs: DataFrame, config: SimilarConfig = SimilarConfig(), stage: Stage | None = None) -> DataFrame:
    """The rows of docs, one of each group of near duplicates: the one with the smallest doc_id.

    Rows with equal shingle sets are in one group; so are all rows without words. Rows that share doc_id and
    text count once; rows that share only doc_id stay or go together. A null doc_id comes after all others.
    """
    stage = stage or Stage(docs.sparkSession, "similar")
    groups = near_duplicates(docs, config, stage)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    profiles = stage.read("profiles").select(key.alias("key"), "whole")
    grouped = profiles.join(groups, "whole", "left").select("key", F.coalesce("component", "whole").alias("g"))
    order = F.nullif("key", F.lit(NO_ID))
    least = grouped.groupBy("g").agg(F.coalesce(F.min(order), F.lit(NO_ID)).alias("least"))
    ids = stage.write(grouped.join(least, "g").select("key", "least"), "ids")
    stage.drop("profiles")
    # rows in doubt: those that go, and those whose doc_id occurs again; all others stay where they are
    repeated = ids.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    bits = key_filter(ids.where("key <> least").select("key").unionByName(repeated))
    sql = f"coalesce(cast(doc_id as bigint), {NO_ID + 1}L - 1L)"
    certain, doubtful = may_be_in(docs, sql, bits, False), may_be_in(docs, sql, bits)
    kept = ids.where("key = least").select("least").distinct()
    one = doubtful.join(kept, key == F.col("least"), "left_semi").dropDuplicates(["doc_id", "text"])
    return certain.unionByName(one)

"""Fuzzy shared passages by collinear chaining of k-mer seeds.

1. Seeds. A document's k-mers are its runs of ``k`` words; of every ``window`` consecutive ones the one with
   the least hash is a seed, so that equal passages of ``k + window - 1`` words share a seed at the same place.
2. Matches. Equal seeds meet by a shuffle on their hash. The first place (smallest doc_id, then position)
   stands for the seed and every other document's place is matched with it: a seed that very many documents
   share gives one match for each of them, and no task needs to hold them together. Seeds of a share of all
   documents (``hot``) that makes one task's work stand out are salted over all tasks: their first places are an
   aggregate with map-side combine and are broadcast.
3. Runs. Where the seeds of a passage occurred earlier in different documents, the matches with each of them are
   too few. So the run of ``min_words`` words that begins with a seed that occurs again is matched in the same way:
   every equal run of ``min_words + window - 1`` words that an earlier document has too is matched with one.
4. Chains. For two documents, matches on one diagonal that overlap are joined to anchors, and anchors in
   rising order in both documents are chained for the best score: words matched, less ``gap`` for each word
   passed over in either document. A Fenwick tree over the first document's positions holds the best chain
   that ends at or before each.
5. Alignment. The words around each chain are cut out of the later document and sent to the earlier one, the
   chain's ends are extended while matches outweigh mismatches, and a bit-parallel longest common subsequence
   gives the identity of the passages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import Stage, as_bytes, int64, key_filter, may_be_in, partitions, slices
from .grouping import groups

#: Keys from here on stand for rows whose doc_id isn't their key.
ODD = 1 << 62
#: Most hot seeds that go out to all places: 5 MB.
MOST = 200_000
#: Bytes of text that numpy works on at once: its arrays of eight bytes a letter stay small.
CHUNK = 1 << 16


@dataclass(frozen=True)
class ChainConfig:
    """min_words: least words of a passage in both documents. identity: least share of the longer passage that
    the common subsequence covers. margin: words looked at on either side of a chain. hot: share of documents from which a seed's places are salted."""

    k: int = 6
    window: int = 10
    gap: float = 0.1
    min_words: int = 40
    identity: float = 0.7
    margin: int = 64
    hot: float = 0.005


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of the A-Z-lowered words of each text."""
    buf = wh.LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    starts, ends = wh.spans(buf)
    hashes = wh.span_hashes(buf, starts, ends)
    cuts = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    return [hashes[a:b] for a, b in zip(cuts, cuts[1:])]


def seeds_of(words: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the seeds of one document; with fewer k-mers than the window, of one."""
    grams = wh.ngram_hashes(words, k)
    if not len(grams):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    window = min(window, len(grams))
    mask = np.uint64(0xFFFFFF)
    m = (grams & ~mask) | (np.arange(len(grams), dtype=np.uint64) & mask)
    width = 1
    while width * 2 <= window:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    m = np.minimum(m[: len(m) - (window - width)], m[window - width :])
    low = (m & mask).astype(np.int64)
    # places beyond 24 bits are told from the window's own place
    at = np.arange(len(m))
    places = np.unique(low + ((at - low + int(mask)) >> 24 << 24))
    return grams[places], places


#: A place of a seed: run is the hash of the run of min_words words that begins there, null if there is none.
PLACE = "seed long, doc long, pos int, run long"
#: Places in a batch of documents from which a seed is noted as perhaps hot: most batches have none.
NOTED = 6


def _places(out: list[tuple[np.ndarray, ...]], ids: list[int]) -> tuple[pa.RecordBatch, list[np.ndarray]]:
    """Rows of documents' seeds (hash, place, run, whether there is a run), and the hashes, once a document.

    A place that isn't the seed's first in its document is written ~pos.
    """
    seed, pos, run, whole = (np.concatenate(x) for x in zip(*out))
    seed, run, doc = seed.view(np.int64), run.view(np.int64), np.repeat(np.array(ids, np.int64), [len(x[0]) for x in out])
    again = np.zeros(len(seed), bool)
    ordered = np.sort(seed)
    twice = np.flatnonzero(np.isin(seed, ordered[1:][ordered[1:] == ordered[:-1]]))
    if len(twice):
        at = twice[np.lexsort([pos[twice], seed[twice], doc[twice]])]
        again[at[1:]] = (seed[at[1:]] == seed[at[:-1]]) & (doc[at[1:]] == doc[at[:-1]])
    columns = [int64(seed), int64(doc), pa.array(np.where(again, ~pos, pos).astype(np.int32)), pa.array(run, pa.int64(), mask=~whole)]
    return pa.RecordBatch.from_arrays(columns, ["seed", "doc", "pos", "run"]), [seed[~again], run[whole & ~again]]


def _notes(hashes: list[np.ndarray], docs: int) -> pa.RecordBatch:
    """Rows without doc: the places of a seed or run in one batch of documents, and without seed the documents."""
    seed, n = np.unique(np.concatenate([np.zeros(0, np.int64), *hashes]), return_counts=True)
    seed, n = seed[n >= NOTED], n[n >= NOTED]
    none = pa.nulls(len(seed) + 1, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([None, *seed.tolist()], pa.int64()), none, pa.array([docs, *n.tolist()], pa.int32()), none], ["seed", "doc", "pos", "run"])


def seeds(docs: DataFrame, config: ChainConfig) -> DataFrame:
    """(seed, doc, pos, run) of every document, and notes."""

    def of(words: np.ndarray) -> tuple[np.ndarray, ...]:
        seed, pos = seeds_of(words, config.k, config.window)
        runs = wh.ngram_hashes(words, config.min_words)
        whole = pos < len(runs)
        return seed, pos, np.where(whole, runs[np.minimum(pos, max(0, len(runs) - 1))] if len(runs) else np.uint64(0), np.uint64(0)).astype(np.uint64), whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, hashes = as_bytes(batch.column("text")), batch.column("doc").to_pylist(), []
            for a, b in slices(map(len, texts), CHUNK):
                rows, found = _places([of(w) for w in word_hashes(texts[a:b])], ids[a:b])
                hashes += found
                yield rows
            yield _notes(hashes, len(texts))

    return docs.select("doc", "text").mapInArrow(run, PLACE)


def hot_seeds(found: DataFrame, config: ChainConfig) -> DataFrame:
    """(seed): seeds and runs of a share of the documents.

    A seed's shares add up to the seeds of a document, so that hot ones are few. It makes no difference to the
    result which seeds are among them; any beyond MOST meet like all others.
    """
    notes = found.where("doc is null")
    total = notes.where("seed is null").agg(F.sum("pos")).first()[0] or 0
    hot = notes.where("seed is not null").groupBy("seed").agg(F.sum("pos").alias("n")).where(F.col("n") >= max(2 * NOTED, config.hot * total))
    return hot.orderBy(F.desc("n"), "seed").limit(MOST).select("seed")


def matches(found: DataFrame, hot: DataFrame) -> DataFrame:
    """(b, a, pb, pa, run): the places (doc, pos) of each seed that has several, with its first place (a, pa),
    which is a row itself. found is read several times and should be a written table.

    The places of a seed meet as a stream in order. Those of a hot seed are salted by document over all tasks,
    which know its first place from a broadcast.
    """
    spark = found.sparkSession
    rows = found.where("doc is not null")
    firsts = _firsts(rows, hot)
    names = ["b", "a", "pb", "pa", "run"]

    def record(doc: np.ndarray, a: np.ndarray, pos: np.ndarray, pa_: np.ndarray, run: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([int64(doc), int64(a), pa.array(pos.astype(np.int32)), pa.array(pa_.astype(np.int32)), run], names)

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds_, first_doc, first_pos = firsts.value
        last = None  # the seed and first place that the rows before ended with, and that row if it is still to come
        for batch in batches:
            seed, doc, pos = (np.asarray(batch.column(c)) for c in ("seed", "doc", "pos"))
            at = _places_in(seeds_, seed)
            if (known := at >= 0).any():
                yield record(doc[known], first_doc[at[known]], pos[known], first_pos[at[known]], batch.column("run").filter(pa.array(known)))
                batch = batch.filter(pa.array(~known))
                seed, doc, pos = seed[~known], doc[~known], pos[~known]
            if not len(seed):
                continue
            new = np.concatenate([[last is None or last[0] != seed[0]], seed[1:] != seed[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(len(seed)), -1))
            a, pa_ = np.where(start < 0, last[1] if last else 0, doc[start]), np.where(start < 0, last[2] if last else 0, pos[start])
            emit = ~(new & np.concatenate([new[1:], [False]]))  # of the last row it isn't known yet whether it is alone
            if last is not None and last[3] is not None and not new[0]:
                yield last[3]
            waiting = None
            if new[-1]:
                emit[-1] = False
                waiting = record(doc[-1:], doc[-1:], pos[-1:], pos[-1:], batch.column("run").slice(len(seed) - 1))
            yield record(doc[emit], a[emit], pos[emit], pa_[emit], batch.column("run").filter(pa.array(emit)))
            last = (seed[-1], a[-1], pa_[-1], waiting)

    n = partitions(spark)
    plain = F.when(F.col("pos") < 0, F.bitwise_not("pos")).otherwise(F.col("pos"))
    marked = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "seed", "left")  # at most MOST rows
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc"), F.lit(n))).otherwise(0).cast("int")
    dealt = marked.select("seed", "doc", plain.alias("pos"), "run", salt.alias("salt")).repartition(n, "seed", "salt").sortWithinPartitions("seed", "doc", "pos")
    return dealt.select("seed", "doc", "pos", "run").mapInArrow(star, "b long, a long, pb int, pa int, run long")


def _places_in(sorted_: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Where each seed stands among the sorted ones, or -1."""
    if not len(sorted_):
        return np.full(len(seed), -1)
    at = np.minimum(np.searchsorted(sorted_, seed), len(sorted_) - 1)
    return np.where(sorted_[at] == seed, at, -1)


def _firsts(rows: DataFrame, hot: DataFrame) -> Broadcast:
    """(seed, doc, pos) of the first place of each hot seed, sorted by seed: of each batch, then of all."""
    context = rows.sparkSession.sparkContext
    seeds_ = context.broadcast(np.sort(np.asarray(hot.toArrow().column("seed").combine_chunks(), np.int64)))  # at most MOST

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places_in(seeds_.value, np.asarray(batch.column("seed")))
            which = np.flatnonzero(at >= 0)
            if len(which):
                at, doc, pos = at[which], np.asarray(batch.column("doc"))[which], np.asarray(batch.column("pos"))[which]
                pos = np.where(pos < 0, ~pos, pos)
                order = np.lexsort([pos, doc, at])
                first = order[np.concatenate([[True], at[order][1:] != at[order][:-1]])]
                yield pa.RecordBatch.from_arrays([int64(seeds_.value[at[first]]), int64(doc[first]), pa.array(pos[first].astype(np.int32))], ["seed", "doc", "pos"])

    least = rows.select("seed", "doc", "pos").mapInArrow(local, "seed long, doc long, pos int").groupBy("seed").agg(F.min(F.struct("doc", "pos")).alias("f"))
    table = least.select("seed", "f.doc", "f.pos").toArrow().sort_by("seed")
    return context.broadcast(tuple(np.asarray(table.column(c).combine_chunks()) for c in ("seed", "doc", "pos")))


class Fenwick:
    """Best (value, index) at or before a place."""

    def __init__(self, n: int):
        self.best = [(0.0, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def get(self, i: int) -> tuple[float, int]:
        """Over places below i."""
        out = (float("-inf"), -1)
        while i > 0:
            if self.best[i][1] >= 0 and self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


def anchors_of(pa_: np.ndarray, pb: np.ndarray, size: np.ndarray) -> list[tuple[int, int, int]]:
    """(a, b, words): matches of ``size`` words on one diagonal that overlap or touch, joined."""
    order = np.lexsort([pb, pb - pa_])
    a, b = pa_[order].astype(np.int64), pb[order].astype(np.int64)
    new = np.concatenate([[True], b[1:] - a[1:] != b[:-1] - a[:-1]])
    # the furthest end so far on the diagonal: diagonals are set apart by a step that no end reaches
    step = (np.cumsum(new) - 1) * (1 << 32)
    reach = np.maximum.accumulate(b + size[order] + step) - step
    cut = np.flatnonzero(new | np.concatenate([[True], b[1:] > reach[:-1]]))
    last = np.concatenate([cut[1:], [len(a)]]) - 1
    return sorted(zip(a[cut].tolist(), b[cut].tolist(), (reach[last] - b[cut]).tolist()), key=lambda x: (x[1], x[0]))


def chains_of(anchors: list[tuple[int, int, int]], gap: float) -> list[tuple[float, list[tuple[int, int, int]]]]:
    """Disjoint chains, best first. A chain takes anchors whose starts rise in both documents; an anchor scores
    its words, less those that overlap the one before and less ``gap`` per word passed over."""
    n = len(anchors)
    if n == 1:
        return [(float(anchors[0][2]), anchors)]
    places = sorted({a + w for a, _, w in anchors} | {a for a, _, _ in anchors})
    at = {p: i for i, p in enumerate(places)}
    tree, score, back = Fenwick(len(places)), [0.0] * n, [-1] * n
    # anchors enter the tree at their ends, once the sweep over b has passed them
    waiting = sorted(range(n), key=lambda i: anchors[i][1] + anchors[i][2])
    k = 0
    for i, (a, b, w) in enumerate(anchors):
        while k < n and anchors[waiting[k]][1] + anchors[waiting[k]][2] <= b:
            j = waiting[k]
            aj, bj, wj = anchors[j]
            tree.put(at[aj + wj], (score[j] + gap * (aj + bj + 2 * wj), j))
            k += 1
        value, j = tree.get(at[a] + 1)
        score[i] = float(w)
        if j >= 0 and value - gap * (a + b) > 0:
            score[i] += value - gap * (a + b)
            back[i] = j
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        if used[i]:
            continue
        chain, j = [], i
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(anchors[j])
            j = back[j]
        out.append((score[i] - (score[j] if j >= 0 else 0.0), chain[::-1]))
    return out


CHAIN = "a long, b0 int, b1 int, a0 int, a1 int, score double, anchors int"


def chains(found: DataFrame, config: ChainConfig) -> DataFrame:
    """(b, chains): the word extents of every chain of b with another document that may reach min_words.

    found are matches (b, a, pb, pa, size). Those of one document are at most its seeds and runs.
    """
    spark = found.sparkSession
    kind = pa.list_(pa.struct([("a", pa.int64()), *((n, pa.int32()) for n in ("b0", "b1", "a0", "a1")), ("score", pa.float64()), ("anchors", pa.int32())]))
    least = config.min_words - 2 * config.margin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        rows: list[list[dict]] = []
        held = 0
        for (b, a), (pb, pa_, size), _, _ in groups(batches, ["b", "a"], ["pb", "pa", "size"], 1 << 30):
            own = []
            for score, chain in chains_of(anchors_of(pa_, pb, size), config.gap):
                b0, b1, a0, a1 = chain[0][1], max(y + w for _, y, w in chain), chain[0][0], max(x + w for x, _, w in chain)
                if min(b1 - b0, a1 - a0) >= least:
                    own.append({"a": a, "b0": b0, "b1": b1, "a0": a0, "a1": a1, "score": score, "anchors": len(chain)})
            if not own:
                continue
            if ids and ids[-1] == b:
                rows[-1] += own
            else:
                if held > 4096:
                    yield pa.RecordBatch.from_arrays([int64(ids), pa.array(rows, kind)], ["b", "chains"])
                    ids, rows, held = [], [], 0
                ids.append(b)
                rows.append(own)
            held += len(own)
        if ids:
            yield pa.RecordBatch.from_arrays([int64(ids), pa.array(rows, kind)], ["b", "chains"])

    dealt = found.repartition(partitions(spark), "b").sortWithinPartitions("b", "a", "pb", "pa")
    return dealt.mapInArrow(run, f"b long, chains array<struct<{CHAIN.replace(' ', ':').replace(',:', ', ')}>>")


def common_words(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence: common ends first, the middle bit-parallel over y."""
    n = min(len(x), len(y))
    unlike = np.flatnonzero(x[:n] != y[:n])
    if not len(unlike):
        return n
    head = int(unlike[0])
    x, y, n = x[head:], y[head:], n - head
    unlike = np.flatnonzero(x[len(x) - n :] != y[len(y) - n :])
    if not len(unlike):
        return head + n
    tail = n - 1 - int(unlike[-1])
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    where: dict[int, int] = {}
    for i, w in enumerate(y.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    mask = (1 << len(y)) - 1
    v = mask
    for w in x.tolist():
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & mask
    return head + tail + len(y) - v.bit_count()


def _run(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Score and length of the best run on one diagonal: matches count 1, mismatches -2."""
    n = min(len(x), len(y))
    if not n:
        return 0, 0
    total = np.cumsum(np.where(x[:n] == y[:n], 1, -2))
    best = int(total.argmax())
    return (int(total[best]), best + 1) if total[best] > 0 else (0, 0)


def extended(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Words of x and of y by which two passages go on alike; after a run up to two words of either may be
    passed over, at 2 each, if the words after them agree and what follows makes up for them."""
    i = j = _run(x, y)[1]
    while True:
        best = (0, 0, 0, 0)
        for di, dj in ((0, 1), (1, 0), (1, 1), (0, 2), (2, 0)):
            if i + di < len(x) and j + dj < len(y) and x[i + di] == y[j + dj]:
                score, length = _run(x[i + di :], y[j + dj :])
                best = max(best, (score - 2 * (di + dj), length, di, dj))
        if best[0] <= 0:
            return i, j
        i, j = i + best[2] + best[1], j + best[3] + best[1]


def _keyed(docs: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """(doc, text) with a key for each distinct row, and (key, id) of the rows whose key isn't their doc_id.

    A doc_id that may occur again, is null or negative or doesn't fit has a hash of doc_id and text as its key,
    above all others; rows that repeat doc_id and text are one.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    fits = f"id >= 0 and id < {ODD}L"
    repeated = base.where(fits).groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    # a null is among the keys, and stands for all ids that don't fit
    bits = key_filter(repeated.select(F.col("id").alias("key")).unionByName(docs.sparkSession.range(1).selectExpr("cast(null as bigint) key")))
    key = F.xxhash64("id", "text").bitwiseAND(F.lit(ODD - 1)).bitwiseOR(F.lit(ODD))
    odd = stage.write(may_be_in(base, f"if({fits}, id, null)", bits).distinct().withColumn("key", key), "odd")
    plain = may_be_in(base.where(fits), "id", bits, False).select(F.col("id").alias("doc"), "text")
    return plain.unionByName(odd.select(F.col("key").alias("doc"), "text")), odd.select("key", "id")


def passages(docs: DataFrame, config: ChainConfig = ChainConfig(), stage: Stage | None = None) -> DataFrame:
    """doc_id, start, end, rep_id, rep_start, rep_end, score, anchors, identity: passages of doc_id (words start
    to end, from 0) and the like passages of rep_id, an earlier document that stands for their class.

    Documents go by doc_id; those whose doc_id is null, negative or occurs again with another text come after all
    others, each row a document of its own. Rows that repeat doc_id and text are one document. Passages shared by
    many documents are linked to their representatives, not with each other; repeats within one document are no
    shared passages. Null and empty texts, and texts of fewer than ``min_words`` words, have none; longer texts are
    searched whole, whatever their length. Of equal chains all are kept. An empty table gives no rows, and other
    columns of docs are left out.
    """
    stage = stage or Stage(docs.sparkSession, "passages")
    base, odd = _keyed(docs, stage)
    places = stage.write(seeds(base, config), "seeds")
    hot = stage.write(hot_seeds(places, config), "hot")
    found = stage.write(matches(places, hot), "matches")
    stage.drop("seeds")
    # places of runs: only those whose seed occurs again; a place is among the matches once
    runs = matches(found.where("run is not null").select(F.col("run").alias("seed"), F.col("b").alias("doc"), F.col("pb").alias("pos"), F.lit(None).cast("long").alias("run")), hot)
    both = found.withColumn("size", F.lit(config.k)).unionByName(runs.withColumn("size", F.lit(config.min_words))).drop("run")
    linked = stage.write(chains(both.where("a <> b"), config), "chains")
    stage.drop("matches")
    first = _aligned(base, linked, config)
    names = first.columns
    for c in ("doc_id", "rep_id"):
        first = first.join(odd.select(F.col("key").alias(c), F.col("id").alias("__id"), F.lit(True).alias("__odd")), c, "left").withColumn(c, F.when(F.col("__odd"), F.col("__id")).otherwise(F.col(c))).drop("__id", "__odd")
    return first.select(*names)


FIELDS = ["a", "b0", "b1", "a0", "a1", "score", "anchors"]


def _cut_words(batch: pa.RecordBatch, config: ChainConfig) -> Iterator[list[pa.Array]]:
    """Of rows (b, text, chains): FIELDS of each chain, b, and the place and hashes of b's words around it.

    Texts are hashed CHUNK bytes at a time, however many a batch holds.
    """
    texts = as_bytes(batch.column("text"))
    for s, e in slices(map(len, texts), CHUNK):
        lists = batch.column("chains").slice(s, e - s)
        flat, lengths = lists.flatten(), np.asarray(lists.value_lengths())
        columns = {f: np.asarray(flat.field(f)) for f in ("b0", "b1")}
        words = word_hashes(texts[s:e])
        doc = np.repeat(np.asarray(batch.column("b"))[s:e], lengths)
        row = np.repeat(np.arange(e - s), lengths)
        low = np.maximum(0, columns["b0"].astype(np.int64) - config.margin)
        high = columns["b1"].astype(np.int64) + config.margin
        for x, y in slices((4 * (high - low)).tolist(), 1 << 20):
            parts = [words[r][i:j].astype("<u4").tobytes() for r, i, j in zip(row[x:y].tolist(), low[x:y].tolist(), high[x:y].tolist())]
            yield [flat.field(f).slice(x, y - x) for f in FIELDS] + [int64(doc[x:y]), pa.array(low[x:y].astype(np.int32)), pa.array(parts, pa.binary())]


def _aligned(base: DataFrame, linked: DataFrame, config: ChainConfig) -> DataFrame:
    """The passages that chains extend to.

    The words of b around each chain go to the document a, where they are aligned. An a that very many chains lead
    to is a skewed key of a plain join, which adaptive execution splits.
    """
    cut_names = [*FIELDS, "b", "at", "words"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in _cut_words(batch, config):
                yield pa.RecordBatch.from_arrays(out, cut_names)

    cut_out = base.join(linked, base.doc == linked.b).select("b", "text", "chains").mapInArrow(cut, f"{CHAIN}, b long, at int, words binary")
    both = cut_out.join(base.select(F.col("doc").alias("a"), "text"), "a").select(*cut_names, "text")
    names = ["doc_id", "start", "end", "rep_id", "rep_start", "rep_end", "score", "anchors", "identity"]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, x = None, np.zeros(0, "<u4")  # rows come by a
        for batch in batches:
            out = []
            texts, words = batch.column("text").cast(pa.binary()), batch.column("words")
            numbers = (batch.column(c).to_pylist() for c in ("a", "b", "b0", "b1", "a0", "a1", "score", "anchors", "at"))
            for i, (a, b, b0, b1, a0, a1, score, anchors, at) in enumerate(zip(*numbers)):
                if a != known:
                    known, x = a, word_hashes([texts[i].as_py()])[0].astype("<u4")
                y = np.frombuffer(words[i].as_py(), "<u4")
                b0, b1 = b0 - at, b1 - at
                before, after = x[max(0, a0 - config.margin) : a0], x[a1 : a1 + config.margin]
                left, right = extended(before[::-1], y[:b0][::-1]), extended(after, y[b1:])
                for a0, b0, a1, b1 in ((a0 - left[0], b0 - left[1], a1 + right[0], b1 + right[1]), (a0, b0, a1, b1)):  # else as it was
                    if min(a1 - a0, b1 - b0) < config.min_words:
                        break
                    same = common_words(x[a0:a1], y[b0:b1]) / max(a1 - a0, b1 - b0)
                    if same >= config.identity:
                        out.append((b, b0 + at, b1 + at, a, a0, a1, score, anchors, same))
                        break
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return both.mapInArrow(align, "doc_id long, start int, end int, rep_id long, rep_start int, rep_end int, score double, anchors int, identity double")

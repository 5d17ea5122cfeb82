"""An inverted-file vector index with product quantisation, and exact re-scoring of what its bounds leave.

Coarse k-means cells and residual codebooks are fitted on a bounded sample: the ``train_rows`` vectors with the least hash of
their id. Every vector is indexed: its cell, a code of one byte for each of ``parts`` stretches of its residual,
the distance between it and what the code decodes to, and the vector itself (for cosine at length one). Rows are Parquet, partitioned by cell.

A search sends each question to its ``nprobe`` nearest cells; questions and codes meet by a cogrouped join on (cell, group),
in which lookup tables give the distance to each decoded vector. Since the error of decoding is stored, the triangle
inequality gives a lower and an upper bound of the true distance. A vector whose lower bound exceeds the k-th upper
bound of its group can't be among the k best; all others are re-scored from their vectors, in the same task, which passes on its k best.
So what is shuffled doesn't grow with how loose the bounds are. The ranking is exact within the
probed cells, and over all rows with ``nprobe`` as large as the number of cells.

Groups hold about ``group_rows`` vectors: a cell with a large share of the sample is dealt out to more groups, so that
copies don't meet in one task. Questions of a cell are split into blocks of ``QUERY_BLOCK``.

Left out, by definition: rows with a null id or vector, null or non-finite components, another length than the sample's most
common one, and, for cosine, zero vectors. Rows that share an id are rows of their own; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from .retrieval import QUERY_BLOCK, TILE, top_k

CODES = "cell int, group int, id long, tag string, embedding array<double>, code binary, error double"
#: What rounding can do to a bound.
SLACK = 1e-7


def _by(key: str, order: str | None = None) -> WindowSpec:
    w = Window.partitionBy(key)
    return w.orderBy(order) if order else w


@dataclass(frozen=True)
class IndexConfig:
    """metric: cosine or l2. cells, codes: sizes of the codebooks at most (codes up to 256)."""

    cells: int = 64
    parts: int = 8
    codes: int = 64
    nprobe: int = 16
    metric: str = "cosine"
    train_rows: int = 16_384
    rounds: int = 15
    group_rows: int = 20_000


def usable(vectors: DataFrame, id_: str, metric: str) -> DataFrame:
    """Rows that have an id and a finite vector; for cosine one that isn't zero."""
    fine = vectors.where(f"{id_} is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return fine.where("exists(embedding, x -> x <> 0)") if metric == "cosine" else fine


def _matrix(column: pa.Array, metric: str) -> np.ndarray:
    x = np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)
    if metric == "cosine":
        x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x


def _lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0)


def k_means(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """At most k centres by Lloyd's rounds, begun with rows drawn by squared distance; empty cells move to the farthest rows."""
    rng, chosen, far = np.random.default_rng(0), [0], np.full(len(x), np.inf)
    while len(chosen) < k:
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        if not far.sum():
            break
        chosen.append(int(rng.choice(len(x), p=far / far.sum())))
    centres = x[chosen].copy()
    for _ in range(rounds):
        d = _squares(x, centres)
        near = d.argmin(axis=1)
        sizes = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
        empty = np.flatnonzero(sizes == 0)
        centres[empty] = x[np.argsort(-d[np.arange(len(x)), near], kind="stable")[: len(empty)]]
    return centres


@dataclass
class Model:
    """centres (cells, d) and one codebook (codes, length) for each stretch of the residual. Of a fixed size."""

    centres: np.ndarray
    books: list[np.ndarray]
    groups: np.ndarray
    metric: str

    @property
    def cuts(self) -> list[int]:
        return np.cumsum([0] + [b.shape[1] for b in self.books]).tolist()

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, codes, distance to what they decode to) of each row."""
        cell = _squares(x, self.centres).argmin(axis=1)
        rest, c = x - self.centres[cell], self.cuts
        codes = np.stack([_squares(rest[:, a:b], book).argmin(axis=1) for a, b, book in zip(c, c[1:], self.books)], axis=1).astype(np.uint8)
        error = rest - np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], axis=1)
        return cell, codes, np.sqrt((error * error).sum(axis=1))

    def distances(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Distances of questions to decoded vectors of one cell, from lookup tables."""
        rest, c = q - self.centres[cell], self.cuts
        total = np.zeros((len(q), len(codes)))
        for j, (a, b, book) in enumerate(zip(c, c[1:], self.books)):
            total += np.take(_squares(rest[:, a:b], book), codes[:, j], axis=1)
        return np.sqrt(total)


def _k_best(q: np.ndarray, v: np.ndarray, left: np.ndarray, ids: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, vector, score) of the k best of what is left for each question; ties to the smaller id.

    A matrix product finds what comes near the k-th; those are scored one by one, so that copies get equal scores.
    """
    columns = np.flatnonzero(left.any(axis=0))
    left, v, ids = left[:, columns], v[columns], ids[columns]
    near = np.where(left, q @ v.T if metric == "cosine" else -_squares(q, v), -np.inf)
    if len(columns) > k:
        scale = 1e-9 if metric == "cosine" else 1e-9 * max(1.0, float((q * q).sum(axis=1).max(initial=0)), float((v * v).sum(axis=1).max(initial=0)))
        left = left & (near >= np.partition(near, len(columns) - k, axis=1)[:, len(columns) - k][:, None] - scale)
    a, b = np.nonzero(left)
    score = np.empty(len(a))
    for i in range(0, len(a), 1 << 16):
        x, y = q[a[i : i + (1 << 16)]], v[b[i : i + (1 << 16)]]
        score[i : i + (1 << 16)] = (x * y).sum(axis=1) if metric == "cosine" else -np.sqrt(((x - y) ** 2).sum(axis=1))
    order = np.lexsort((ids[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    first = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[first], columns[b[first]], score[first]


def fit(vectors: DataFrame, config: IndexConfig) -> Model | None:
    """The model of the sample; none if there are no usable vectors. n counts all of them for the groups."""
    rows = usable(vectors, "id", config.metric).select(F.xxhash64("id").alias("h"), "id", "embedding")
    n = rows.count()
    sample = rows.orderBy("h", "id").limit(config.train_rows).select("embedding").toArrow().column(0).combine_chunks()  # train_rows at most
    if not n:
        return None
    lengths = np.asarray(sample.value_lengths())
    d = int(np.bincount(lengths).argmax())
    x = _matrix(sample.filter(pa.array(lengths == d)), config.metric)
    centres = k_means(x, config.cells, config.rounds)
    cell = _squares(x, centres).argmin(axis=1)
    edges = np.unique(np.linspace(0, d, min(config.parts, d) + 1).astype(int))
    rest = x - centres[cell]
    books = [k_means(rest[:, a:b], min(config.codes, 256), config.rounds) for a, b in zip(edges, edges[1:])]
    share = np.bincount(cell, minlength=len(centres)) / len(cell)
    return Model(centres, books, np.maximum(1, np.ceil(share * n / config.group_rows)).astype(np.int64), config.metric)


class VectorIndex:
    """A written index: ``model`` (one row), ``codes`` partitioned by cell."""

    def __init__(self, spark: SparkSession, path: str, config: IndexConfig = IndexConfig()):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config

    @property
    def model(self) -> Model:
        row = self.spark.read.parquet(f"{self.path}/model").first()
        centres = np.array(row.centres).reshape(-1, row.d)
        books = [np.array(b).reshape(-1, w) for b, w in zip(row.books, row.widths)]
        return Model(centres, books, np.array(row.groups), row.metric)

    @property
    def codes(self) -> DataFrame:
        return self.spark.read.schema(CODES).parquet(f"{self.path}/codes")

    @classmethod
    def create(cls, vectors: DataFrame, path: str, config: IndexConfig = IndexConfig()) -> VectorIndex:
        """Fits the model on the sample and indexes every usable row of vectors (id, embedding[, tag])."""
        index = cls(vectors.sparkSession, path, config)
        model = fit(vectors, config)
        if model is None:
            model = Model(np.zeros((1, 1)), [np.zeros((1, 1))], np.ones(1, np.int64), config.metric)
        row = [(model.centres.shape[1], model.centres.ravel().tolist(), [b.ravel().tolist() for b in model.books], [b.shape[1] for b in model.books], model.groups.tolist(), config.metric)]
        schema = "d int, centres array<double>, books array<array<double>>, widths array<int>, groups array<long>, metric string"
        index.spark.createDataFrame(row, schema).coalesce(1).write.parquet(f"{index.path}/model")
        index.add(vectors)
        return index

    def add(self, vectors: DataFrame) -> None:
        """Indexes further rows with the same model; what is there isn't rewritten."""
        model = self.model
        shared, metric, d = self.spark.sparkContext.broadcast(model), model.metric, model.centres.shape[1]
        rows = usable(vectors, "id", metric).where(F.size("embedding") == d)
        tag = F.col("tag").cast("string") if "tag" in vectors.columns else F.lit(None).cast("string")
        rows = rows.select(F.col("id").cast("long").alias("id"), tag.alias("tag"), F.col("embedding").cast("array<double>").alias("embedding"))

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column("embedding"), metric)
                    cell, codes, error = m.encode(x)
                    group = np.asarray(batch.column("id")) % m.groups[cell]
                    columns = [pa.array(cell, pa.int32()), pa.array(group, pa.int32()), batch.column("id"), batch.column("tag"), _lists(x), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)]
                    yield pa.RecordBatch.from_arrays(columns, ["cell", "group", "id", "tag", "embedding", "code", "error"])

        found = rows.mapInArrow(encode, CODES)
        found.repartition("cell", "group").write.mode("append").partitionBy("cell").parquet(f"{self.path}/codes")

    def probes(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """(qid, tag, embedding scaled as the metric asks, cell): a question's nearest cells."""
        model = self.model
        shared, metric = self.spark.sparkContext.broadcast(model), model.metric
        tag = F.col("tag").cast("string") if "tag" in queries.columns else F.lit(None).cast("string")
        rows = usable(queries, "qid", metric).where(F.size("embedding") == model.centres.shape[1]).select(F.col("qid").cast("long").alias("qid"), tag.alias("tag"), F.col("embedding").cast("array<double>").alias("embedding"))

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column("embedding"), metric)
                    cells = np.argsort(_squares(x, shared.value.centres), axis=1, kind="stable")[:, :nprobe]
                    at = pa.array(np.repeat(np.arange(len(x)), cells.shape[1]))
                    yield pa.RecordBatch.from_arrays([batch.column("qid").take(at), batch.column("tag").take(at), _lists(x).take(at), pa.array(cells.ravel(), pa.int32())], ["qid", "tag", "embedding", "cell"])

        return rows.mapInArrow(nearest, "qid long, tag string, embedding array<double>, cell int")

    def candidates(self, queries: DataFrame, k: int, nprobe: int | None = None, same: bool = False) -> DataFrame:
        """(qid, id, cell): all rows of the probed cells that can be among the k best by the bounds of their distance."""
        kth = F.max(F.when(F.col("place") == k, F.col("high"))).over(_by("qid"))
        found = self._bounds(queries, k, nprobe, same).withColumn("place", F.row_number().over(_by("qid", "high"))).withColumn("kth", kth)
        return found.where("kth is null or low <= kth").select("qid", "id", "cell").distinct()

    def _bounds(self, queries: DataFrame, k: int, nprobe: int | None, same: bool) -> DataFrame:
        """(qid, id, cell, low, high): what each group of codes can't leave out by itself."""
        return self._met(queries, k, nprobe, same, False)

    def _met(self, queries: DataFrame, k: int, nprobe: int | None, same: bool, exact: bool) -> DataFrame:
        """What each group of codes can't leave out: all of it with its bounds, or (exact) its k best as (qid, id, score)."""
        model = self.model
        probes = self.probes(queries, min(nprobe or self.config.nprobe, len(model.centres)))
        met = {r.cell: r.n for r in probes.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
        blocks = max(1, -(-max(met.values(), default=0) // QUERY_BLOCK))
        codes = self.codes.where(F.col("cell").isin(list(met)))
        spread = F.lit(model.groups.tolist())
        asked = probes.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.get(spread, F.col("cell")).cast("int") - 1)))
        held = codes.select("cell", "group", "id", "tag", "code", "error", *["embedding"] * exact, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        shared = self.spark.sparkContext.broadcast(model)

        def bound(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)][: 3 if exact else 4]
            if left.num_rows and right.num_rows:
                m, cell = shared.value, key[0].as_py()
                vectors = np.asarray(left.column("embedding").combine_chunks().flatten()).reshape(left.num_rows, -1)
                qids, ids = np.asarray(left.column("qid")), np.asarray(right.column("id"))
                error, tags = np.asarray(right.column("error")), (np.array(t.column("tag").to_pylist(), object) for t in (left, right))
                own, theirs = tags
                grid = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
                full = np.asarray(right.column("embedding").combine_chunks().flatten()).reshape(len(ids), -1) if exact else None
                found = []
                for a in range(0, len(qids), TILE):
                    d = m.distances(vectors[a : a + TILE], cell, grid)
                    high = d + error + SLACK
                    fit = qids[a : a + TILE, None] != ids[None, :]
                    if same:
                        fit &= (own[a : a + TILE, None] == theirs[None, :]) & np.array([t is not None for t in theirs])
                    high[~fit] = np.inf
                    least = np.partition(high, k - 1, axis=1)[:, k - 1 : k] if len(ids) > k else np.inf
                    left = fit & (d - error - SLACK <= least)
                    if exact:
                        q, i, score = _k_best(vectors[a : a + TILE], full, left, ids, k, m.metric)
                        found.append((qids[a + q], ids[i], score))
                        continue
                    q, i = np.nonzero(left)
                    found.append((qids[a + q], ids[i], (d - error - SLACK)[q, i], high[q, i]))
                out = [np.concatenate(x) for x in zip(*found)]
            if exact:
                return pa.table({"qid": out[0], "id": out[1], "score": out[2]})
            return pa.table({"qid": out[0], "id": out[1], "cell": pa.array(np.full(len(out[0]), key[0].as_py()), pa.int32()), "low": out[2], "high": out[3]})

        keys = ["cell", "group", "block"]
        return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(bound, "qid long, id long, score double" if exact else "qid long, id long, cell int, low double, high double")

    def search(self, queries: DataFrame, k: int, nprobe: int | None = None, same: bool = False) -> DataFrame:
        """(qid, rank, id, score): the k best rows of the probed cells, scored exactly. With ``same`` only rows of the question's tag count.

        A vector isn't its own answer. score: cosine, or the negated distance.
        """
        return top_k(self._met(queries, k, nprobe, same, True), k).select("qid", "rank", "id", "score")

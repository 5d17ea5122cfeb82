"""Quality classifier: support vectors over naive Bayes features (NB-SVM).

A document is the set of its hashed n-grams (indicators, not counts). Each indicator is scaled by the
log ratio of its smoothed shares in the two classes, and a linear model with hinge loss is fitted on the
scaled indicators by dual coordinate descent. A logistic curve turns margins into scores from 0 to 1.

The n-grams are of two kinds: words, and runs of one to three word *shapes* (letter case, punctuation
at the end, digits, symbols, whether the word before is the same). A share of a shape in the document,
in steps, makes a further indicator, so that a single odd word doesn't weigh as much as a page of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import as_bytes, schema_with, slices, small_batches

BITS = 18
#: Bytes of text that numpy works on at once: its arrays of eight bytes a letter stay small.
CHUNK = 1 << 16


@dataclass(frozen=True)
class QualityConfig:
    """max_train: most labelled rows of each class used to fit; they are picked by a hash of doc_id."""

    max_train: int = 4000
    smoothing: float = 1.0
    cost: float = 1.0
    epochs: int = 12
    threshold: float = 0.3


_KIND = np.full(256, 4, np.uint8)  # symbols
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[128:] = 0  # bytes of other scripts count as lower-case letters
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[ord(c) for c in ".,;:?!'\"()-"]] = 3


def _shapes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A small code for the shape of each word."""
    kinds = _KIND[buf]
    n = ends - starts
    per_kind = []
    for k in range(5):
        total = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(kinds == k, out=total[1:])
        per_kind.append(total[ends] - total[starts])
    low, up, digit, mark, symbol = per_kind
    case = np.where(up == 0, 0, np.where((up > 1) & (up >= 0.5 * (up + low)), 3, np.where(low > 0, 1, 2)))
    last, before = buf[ends - 1], buf[np.maximum(ends - 2, starts)]
    end = np.where(kinds[ends - 1] < 3, 0, np.where((n > 1) & (last == before), 2, 1))
    same = np.zeros(len(words), np.int64)
    if len(words) > 1:
        same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    bare = (low + up + digit) == 0
    return case + 4 * end + 12 * (symbol > 0) + 24 * (digit > 0) + 48 * same + 96 * bare + 192 * (n > 20)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs without repeats, sorted by document."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts, ends = wh.spans(buf)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.searchsorted(np.cumsum(sizes), starts, side="right")
    words = wh.span_hashes(buf, starts, ends)
    shape = _shapes(buf, starts, ends, words, doc).astype(np.uint64)
    lowered = wh.span_hashes(wh.LOWER[buf], starts, ends)
    mask = np.uint64((1 << BITS) - 1)
    found = [doc * (1 << BITS) + (lowered & mask).astype(np.int64)]
    for n in (1, 2, 3):
        grams = wh.ngram_hashes(shape + np.uint64(1000 * n), n)
        whole = doc[: len(grams)] == doc[n - 1 :]
        found.append(doc[: len(grams)][whole] * (1 << BITS) + (grams & mask).astype(np.int64)[whole])
    pairs, counts = np.unique(doc * 1024 + shape.astype(np.int64), return_counts=True)
    of, code = pairs // 1024, pairs % 1024
    totals = np.bincount(doc, minlength=len(texts))
    step = np.ceil(10.0 * counts / totals[of]).astype(np.uint64)
    shares = wh.mix((code.astype(np.uint64) << np.uint64(8)) + step + np.uint64(7 << 40))
    found.append(of * (1 << BITS) + (shares & mask).astype(np.int64))
    all_pairs = np.unique(np.concatenate(found))
    return all_pairs >> BITS, all_pairs & ((1 << BITS) - 1)


def rows_of(texts: list[bytes]) -> list[np.ndarray]:
    doc, idx = features(texts)
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [idx[cuts[i] : cuts[i + 1]] for i in range(len(texts))]


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, texts: list[bytes]) -> np.ndarray:
        doc, idx = features(texts)
        found = np.bincount(doc, minlength=len(texts))
        raw = np.bincount(doc, self.weights[idx], len(texts)) if len(doc) else np.zeros(len(texts))
        return raw / np.sqrt(np.maximum(found, 1)) + self.bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -35, 35)))


def fit(rows: list[np.ndarray], labels: np.ndarray, config: QualityConfig = QualityConfig()) -> QualityModel:
    """Fits on documents given as arrays of distinct feature numbers; labels are 0 or 1.

    Without two classes the score is the share of label 1 (one half without rows).
    """
    size = 1 << BITS
    labels = np.asarray(labels)
    good, bad = int((labels == 1).sum()), int((labels == 0).sum())
    if not good or not bad:
        share = good / (good + bad) if good + bad else 0.5
        return QualityModel(np.zeros(size), 0.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    counts = np.full((2, size), config.smoothing)
    for x, y in zip(rows, labels):
        counts[int(y), x] += 1
    ratio = np.log((counts[1] / (good + 2 * config.smoothing)) / (counts[0] / (bad + 2 * config.smoothing)))
    signs = np.where(labels == 1, 1.0, -1.0)
    cost = np.where(labels == 1, config.cost * (good + bad) / (2 * good), config.cost * (good + bad) / (2 * bad))
    values = [ratio[x] / np.sqrt(max(1, len(x))) for x in rows]
    square = np.array([v @ v + 1.0 for v in values])
    weights, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(0)
    for _ in range(config.epochs):
        for i in rng.permutation(len(rows)):
            x, v, y = rows[i], values[i], signs[i]
            slope = y * (weights[x] @ v + bias) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                weights[x] += step * v
                bias += step
                alpha[i] = new
    margins = np.array([weights[x] @ v + bias for x, v in zip(rows, values)])
    a, b = _logistic(margins, labels, np.where(labels == 1, 0.5 / good, 0.5 / bad))
    return QualityModel(weights * ratio, float(bias), a, b)


def _logistic(margins: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by damped Newton steps, both classes weighing the same."""
    a, b, n = 1.0, 0.0, len(margins)
    target = np.where(labels == 1, 1 - 1 / (n + 2), 1 / (n + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        g, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[h @ margins**2 + 1e-4, h @ margins], [h @ margins, h.sum() + 1e-6]])
        da, db = np.linalg.solve(hess, [g @ margins + 1e-4 * (a - 1), g.sum()])
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return max(float(a), 1e-3), float(b)


def training_rows(docs: DataFrame, labels: DataFrame, config: QualityConfig) -> DataFrame:
    """At most max_train labelled rows of each class outside the held-out fold, with their whole texts."""
    labelled = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(
        "doc_id is not null and quality in (0, 1) and crc32(cast(doc_id as string)) % 5 <> 0"
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = None
    for q in (0, 1):
        part = labelled.where(F.col("quality") == q).orderBy(*order).limit(config.max_train)
        picked = part if picked is None else picked.unionByName(part)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").orderBy(*order, "text").limit(2 * config.max_train)


def train(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> QualityModel:
    """Turns the bounded sample into features on the executors and fits in one task; only the model reaches the driver."""
    small_batches(docs.sparkSession)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            out = [rows_of(texts[a:b]) for a, b in slices(map(len, texts), CHUNK)]
            data = [x.astype("<i4").tobytes() for part in out for x in part]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array(data, pa.binary())], ["doc_id", "quality", "found"]
            )

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(d, x, q) for batch in batches for d, x, q in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "found", "quality")))]
        held.sort(key=lambda r: r[:2])
        model = fit([np.frombuffer(x, "<i4") for _, x, _ in held], np.array([q for _, _, q in held], int), config)
        numbers = pa.array([[model.bias, model.slope, model.shift]], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype("<f8").tobytes()], pa.binary()), numbers], ["weights", "numbers"])

    sample = training_rows(docs, labels, config).select(F.col("doc_id").cast("string").alias("doc_id"), "quality", "text")
    rows = sample.repartition(8).mapInArrow(featurise, "doc_id string, quality int, found binary")
    got = rows.repartition(1).mapInArrow(fitted, "weights binary, numbers array<double>").first()  # at most 2 * max_train rows
    if got is None:  # no rows to train on
        return fit([], np.zeros(0, int), config)
    return QualityModel(np.frombuffer(bytes(got["weights"]), "<f8"), *got["numbers"])


def score(docs: DataFrame, model: QualityModel, config: QualityConfig = QualityConfig()) -> DataFrame:
    """All columns of docs plus ``score`` and ``predicted``; a column of those names is replaced.

    Null and empty texts have no n-grams and get the score of the bias alone.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 2**BITS doubles: 2 MB whatever the input
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    base = docs.select(*[F.col(f"`{c}`") for c in kept])
    threshold = config.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            parts = [model.scores(texts[a:b]) for a, b in slices(map(len, texts), CHUNK)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            columns = [*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "score", "predicted"])

    schema = schema_with(base, "score double, predicted int")
    return base.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; rows that repeat, and those without doc_id, one by one.

    Null and empty texts get the score of the model's bias, texts of any length are read whole. A doc_id with several
    rows of labels is trained on once for each. Without labels of both classes the score is the share of label 1. An
    empty table gives no rows; other columns of docs, whatever their names, are left out.
    """
    model = train(docs, labels, config)
    # only the id and the text go through Python
    scored = score(docs.select("doc_id", "text"), model, config)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")

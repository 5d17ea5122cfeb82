"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

The automaton accepts every run of consecutive words of every item. Training words stream through it
and each position gets the length of the longest item run that ends there. A position whose length is at
least ``window`` ends an occurrence of a whole window (``window`` consecutive words of an item); an item
with fewer words is one window by itself. Words inside any such occurrence are hit.

Items are dealt by hash into shards of about ``shard_words`` words. One shard's texts at a time are broadcast, and
each worker builds and keeps that shard's automaton only, so that memory doesn't grow with the benchmark. With
several shards the documents stream through one after the other; what each finds is written by a hash of the text
(128 bits) and comes together before spans are merged or cut.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Stage, as_bytes, int64, schema_with, small_batches

#: Words of A-Z-lowered text: everything but ASCII non-alphanumerics.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class DecontamConfig:
    """window: words that make an occurrence. shard_words: about the item words in one automaton.

    max_coverage: share of hit words above which ``remove_spans`` drops the whole document.
    """

    window: int = 10
    shard_words: int = 300_000
    max_coverage: float = 0.5


class Automaton:
    """Suffix automaton over item words; word numbers are local to it."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.moves: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        pairs = set()
        self.shortest = window
        runs = []
        for item, words in items:
            if not words:
                continue
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            runs.append((item, numbers))
            self.shortest = min(self.shortest, len(numbers))
            pairs.update(zip(numbers, numbers[1:]))
            last = 0
            for c in numbers:
                last = self._extend(last, c)
        # what ends where: the items that have the window, by the state and length of the window
        self.ends: dict[tuple[int, int], set[str | None]] = {}
        for item, numbers in runs:
            need = min(window, len(numbers))
            state = size = 0
            for c in numbers:
                state, size = self.step(state, size, c)
                if size >= need:
                    self.ends.setdefault((self._holder(state, need), need), set()).add(item)
        #: the lengths of windows of items shorter than the window, longest first
        self.needs = sorted({n for _, n in self.ends}, reverse=True)
        self.pairs = np.array(sorted(a * len(self.vocabulary) + b for a, b in pairs), np.int64)

    def _extend(self, last: int, c: int) -> int:
        moves, link, length = self.moves, self.link, self.length
        if c in moves[last]:  # a run of an earlier item
            q = moves[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        moves, link, length = self.moves, self.link, self.length
        copy = len(moves)
        moves.append(dict(moves[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and moves[p].get(c) == q:
            moves[p][c] = copy
            p = link[p]
        return copy

    def step(self, state: int, size: int, c: int) -> tuple[int, int]:
        """The state and length of the longest item run that ends with word c."""
        moves, link, length = self.moves, self.link, self.length
        while c not in moves[state]:
            state = link[state]
            if state < 0:
                return 0, 0
            size = length[state]
        return moves[state][c], size + 1

    def _holder(self, state: int, need: int) -> int:
        """The state that stands for the last ``need`` words of a match."""
        while self.length[self.link[state]] >= need:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Occurrences as (first word, word after the last), and the items whose windows occur."""
        get = self.vocabulary.get
        numbers = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        spans: list[tuple[int, int]] = []
        found: set[str | None] = set()
        if not len(self.vocabulary):
            return spans, found
        for a, b in self._regions(numbers):
            state = size = 0
            for i, c in enumerate(numbers[a:b].tolist(), a):
                state, size = self.step(state, size, c)
                if size >= self.shortest:
                    for need in self.needs:
                        if size >= need and (items := self.ends.get((self._holder(state, need), need))) is not None:
                            spans.append((i + 1 - need, i + 1))
                            found |= items
        return spans, found

    def _regions(self, numbers: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of words, each next to one that follows it in an item, long enough for a window."""
        known = numbers >= 0
        if self.shortest == 1:
            joined = known[1:] & known[:-1]
        else:
            code = numbers[:-1] * len(self.vocabulary) + numbers[1:]
            at = np.minimum(np.searchsorted(self.pairs, code), max(0, len(self.pairs) - 1))
            joined = known[1:] & known[:-1] & (self.pairs[at] == code) if len(self.pairs) else np.zeros(max(0, len(numbers) - 1), bool)
        if not len(numbers):
            return
        cut = np.flatnonzero(~joined) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(numbers)]])
        long = (ends - starts >= self.shortest) & known[starts]
        yield from zip(starts[long].tolist(), ends[long].tolist())


def benchmark_shards(benchmark: DataFrame, config: DecontamConfig) -> list[DataFrame]:
    """(item, text) of each shard; the ids of items are strings."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    n = max(1, -(-int(items.agg(F.sum(words)).first()[0] or 0) // config.shard_words))
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


#: The automaton that this worker built last, and which shard it is of.
_BUILT: dict[str, Automaton] = {}


class Shard:
    """One shard's texts on their way to the workers."""

    def __init__(self, items: DataFrame, window: int):
        rows = [(r["item"], r["text"]) for r in items.orderBy("item", "text").collect()]  # about shard_words words
        self.name, self.window = uuid.uuid4().hex, window
        self.shared = items.sparkSession.sparkContext.broadcast(rows)

    def automaton(self) -> Automaton:
        if self.name not in _BUILT:
            _BUILT.clear()
            _BUILT[self.name] = Automaton([(item, WORD.findall(text.encode().lower())) for item, text in self.shared.value], self.window)
        return _BUILT[self.name]


def _scan(text: bytes, automaton: Automaton) -> tuple[int, list[str | None], list[tuple[int, int]]]:
    """Number of words, items found (a null id comes last) and merged spans of one text."""
    words = WORD.findall(text.lower())
    spans, found = automaton.scan(words)
    return len(words), _sorted_items(found), merge(spans)


def _sorted_items(found: set[str | None]) -> list[str | None]:
    return sorted(x for x in found if x is not None) + [None] * (None in found)


_FOUND = "items array<string>, spans array<array<bigint>>"


def _text_key() -> list[Column]:
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("__k0"), F.xxhash64(text, F.lit(1)).alias("__k1")]


def _with_found(docs: DataFrame, shards: list[Shard], stage: Stage) -> DataFrame:
    """docs, and __found: what each of the shards has found in the text, for several shards."""
    found = None
    for k, shard in enumerate(shards):

        def run(batches: Iterator[pa.RecordBatch], shard: Shard = shard) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = [_scan(t, shard.automaton()) for t in as_bytes(batch.column("text"))]
                hit = [i for i, d in enumerate(done) if d[2]]
                columns = [batch.column(c).take(pa.array(hit, pa.int64())) for c in ("__k0", "__k1")]
                columns += [pa.array([done[i][1] for i in hit], pa.list_(pa.string())), pa.array([[list(x) for x in done[i][2]] for i in hit], pa.list_(pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays(columns, ["__k0", "__k1", "items", "spans"])

        here = stage.write(docs.select("text", *_text_key()).mapInArrow(run, f"__k0 long, __k1 long, {_FOUND}"), f"shard-{k}")
        found = here if found is None else found.unionByName(here)
    # rows with one text give each shard's result again; a text has one of each shard
    each = found.distinct().groupBy("__k0", "__k1").agg(F.collect_list(F.struct("items", "spans")).alias("__found"))
    return docs.withColumns(dict(zip(("__k0", "__k1"), _text_key()))).join(each, ["__k0", "__k1"], "left").drop("__k0", "__k1")


def _scanned(docs: DataFrame, benchmark: DataFrame, config: DecontamConfig, make: Callable, schema: StructType) -> DataFrame:
    """mapInArrow over docs of make(batch, results), where results are the number of words, items and spans of each row."""
    small_batches(docs.sparkSession)
    shards = [Shard(items, config.window) for items in benchmark_shards(benchmark, config)]
    if len(shards) > 1:
        docs = _with_found(docs, shards, Stage(docs.sparkSession, "decontaminate"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            if len(shards) == 1:
                yield make(batch, [_scan(t, shards[0].automaton()) for t in texts])
            else:
                results = []
                for text, found in zip(texts, batch.column("__found").to_pylist()):
                    items = _sorted_items({i for f in found or () for i in f["items"]})
                    results.append((len(WORD.findall(text.lower())), items, merge([tuple(x) for f in found or () for x in f["spans"]])))
                yield make(batch.drop_columns(["__found"]), results)

    return docs.mapInArrow(run, schema)


def scan_documents(docs: DataFrame, benchmark: DataFrame, config: DecontamConfig = DecontamConfig()) -> DataFrame:
    """The columns of docs without text, n_words, n_hit, items (array, sorted as strings) and spans (array of
    [first word, word after the last], merged). One row for each row of docs, repeated rows included.

    A null or empty text has no words; texts of any length are scanned whole, one at a time. An empty table of
    documents gives no rows, an empty benchmark hits nothing. An item without words has no window; one with a null
    id counts like any other and stands in items as a null. Items that share an id are one item in items. Columns
    of docs that bear one of the new names are left out.
    """
    new = ("n_words", "n_hit", "items", "spans")
    names = [c for c in docs.columns if c not in new]
    base = docs.select(*[F.col(f"`{c}`") for c in names])
    kept = [c for c in names if c != "text"]

    def make(batch: pa.RecordBatch, results: list) -> pa.RecordBatch:
        columns = [batch.column(c) for c in kept]
        columns += [int64([n for n, _, _ in results]), int64([sum(b - a for a, b in spans) for _, _, spans in results])]
        columns += [pa.array([items for _, items, _ in results], pa.list_(pa.string())), pa.array([[list(x) for x in spans] for _, _, spans in results], pa.list_(pa.list_(pa.int64())))]
        return pa.RecordBatch.from_arrays(columns, [*kept, *new])

    return _scanned(base, benchmark, config, make, schema_with(base.select(*[F.col(f"`{c}`") for c in kept]), f"n_words long, n_hit long, {_FOUND}"))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, config: DecontamConfig = DecontamConfig()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document.

    Nulls, empty and long texts, repeated rows and empty tables: see ``scan_documents``. A null item_id counts in
    n_items and has no part in items_sha256. Columns of docs other than doc_id and text are left out.
    """
    found = scan_documents(docs.select("doc_id", "text"), benchmark, config)
    joined = F.concat_ws(",", "items")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove_spans(docs: DataFrame, benchmark: DataFrame, config: DecontamConfig = DecontamConfig()) -> DataFrame:
    """The documents with hit words, and what stands between them, cut out of their texts.

    A document more than ``max_coverage`` of whose words are hit is dropped whole. Documents without hits
    stay as they are, byte for byte. ``n_chars``, if docs has it, follows the new text. All other columns, whatever
    their names, are kept; repeated rows stay repeated; null and empty texts have no hits.
    """
    names, limit = docs.columns, config.max_coverage

    def make(batch: pa.RecordBatch, results: list) -> pa.RecordBatch:
        keep, new = [], {}
        for i, (n, _, spans) in enumerate(results):
            if sum(b - a for a, b in spans) <= limit * n:
                keep.append(i)
                if spans:
                    new[i] = _without(batch.column("text")[i].as_py().encode(), spans)
        if new:
            text = [new.get(i, t) for i, t in enumerate(batch.column("text").to_pylist())]
            batch = batch.set_column(names.index("text"), "text", pa.array(text, pa.string()))
            if "n_chars" in names:
                n_chars = [len(new[i]) if i in new else n for i, n in enumerate(batch.column("n_chars").to_pylist())]
                batch = batch.set_column(names.index("n_chars"), "n_chars", pa.array(n_chars, batch.schema.field("n_chars").type))
        return batch.take(pa.array(keep, pa.int64()))

    return _scanned(docs, benchmark, config, make, docs.schema)


def _without(text: bytes, spans: list[list[int]]) -> str:
    places = [m.span() for m in WORD.finditer(text.lower())]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]]).decode()

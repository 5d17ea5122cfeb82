"""Token-id output: frequency-ranked ids in byte-aligned variable-length blocks with control bytes.

Format. A block is one row of a Parquet table (columns below), so that writing is atomic per task, can
be retried, and works on any file system that Spark reaches:

* ``shard``, ``block``: place in the output; shards and blocks ascend with doc_id.
* ``shard_start``: ids in the shard before this block.
* ``doc_ids``, ``lengths``: documents of the block in order, and ids in each (end id included).
* ``control``: two bits per id, lowest bits first: bytes that its rank takes, less one.
* ``data``: the ranks, little-endian, in 1 to 4 bytes each.

``ranks`` is a second table (rank, id, n): rank 0 is the most frequent id. It has at most as many rows as
the tokenizer has ids, so it may be broadcast whatever the input.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, int64, partitions, schema_with

END_ID = 1
#: Ids in a block, unless a single document has more.
BLOCK_IDS = 1 << 17
#: Words and pieces of words whose ids a worker remembers before it starts anew; about 200 bytes each.
WORDS, PIECES = 100_000, 800_000
SCHEMA = "shard int, block int, shard_start long, doc_ids array<long>, lengths array<int>, control binary, data binary"


@dataclass(frozen=True)
class TokenConfig:
    """tokenizer: path of a ``tokenizers`` JSON file whose ids don't depend on neighbours across white space."""

    tokenizer: str
    end_id: int = END_ID
    block_ids: int = BLOCK_IDS


#: The normaliser and pre-tokeniser that PLAIN and PIECE stand for.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Printable ASCII, accented letters of Latin-1 and ASCII white space; the pre-token pieces of texts made of them.
PLAIN = bytes([*range(0x21, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100), *b" \t\n\r\x0b\x0c"])
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")


def _byte_letters() -> list[str]:
    """The letter that byte-level models write for each byte: printable ones stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


def _is_plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, PLAIN)
    except UnicodeEncodeError:
        return False


class WordEncoder:
    """Encodes texts through a memo of pre-token pieces.

    The tokenizer drops white space and never merges across pieces, so a text's ids are its pieces' ids in
    order; only pieces not met before go to the library's model. Words with other letters go through the
    whole library, word by word, and so do texts that hold a special token's string. A tokenizer with
    another normaliser or pre-tokeniser than the one that the pieces stand for encodes every text itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        self.known = own.get("normalizer") == NORMALIZER and own.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]} and own.get("post_processor") is None
        self.letters = _byte_letters()
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, pieces: Iterable[str]) -> None:
        tokenize, letters, memo = self.model.tokenize, self.letters, self.pieces
        for p in pieces:
            shown = p if p.isascii() else "".join([letters[b] for b in p.encode()])
            memo[p] = array("I", [t.id for t in tokenize(shown)]).tobytes()

    def _mixed(self, text: str) -> bytes:
        # only ASCII white space ends a word here; other white space is left to the library
        out = []
        for word in text.encode().split():
            w = word.decode()
            if _is_plain(w):
                parts = PIECE.findall(w.lower())
                self._learn([p for p in parts if p not in self.pieces])
                out += [self.pieces[p] for p in parts]
            else:
                if w not in self.words:
                    self.words[w] = self._library(w)
                out.append(self.words[w])
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        for memo, most in ((self.words, WORDS), (self.pieces, PIECES)):
            if len(memo) > most:
                memo.clear()
        out: list = []
        for text in texts:
            if not self.known or any(s in text for s in self.special):
                out.append(self._library(text))
            else:
                out.append(PIECE.findall(text.lower()) if _is_plain(text) else self._mixed(text))
        self._learn(set().union(*(x for x in out if isinstance(x, list))).difference(self.pieces))
        known = self.pieces.__getitem__
        return [np.frombuffer(b"".join(map(known, x)) if isinstance(x, list) else x, "<u4") for x in out]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each Python worker, kept between its tasks."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pack(ids: np.ndarray) -> bytes:
    """Ids as compressed byte planes, for the way between two stages."""
    planes = np.frombuffer(ids.astype("<u4").tobytes(), np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.frombuffer(np.ascontiguousarray(planes.T).tobytes(), "<u4")


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of an array of ranks below 2**32."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = size - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | (quads[:, 1] << 2) | (quads[:, 2] << 4) | (quads[:, 3] << 6)
    grid = np.frombuffer(ranks.tobytes(), np.uint8).reshape(-1, 4)
    data = grid[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


#: Byte lengths of the four ranks that a control byte stands for.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The inverse of encode_ranks by table lookup."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    out = raw[at]
    for k in (1, 2, 3):
        out = out | np.where(size > k, raw[np.minimum(at + k, len(raw) - 1)] << np.uint32(8 * k), np.uint32(0))
    return out


def encode_documents(docs: DataFrame, config: TokenConfig, order: str = "doc_id") -> DataFrame:
    """(order column, doc_id, n, packed): the ids of every whole text and the end id. Null texts are empty."""
    extra = [] if order == "doc_id" else [order]
    base = docs.select("doc_id", *extra, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(config.tokenizer), np.uint32(config.end_id)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = words.encode(texts)
            columns = [batch.column(c) for c in ["doc_id", *extra]]
            columns += [pa.array([len(x) + 1 for x in ids], pa.int32()), pa.array([pack(np.append(x, end)) for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *extra, "n", "packed"])

    schema = schema_with(base.drop("text"), "n int, packed binary")
    return base.mapInArrow(run, schema)


def id_ranks(encoded: DataFrame) -> DataFrame:
    """(rank, id, n): ids by falling frequency over all documents, ties by id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column("packed").to_pylist():
                found = np.bincount(unpack(x))
                if len(found) > len(total):
                    total = np.pad(total, (0, 2 * len(found) - len(total)))
                total[: len(found)] += found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([int64(ids), int64(total[ids])], ["id", "n"])

    counts = encoded.select("packed").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # one window over at most as many rows as the tokenizer has ids
    return counts.select((F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).alias("rank"), "id", "n")


def write_tokens(docs: DataFrame, config: TokenConfig, stage: Stage, order: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Writes the ``blocks`` and ``ranks`` tables under the stage's folder and returns them as read back."""
    encoded = stage.write(encode_documents(docs, config, order), "encoded", codec="uncompressed")
    ranks = stage.write(id_ranks(encoded), "ranks")
    table = ranks.orderBy("rank").toArrow()
    ids = np.asarray(table.column("id"))
    to_rank = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    to_rank[ids] = np.arange(len(ids))
    shared = docs.sparkSession.sparkContext.broadcast(to_rank)  # the tokenizer's ids at most
    limit = config.block_ids

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of, shard, block, start = shared.value, TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def row() -> pa.RecordBatch:
            all_ids = np.concatenate([x for _, x in held])
            control, data = encode_ranks(rank_of[all_ids])
            values = [[shard], [block], [start], [[d for d, _ in held]], [[len(x) for _, x in held]], [control], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], [c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            for d, x in zip(batch.column("doc_id").to_pylist(), batch.column("packed").to_pylist()):
                ids = unpack(x)
                if size and size + len(ids) > limit:
                    yield row()
                    block, start, held, size = block + 1, start + size, [], 0
                held.append((d, ids))
                size += len(ids)
        if held:
            yield row()

    n = partitions(docs.sparkSession)
    ordered = encoded.repartitionByRange(n, order).sortWithinPartitions(order, "n", "packed")
    out = stage.write(ordered.select("doc_id", "packed").mapInArrow(blocks, SCHEMA), "blocks")
    stage.drop("encoded")
    return out, ranks


def read_tokens(blocks: DataFrame, ranks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (array<int>) of every document, from the written tables."""
    return _decoded(blocks, ranks, True)


def token_digest(blocks: DataFrame, ranks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the written tables."""
    return _decoded(blocks, ranks, False)


def _decoded(blocks: DataFrame, ranks: DataFrame, whole: bool) -> DataFrame:
    spark = blocks.sparkSession
    table = ranks.orderBy("rank").toArrow()
    shared = spark.sparkContext.broadcast(np.asarray(table.column("id")).astype("<u4"))
    kind = "ids array<long>" if whole else "ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of = shared.value
        for batch in batches:
            for r in batch.to_pylist():
                lengths = np.array(r["lengths"], np.int64)
                ids = id_of[decode_ranks(r["control"], r["data"], int(lengths.sum()))]
                ends = np.cumsum(lengths)
                starts = ends - lengths
                parts = [ids[a:b] for a, b in zip(starts, ends)]
                last = pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())) if whole else int64([zlib.crc32(p.tobytes()) for p in parts])
                shard = pa.array(np.full(len(parts), r["shard"], np.int32))
                yield pa.RecordBatch.from_arrays(
                    [shard, pa.array(r["doc_ids"], pa.int64()), int64(starts + r["shard_start"]), int64(lengths), last],
                    ["shard", "doc_id", "at", "n_tokens", kind.split()[0]],
                )

    found = blocks.select("shard", "shard_start", "lengths", "doc_ids", "control", "data").mapInArrow(run, f"shard int, doc_id long, at long, n_tokens long, {kind}")
    # one row per shard, of which there are as many as shuffle partitions
    sizes = blocks.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("size"))
    before = sizes.select("shard", (F.sum("size").over(Window.orderBy("shard")) - F.col("size")).alias("before"))
    return found.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", kind.split()[0])

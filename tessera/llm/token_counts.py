"""Token counts by a whole-token shortcut: vocabulary strings proved to encode alone are counted directly.

A BPE piece is built by merges of neighbours whose concatenation is in the vocabulary. Where no vocabulary
string holds two characters next to each other, no merge crosses between them, so that a text's count is the
sum of its pre-tokens' counts. ``Vocabulary`` proves offline, from the model alone,

* that no vocabulary string crosses the borders at which ``WORD`` and ``part_pattern`` cut, and
* which vocabulary strings encode alone, each by the library, as the one token that they are.

Pre-tokens among the latter count one without any merge; only the rest goes to the library. A model for which
the first can't be proved encodes every whole text.

Defined results: a null text is empty, and an empty one has no tokens; doc_id may be null or repeat, each row is
counted by itself; an empty table gives no rows; only doc_id and text are read, whatever other columns there are;
texts of any length are counted whole, about a million characters at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import int64, key_columns, small_batches

#: Characters of a text that are cut into words at once.
SLICE = 1 << 20
#: Words whose counts a worker remembers before it starts anew, and the longest of them.
MEMO, LONGEST = 400_000, 80
SPACE = "▁"
#: A word with the spaces before it.
WORD = re.compile(" +[^ ]*")


def part_pattern(marks: str = "_") -> re.Pattern:
    """Parts of a word: letters, a digit, a line end, or other characters, to which ``marks`` belong as well."""
    m = re.escape(marks)
    return re.compile(rf" *[^\W\d{m}]+| *\d|\n| *(?:[^\w\n ]|[{m}])+| +")


class Vocabulary:
    """What can be proved about a sentencepiece model without any text. Holds plain values and is broadcast.

    ``cuts``: no merge crosses a border between words or parts. ``anchor``: a character that no longer
    vocabulary string holds; behind it a part is encoded without a leading space. ``single``: vocabulary
    strings that encode alone as one token; at most as many as the model has ids.
    """

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.model = model
        spec = pb.ModelProto()
        spec.ParseFromString(model)
        plain = [p.piece for p in spec.pieces if p.type == p.NORMAL]
        own, trained = spec.normalizer_spec, spec.trainer_spec
        as_is = not own.precompiled_charsmap and own.add_dummy_prefix and own.escape_whitespaces and not own.remove_extra_whitespaces
        odd = any(p.type in (p.USER_DEFINED, p.UNUSED) for p in spec.pieces)
        pairs = {p[i : i + 2].replace(SPACE, " ") for p in plain for i in range(len(p) - 1)}
        joined = {c for x in pairs for c in x}
        # raised numbers and the like count as letters to the expression
        self.part = part_pattern("_" + "".join(sorted(c for c in joined if re.match(r"[^\W\d_]", c) and not c.isalpha())))
        whole = all(len(WORD.findall(f" {x}" if x[0] != " " else x)) == 1 and len(self.part.findall(x)) == 1 for x in pairs)
        self.anchor = next((c for c in "\n\t\0\1" if c not in joined), None)
        self.cuts = trained.model_type == trained.BPE and not trained.treat_whitespace_as_suffix and as_is and not odd and whole and self.anchor is not None
        self.single: frozenset[str] = frozenset()
        if self.cuts:
            sp = SentencePieceProcessor(model_proto=model)
            before = sp.encode(self.anchor)
            found = []
            for s in plain:
                text = s.replace(SPACE, " ")
                ids = sp.encode(text[1:]) if text[0] == " " else sp.encode(self.anchor + text)[len(before) :]
                if ids == [sp.piece_to_id(s)]:
                    found.append(text)
            self.single = frozenset(found)


class Counter(dict):
    """Counts of words, written as the library takes them: without the one space before each."""

    def __init__(self, known: Vocabulary):
        from sentencepiece import SentencePieceProcessor

        self.known, self.sp = known, SentencePieceProcessor(model_proto=known.model)
        self.before = len(self.sp.encode(known.anchor)) if known.cuts else 0
        self._start()

    def _start(self) -> None:
        self.clear()
        # the shortcut for whole words
        self.update((s[1:], 1) for s in self.known.single if s[0] == " " and len(s) > 1)
        self.first = len(self)

    def __missing__(self, word: str) -> int:
        n = 0
        for part in self.known.part.findall(f" {word}"):
            if part in self.known.single:
                n += 1
            elif part[0] == " ":
                n += len(self.sp.encode(part[1:])) if len(part) > 1 else 1
            else:
                n += len(self.sp.encode(self.known.anchor + part)) - self.before
        if len(word) <= LONGEST:
            if len(self) - self.first >= MEMO:
                self._start()
            self[word] = n
        return n

    def _slices(self, text: str) -> Iterator[str]:
        """Stretches that end before a space that follows another character; that space belongs to none."""
        at = 0
        while len(text) - at > SLICE:
            end = text.find(" ", at + SLICE)
            while 0 < end < len(text) and text[end - 1] == " ":
                end = text.find(" ", end + 1)
            if end < 0:
                break
            yield text[at:end]
            at = end + 1
        yield text[at:]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.known.cuts:
            return len(self.sp.encode(text))
        if SPACE in text:
            text = text.replace(SPACE, " ")
        total = 0
        for part in self._slices(text):
            # an empty stretch is the space that ends the text
            words = [w[1:] for w in WORD.findall(f" {part}")] if "  " in part or part[:1] in ("", " ") or part[-1] == " " else part.split(" ")
            total += sum(map(self.__getitem__, words))
        return total


def vocabulary(path: str) -> Vocabulary:
    """Proved on the driver, once a call; of the size of the model."""
    with open(path, "rb") as f:
        return Vocabulary(f.read())


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than ``limit``) of every whole text. One scan, no shuffle.

    path: a sentencepiece model; the driver reads it, and the executors get its bytes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary(path))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            texts = batch.column("text").fill_null("")
            n = [counter.count(t.as_py()) for t in texts]
            columns = [batch.column("doc_id"), pc.binary_length(texts.cast(pa.large_binary())).cast(pa.int64()), int64(n), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return key_columns(docs, ["doc_id", "text"]).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")

"""Text functions that are sequential by nature: vectorised Python UDFs, one call per batch of texts."""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as p


@dataclass(frozen=True)
class CleanConfig:
    dehyphenate: bool = True
    merge_lines: bool = True
    boilerplate_min: int = 40
    boilerplate_lines: int = 6
    head_lines: int = 80
    tail_lines: int = 200
    credits_lines: int = 60


def _rx(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.IGNORECASE)


_DROPPED = [_rx(x) for x in (p.PAGE_LINE, p.PAGE_DASH, p.JUNK_LINE, p.PUNCT_LINE, p.ONE_LETTER_LINE, p.SYMBOLS_LINE)]
_DOWNLOAD, _MARKETING, _CREDITS = _rx(p.DOWNLOAD_LINE), _rx(p.MARKETING_LINE), _rx(p.CREDITS_LINE)
_RIGHTS, _OWNER, _MARK = _rx(p.RIGHTS), _rx(p.COMPANY), _rx(p.TRADEMARK)
_BULLET, _SECTION = _rx(p.BULLET), _rx(p.SECTION)
_HYPHEN, _WORD = re.compile(r"[A-Za-zА-Яа-яЁё]{2,}-\s*$"), re.compile(r"[A-Za-zА-Яа-яЁё]{2,}")
_SPACES = re.compile("[ \t ]{2,}")


#: Phrases up to so many characters are found by comparing both sides of every space; longer ones by their first
#: ANCHOR characters. Cells of the first comparison at a time.
NEAR, ANCHOR, CELLS = 400, 64, 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Line:
    """A line's characters with prefix hashes."""

    def __init__(self, line: str):
        self.codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.blank = np.isin(self.codes, [ord(c) for c in set(line) if c.isspace()])
        self.runs = np.concatenate([[0], np.cumsum(self.blank[1:] & ~self.blank[:-1])])  # runs of white space so far
        self.spaces = np.flatnonzero(self.codes == 32)
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(self.codes), _STEP)]), dtype=np.uint64)
        self.total = np.concatenate([[np.uint64(0)], np.cumsum((self.codes.astype(np.uint64) + np.uint64(1)) * self.powers[:-1], dtype=np.uint64)])

    def checked(self, i: np.ndarray, n: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, words, -length) of those phrases (start, length) that one space and the phrase again follow."""
        ok = (i >= 0) & (i + 2 * n + 1 <= len(self.codes))
        i, n = i[ok], n[ok]
        j = i + n
        same = ((self.total[j] - self.total[i]) * self.powers[n + 1] == self.total[j + 1 + n] - self.total[j + 1]) & ~self.blank[i] & ~self.blank[j - 1]
        i, n = i[same], n[same]
        words = self.runs[i + n - 1] - self.runs[i]
        return [(int(p), int(w), -int(k)) for p, w, k in zip(i, words, n) if w > 0]

    def near(self) -> list[tuple[int, int, int]]:
        codes, most = self.codes, min(NEAR, len(self.codes) // 2)
        ahead = np.concatenate([codes, np.zeros(most + 2, np.uint32)])
        behind = np.concatenate([np.full(most, 1 << 31, np.uint32), codes])  # no text has this code
        length = np.arange(3, most + 1)
        step, found = max(1, CELLS // max(1, most)), []
        for a in range(0, len(self.spaces), step):
            j = self.spaces[a : a + step]
            grid = behind[(j[:, None] - length[None, :]) + most] == codes[np.minimum(j + 1, len(codes) - 1)][:, None]
            grid &= ahead[j[:, None] + length[None, :]] == codes[np.maximum(j - 1, 0)][:, None]
            x, y = np.nonzero(grid)  # both ends alike; the rest is compared by hash
            found += self.checked(j[x] - length[y], length[y])
        return found

    def far(self, known: np.ndarray) -> list[tuple[int, int, int]]:
        """Phrases longer than NEAR that start where no shorter one does (known: where one does)."""
        size = len(self.codes)
        if size < 2 * NEAR + 3:
            return []
        at = np.arange(size - ANCHOR + 1)
        key = (self.total[at + ANCHOR] - self.total[at]) * self.powers[size - at]
        begin = at[~known[at] & ~self.blank[at]]
        begin = begin[np.argsort(key[begin], kind="stable")]
        again = self.spaces[(self.spaces > NEAR) & (self.spaces + 1 + ANCHOR <= size)] + 1
        low, high = np.searchsorted(key[begin], key[again]), np.searchsorted(key[begin], key[again], "right")
        found = []
        for a in range(0, len(again), 256):  # a place's earlier likes come to some few
            n = (high - low)[a : a + 256]
            q = np.repeat(again[a : a + 256], n)
            i = begin[np.arange(n.sum()) + np.repeat(low[a : a + 256] - np.cumsum(n) + n, n)]
            longer = q - i - 1 > NEAR
            found += self.checked(i[longer], (q - i - 1)[longer])
        return found


#: Words of a line up to which ``_may_repeat`` looks at them.
FEW_WORDS = 400


def _may_repeat(line: str) -> bool:
    """False only if no phrase of two or more words can be followed by a space and itself.

    Of a phrase's two copies all words are equal but the first, which may be the end of a longer word in the first copy, and
    the last, which may be the beginning of one in the second.
    """
    words = line.split()
    n = len(words)
    if n > FEW_WORDS:
        return True
    places: dict[str, list[int]] = {}
    for j, word in enumerate(words):
        if 2 <= j < n - 1 and words[j - 2].endswith(word) and words[j + 1].startswith(words[j - 1]):
            return True
        for i in places.get(word, ()):
            k = j - i
            if k > 2 and i > 0 and j + k - 1 <= n and words[i - 1].endswith(words[j - 1]) and words[i : i + k - 2] == words[j : j + k - 2] and words[j + k - 2].startswith(words[j - 2]):
                return True
        places.setdefault(word, []).append(j)
    return False


def _repeats(line: str) -> list[tuple[int, int]]:
    """(start, length) of phrases that are followed by one space and themselves, leftmost first; at one start
    that of fewest words, then the longest. Spans don't overlap.

    Prefix hashes compare the two sides of every space for all lengths at once, where a backtracking pattern
    would take quadratic time.
    """
    if not _may_repeat(line):
        return []
    x = _Line(line)
    found = x.near()
    known = np.zeros(len(x.codes), bool)
    known[[p for p, _, _ in found]] = True
    found += x.far(known)
    out, at = [], 0
    for p, _, k in sorted(found):
        if p >= at and line[p : p - k] == line[p - k + 1 : p - 2 * k + 1]:
            out.append((p, -k))
            at = p - 2 * k + 1
    return out


def collapse_phrase(line: str) -> str:
    """Repeats of phrases of two or more words, next to each other, once; to a fixpoint."""
    while found := _repeats(line):
        parts, at = [], 0
        for p, n in found:
            parts.append(line[at : p + n])
            at = p + 2 * n + 1
        line = "".join([*parts, line[at:]])
    return line


def keeps_break(line: str) -> bool:
    """Whether a line stands for itself: blank, bullet, section heading, or short and upper-case or with a colon."""
    s = line.strip()
    return not s or bool(_BULLET.match(s) or _SECTION.match(s)) or (len(s) <= 35 and (s.isupper() or s.endswith(":")))


class LineCleaner:
    """The stages of the line cleaner: each takes and gives a list of lines."""

    def __init__(self, boilerplate: frozenset[str] = frozenset(), config: CleanConfig = CleanConfig()):
        self.boilerplate, self.config = boilerplate, config

    def _unwanted(self, s: str, at_end: bool) -> bool:
        if not s:
            return False
        if s in self.boilerplate or any(rx.match(s) for rx in _DROPPED):
            return True
        if at_end and (_DOWNLOAD.match(s) or _MARKETING.match(s)):
            return True
        return 40 <= len(s) <= 400 and bool(_RIGHTS.search(s)) and (at_end or bool(_OWNER.search(s) or _MARK.search(s)))

    def filtered(self, lines: list[str]) -> list[str]:
        """Without unwanted lines and credits; hyphenated words put together; blank lines single."""
        lines, out, skip = list(lines), [], 0
        head, tail = self.config.head_lines, max(0, len(lines) - self.config.tail_lines)
        for i in range(len(lines)):
            s = lines[i].strip()
            if skip:
                if s and not _SECTION.match(s) and not _BULLET.match(s):
                    skip -= 1
                    continue
                skip = 0
            at_end = i < head or i >= tail
            plain = s and (s in self.boilerplate or any(rx.match(s) for rx in _DROPPED))
            if not plain and at_end and s and _CREDITS.match(s) and not (_DOWNLOAD.match(s) or _MARKETING.match(s)):
                skip = self.config.credits_lines
                continue
            if self._unwanted(s, at_end):
                continue
            line = _SPACES.sub(" ", lines[i]).strip()
            if not line:
                if out and out[-1]:
                    out.append("")
                continue
            if self.config.dehyphenate and i + 1 < len(lines) and _HYPHEN.search(line):
                following = lines[i + 1].lstrip()
                if _WORD.match(following) and following[:1].islower():
                    word, _, rest = following.partition(" ")
                    line = line[:-1] + word
                    lines[i + 1] = f" {rest}" if len(following) > len(word) else ""
            out.append(line)
        return out

    def merged(self, lines: list[str]) -> list[str]:
        """Running text as one line; lines that keep their break as they are."""
        out: list[str] = []
        running: list[str] = []
        for line in [*lines, None]:
            if line is None or keeps_break(line):
                if running:
                    out.append(" ".join(running).strip())
                    running = []
                if line is not None:
                    out.append(line)
            else:
                running.append(line)
        return out

    def clean(self, text: str) -> str:
        lines = self.filtered(text.split("\n"))
        if not self.config.merge_lines:
            return "\n".join(lines).strip() + "\n"
        out: list[str] = []
        for line in self.merged(lines):
            line = collapse_phrase(line) if line else line
            if (out and out[-1] == line) or (not line and not out):
                continue
            out.append(line)
        return _SPACES.sub(" ", "\n".join(out).strip() + "\n")


def clean_text(text: Column | str, boilerplate: Column | str, config: CleanConfig = CleanConfig()) -> Column:
    """The cleaned text; boilerplate is an array of lines to drop (null: none)."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series, drops: pd.Series) -> pd.Series:
        cleaners: dict[frozenset, LineCleaner] = {}
        out = []
        for text, drop in zip(texts, drops):
            key = frozenset(() if drop is None else drop)
            cleaner = cleaners.setdefault(key, LineCleaner(key, config))
            out.append(None if text is None else cleaner.clean(text))
        return pd.Series(out, dtype=object)

    return run(text, boilerplate)


def clean_text_by(text: Column | str, group: Column | str, shared: Broadcast, config: CleanConfig = CleanConfig()) -> Column:
    """The same with the lines to drop broadcast, by group."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series, names: pd.Series) -> pd.Series:
        cleaners = {k: LineCleaner(v, config) for k, v in shared.value.items()}
        other = LineCleaner(frozenset(), config)
        return pd.Series([None if text is None else cleaners.get(k, other).clean(text) for text, k in zip(texts, names)], dtype=object)

    return run(text, group)


@F.pandas_udf(T.StringType())
def collapse_phrases(lines: pd.Series) -> pd.Series:
    return lines.map(lambda t: None if t is None else collapse_phrase(t))


def chunk_spans(text: str, size: int, overlap: int, separator: str = "\n\n") -> list[str]:
    """Chunks of at most ``size`` word or punctuation tokens, cut at paragraphs, sentences, clauses or words.

    Each chunk after the first starts with the last whole pieces of the one before, ``overlap`` tokens at most.
    """
    count = lambda t: len(_TOKEN.findall(t))

    def pieces(part: str, level: int) -> list[str]:
        if count(part) <= size or level == len(_CUTS):
            return [part] if part.strip() else []
        found = part.split(separator) if level == 0 else _CUTS[level].findall(part)
        return [x for piece in found for x in pieces(piece, level + 1)]

    chunks: list[str] = []
    held: list[tuple[str, int]] = []
    total = 0
    for piece in pieces(text, 0):
        n = count(piece)
        if held and total + n > size:
            chunks.append("".join(t for t, _ in held).strip())
            kept: list[tuple[str, int]] = []
            for item in reversed(held):
                if sum(k for _, k in kept) + item[1] > overlap or sum(k for _, k in kept) + item[1] + n > size:
                    break
                kept.insert(0, item)
            held, total = kept, sum(k for _, k in kept)
        held.append((piece, n))
        total += n
    if held:
        chunks.append("".join(t for t, _ in held).strip())
    return [c for c in chunks if c]


_TOKEN = re.compile(r"\w+|[^\w\s]")
_CUTS = [None, re.compile(r"[^.!?\n]+[.!?\n]*\s*|[.!?\n]+\s*"), re.compile(r"[^,;:]+[,;:]*\s*|[,;:]+\s*"), re.compile(r"\S+\s*|\s+")]


def chunks(text: Column | str, size: int = 128, overlap: int = 20, separator: str = "\n\n") -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else chunk_spans(t, size, overlap, separator))

    return run(text)


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, bit-parallel over b."""
    where: dict[str, int] = {}
    for i, w in enumerate(b):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for w in a:
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


@F.pandas_udf(T.DoubleType())
def rouge_l(predicted: pd.Series, reference: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of two token arrays; 0 when either is empty."""
    out = []
    for a, b in zip(predicted, reference):
        a, b = list(a) if a is not None else [], list(b) if b is not None else []
        n = lcs_length(a, b) if a and b else 0
        out.append(2 * n / (len(a) + len(b)) if n else 0.0)
    return pd.Series(out)


def _grams(items, n: int) -> dict:
    out: dict = {}
    for i in range(len(items) - n + 1):
        g = tuple(items[i : i + n])
        out[g] = out.get(g, 0) + 1
    return out


def _scored_words(text: str) -> list[str]:
    """Words parted by white space; one mark at a word's end or else at its beginning is a word of its own."""
    out = []
    for word in text.split():
        if len(word) > 1 and word[-1] in string.punctuation:
            out += [word[:-1], word[-1]]
        elif len(word) > 1 and word[0] in string.punctuation:
            out += [word[0], word[1:]]
        else:
            out.append(word)
    return out


def chrf(predicted: str, references: str | list[str], chars: int = 6, words: int = 2, beta: float = 2.0) -> float:
    """chrF with word n-grams of lower-cased texts, from 0 to 1, against the best reference.

    Precision and recall are each averaged over the orders that both sides have; F is taken of the two averages. Blank
    predictions and references don't count.
    """
    predicted = (predicted or "").strip().lower()
    best = 0.0
    for reference in [references] if isinstance(references, str) or references is None else references:
        reference = (reference or "").strip().lower()
        if not predicted or not reference:
            continue
        precision = recall = 0.0
        orders = 0
        for a, b, most in [("".join(predicted.split()), "".join(reference.split()), chars), (_scored_words(predicted), _scored_words(reference), words)]:
            for n in range(1, most + 1):
                x, y = _grams(a, n), _grams(b, n)
                if x and y:
                    same = sum(min(c, y.get(g, 0)) for g, c in x.items())
                    precision, recall, orders = precision + same / sum(x.values()), recall + same / sum(y.values()), orders + 1
        bottom = beta * beta * precision + recall
        if bottom:
            best = max(best, (1 + beta * beta) * precision * recall / bottom / orders)
    return best


@F.pandas_udf(T.DoubleType())
def chrf_pp(predicted: pd.Series, reference: pd.Series) -> pd.Series:
    """reference: a text, or an array of texts of which the best counts."""
    return pd.Series([chrf(a, b if b is None or isinstance(b, str) else list(b)) for a, b in zip(predicted, reference)])

"""Column functions over texts. All run inside the JVM unless their name says otherwise."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as p

SPACE = r"(?U)\s"


def strip(c: Column | str) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def matches(c: Column | str, pattern: str) -> Column:
    return F.col(c).rlike(p.java(pattern)) if isinstance(c, str) else c.rlike(p.java(pattern))


def ink(c: Column | str) -> Column:
    """Number of characters that are no white space."""
    return F.length(F.regexp_replace(c, SPACE, ""))


def letters(c: Column | str) -> Column:
    return F.regexp_count(c, F.lit(r"\p{L}"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def alpha_ratio(c: Column | str) -> Column:
    """Letters among the characters that are no white space; 0 without any."""
    return _ratio(letters(c), ink(c))


def letter_ratio(c: Column | str) -> Column:
    """Letters among all characters; 0 for an empty text."""
    return _ratio(letters(c), F.length(c))


def sha_fingerprint(c: Column | str) -> Column:
    """"sha256:" and the digest of the stripped text."""
    return F.concat(F.lit("sha256:"), F.sha2(strip(c), 256))


def lines(c: Column | str) -> Column:
    return F.split(c, "\n")


def char_stats(c: Column | str) -> Column:
    """struct(entropy, max_ratio) of the characters that are no white space: one vectorised pass per text.

    Without such characters: entropy 0, max_ratio 1. Null stays null.
    """
    return _char_stats(c)


def char_stats_each(c: Column | str) -> Column:
    """char_stats of every text of an array, in order."""
    return _char_stats_each(c)


_STATS = T.StructType([T.StructField("entropy", T.DoubleType()), T.StructField("max_ratio", T.DoubleType())])


def _stats_of(text: str | None) -> tuple[float | None, float | None]:
    if text is None:
        return None, None
    codes = np.frombuffer("".join(text.split()).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return 0.0, 1.0
    counts = np.unique(codes, return_counts=True)[1] / len(codes)
    return float(-(counts * np.log2(counts)).sum()) + 0.0, float(counts.max())


@F.pandas_udf(_STATS)
def _char_stats(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_stats_of(text) for text in texts], columns=["entropy", "max_ratio"])


@F.pandas_udf(T.ArrayType(_STATS))
def _char_stats_each(arrays: pd.Series) -> pd.Series:
    return arrays.map(lambda texts: None if texts is None else [dict(zip(("entropy", "max_ratio"), _stats_of(text))) for text in texts])


def repetition_ratio(c: Column | str) -> Column:
    """Share of the most common stripped line among the lines that aren't blank; 0 without any."""
    kept = F.filter(F.transform(lines(c), strip), lambda x: x != "")
    ordered = F.array_sort(kept)
    # lengths of runs in the sorted lines
    start = F.struct(F.lit("").alias("line"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["line"] == x, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("line"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return _ratio(F.aggregate(ordered, start, step, lambda acc: acc["best"]), F.size(kept))


def clip(c: Column | str, n: int, marker: str = "…") -> Column:
    """Stripped; if longer than n, cut and a line with the marker added."""
    t = strip(c)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n), F.lit("\n" + marker)))


def normalize_quote(c: Column | str) -> Column:
    """For matching quotes: stripped, lower case, ё as е, single spaces, no punctuation (NFKC comes before)."""
    lowered = F.translate(F.lower(strip(c)), "ё", "е")
    return F.regexp_replace(F.regexp_replace(lowered, r"(?U)\s+", " "), r"(?U)[^\w\s]", "")


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Version-5 UUID of a name, from SHA-1 in the JVM."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3))).bitwiseOR(F.lit(8))))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12)
    )


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """NFKC, for which the JVM side has no function."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def ngrams(tokens: Column, n: int) -> Column:
    """Arrays of n consecutive tokens joined by a space."""
    count = F.size(tokens) - F.lit(n - 1)
    following = lambda i: [F.get(tokens, i + k) for k in range(1, n)]
    grams = F.transform(F.slice(tokens, F.lit(1), F.greatest(count, F.lit(0))), lambda x, i: F.concat_ws(" ", x, *following(i)))
    return F.when(count > 0, grams).otherwise(F.array().cast("array<string>"))


def json_body(c: Column | str) -> Column:
    """The outermost {...} of a reply, code fences and trailing commas taken off; null if there is none."""
    bare = F.regexp_replace(c, r"```(?:json)?", "")
    body = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(body != "", F.regexp_replace(body, r",\s*([}\]])", "$1"))

"""Model hooks with deterministic stand-ins that need no network.

A hook is a function from a pandas Series (or two) to a Series; ``as_column`` makes a vectorised column
function of it. The stand-ins are no models: name their output columns so.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = re.compile(r"\w+")


def hash_embed(texts: pd.Series, dim: int = 64, prefix: str = "") -> pd.Series:
    """Unit vectors of signed hash counts of words; zero for a text without words."""
    out = []
    for text in texts:
        x = np.zeros(dim, np.float32)
        for w in _WORD.findall((prefix + (text or "")).lower()):
            h = zlib.crc32(w.encode())
            x[h % dim] += 1.0 if h >> 16 & 1 else -1.0
        n = float(np.sqrt((x * x).sum()))
        out.append((x / n if n else x).tolist())
    return pd.Series(out)


def lexical_score(queries: pd.Series, texts: pd.Series) -> pd.Series:
    """A stand-in for a cross-encoder: share of the question's words that the text has."""
    out = []
    for q, t in zip(queries, texts):
        a, b = set(_WORD.findall((q or "").lower())), set(_WORD.findall((t or "").lower()))
        out.append(len(a & b) / len(a) if a else 0.0)
    return pd.Series(out)


def extractive_answer(queries: pd.Series, contexts: pd.Series) -> pd.Series:
    """A stand-in for a generator: the sentence with most words of the question."""
    out = []
    for q, c in zip(queries, contexts):
        a = set(_WORD.findall((q or "").lower()))
        sentences = re.split(r"(?<=[.!?])\s+", c or "")
        out.append(max(sentences, key=lambda s: len(a & set(_WORD.findall(s.lower()))), default=""))
    return pd.Series(out)


def as_column(hook: Callable, kind: T.DataType) -> Callable[..., Column]:
    return F.pandas_udf(hook, returnType=kind)


def embed(c: Column | str, dim: int = 64, prefix: str = "passage: ") -> Column:
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        return hash_embed(texts, dim, prefix)

    return run(c)

"""Streams over Arrow batches that are sorted by key."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], values: list[str], most: int) -> Iterator[tuple[tuple, list[np.ndarray], bool, bool]]:
    """Runs of equal keys, in pieces of at most ``most`` rows: key, values, whether first and last piece."""
    held: list[list[np.ndarray]] = []
    size, held_key, first = 0, None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        vals = [batch.column(v).to_numpy(zero_copy_only=False) for v in values]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(change), [batch.num_rows]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            key = tuple(c[a] for c in cols)
            if size and key != held_key:
                yield held_key, _joined(held), first, True
                held, size, first = [], 0, True
            held_key = key
            held.append([v[a:b] for v in vals])
            size += b - a
            while size > most:
                whole = _joined(held)
                yield key, [v[:most] for v in whole], first, False
                held, size, first = [[v[most:] for v in whole]], size - most, False
    if size:
        yield held_key, _joined(held), first, True


def _joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return parts[0] if len(parts) == 1 else [np.concatenate(x) for x in zip(*parts)]


class Forest:
    """Union-find over any hashable members; unseen members stand alone."""

    def __init__(self):
        self.parent: dict = {}

    def top(self, x):
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    def spanning(self, pairs: Iterable[tuple]) -> Iterator[tuple]:
        """Those pairs that join two trees."""
        for a, b in pairs:
            ra, rb = self.top(a), self.top(b)
            if ra != rb:
                self.parent[max(ra, rb)] = min(ra, rb)
                yield a, b

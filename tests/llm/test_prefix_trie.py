"""Prefix tries against a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import prefix_trie as t
from tessera.llm.common import Stage

SCHEMA = "conv_id long, turn long, role string, text string, k1 string, depth string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), digest(role or "", text or ""), (role or "", text or "")))
    convs = {c: [x for *_, x in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        whole[c] = convs.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, w in whole.items():
        for d in range(len(w) + 1):
            members[tuple(w[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = sum(saved[x] for x in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def found(spark, rows, limit):
    got = t.conversation_trie(spark.createDataFrame(rows, SCHEMA), Stage(spark, "test-trie"), limit)
    return sorted((tuple(r) for r in got.collect()), key=lambda r: (r[1], r[0]))


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.choice([rng.randrange(0, 400), rng.randrange(-300, 300), rng.randrange(0, 40) * 100])
        rows += [(c, i, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "", "long " * 9]), "x", None) for i in range(rng.randrange(1, 8))]
    return rows


@pytest.mark.parametrize("seed,limit", [(1, None), (2, 1), (3, 4), (4, 25)])
def test_against_prefixes(spark, seed, limit):
    rows = conversations(seed, 300)
    assert found(spark, rows, limit) == brute(rows)


def test_hot_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(t, "CHUNK", 7)
    rows = [(c, i, "user" if i % 2 else None, f"{i}", None, None) for c in range(1000, 1200) for i in range(3)]  # one conversation 200 times
    rows += [(5, i, "user", "deep", None, None) for i in range(150)] + [(6, None, None, None, "x", "y"), (6, 3, "b", "z", None, None), (6, 3, "a", "z", None, None), (6, 3, "a", "z", None, None)]
    rows += [(None, 1, "user", "lost", None, None), (7, 1, "", "\U0001f600" * 3000, None, None)]
    for limit in (None, 3, 100):
        assert found(spark, rows, limit) == brute(rows)


def test_empty(spark):
    assert found(spark, [], None) == []
    assert found(spark, [(None, 1, "a", "b", None, None)], None) == []


def test_louds():
    """A forest by hand: two tops, the second with two children, of which the first has one."""
    ids = np.arange(1, 6)
    rows = {"k1": ids, "k2": ids, "q1": np.array([9, 9, 2, 2, 3]), "q2": np.array([9, 9, 2, 2, 3]), "depth": np.array([3, 3, 4, 4, 5]), "conv_id": np.array([1, 2, 2, 4, 2])}
    trie = t.Trie.build(rows)
    assert trie.louds.tolist() == [1, 1, 0, 0, 1, 1, 0, 1, 0, 0, 0]
    assert trie.parent.tolist() == [0, 0, 2, 2, 3] and trie.degree.tolist() == [2, 0, 2, 1, 0, 0]
    assert [(s.start, s.stop) for s in trie.levels()] == [(0, 2), (2, 4), (4, 5)]

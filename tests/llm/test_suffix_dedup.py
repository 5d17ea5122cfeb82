"""Removal of repeated byte strings against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import suffix_dedup as sd
from tessera.llm.common import Stage


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        rest = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((d, len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return out


def key(r):
    return (r[0] is None, *map(str, r))


def made(seed, length):
    rng = np.random.default_rng(seed)
    letters = lambda n, a: "".join(rng.choice(list(a), n))
    shared = [letters(int(rng.integers(length - 3, 3 * length)), "abcdé") for _ in range(4)]
    rows = []
    for i in range(60):
        t = letters(int(rng.integers(0, 2 * length)), "abcdefgh")
        for _ in range(int(rng.integers(0, 3))):
            s = shared[int(rng.integers(4))]
            a = int(rng.integers(0, len(s) // 2))
            t += s[a : a + int(rng.integers(1, len(s)))] + letters(int(rng.integers(0, length)), "abcdefgh")
        rows.append((i, t))
    copy = rows[3][1]
    near = copy[: len(copy) // 2] + "#" + copy[len(copy) // 2 :]
    rows += [(100 + i, copy) for i in range(8)] + [(110, near), (111, "a" * (4 * length)), (112, "ab" * length), (113, "a" * length), (114, "x" * (length - 1)), (115, "x" * (length - 1))]
    return rows + [(116, None), (117, ""), (3, copy), (None, copy), (None, shared[0]), (5, shared[1] * 2)]


@pytest.mark.parametrize("seed,length,group", [(0, 40, 4096), (1, 40, 2), (2, 100, 4096), (3, 400, 4096), (4, 34, 3)])
def test_random(spark, seed, length, group):
    rows = made(seed, length)
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, row int, kept string")
    got = sd.remove_repeats(docs, sd.RepeatConfig(length=length, group=group), digest=True).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, length), key=key)


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(1000 + i, t[: len(t) * 2 // 3] + "." + t[len(t) * 2 // 3 :]) for i, t in rows[:30]]
    got = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), digest=True).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, 400), key=key)
    assert sum(r.n_removed for r in got) > 0
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_kept_bytes(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(900)) + "ü"
    docs = spark.createDataFrame([(1, text), (2, "start " + text[:500] + " end")], "doc_id long, text string")
    got = {r.doc_id: r for r in sd.remove_repeats(docs, stage=Stage(spark, "kept")).collect()}
    want = brute([(1, text), (2, "start " + text[:500] + " end")], 400)
    assert {d: (r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for d, r in got.items()} == {r[0]: (r[2], r[4]) for r in want}


def test_quicksort():
    rng = np.random.default_rng(0)
    words = [rng.integers(0, 3, 9000), rng.integers(-5, 5, 9000), rng.integers(0, 100, 9000)]
    order = sd.multikey_quicksort(words)
    rows = [tuple(w[i] for w in words) for i in order]
    assert rows == sorted(rows) and sorted(order) == list(range(9000))


def test_many_stretches_of_a_lead(spark):
    """A phrase in very many surroundings has one lead; few of its stretches come to one task, and the rows stay right."""
    rng = np.random.default_rng(5)
    letters = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    phrase, copy = letters(44), letters(90)
    rows = [(i, letters(20) + phrase + letters(20)) for i in range(300)] + [(1000 + i, letters(9) + phrase + "same end" + letters(9)) for i in range(50)]
    rows += [(2000 + i, copy[:i] + "#" + copy[i:]) for i in range(90)] + [(3000 + i, copy[:i] + "+" + copy[i + 1 :]) for i in range(90)]
    rows += [(4000, rows[0][1]), (4001, "x" + rows[1][1]), (4002, rows[2][1] + "x"), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for length, group in ((48, 4096), (48, 8), (64, 4096)):
        config, stage = sd.RepeatConfig(length=length, group=group, many=20), Stage(spark, "many")
        open_ = stage.write(sd._sorted_buckets(stage.write(sd._suffixes(docs, config), "suffixes"), config), "sorted").where("kind = 1")
        most = lambda d, *by: max(r["count"] for r in d.groupBy(*by).count().collect())
        assert most(sd._stretches(docs, open_, stage, config)[0], "lead") < most(open_, *sd.WORDS) / 2
        got = sd.remove_repeats(docs, config, digest=True).collect()
        assert sorted(map(tuple, got), key=key) == sorted(brute(rows, length), key=key)


@pytest.mark.parametrize("seed,length,group", [(5, 40, 4096), (6, 34, 2), (7, 100, 4096), (8, 400, 3)])
def test_random_pieces(spark, seed, length, group):
    rows = made(seed, length)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sd.remove_repeats(docs, sd.RepeatConfig(length=length, group=group, many=1), digest=True).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, length), key=key)

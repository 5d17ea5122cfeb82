"""SimHash links and near-duplicate groups against all pairs."""

import itertools

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash as sh
from tessera.llm.common import Stage
from tessera.llm.components import components

SF = "/root/testdata/sf0.001"


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (50, 2))] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7)]
    nodes = {x for a, b in pairs for x in (a, b) if a != b}
    got = components(spark.createDataFrame(pairs, "a long, b long"), Stage(spark, "cc")).collect()
    assert {r.id: r.root for r in got} == {n: r for n, r in roots({x for p in pairs for x in p}, pairs).items() if n in nodes}
    assert len(got) == len(nodes)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long"), Stage(spark, "cc")).count() == 0


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("tree", [3, 4096])
def test_deduplicate(spark, tree):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    words = rows[0][1].split()
    rows += [(1000 + i, " ".join(words[:i] + ["x"] + words[i:])) for i in range(0, 60, 2)]
    rows += [(2000, None), (2001, ""), (2002, " \t"), (1990, "\x0b"), (2003, "one"), (2004, "One"), (2005, "one two"), (2005, "one two"), (2006, "long " * 20_000), (None, "alone"), (2007, "Ünï x y z w")]
    docs = spark.createDataFrame([(*r, 0, "q") for r in rows], "doc_id long, text string, fp int, key string")
    got = sh.deduplicate(docs, sh.SimHashConfig(tree=tree)).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    comp = roots(range(len(rows)), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2])
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[comp[i]] = min(d, least.get(comp[i], d))
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(((d, f"{f:016x}", least.get(comp[i])) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=key)
    assert sh.deduplicate(docs.limit(0)).count() == 0


def test_bk_tree():
    rng = np.random.default_rng(0)
    values = [int(x) for x in rng.integers(0, 1 << 10, 300)]
    tree = sh.BKTree()
    for v in values:
        tree.add(v)
    for v in range(0, 1 << 10, 37):
        assert {u for _, u in tree.within(v, 2)} == {u for u in values if (u ^ v).bit_count() <= 2}


def test_near_duplicates(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(8, 500))))) for i in range(60)]
    for i in range(60):
        parts = rows[i][1].split()
        for k in range(3):
            p = list(parts)
            for _ in range(max(1, int(len(p) * rng.choice([0.005, 0.01, 0.02, 0.06])))):
                p[int(rng.integers(len(p)))] = "new" + str(rng.integers(1 << 30))
            rows.append((100 + 3 * i + k, " ".join(p)))
    rows += [(900, None), (901, ""), (903, rows[3][1]), (903, rows[3][1])]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    sets = [{tuple(t.split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))} if (t or "").split() else {()} for _, t in rows]
    close = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    comp = roots(range(len(rows)), close)
    want = {min(rows[j][0] for j in comp if comp[j] == i) for i in set(comp.values())}
    got = [r.doc_id for r in sh.keep_one(docs).collect()]
    assert len(got) == len(set(got))
    assert want <= set(got)  # clean documents stay
    assert len(set(got) - want) <= 0.01 * len(rows)
    assert sh.keep_one(docs.limit(0)).count() == 0


def test_large_group(spark):
    """A large group of loosely linked variants comes out as all pairs have it."""
    rng = np.random.default_rng(8)
    text = [f"w{i}" for i in rng.integers(0, 5000, 200)]
    rows = []
    for i in range(500):
        p = list(text)
        for k in np.flatnonzero(rng.random(200) < 0.022):
            p[k] = f"new{rng.integers(1 << 30)}"
        rows.append((i, " ".join(p)))
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
    close = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = len(set(roots(range(len(rows)), close).values()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for config in (sh.SimilarConfig(), sh.SimilarConfig(tree=64, piece=50)):
        got = sh.keep_one(docs, config).count()
        assert want <= got <= 1.02 * want, (want, got)

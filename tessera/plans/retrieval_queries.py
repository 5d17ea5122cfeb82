"""Retrieval over embeddings and documents, and its evaluation.

The questions are the vectors whose id is divisible by 100, or the benchmark's items; all rows are searched.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators import retrieval as r
from ..operators.postings import PostingsIndex
from ..operators.vector_index import IndexConfig, VectorIndex
from ..sources.workspace import workspace
from .registry import query

_COSINE = """
scored AS (
  SELECT q.vec_id AS qid, v.vec_id AS id, q.label AS ql, v.label AS vl,
    list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score,
    -list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score2
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id
)"""

_BM25 = """
dt AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
dl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '\\p{L}+')) AS dl FROM documents),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term FROM benchmark),
bm AS (
  SELECT qid, tf.doc_id AS id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score,
    count(*)::DOUBLE AS overlap
  FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl ON dl.doc_id = tf.doc_id, st GROUP BY ALL
)"""


def _top(source: str, order: str, k: int, out: str) -> str:
    return f"{out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}) AS rank FROM {source}) WHERE rank <= {k})"


_BRANCHES = f"""{_BM25},
{_top("bm", "round(score, 9) DESC, id", 10, "b1")},
{_top("bm", "overlap DESC, id", 10, "b2")}"""


def _vectors(read):
    e = read("embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("tag"))
    return e.where("id % 100 = 0").withColumnRenamed("id", "qid"), e


@query(f"WITH {_COSINE}, {_top('scored', 'score DESC, id', 5, 't')} SELECT qid, rank, id, round(score, 6) AS score FROM t")
def dense_topk(read):
    queries, vectors = _vectors(read)
    return r.dense_top_k(queries, vectors, 5).withColumn("score", F.round("score", 6))


def _indexed(read, nprobe: int, same: bool = False):
    queries, vectors = _vectors(read)
    config = IndexConfig()
    index = VectorIndex.create(vectors, workspace(vectors.sparkSession, "vector-index"), config)
    return index.search(queries, 5, nprobe or config.cells, same).withColumn("score", F.round("score", 6))


@query(f"WITH {_COSINE}, {_top('scored', 'score DESC, id', 5, 't')} SELECT qid, rank, id, round(score, 6) AS score FROM t")
def vector_index_topk(read):
    """The inverted-file index with all cells probed: its bounds lose nothing."""
    return _indexed(read, 0)


@query(f"WITH {_COSINE}, same AS (SELECT * FROM scored WHERE ql = vl), {_top('same', 'score DESC, id', 5, 't')} SELECT qid, rank, id, round(score, 6) AS score FROM t")
def vector_index_filtered(read):
    return _indexed(read, 0, same=True)


@query()
def vector_index_probed(read):
    """A quarter of the cells. No SQL: what is lost goes by the fitted cells; recall is tested."""
    return _indexed(read, 16)


@query(f"WITH {_COSINE}, same AS (SELECT * FROM scored WHERE ql = vl), {_top('same', 'score DESC, id', 5, 't')} SELECT qid, rank, id, round(score, 6) AS score FROM t")
def dense_topk_filtered(read):
    """The metadata filter applies before the ranking."""
    queries, vectors = _vectors(read)
    return r.dense_top_k(queries, vectors, 5, same=True).withColumn("score", F.round("score", 6))


@query(f"""WITH {_COSINE}, {_top('scored', 'score DESC, id', 10, 't')},
h AS (SELECT qid, rank, (ql = vl)::INT AS hit FROM t),
c AS (SELECT *, sum(hit) OVER (PARTITION BY qid ORDER BY rank) AS cum FROM h),
g AS (SELECT qid, count(*) FILTER (ql = vl) AS rel FROM scored GROUP BY qid),
p AS (SELECT qid, sum(hit) AS hits, sum(hit * cum / rank) AS gains, sum(hit / log2(rank + 1)) AS dcg FROM c GROUP BY qid),
s AS (SELECT qid, hits, gains, dcg, rel, least(rel, 10) AS top, list_sum(list_transform(range(1, least(rel, 10) + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM p JOIN g USING (qid))
SELECT round(avg(CASE WHEN rel > 0 THEN hits / rel ELSE 0 END), 6) AS recall, round(avg(hits / 10), 6) AS precision,
  round(avg(CASE WHEN rel > 0 THEN gains / top ELSE 0 END), 6) AS ap, round(avg(coalesce(dcg / ideal, 0)), 6) AS ndcg,
  round(avg((hits > 0)::INT), 6) AS hit, count(*) AS n FROM s""")
def retrieval_metrics(read):
    """Macro averages at 10, with the vectors of the query's label as gold."""
    queries, vectors = _vectors(read)
    per = m.tag_metrics(queries, r.dense_top_k(queries, vectors, 10), vectors, 10)
    out = m.macro_average(per)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns if c != "n"], "n")


@query(f"WITH {_COSINE}, {_top('scored', 'score DESC, id', 20, 'f')}, g AS (SELECT qid, id, score2 FROM f), {_top('g', 'score2 DESC, id', 5, 't')} SELECT qid, rank, id, round(score2, 6) AS score FROM t")
def two_stage_rerank(read):
    """20 candidates by cosine, reranked by the negated distance, 5 kept."""
    queries, vectors = _vectors(read)
    scored = r.pair_scores(r.dense_top_k(queries, vectors, 20), queries, vectors)
    top = r.top_k(scored.select("qid", "id", F.col("score2").alias("score")), 5)
    return top.select("qid", "rank", "id", F.round("score", 6).alias("score"))


def _bm25(read, k: int, by: tuple[str, ...] = ("score",)):
    """k documents an item and order, written: what follows may use them several times and knows that they are few."""
    docs = read("documents").select(F.col("doc_id").alias("id"), "text")
    top = r.bm25_top_k(docs, read("benchmark").select(F.col("item_id").alias("qid"), "text"), k, by)
    path = workspace(docs.sparkSession, "bm25-top")
    top.write.parquet(path)
    return docs.sparkSession.read.schema(top.schema).parquet(path)


@query(f"WITH {_BM25}, {_top('bm', 'round(score, 9) DESC, id', 5, 't')} SELECT qid, rank, id, round(score, 6) AS score FROM t")
def bm25_topk(read):
    return _bm25(read, 5).select("qid", "rank", "id", F.round("score", 6).alias("score"))


def _postings(read, ranges: int) -> PostingsIndex:
    docs = read("documents").select(F.col("doc_id").alias("id"), "text")
    index = PostingsIndex(docs.sparkSession, workspace(docs.sparkSession, "postings"))
    for part in range(3):
        index.add(docs.where(F.pmod(F.xxhash64("id"), F.lit(3)) == part), ranges)
    return index


_INDEXED = f"WITH {_BM25}, {_top('bm', 'round(score, 9) DESC, id', 5, 't')} SELECT qid, rank, id, round(score, 6) AS score FROM t"


@query(_INDEXED)
def postings_topk(read):
    """The same ranking from three segments of a written index."""
    items = read("benchmark").select(F.col("item_id").alias("qid"), "text")
    return _postings(read, 64).search(items, 5).withColumn("score", F.round("score", 6))


@query(_INDEXED)
def postings_merged(read):
    """And from the one segment that they are merged to."""
    index = _postings(read, 64)
    index.merge(ranges=100)
    items = read("benchmark").select(F.col("item_id").alias("qid"), "text")
    return index.search(items, 5).withColumn("score", F.round("score", 6))


def _branches(read):
    top = _bm25(read, 10, ("score", "overlap"))
    return tuple(top.where(F.col("by") == name).select("qid", "rank", "id", F.col(name).alias("score")) for name in ("score", "overlap"))


@query(f"""WITH {_BRANCHES},
u AS (SELECT qid, id, rank, 0 AS br FROM b1 UNION ALL SELECT qid, id, rank, 1 FROM b2),
f AS (SELECT qid, id, sum(1.0 / (60 + rank)) AS score, min({{'br': br, 'rank': rank}}) AS first FROM u GROUP BY ALL),
{_top('f', "round(score, 12) DESC, first.br, first.rank, id", 5, 't')} SELECT qid, rank, id, round(score, 6) AS score FROM t""")
def rrf_fusion(read):
    """BM25 and the number of common terms, fused by reciprocal rank."""
    return r.rrf(list(_branches(read)), 5).withColumn("score", F.round("score", 6))


@query(f"""WITH {_BRANCHES},
n1 AS (SELECT qid, id, score, min(score) OVER w AS lo, max(score) OVER w AS hi FROM b1 WINDOW w AS (PARTITION BY qid)),
n2 AS (SELECT qid, id, overlap AS score, min(overlap) OVER w AS lo, max(overlap) OVER w AS hi FROM b2 WINDOW w AS (PARTITION BY qid)),
f AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id,
    0.7 * coalesce(CASE WHEN a.hi > a.lo THEN (a.score - a.lo) / (a.hi - a.lo) ELSE a.score END, 0) + (1 - 0.7) * coalesce(CASE WHEN b.hi > b.lo THEN (b.score - b.lo) / (b.hi - b.lo) ELSE b.score END, 0) AS score
  FROM n1 a FULL JOIN n2 b ON a.qid = b.qid AND a.id = b.id),
{_top('f', "round(score, 9) DESC, id", 5, 't')} SELECT qid, rank, id, round(score, 6) AS score FROM t""")
def weighted_fusion(read):
    """The same branches by scaled scores, 0.7 of the first."""
    return r.weighted_fusion(*_branches(read), 5, 0.7).withColumn("score", F.round("score", 6))


@query(f"""WITH {_BRANCHES},
c1 AS (SELECT * FROM b1 WHERE qid % 3 <> 0), c2 AS (SELECT * FROM b2 WHERE qid % 3 <> 1),
n1 AS (SELECT qid, id, rank, score, min(score) OVER w AS lo, max(score) OVER w AS hi FROM c1 WINDOW w AS (PARTITION BY qid)),
n2 AS (SELECT qid, id, rank, overlap AS score, min(overlap) OVER w AS lo, max(overlap) OVER w AS hi FROM c2 WINDOW w AS (PARTITION BY qid)),
f AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id,
    0.7 * coalesce(CASE WHEN a.hi > a.lo THEN (a.score - a.lo) / (a.hi - a.lo) ELSE a.score END, 0) + (1 - 0.7) * coalesce(CASE WHEN b.hi > b.lo THEN (b.score - b.lo) / (b.hi - b.lo) ELSE b.score END, 0) AS score
  FROM n1 a FULL JOIN n2 b ON a.qid = b.qid AND a.id = b.id),
{_top('f', "round(score, 9) DESC, id", 5, 't')}
SELECT qid, rank, id, round(score, 6) AS score FROM t WHERE qid % 3 = 2
UNION ALL SELECT qid, rank, id, round(score, 6) FROM c1 WHERE qid % 3 = 1 AND rank <= 5
UNION ALL SELECT qid, rank, id, round(overlap, 6) FROM c2 WHERE qid % 3 = 0 AND rank <= 5""")
def fusion_one_branch(read):
    """A third of the items have rows in the first branch only, a third in the second: these stay what they are."""
    one, two = _branches(read)
    return r.weighted_fusion(one.where("qid % 3 <> 0"), two.where("qid % 3 <> 1"), 5, 0.7).withColumn("score", F.round("score", 6))


@query(f"""WITH {_BM25}, {_top('bm', 'round(score, 9) DESC, id', 3, 't')}
SELECT qid, string_agg('[' || rank || '] Игра: ' || source || chr(10) || 'Релевантность: ' || printf('%.3f', score) || chr(10) || '---' || chr(10) || text || chr(10), chr(10) ORDER BY rank) AS context
FROM t JOIN documents ON id = doc_id GROUP BY qid""")
def context_format(read):
    """The three best documents of each item as the context of a prompt; the source stands for the title."""
    top = _bm25(read, 3).select("qid", "rank", "id", "score")
    docs = read("documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("title"))
    return r.context(top.join(docs, "id"))


@query(f"""WITH {_COSINE}, {_top('scored', 'score DESC, id', 10, 't')},
a AS (SELECT 'hits_all' AS metric, avg((ql = vl)::INT) AS value FROM t UNION ALL SELECT 'top_score', avg(score) FROM t WHERE rank = 1),
b AS (SELECT 'hits_all' AS metric, avg((ql = vl)::INT) AS value FROM t WHERE rank <= 3 UNION ALL SELECT 'score', avg(score) FROM t)
SELECT metric, round(a.value, 6) AS baseline, round(b.value, 6) AS best, round(b.value - a.value, 6) AS delta FROM a FULL JOIN b USING (metric)""")
def leaderboard(read):
    """Two runs compared metric by metric; a metric that one run lacks stays null."""
    queries, vectors = _vectors(read)
    ranked = r.dense_top_k(queries, vectors, 10).join(queries.select("qid", F.col("tag").alias("ql")), "qid").join(vectors.select("id", F.col("tag").alias("vl")), "id")
    hit = F.avg((F.col("ql") == F.col("vl")).cast("int"))
    value = lambda df, name, v: df.agg(v.alias("value")).select(F.lit(name).alias("metric"), "value")
    base = value(ranked, "hits_all", hit).unionByName(value(ranked.where("rank = 1"), "top_score", F.avg("score")))
    best = value(ranked.where("rank <= 3"), "hits_all", hit).unionByName(value(ranked, "score", F.avg("score")))
    out = m.compare_runs(base, best)
    return out.select("metric", *[F.round(c, 6).alias(c) for c in ("baseline", "best", "delta")])

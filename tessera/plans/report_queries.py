"""Names, payloads, corpus and set reports, catalogue rules, composed retrieval and its evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names as n
from ..functions import text as t
from ..operators import catalog as c
from ..operators import metrics as m
from ..operators import payloads as pl
from ..operators import reports as rp
from ..operators import search as s
from ..sources import storage
from .registry import query


@query("""SELECT p_partkey, 'rules/sources/by-hash/' || sha256(p_name) || '.' || lower(ltrim(ext, '.')) AS source_key, 'rules/processed/by-hash/' || sha256(p_name) || '.txt' AS text_key,
  CASE lower(ltrim(ext, '.')) WHEN 'pdf' THEN 'application/pdf' WHEN 'txt' THEN 'text/plain; charset=utf-8' ELSE 'application/octet-stream' END AS content_type,
  CASE WHEN length(p_name) > 12 THEN p_name[1:12] || '...' ELSE p_name END AS preview, '' AS nothing
FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN 'txt' ELSE 'dat' END AS ext FROM part)""")
def storage_names(read):
    """Content-addressed keys, content types and previews of named objects."""
    ext = F.when(F.col("p_partkey") % 3 == 0, ".PDF").when(F.col("p_partkey") % 3 == 1, "txt").otherwise("dat")
    digest = F.sha2("p_name", 256)
    return read("part").select(
        "p_partkey", n.source_key(digest, ext).alias("source_key"), n.processed_key(digest, F.lit("")).alias("text_key"),
        n.content_type(F.concat(F.lit("a.b/name."), F.ltrim(ext, F.lit(".")))).alias("content_type"), n.cut(F.col("p_name"), 12).alias("preview"), n.cut(F.col("p_name"), 0).alias("nothing"),
    )


@query("""WITH u AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1) AS path, page_id % 3 AS k FROM pages),
f AS (SELECT *, CASE k WHEN 0 THEN '/files/' || page_id || '/7/binder1.pdf' WHEN 1 THEN '/files/rules_' || page_id || '.pdf' ELSE '/' END AS file FROM u),
b AS (SELECT *, list_filter(string_split(file, '/'), lambda x: x <> '') AS parts FROM f)
SELECT page_id, CASE WHEN len(parts) = 0 THEN coalesce(nullif(string_split(trim(path, '/'), '/')[-1], ''), 'rules') || '.pdf'
  WHEN k = 0 THEN page_id || '_7_binder1.pdf' ELSE parts[-1] END AS filename,
  CASE WHEN k = 0 THEN 'a b+' || page_id || '.pdf' WHEN k = 1 THEN 'plain ' || page_id || '.pdf' ELSE 'fallback.pdf' END AS sent_as
FROM b""")
def file_names(read):
    """File names of links, and of Content-Disposition headers in their three forms."""
    k, id_ = F.col("page_id") % 3, F.col("page_id").cast("string")
    file = F.when(k == 0, F.concat(F.lit("http://files.example/files/"), id_, F.lit("/7/binder1.pdf"))).when(k == 1, F.concat(F.lit("http://files.example/files/rules_"), id_, F.lit(".pdf?x=1"))).otherwise("http://files.example/")
    header = F.when(k == 0, F.concat(F.lit("attachment; filename=\"no.pdf\"; filename*=UTF-8''a%20b+"), id_, F.lit(".pdf"))).when(k == 1, F.concat(F.lit('attachment; filename="plain '), id_, F.lit('.pdf"')))
    return read("pages").select("page_id", n.file_name_of(F.col("url"), file).alias("filename"), n.disposition_name(header, F.lit("fallback.pdf")).alias("sent_as"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'manifest_index_batch' WHEN 1 THEN 'rules_document' WHEN 2 THEN 'game' END AS kind,
  CASE event_id % 4 WHEN 0 THEN 3 WHEN 1 THEN event_id WHEN 2 THEN user_id END::BIGINT AS id,
  CASE WHEN event_id % 4 = 0 THEN 'Манифест (3 документов)' ELSE event_type END AS title,
  '{"content_base64":"<omitted>","kind":"' || event_type || '"}' AS snapshot, CASE WHEN event_id % 2 = 0 THEN 'trace' ELSE 'unknown error' END AS error, event_id::VARCHAR AS task_id
FROM events""")
def task_log_payload(read):
    """What a log of tasks keeps of arguments, results and errors."""
    k, e = F.col("event_id") % 4, F.col("event_id").cast("string")
    task = F.when(k == 0, "app.process_manifest_index_batch").when(k == 1, "app.process_rules_document").otherwise("app.other")
    args = F.when(k == 0, "[[4,5,6]]").when(k == 1, F.concat(F.lit("["), e, F.lit("]"))).otherwise("[]")
    context = F.when(k == 2, F.concat(F.lit('{"kind":"game","id":'), F.col("user_id").cast("string"), F.lit("}")))
    kwargs = F.create_map(F.lit("content_base64"), F.lit("AAAA"), F.lit("kind"), F.col("event_type"))
    rows = read("events").withColumn("r", pl.related_entity(task, args, context))
    return rows.select(
        "event_id", "r.kind", "r.id", pl.task_title(F.col("r.kind"), F.col("r.id"), F.col("event_type")).alias("title"), pl.snapshot(pl.sanitized(kwargs)).alias("snapshot"),
        pl.error_text(F.when(k % 2 == 0, "trace"), F.lit(None).cast("string")).alias("error"), pl.task_id(F.lit(""), e).alias("task_id"),
    )


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'flat' END AS title, lang, doc_id % 3 = 0 AS mine, 'sha256:' || sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS fingerprint,
  CASE WHEN doc_id % 2 = 0 THEN 'lang,source_doc_id,title' ELSE 'lang,source_doc_id' END AS keys, 1::BIGINT AS games
FROM documents""")
def payload_fields(read):
    """Metadata of stored points: nested maps under flat values, titles as lists, gold contexts."""
    even = F.col("doc_id") % 2 == 0
    nested = F.when(even, F.create_map(F.lit("lang"), F.lit("XX"), F.lit("title"), F.col("source"), F.lit("gone"), F.lit(None).cast("string")))
    meta = pl.metadata(nested, F.create_map().cast("map<string,string>"), flat={"lang": F.col("lang"), "source_doc_id": F.col("doc_id").cast("string")})
    rows = read("documents").withColumn("meta", meta).withColumn("titles", pl.titles(F.coalesce(F.try_element_at("meta", F.lit("title")), F.lit(" flat "))))
    gold = pl.gold_context(F.col("text"), F.col("titles"), F.col("lang"), F.col("doc_id").cast("string"))
    return rows.withColumn("gold", F.array(gold, gold)).select(
        "doc_id", pl.first_title(F.col("titles")).alias("title"), pl.lang(F.try_element_at("meta", F.lit("lang")), F.lit("zz")).alias("lang"),
        pl.has_document(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")), F.lit("-1"), F.col("doc_id")).alias("mine"), F.col("gold")[0]["fingerprint"].alias("fingerprint"),
        F.array_join(F.array_sort(F.map_keys("meta")), ",").alias("keys"), F.size(pl.games(F.col("gold"))).cast("long").alias("games"),
    )


@query("""SELECT round(avg((length(text) < 500)::INT), 6) AS share, count(*) FILTER (length(text) < 500) AS flagged, count(*) AS n, count(DISTINCT source) AS keys FROM documents""")
def quarantine_share(read):
    out = rp.flag_share(read("documents").select((F.length("text") < 500).cast("int").alias("short"), "source"), "short", "source")
    return out.withColumn("share", F.round("share", 6))


@query("""WITH r AS (SELECT conv_id, list(DISTINCT role) AS roles, count(*) AS turns FROM conversations GROUP BY conv_id)
SELECT 'role' AS what, x AS value, count(*) AS n FROM (SELECT unnest(roles) AS x FROM r) GROUP BY x
UNION ALL SELECT 'size', len(roles)::VARCHAR, count(*) FROM r GROUP BY len(roles)""")
def set_counts(read):
    """Conversations by role, and by the number of their roles."""
    rows = read("conversations").groupBy("conv_id").agg(F.collect_list("role").alias("roles"))
    sizes = rp.size_histogram(rows.select(F.lit("x").alias("all"), F.array_distinct("roles").alias("r")), "all", "r")
    return rp.array_counts(rows, "roles").select(F.lit("role").alias("what"), "value", "n").unionByName(sizes.select(F.lit("size").alias("what"), F.col("size").cast("string").alias("value"), "n"))


@query("""WITH r AS (SELECT conv_id, min(text) FILTER (role = 'user') AS q, list(text ORDER BY turn) FILTER (role = 'assistant') AS a, list(text ORDER BY turn) AS everything FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)
SELECT conv_id, length(q) AS question, coalesce(length(a[1]), 0) AS truth, coalesce(list_sum(list_transform(everything, lambda x: length(x))), 0)::BIGINT AS contexts FROM r""")
def set_lengths(read):
    """Lengths of questions, first answers and all texts together."""
    rows = read("conversations").where("text is not null").groupBy("conv_id").agg(
        F.min(F.when(F.col("role") == "user", F.col("text"))).alias("q"), F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))), lambda x: x["text"]).alias("a"), F.collect_list("text").alias("everything")
    )
    return rows.select("conv_id", rp.length_stats(F.col("q"), F.col("a"), F.col("everything")).alias("l")).select("conv_id", "l.*")


@query("""(SELECT item_id, length(text) AS chars, CASE WHEN length(text) > 100 THEN text[1:100] || '...' ELSE text END AS preview, 'shortest' AS "end" FROM benchmark ORDER BY length(text), item_id LIMIT 3)
UNION ALL (SELECT item_id, length(text), CASE WHEN length(text) > 100 THEN text[1:100] || '...' ELSE text END, 'longest' FROM benchmark ORDER BY length(text) DESC, item_id LIMIT 3)""")
def question_extremes(read):
    return rp.extremes(read("benchmark").where("text is not null"), "text", "item_id")


@query("""WITH r AS (SELECT o_orderpriority || '/' || o_orderstatus AS run, avg(o_totalprice::DOUBLE) AS a, count(*) AS b FROM orders GROUP BY ALL)
SELECT run, round(a, 4) AS a, b FROM r WHERE NOT starts_with(run, '1-') ORDER BY a DESC, b DESC, run LIMIT 1""")
def best_run(read):
    runs = read("orders").groupBy(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("run")).agg(F.avg(F.col("o_totalprice").cast("double")).alias("a"), F.count("*").alias("b"))
    return rp.winner(runs, ["a", "b"], F.col("run").startswith("1-")).withColumn("a", F.round("a", 4))


@query("""WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '(?i)[A-Za-zА-Яа-яЁё]+(?:-[A-Za-zА-Яа-яЁё]+)*|[0-9]+(?:\\.[0-9]+){1,6}|[0-9]+(?:[.,][0-9]+)?(?:[–-][0-9]+(?:[.,][0-9]+)?)?'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(w)::BIGINT AS tokens, len(list_distinct(w))::BIGINT AS types, w[1] AS first, md5(array_to_string(w, ' ')) AS digest FROM d""")
def corpus_tokens(read):
    rows = read("documents").where("text is not null").select("doc_id", rp.corpus_tokens("text").alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("tokens"), F.size(F.array_distinct("w")).cast("long").alias("types"), F.try_element_at("w", F.lit(1)).alias("first"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("""WITH r AS (SELECT event_type, value, list_filter(['low', 'odd', 'late'], lambda x: (x = 'low' AND value < 10) OR (x = 'odd' AND event_id % 2 = 1) OR (x = 'late' AND hour(ts) > 20)) AS reasons FROM events)
SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY reason ORDER BY n DESC, reason LIMIT 10""")
def reject_reasons(read):
    rows = read("events").select(F.array_compact(F.array(F.when(F.col("value") < 10, "low"), F.when(F.col("event_id") % 2 == 1, "odd"), F.when(F.hour("ts") > 20, "late"))).alias("reasons"))
    return rp.top_reasons(rows, "reasons")


@query("""SELECT max(item_id)::BIGINT AS last_id, count(*) FILTER (item_id % 2 = 0) AS single, count(*) FILTER (item_id % 2 = 1) AS multi, count(DISTINCT regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS fingerprints FROM benchmark""")
def dataset_state(read):
    """The state that a set of questions is resumed from."""
    ids = read("benchmark").select(F.lpad(F.col("item_id").cast("string"), 6, "0").alias("id"), F.when(F.col("item_id") % 2 == 1, "multi_hop").otherwise("single_hop").alias("question_type"), "text")
    gold = F.when(F.col("text").isNotNull(), F.array(F.struct(F.lit(None).cast("string").alias("fingerprint"), F.col("text").alias("text")))).otherwise(F.array().cast("array<struct<fingerprint:string,text:string>>"))
    return rp.dataset_state(ids.withColumn("gold_contexts", gold))


@query("""SELECT item_id, lpad((499 + row_number() OVER (ORDER BY item_id))::VARCHAR, 6, '0') AS id FROM benchmark WHERE item_id % 2 = 0""")
def numbered_ids(read):
    """Ids of one accepted batch, in six digits."""
    return read("benchmark").where("item_id % 2 = 0").select("item_id", n.numbered_ids(500, ["item_id"]).alias("id"))


@query("""SELECT (SELECT count(*) FROM customer WHERE c_custkey = 7) AS by_key, (SELECT count(*) FROM orders WHERE o_custkey = 7) AS by_foreign_key,
  (SELECT count(*) FROM orders WHERE o_custkey = 7 AND o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_custkey = 7)) AS by_two_keys, (SELECT count(*) FROM customer WHERE c_acctbal > 9000) AS admins, count(*) > 0 AS "any" FROM customer""")
def key_lookups(read):
    """Point lookups by one and two keys, a count under a condition, and existence."""
    customers, orders = read("customer"), read("orders")
    mine = c.find(orders, o_custkey=7)
    two = mine.join(F.broadcast(mine.agg(F.min("o_orderkey").alias("o_orderkey"))), "o_orderkey", "left_semi")  # one row
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = one(c.find(customers, c_custkey=7), "by_key").crossJoin(one(mine, "by_foreign_key")).crossJoin(one(two, "by_two_keys")).crossJoin(one(customers.where("c_acctbal > 9000"), "admins"))
    return out.withColumn("any", F.lit(rp.exists(customers)))


@query("""WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'pending' ELSE 'failed' END AS status, doc_id % 10 AS game_id FROM documents)
SELECT doc_id, game_id, status FROM d WHERE game_id <> 100 UNION ALL SELECT -1, 100, 'pending'""")
def document_upload(read):
    """A document uploaded for a game that has none in work."""
    k = F.col("doc_id") % 3
    docs = read("documents").select("doc_id", (F.col("doc_id") % 10).cast("long").alias("game_id"), F.when(k == 0, "done").when(k == 1, "pending").otherwise("failed").alias("status"))
    new = docs.sparkSession.createDataFrame([(-1,)], "doc_id long")
    return c.upload(docs, 100, new)


@query("""SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 1000, 'ATLANTIS'""")
def catalogue_changes(read):
    """A nation is deleted, another one is put in under a new name."""
    nations = read("nation").select("n_nationkey", "n_name")
    new = nations.sparkSession.createDataFrame([(1000, "ATLANTIS")], "n_nationkey long, n_name string").select(F.col("n_nationkey").cast(nations.schema["n_nationkey"].dataType), "n_name")
    return c.insert_unique(nations.where("n_nationkey <> 3"), new, "n_name")


@query("""SELECT o_custkey, CASE WHEN 10 < n THEN 11 ELSE 0 END::BIGINT AS first, CASE WHEN 10 < n THEN least(n, 20) ELSE 0 END::BIGINT AS last, 20 < n AS more FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)""")
def page_ranges(read):
    """The range that the second page of ten shows of each customer's orders."""
    rows = read("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return rows.select("o_custkey", c.page_info(F.col("n"), F.lit(1), 10).alias("p")).select("o_custkey", "p.*")


@query("""SELECT doc_id, d.lang AS one, 'de' AS other FROM documents d WHERE lang IS NOT NULL AND lang <> 'de' AND doc_id % 5 = 0 ORDER BY doc_id LIMIT 10""")
def language_conflicts(read):
    docs = read("documents").select("doc_id", "lang")
    return c.language_conflicts(docs, docs.where("doc_id % 5 = 0").select("doc_id", F.lit("de").alias("lang")), "doc_id")


@query("""WITH p AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS pages FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(array_to_string(list_transform(pages, lambda x: CASE WHEN length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) < 50 THEN '[' || length(x) || ']' ELSE x END), chr(10) || chr(10))) AS text_md5 FROM p""")
def page_texts(read):
    """Pages with too little native text are read by a hook; here it writes the length."""
    pages = read("documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("page", "native")).withColumn("image", F.col("native"))
    return storage.page_texts(pages, lambda image: F.concat(F.lit("["), F.length(image).cast("string"), F.lit("]"))).select("doc_id", F.md5("text").alias("text_md5"))


@query("""WITH d AS (SELECT doc_id, text, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS letters, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN length(text) < 50 THEN 'unknown' WHEN letters > 0 AND length(regexp_replace(text, '[^Ѐ-ӿ]', '', 'g')) / letters >= 0.7 THEN 'ru'
  WHEN letters > 0 AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / letters >= 0.7 AND len(list_filter(w, lambda x: list_contains(['the', 'and', 'of', 'to', 'in', 'is', 'that', 'for', 'with', 'a'], x))) / greatest(len(w), 1) >= 0.02 THEN 'en' ELSE 'unknown' END AS language FROM d""")
def detect_language(read):
    return read("documents").where("text is not null").select("doc_id", storage.detect_language(F.col("text")).alias("language"))


_GRID = """WITH scored AS (
  SELECT q.vec_id AS qid, v.vec_id AS id, (q.label = v.label)::INT AS hit, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id
), t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scored)"""


def _questions(read):
    """Vectors as questions and passages; the text of both is the label."""
    e = read("embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("tag"), F.concat(F.lit("w"), F.col("label").cast("string")).alias("text"))
    return e.where("id % 100 = 0").withColumnRenamed("id", "qid"), e


@query(_GRID + """, r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY coalesce(hit, 0) DESC, rank) AS rank, coalesce(hit, 0)::DOUBLE AS score FROM t WHERE rank <= 20)
SELECT qid, rank, id, score FROM r WHERE rank <= 5""")
def retrieve_two_stage(read):
    """Twenty candidates by cosine, reranked by the scorer hook (words in common), five kept."""
    questions, passages = _questions(read)
    return s.retrieve(questions, passages, s.SearchConfig(two_stage=True), top_k=17)


@query("""WITH w AS (SELECT doc_id, array_to_string(regexp_extract_all(text, '\\S+')[1:8], ' ') AS q, text FROM documents WHERE text IS NOT NULL),
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings JOIN w ON vec_id = doc_id),
dn AS (SELECT a.vec_id AS qid, b.vec_id AS id, list_cosine_similarity(a.e, b.e) AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
b0 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM dn),
c AS (SELECT doc_id, text, q FROM w SEMI JOIN v ON doc_id = vec_id),
dt AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term FROM c), tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
dl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '\\p{L}+')) AS dl FROM c), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT DISTINCT doc_id AS qid, unnest(regexp_extract_all(lower(q), '\\p{L}+')) AS term FROM c WHERE doc_id % 100 = 0),
bm AS (SELECT qid, tf.doc_id AS id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl ON dl.doc_id = tf.doc_id, st WHERE qid <> tf.doc_id GROUP BY ALL),
b1 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM bm),
u AS (SELECT qid, id, rank, 0 AS br, score FROM b0 WHERE rank <= 20 UNION ALL SELECT qid, id, rank, 1, score FROM b1 WHERE rank <= 20),
n AS (SELECT qid, count(DISTINCT br) AS k FROM u GROUP BY qid),
f AS (SELECT qid, id, sum(1.0 / (60 + rank)) AS fused, min({'br': br, 'rank': rank}) AS first, max(score) AS raw FROM u GROUP BY ALL),
t AS (SELECT qid, id, CASE WHEN k > 1 THEN fused ELSE raw END AS score, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN k > 1 THEN round(fused, 12) END DESC, first.br, first.rank, id) AS rank FROM f JOIN n USING (qid))
SELECT qid, rank, id, round(score, 6) AS score FROM t WHERE rank <= 5""")
def retrieve_hybrid(read):
    """Dense and lexical branches of twenty candidates each, fused by reciprocal rank."""
    docs = read("documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")
    e = read("embeddings").select(F.col("vec_id").alias("id"), "embedding").join(docs, "id")
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"(\S+)"), 1), 1, 8), " ")
    questions = e.where("id % 100 = 0").select(F.col("id").alias("qid"), "embedding", first.alias("text"))
    return s.retrieve(questions, e, s.SearchConfig(mode="hybrid")).withColumn("score", F.round("score", 6))


def _run_sql(first: int, second: int) -> str:
    return f"""SELECT 'two_stage_{first}_{second}' AS run, round(avg(coalesce(h, 0)), 6) AS precision, round(avg((coalesce(h, 0) > 0)::INT), 6) AS hit, count(*) AS n, count(*) AS n_samples
FROM (SELECT qid, sum(hit) / {second} AS h FROM (SELECT qid, coalesce(hit, 0) AS hit, row_number() OVER (PARTITION BY qid ORDER BY coalesce(hit, 0) DESC, rank) AS rank FROM t WHERE rank <= {first}) WHERE rank <= {second} GROUP BY qid)"""


@query(_GRID + " " + " UNION ALL ".join(_run_sql(a, b) for a in (3, 10) for b in (3, 5) if b <= a))
def retriever_grid(read):
    """Evaluation of every two-stage configuration of a grid; those with fewer candidates than passages are left out."""
    questions, passages = _questions(read)
    runs = s.run_grid(s.two_stage_grid(s.SearchConfig(), [3, 10], [3, 5]), lambda config: s.evaluate_retriever(questions, passages, None, config))
    return runs.select("run", F.round("precision", 6).alias("precision"), F.round("hit", 6).alias("hit"), "n", "n_samples")


@query("""WITH p AS (SELECT a.vec_id AS qid, max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS x FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id % 50 = 0 AND a.vec_id <> b.vec_id GROUP BY a.vec_id)
SELECT qid, round(greatest(0, x), 6) AS similarity FROM p""")
def semantic_similarity(read):
    """The best cosine with several references, the label's vectors whose id is divisible by 50."""
    e = read("embeddings")
    refs = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("rid"), "embedding", F.col("label").alias("tag"))
    return s.best_tag_similarity(e.select(F.col("vec_id").alias("qid"), "embedding", F.col("label").alias("tag")), refs).withColumn("similarity", F.round("similarity", 6))


@query("""WITH x AS (SELECT event_type, user_id, CASE WHEN value >= 1 THEN 1 + event_id % 5 END AS score FROM events) SELECT event_type, user_id, round_even(median(score), 0)::INT AS score FROM x GROUP BY ALL""")
def judge_median(read):
    """A judge's trials: the median of the valid ones, rounded half to even."""
    trials = read("events").select("event_type", "user_id", F.when(F.col("value") >= 1, F.lit(1) + F.col("event_id") % 5).alias("score"))
    return s.judge(trials, ["event_type", "user_id"])


@query("""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+')[1:30] AS p, [regexp_extract_all(lower(text), '[a-z]+')[11:50], regexp_extract_all(lower(text), '[a-z]+')[1:20]] AS refs FROM documents WHERE text IS NOT NULL AND doc_id % 20 = 0),
r AS (SELECT doc_id, p, unnest(refs) AS r, unnest([1, 2]) AS nth FROM d),
g AS (SELECT doc_id, nth, x, count(*) AS a FROM (SELECT doc_id, nth, unnest(r) AS x FROM r) GROUP BY ALL), h AS (SELECT doc_id, x, count(*) AS b FROM (SELECT doc_id, unnest(p) AS x FROM d) GROUP BY ALL),
o AS (SELECT doc_id, nth, sum(least(a, coalesce(b, 0))) / sum(a) AS v FROM g LEFT JOIN h USING (doc_id, x) GROUP BY ALL)
SELECT doc_id, round(coalesce(max(v), 0), 6) AS rouge1_recall FROM d LEFT JOIN o USING (doc_id) GROUP BY doc_id""")
def rouge_best(read):
    """The best of two references for each measure by itself."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)
    rows = read("documents").where("text is not null and doc_id % 20 = 0").select("doc_id", F.slice(w, 1, 30).alias("p"), F.array(F.slice(w, 11, 40), F.slice(w, 1, 20)).alias("refs"))
    return s.best_rouge(rows, "doc_id", "p", "refs").select("doc_id", F.round("rouge1_recall", 6).alias("rouge1_recall"))

"""Catalogue, dialogue, task-log and event queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names as n
from ..functions import text as t
from ..operators import metrics as m
from ..operators import tables as o
from ..sources.workspace import workspace
from ..streaming import tasks
from .registry import query


@query("""WITH o AS (SELECT * FROM orders WHERE o_custkey IS NOT NULL),
d AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM o WHERE o_orderpriority IS NOT NULL GROUP BY ALL)
SELECT c.c_custkey, (SELECT list(o_orderpriority ORDER BY k) FROM d WHERE d.o_custkey = c.c_custkey) AS titles, min(o_orderkey) AS first_order, arg_min(o_orderstatus, o_orderkey) AS first_status
FROM customer c JOIN o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey""".replace(
    "(SELECT list(o_orderpriority ORDER BY k) FROM d WHERE d.o_custkey = c.c_custkey) AS titles", "(SELECT string_agg(o_orderpriority, '|' ORDER BY k) FROM d WHERE d.o_custkey = c.c_custkey) AS titles"
))
def manifest_group(read):
    """One row per customer: distinct values in order of first appearance, and first non-null values."""
    rows = read("orders").join(read("customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    grouped = o.ordered_unique(rows, ["c_custkey"], "o_orderkey", "o_orderpriority", {"first_status": "o_orderstatus"})
    return grouped.select("c_custkey", F.concat_ws("|", "titles").alias("titles"), F.col("first_ord").alias("first_order"), "first_status")


@query("""SELECT conv_id, count(*) AS chunks, min(role) FILTER (role = 'system') AS title FROM conversations GROUP BY conv_id HAVING count(*) >= 2 AND count(DISTINCT role) FILTER (role = 'system') = 1""")
def multihop_groups(read):
    """Groups of two rows or more with exactly one system role: candidates for multi-hop questions."""
    g = read("conversations").groupBy("conv_id").agg(F.count("*").alias("chunks"), F.max(F.when(F.col("role") == "system", F.col("role"))).alias("title"))
    return g.where("chunks >= 2 and title is not null")


@query("""WITH x AS (SELECT conv_id, turn, CASE WHEN length(s) <= 600 THEN s ELSE s[1:600] || chr(10) || '…' END AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back
  FROM (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM conversations)),
y AS (SELECT conv_id, turn, t, sum(length(t)) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM x WHERE back <= 6)
SELECT conv_id, string_agg(t, chr(10) || chr(10) ORDER BY turn) AS history FROM y WHERE total <= 3000 GROUP BY conv_id""")
def dialog_history(read):
    """The last turns, each clipped, up to a total length."""
    return o.history(read("conversations"), turns=6, each=600, total=3000)


@query(r"""WITH l AS (SELECT conv_id, turn, role, text AS a, lag(role) OVER w AS br, lag(text) OVER w AS q FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(q, ''), '^\s+|\s+$', '', 'g')) AS q, trim(regexp_replace(coalesce(a, ''), '^\s+|\s+$', '', 'g')) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM l WHERE role = 'assistant' AND br = 'user'),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM p WHERE back <= 3),
b AS (SELECT conv_id, turn, 'QUESTION' || n || ': ' || CASE WHEN length(q) > 300 THEN substr(q, 1, 300) || chr(10) || '...[обрезано]' ELSE q END || chr(10) || 'ANSWER' || n || ': ' || CASE WHEN length(a) > 300 THEN substr(a, 1, 300) || chr(10) || '...[обрезано]' ELSE a END AS block FROM k),
r AS (SELECT *, sum(length(block)) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM b)
SELECT conv_id, 'Контекст предыдущих вопросов по этой же игре:' || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY turn) AS history FROM r WHERE upto <= 1000 GROUP BY conv_id""")
def qa_history(read):
    """Question and answer blocks of each conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read("conversations").select("conv_id", "turn", "role", F.col("text").alias("a"), F.lag("role").over(w).alias("before"), F.lag("text").over(w).alias("q"))
    return o.qa_history(rows.where("role = 'assistant' and before = 'user'"), turns=3, each=300, total=1000)


@query("""SELECT conv_id, turn, string_agg(role || ':' || length(text), ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3 FROM conversations""")
def dialog_last3(read):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, 0)
    item = F.concat_ws(":", "role", F.length("text").cast("string"))
    return read("conversations").select("conv_id", "turn", F.concat_ws(" ", F.collect_list(item).over(w)).alias("last3"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, count(value) AS n FROM events GROUP BY event_type")
def latency_stats(read):
    out = m.latency_stats(read("events"), ["event_type"], "value")
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p50", "p95")], "n")


@query("""WITH r AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY ALL) SELECT event_type, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(*) AS runs FROM r GROUP BY event_type""")
def run_aggregate(read):
    """Mean and sample deviation over runs (days)."""
    runs = read("events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return runs.groupBy("event_type").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("std"), F.count("*").alias("runs"))


@query("""SELECT e.event_id, e.event_type, c.c_name, n.n_name FROM events e LEFT JOIN customer c ON e.event_type = 'purchase' AND e.user_id = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey ORDER BY e.ts DESC, e.event_id LIMIT 50 OFFSET 20""")
def task_log_page(read):
    """A page of the log with its context: two left joins, the type test in the join's condition."""
    e, c, n = read("events"), read("customer"), read("nation")
    page = e.orderBy(F.desc("ts"), "event_id").offset(20).limit(50)  # customers and nations are unique, so the page may come first
    joined = page.join(c, (page.event_type == "purchase") & (page.user_id == c.c_custkey), "left").join(n, c.c_nationkey == n.n_nationkey, "left")
    return joined.select("event_id", "event_type", "c_name", "n_name")


@query("SELECT p_partkey, p_name, (SELECT count(*) FROM part WHERE p_name ILIKE '%ring%') AS total FROM part WHERE p_name ILIKE '%ring%' ORDER BY p_name, p_partkey LIMIT 20 OFFSET 10")
def title_search_page(read):
    return o.search_page(read("part"), "p_name", "ring", ["p_name", "p_partkey"], 10, 20).select("p_partkey", "p_name", "total")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey")
def latest_per_key(read):
    return o.latest(read("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey ORDER BY min(l_partkey), l_orderkey LIMIT 100)")
def first_n_keys(read):
    """All rows of the first 100 keys by first appearance."""
    return o.first_keys(read("lineitem"), "l_orderkey", "l_partkey", 100).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT p_partkey, count(DISTINCT l_suppkey) AS refs, count(l_suppkey) = 0 AS orphan FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey")
def refcount_orphans(read):
    return o.refcounts(read("part"), "p_partkey", read("lineitem"), "l_partkey", "l_suppkey")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS since, count(*) AS changes FROM events GROUP BY user_id")
def task_state_latest(read):
    return o.latest_state(read("events"), "user_id", "event_type", ["ts", "event_id"])


@query("""WITH n AS (SELECT doc_id, md5(text || '!') AS body, 2 AS version FROM documents WHERE lang = 'de'), u AS (SELECT doc_id, md5(text) AS body, 1 AS version FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n) SELECT doc_id, body, version FROM u""")
def upsert_replace(read):
    """New versions of the German documents replace the old rows."""
    docs = read("documents")
    old = docs.select("doc_id", F.md5("text").alias("body"), F.lit(1).alias("version"))
    new = docs.where("lang = 'de'").select("doc_id", F.md5(F.concat("text", F.lit("!"))).alias("body"), F.lit(2).alias("version"))
    return o.upsert(old, new, ["doc_id"])


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def json_fields(read):
    j = F.from_json("props", "k INT, missing STRING")
    return read("events").select("event_id", j["k"].alias("k"), F.coalesce(j["missing"], F.lit("none")).alias("missing"))


@query("""WITH l AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS href FROM pages) SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title, coalesce(n, 0) AS links, first_href FROM pages LEFT JOIN (SELECT page_id, count(*) AS n, min(href) AS first_href FROM l GROUP BY page_id) USING (page_id)""")
def link_extract(read):
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))
    rows = read("pages").select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("title"), links.alias("l"))
    return rows.select("page_id", "title", F.size("l").cast("long").alias("links"), F.array_min("l").alias("first_href"))


@query("""SELECT event_id, regexp_replace(lower(event_type), '[^a-z]+', '_', 'g') || '_rules.txt' AS filename, 'sha256:' || sha256(event_type) AS fp, CASE WHEN value >= 50 THEN 'high' WHEN value >= 10 THEN 'mid' ELSE 'low' END AS band FROM events""")
def scalar_names(read):
    """File names, fingerprints and score bands from plain columns."""
    return read("events").select(
        "event_id", n.source_filename(F.col("event_type"), "txt").alias("filename"), t.sha_fingerprint("event_type").alias("fp"), F.when(F.col("value") >= 50, "high").when(F.col("value") >= 10, "mid").otherwise("low").alias("band")
    )


@query(r"""WITH d AS (SELECT doc_id, substr(coalesce(text, ''), 1, 40) AS head, CASE doc_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN 'txt' ELSE '' END AS ext FROM documents),
s AS (SELECT doc_id, ext, CASE WHEN doc_id % 10 = 0 THEN '' ELSE trim(regexp_replace(replace(replace(strip_accents(lower('!' || head || ' ' || doc_id || ',5')), 'ß', 'ss'), ',5', '5'), '[^a-z0-9]+', '_', 'g'), '_') END AS slug FROM d)
SELECT doc_id, CASE WHEN slug = '' THEN 'game_' || doc_id ELSE slug END || '_rules.' || CASE ext WHEN '.PDF' THEN 'pdf' WHEN 'txt' THEN 'txt' ELSE 'bin' END AS filename FROM s""")
def source_filenames(read):
    """Titles with accents, digits, marks at both ends and none at all; extensions in several spellings."""
    title = F.when(F.col("doc_id") % 10 == 0, "¿?").otherwise(F.concat(F.lit("!"), F.substr(F.coalesce("text", F.lit("")), F.lit(1), F.lit(40)), F.lit(" "), F.col("doc_id").cast("string"), F.lit(",5")))
    kind = F.when(F.col("doc_id") % 3 == 0, ".PDF").when(F.col("doc_id") % 3 == 1, "txt").otherwise("")
    return read("documents").select("doc_id", n.source_filename(title, kind, F.col("doc_id")).alias("filename"))


@query("SELECT (SELECT count(*) FROM (SELECT user_id FROM events INTERSECT SELECT c_custkey FROM customer)) AS both, (SELECT count(*) FROM (SELECT user_id FROM events EXCEPT SELECT c_custkey FROM customer)) AS only_events, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT user_id FROM events)) AS only_customers, (SELECT count(DISTINCT user_id) FROM events) AS users")
def key_sets(read):
    """Intersection and differences of two key sets."""
    return o.set_sizes(read("events").select(F.col("user_id").alias("k")), read("customer").select(F.col("c_custkey").alias("k"))).select(
        "both", F.col("only_left").alias("only_events"), F.col("only_right").alias("only_customers"), F.col("left").alias("users")
    )


@query("""WITH w AS (SELECT item_id, array_to_string(regexp_extract_all(text, '\\S+')[1:3], ' ') AS start, length(text) AS n FROM benchmark)
SELECT start, count(*) AS n, min(item_id) AS first_item FROM w GROUP BY start ORDER BY n DESC, start LIMIT 25""")
def top_starts(read):
    """The 25 most frequent first three words of the questions."""
    start = F.concat_ws(" ", F.slice(F.regexp_extract_all("text", F.lit(r"(\S+)"), 1), 1, 3))
    rows = read("benchmark").select(start.alias("start"), "item_id")
    return rows.groupBy("start").agg(F.count("*").alias("n"), F.min("item_id").alias("first_item")).orderBy(F.desc("n"), "start").limit(25)


@query("""WITH e AS (SELECT user_id AS task_id, event_id, ts, CASE event_type WHEN 'view' THEN 'pending' WHEN 'signup' THEN 'processing' WHEN 'purchase' THEN 'indexed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'retry' END AS state
  FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL)
SELECT task_id, arg_max(state, {'ts': ts, 'id': event_id}) AS state, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS since, count(*) AS n_events, count(*) FILTER (state = 'retry') AS n_retries, count(*) FILTER (state = 'failed') AS n_failures
FROM e WHERE state IS NOT NULL GROUP BY task_id""")
def task_machine(read):
    """The event log as a stream in three parts that overlap in time, one of them twice; the state machine's last states."""
    signals = F.create_map(*[F.lit(x) for pair in {"view": "received", "signup": "started", "purchase": "succeeded", "error": "failed", "click": "retried"}.items() for x in pair])
    events = read("events").select(F.col("user_id").alias("task_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), signals[F.col("event_type")].alias("signal"))
    spark, root = events.sparkSession, workspace(read("events").sparkSession, "task-machine")
    for part in (0, 1, 1, 2):
        # a file holds all events of its tasks: with more files, and so more batches, no batch meets more tasks
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part).repartition("task_id").write.mode("append").parquet(f"{root}/log")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 8).parquet(f"{root}/log")
    tasks.run_tasks(spark, stream, f"{root}/updates", f"{root}/mark", tasks.TaskConfig(expiry=1e9, backoff=1e9, longest=1e9, watermark="400 days"))
    last = tasks.latest_states(spark, f"{root}/updates")
    return last.select("task_id", "state", F.date_format("since", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("since"), "n_events", "n_retries", "n_failures")

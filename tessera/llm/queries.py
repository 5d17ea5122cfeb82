"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import Stage, read_table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), stage=Stage(spark, "op1"), digest=True)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.schedule(docs)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import token_output as t

    config = t.TokenConfig(public_tokenizers.path("word_bpe_49k.json"))
    blocks, ranks = t.write_tokens(read_table(spark, sf_dir, "documents"), config, Stage(spark, "op4"))
    return t.token_digest(blocks, ranks)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    return chat.conversations_digest(read_table(spark, sf_dir, "conversations"), Stage(spark, "op5"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate as d

    return d.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.deduplicate(read_table(spark, sf_dir, "documents"), stage=Stage(spark, "op7"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chaining

    return chaining.passages(read_table(spark, sf_dir, "documents"), stage=Stage(spark, "op8"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_blocks

    return html_blocks.extract(read_table(spark, sf_dir, "pages"))


def op10_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import projection

    return projection.deduplicate(read_table(spark, sf_dir, "embeddings"), stage=Stage(spark, "op10"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tiered_index

    return tiered_index.rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), Stage(spark, "op11"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import prefix_trie

    return prefix_trie.conversation_trie(read_table(spark, sf_dir, "conversations"), Stage(spark, "op12"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import token_counts

    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


_ALL = (
    op1_suffix_dedup, op2_mixing, op3_quality, op4_tokens, op5_chat, op6_decontaminate, op7_simhash, op8_passages, op9_main_text, op10_projection,
    op11_ranked_search, op12_prefix_trie, op13_token_counts,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

ORACLE_SQL: dict[str, str] = {
    "op5_chat": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), esc AS (
  SELECT *, length(regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?s>)', '\\l\1', 'gi'), '\[(/?INST\])', '\\b\1', 'gi')) AS n_text,
    length(regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(/?s>)', '\\l\1', 'gi'), '\[(/?INST\])', '\\b\1', 'gi')) AS n_role
  FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n_text + n_role + 23)::BIGINT AS formatted_chars
FROM esc GROUP BY conv_id
""",
    "op6_decontaminate": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ig AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
dg AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM ig) WHERE len(w) >= k)),
m AS (SELECT doc_id, i, k, item_id FROM dg JOIN ig USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
""",
    # the tables' pages have one article each, of headings and paragraphs
    "op9_main_text": r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|\z)', 1) AS x FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(string_split_regex(x, '</?(?:p|h1)>'), lambda s: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(s, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))), lambda s: s <> '') AS blocks FROM a)
SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, length(array_to_string(blocks, chr(10)))::BIGINT AS n_chars FROM b
""",
    "op11_ranked_search": r"""
WITH dt AS (SELECT rowid AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
it AS (SELECT qid, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS qid, item_id, text FROM benchmark)),
tot AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_words FROM dt WHERE len(w) > 0),
tf AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(w) AS term FROM dt) GROUP BY ALL),
lex AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, tot GROUP BY term, n_docs),
doc AS (SELECT rid, doc_id, 75 + (25 * len(w)::BIGINT * n_docs) // n_words AS m FROM dt, tot),
post AS (SELECT tf.rid, term, lex.w * ((1000000000 * tf) // (1000 * tf + 12 * m)) AS part FROM tf JOIN lex USING (term) JOIN doc USING (rid)),
s AS (SELECT qid, item_id, rid, sum(part)::BIGINT AS score FROM it JOIN post USING (term) GROUP BY ALL),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST, rid) AS rank FROM s JOIN doc USING (rid) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20
""",
    "op12_prefix_trie": r"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) AS r(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
num AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
    {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, count(*) AS n FROM num GROUP BY conv_id),
crc(conv_id, i, c) AS (
  SELECT conv_id, 0, 4294967295::BIGINT FROM ids
  UNION ALL SELECT conv_id, i + 1, xor(c // 256, t[xor(c, ascii((conv_id::VARCHAR)[i + 1])) % 256 + 1]) FROM crc, tab WHERE i < length(conv_id::VARCHAR)),
h AS (SELECT conv_id, n, xor(c, 4294967295) % 6 AS h FROM crc JOIN ids USING (conv_id) WHERE i = length(conv_id::VARCHAR)),
parts AS (
  SELECT h.conv_id, 0 AS part, b.pos, b.x FROM h JOIN num b ON b.conv_id = h.conv_id - h.conv_id % 100 AND b.pos <= h.h
  UNION ALL SELECT h.conv_id, 1, o.pos, o.x FROM h JOIN num o ON o.conv_id = h.conv_id AND o.pos > h.h),
whole AS (SELECT h.conv_id, coalesce(list(x ORDER BY part, pos) FILTER (part IS NOT NULL), []) AS w FROM h LEFT JOIN parts USING (conv_id) GROUP BY h.conv_id),
path AS (SELECT conv_id, len(w) AS total, unnest(range(len(w) + 1)) AS depth, w FROM whole),
keyed AS (SELECT conv_id, total, depth, sha256(w[1:depth]::VARCHAR) AS k, sha256(w[1:depth - 1]::VARCHAR) AS up, CASE WHEN depth > 0 THEN length(w[depth].text) ELSE 0 END AS chars FROM path),
node AS (SELECT k, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (total = depth), '')) AS ends_sha256 FROM keyed GROUP BY k, depth),
kids AS (SELECT up, depth - 1 AS depth, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
below AS (SELECT a.k, a.depth, sum((b.n_convs - 1) * b.chars) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
  FROM (SELECT DISTINCT a.k, a.depth, b.k AS bk, b.depth AS bd FROM keyed a JOIN keyed b ON a.conv_id = b.conv_id AND a.depth <= b.depth) p
  JOIN node a ON a.k = p.k AND a.depth = p.depth JOIN node b ON b.k = p.bk AND b.depth = p.bd LEFT JOIN kids c ON c.up = b.k AND c.depth = b.depth GROUP BY a.k, a.depth)
SELECT n.conv_id, n.depth::BIGINT AS depth, CASE WHEN n.depth > 0 THEN u.conv_id END AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, n.ends_sha256
FROM node n JOIN below USING (k, depth) LEFT JOIN node u ON u.k = n.up AND u.depth = n.depth - 1 LEFT JOIN kids c ON c.up = n.k AND c.depth = n.depth
""",
    "op10_projection": r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS least FROM r GROUP BY x), n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.least, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN c ON c.x = vec_id
""",
}

"""Documents: measures, flags, cleaning, chunks, duplicates, hold-out and text scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import udf_text as u
from ..operators import corpus as c
from ..operators import metrics as m
from ..sources.workspace import workspace
from .registry import query

_INK = "regexp_replace(text, '[\\s\\v\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{0085}]', '', 'g')"
_CHARS = f"ch AS (SELECT doc_id, unnest(string_split({_INK}, '')) AS c FROM documents WHERE length({_INK}) > 0)"
_FREQ = f"{_CHARS}, fr AS (SELECT doc_id, c, count(*) AS n FROM ch GROUP BY ALL), mx AS (SELECT doc_id, max(n) / sum(n) AS max_char, -sum((n / t) * log2(n / t)) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS t FROM fr) GROUP BY doc_id)"
_WORD = "[\\p{L}]+|[0-9]+"
_STRIP = "regexp_replace({}, '^[\\s\\x{{00a0}}]+|[\\s\\x{{00a0}}]+$', '', 'g')"
_LINES = f"ln AS (SELECT doc_id, lang, generate_subscripts(l, 1) - 1 AS pos, {_STRIP.format('unnest(l)')} AS line FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents))"
_METRICS = f"""{_FREQ}, met AS (
  SELECT doc_id, length(text) AS chars, len(string_split(text, chr(10))) AS n_lines,
    CASE WHEN length({_INK}) > 0 THEN len(regexp_extract_all(text, '\\p{{L}}')) / length({_INK}) ELSE 0 END AS alpha,
    coalesce(max_char, 1) AS max_char, coalesce(entropy, 0) AS entropy,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_full_match(x, '\\s*[A-Za-zА-Яа-яЁё]\\s*'))) / len(string_split(text, chr(10))) AS one_letter
  FROM documents LEFT JOIN mx USING (doc_id))"""


@query(f"WITH {_METRICS} SELECT doc_id, chars, n_lines, round(alpha, 6) AS alpha, round(max_char, 6) AS max_char, round(one_letter, 6) AS one_letter FROM met")
def doc_char_metrics(read):
    out = c.char_metrics(read("documents"))
    return out.select("doc_id", "chars", "n_lines", *[F.round(x, 6).alias(x) for x in ("alpha", "max_char", "one_letter")])


@query(f"WITH {_FREQ} SELECT doc_id, round(coalesce(entropy, 0), 6) AS entropy FROM documents LEFT JOIN mx USING (doc_id)")
def doc_entropy(read):
    return read("documents").select("doc_id", F.round(t.char_stats("text")["entropy"], 6).alias("entropy"))


@query(f"""WITH {_LINES}, k AS (SELECT doc_id, line, count(*) AS n FROM ln WHERE line <> '' GROUP BY ALL),
rep AS (SELECT doc_id, max(n) / sum(n) AS repetition FROM k GROUP BY doc_id),
x AS (SELECT doc_id, lang, text, coalesce(repetition, 0) AS repetition, CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '\\p{{L}}')) / length(text) ELSE 0 END AS letter_ratio FROM documents LEFT JOIN rep USING (doc_id))
SELECT doc_id, round(letter_ratio, 6) AS letter_ratio, round(repetition, 6) AS repetition, length(text) < 500 AS too_short, letter_ratio < 0.5 AS few_letters, repetition > 0.7 AS repetitive, coalesce(lang, 'unknown') = 'unknown' AS unknown_lang FROM x""")
def letter_repetition_flags(read):
    out = c.defect_flags(read("documents"))
    return out.withColumn("letter_ratio", F.round("letter_ratio", 6)).withColumn("repetition", F.round("repetition", 6))


@query(f"WITH {_METRICS} SELECT doc_id, round(one_letter, 6) AS one_letter, round(max_char, 6) AS max_char, round(alpha, 6) AS alpha FROM met ORDER BY round(one_letter, 6) DESC, round(max_char, 6) DESC, round(alpha, 6), doc_id LIMIT 15")
def raw_suspicious_top15(read):
    rows = c.char_metrics(read("documents")).select("doc_id", *[F.round(x, 6).alias(x) for x in ("one_letter", "max_char", "alpha")])
    return rows.orderBy(F.desc("one_letter"), F.desc("max_char"), "alpha", "doc_id").limit(15)


@query("SELECT coalesce(lang, 'unknown') AS lang, count(*) AS n FROM documents GROUP BY 1")
def lang_counts(read):
    return read("documents").groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.count("*").alias("n"))


@query(f"""WITH tk AS (SELECT lang, doc_id, unnest(regexp_extract_all(lower(text), '{_WORD}')) AS tok FROM documents)
SELECT lang, count(DISTINCT doc_id) AS docs, count(*) AS tokens, count(DISTINCT tok) AS types, round(count(DISTINCT tok) / count(*), 6) AS ttr FROM tk GROUP BY lang""")
def vocab_ttr(read):
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+|[0-9]+)"), 1)
    # one row per language and word before the words are counted
    per_word = read("documents").select("lang", F.explode(tokens).alias("tok")).groupBy("lang", "tok").agg(F.count("*").alias("n"))
    docs = read("documents").where(F.size(tokens) > 0).groupBy("lang").agg(F.count_distinct("doc_id").alias("docs"))
    words = per_word.groupBy("lang").agg(F.sum("n").alias("tokens"), F.count("*").alias("types"))
    return words.join(docs, words.lang.eqNullSafe(docs.lang), "left").select(words.lang, "docs", "tokens", "types", F.round(F.col("types") / F.col("tokens"), 6).alias("ttr"))


#: Stop words of the n-gram report.
STOP = {"en": ["the", "and", "of", "to", "in", "is", "that", "for", "with", "are", "this", "be", "on", "it"], "de": ["der", "die", "das", "und", "ist"], "fr": ["le", "la", "les", "de", "et"], "es": ["el", "la", "los", "de", "y"]}


def _ngram_query(n: int) -> None:
    stops = " ".join(f"WHEN lang = '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in STOP.items())
    sql = f"""WITH a AS (SELECT lang, list_filter(regexp_extract_all(lower(text), '{_WORD}'), lambda x: length(x) >= 2 AND regexp_full_match(x, '\\p{{L}}+') AND NOT list_contains(CASE {stops} ELSE [] END, x)) AS tk FROM documents),
g AS (SELECT lang, unnest(list_transform(range(1, len(tk) - {n - 2}), lambda i: array_to_string(tk[i:i + {n - 1}], ' '))) AS gram FROM a),
k AS (SELECT lang, gram, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS rank FROM k)
SELECT lang, rank, gram, n FROM t WHERE rank <= 25"""

    @query(sql, name=f"top_ngrams_{n}")
    def top(read):
        """The 25 most frequent n-grams of each language, after stop words, short and non-letter tokens are gone."""
        # runs of letters are the tokens that are no digits; the pattern runs once a text, the stop words are constants
        rows = read("documents").select("lang", F.split(F.lower("text"), r"[^\p{L}]+").alias("tk"))
        kept = lambda stop: F.filter("tk", lambda x: (F.length(x) >= 2) & ~x.isin(stop))
        by_lang = F.coalesce(*[F.when(F.col("lang") == k, kept(v)) for k, v in STOP.items()], F.filter("tk", lambda x: F.length(x) >= 2))
        rows = rows.select("lang", by_lang.alias("tk"))
        grams = rows.select("lang", F.explode(t.ngrams(F.col("tk"), n)).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
        ranked = grams.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
        return ranked.where("rank <= 25").select("lang", "rank", "gram", "n")


for _n in (1, 2, 3):
    _ngram_query(_n)


@query(f"""WITH {_METRICS}, r0 AS (SELECT round(alpha, 9) AS a, round(max_char, 9) AS m, n_lines::DOUBLE AS l FROM met),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS a, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2 AS m, rank() OVER (ORDER BY l) + (count(*) OVER (PARTITION BY l) - 1) / 2 AS l FROM r0)
SELECT round(corr(a, m), 6) AS alpha_max_char, round(corr(a, l), 6) AS alpha_lines, round(corr(m, l), 6) AS max_char_lines FROM r""")
def spearman_matrix(read):
    """Spearman correlations with average ranks on ties.

    Ranks come from the counts of distinct values: a running sum over them, not a sort of all rows in one task.
    """
    measured = c.char_metrics(read("documents")).select(F.round("alpha", 9).alias("a"), F.round("max_char", 9).alias("m"), F.col("n_lines").cast("double").alias("l"))
    path = workspace(measured.sparkSession, "spearman")
    measured.write.parquet(path)  # three numbers a document; the texts are measured once
    values = measured.sparkSession.read.schema(measured.schema).parquet(path)
    rows = values
    for name in ("a", "m", "l"):
        counts = values.groupBy(name).agg(F.count("*").alias("n"))
        # the running sum is over ranges of values first, then within each
        parts = counts.withColumn("part", F.floor(F.col(name) * 100))
        sums = parts.groupBy("part").agg(F.sum("n").alias("size")).withColumn("before", F.sum("size").over(Window.orderBy("part")) - F.col("size"))
        within = F.sum("n").over(Window.partitionBy("part").orderBy(name)) - F.col("n")
        ranks = parts.withColumn("within", within).join(sums, "part").select(name, (F.col("before") + F.col("within") + 1 + (F.col("n") - 1) / 2).alias(f"r{name}"))
        rows = rows.join(ranks, name)
    return rows.agg(*[F.round(F.corr(f"r{x}", f"r{y}"), 6).alias(n) for x, y, n in (("a", "m", "alpha_max_char"), ("a", "l", "alpha_lines"), ("m", "l", "max_char_lines"))])


@query(f"""WITH {_LINES}, nb AS (SELECT lang, doc_id, list(line ORDER BY pos) FILTER (line <> '') AS l FROM ln GROUP BY ALL),
e AS (SELECT lang, unnest(list_concat(l[1:6], l[greatest(1, len(l) - 5):])) AS line FROM nb)
SELECT lang, line, count(*) AS n FROM e WHERE length(line) BETWEEN 3 AND 120 GROUP BY ALL HAVING count(*) >= 3""")
def boilerplate_lines(read):
    return c.boilerplate(read("documents"), least=3)


_BAD_LINE = "regexp_matches(line, '(?i)^\\s*(стр\\.?|страниц[аы]?|page)\\s*\\d+(\\s*[\\/\\-]\\s*\\d+)?\\s*$|^\\s*[–—\\-]\\s*\\d+\\s*[–—\\-]?\\s*$|^\\s*([_\\-–—=•\\*]{3,}|\\d{1,4})\\s*$|^\\s*[.,;:!?•*\\-–—=\\s]{1,10}\\s*$|^\\s*[A-Za-zА-Яа-яЁё]\\s*$|^\\s*[^A-Za-zА-Яа-яЁё0-9]{6,}\\s*$')"


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (line <> '' AND {_BAD_LINE}) AS dropped FROM ln GROUP BY doc_id")
def page_junk_filter(read):
    rows = c.exploded_lines(read("documents"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if((F.col("line") != "") & c.unwanted_line(F.col("line"))).alias("dropped"))


@query(f"""WITH {_LINES}, pr AS (SELECT row_number() OVER () AS k, doc_id, line AS text FROM ln WHERE line <> ''),
ch AS (SELECT k, unnest(string_split({_INK}, '')) AS c FROM pr WHERE length({_INK}) > 0),
fr AS (SELECT k, c, count(*) AS n FROM ch GROUP BY ALL),
mx AS (SELECT k, max(n) / sum(n) AS mc, -sum((n / t) * log2(n / t)) AS en FROM (SELECT *, sum(n) OVER (PARTITION BY k) AS t FROM fr) GROUP BY k),
s AS (SELECT doc_id, length(text) AS len, CASE WHEN length({_INK}) > 0 THEN len(regexp_extract_all(text, '\\p{{L}}')) / length({_INK}) ELSE 0 END AS al, coalesce(mc, 1) AS mc, coalesce(en, 0) AS en,
  regexp_matches(text, '(?i)^\\s*(ФАЗА|ШАГ|PHASE|STEP)\\s+\\d|^\\s*(раздел|глава|приложение)(\\s|$)|^\\s*(Setup|Components|Gameplay|End of game|Scoring)\\s*:?\\s*$') AS hd FROM pr LEFT JOIN mx USING (k)),
b AS (SELECT doc_id, len, NOT hd AND (al < 0.55 OR mc > 0.22 OR (len >= 120 AND en < 3.2)) AS bad FROM s),
a AS (SELECT doc_id, count(*) AS total, count(*) FILTER (bad) AS bad, sum(CASE WHEN bad THEN 0 ELSE len END) AS kept FROM b GROUP BY doc_id)
SELECT doc_id, coalesce(total, 0) AS total, coalesce(bad, 0) AS bad, round(coalesce(bad / total, 1), 6) AS bad_ratio, coalesce(kept, 0)::BIGINT AS kept_chars FROM documents LEFT JOIN a USING (doc_id)""")
def paragraph_quality(read):
    """Each line as a paragraph: the texts have no blank lines."""
    return c.paragraph_quality(read("documents"), separator="\n").withColumn("bad_ratio", F.round("bad_ratio", 6))


@query(f"""WITH {_LINES}, a AS (SELECT doc_id, pos, line, (line = '' OR regexp_matches(line, '(?i)^\\s*((\\d+(\\.\\d+){{0,5}}[.)])|([a-zа-яё]\\))|([\\-–—•]))\\s+|^\\s*(раздел|глава|приложение)(\\s|$)')
  OR (length(line) <= 35 AND ((upper(line) = line AND regexp_matches(line, '\\p{{Lu}}')) OR suffix(line, ':')))) AS alone FROM ln),
b AS (SELECT *, alone OR coalesce(lag(alone) OVER (PARTITION BY doc_id ORDER BY pos), true) AS st FROM a),
d AS (SELECT *, sum(st::INT) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS part FROM b)
SELECT doc_id, part::BIGINT AS part, string_agg(line, ' ' ORDER BY pos) AS line FROM d GROUP BY ALL""")
def line_merge(read):
    return c.merge_lines(read("documents"))


@query()
def collapse_phrases(read):
    """Lines with their repeated phrases collapsed, counted; needs back references, so there is no SQL."""
    rows = c.exploded_lines(read("documents")).withColumn("short", u.collapse_phrases("line"))
    return rows.groupBy("doc_id").agg(F.count_if(F.col("short") != F.col("line")).alias("changed"), F.sum(F.length("line") - F.length("short")).alias("saved"))


@query()
def clean_report(read):
    """The whole cleaner: its line stage is sequential, so there is no SQL."""
    return c.clean_report(read("documents")).drop("clean_text")


@query("""WITH h AS (SELECT doc_id, lang, sha256(text) AS doc_sha256 FROM documents)
SELECT doc_sha256, min(doc_id) AS keep_id, count(*) AS copies, arg_min(lang, doc_id) AS lang FROM h GROUP BY doc_sha256""")
def exact_dupes(read):
    rows = read("documents").select("doc_id", "lang", F.sha2("text", 256).alias("doc_sha256"))
    return rows.groupBy("doc_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("copies"), F.min_by("lang", "doc_id").alias("lang"))


@query("""SELECT d.doc_id, sha256(d.text) AS raw_sha256, d.lang, d.source || '/' || d.doc_id || '.txt' AS source_path, 'text/plain' AS source_mime, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def manifest_join(read):
    """Documents with their outcome: a left join whose right side must have unique keys."""
    docs = read("documents").select("doc_id", F.sha2("text", 256).alias("raw_sha256"), "lang", F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("source_path"))
    joined = docs.join(c.unique_key(read("labels"), "doc_id"), "doc_id", "left")
    return joined.select("doc_id", "raw_sha256", "lang", "source_path", c.mime_type(F.col("source_path")).alias("source_mime"), "quality", "toxic")


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - 128) / 108))::BIGINT + 1)) AS chunk FROM w WHERE len(w) > 0)
SELECT doc_id, chunk::INT AS chunk, md5(array_to_string(w[chunk * 108 + 1:chunk * 108 + 128], ' ')) AS text_md5 FROM s""")
def chunk_windows(read):
    """Windows of 128 words that overlap by 20."""
    return c.word_windows(read("documents"), 128, 108).select("doc_id", "chunk", F.md5("text").alias("text_md5"))


@query()
def chunk_docs(read):
    """Chunks cut at paragraphs, sentences, clauses or words; the rule is recursive, so there is no SQL."""
    return c.chunk_documents(read("documents"), separator="\n").select("doc_id", "chunk", "chunk_id", F.length("text").alias("chars"), t.sha_fingerprint("text").alias("fingerprint"))




@query("""WITH k AS (SELECT doc_id, unnest([0, 1, 2]) AS chunk FROM documents),
h AS (SELECT doc_id, chunk, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(doc_id || chr(0) || chunk)) AS h FROM k)
SELECT doc_id, chunk, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (strpos('0123456789abcdef', h[17]) - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS chunk_id FROM h""")
def chunk_ids(read):
    """Stable UUIDs for the first three chunk numbers of every document."""
    rows = read("documents").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("chunk"))
    return rows.select("doc_id", "chunk", c.chunk_id("doc_id", "chunk").alias("chunk_id"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - 128) / 108))::BIGINT + 1)) AS chunk FROM w WHERE len(w) > 0),
c AS (SELECT doc_id, array_to_string(w[chunk * 108 + 1:chunk * 108 + 128], ' ') AS t FROM s)
SELECT doc_id, count(*) AS chunks, count(*) FILTER (length(t) >= 300 AND NOT regexp_matches(lower(t), 'https?://|www\\.|©|isbn') AND len(regexp_extract_all(t, '\\p{Latin}')) >= 0.3 * length(t) AND len(regexp_extract_all(t, '[0-9]')) <= 0.25 * length(t)) AS good FROM c GROUP BY doc_id""")
def good_chunks(read):
    rows = c.word_windows(read("documents"), 128, 108)
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(c.good_chunk("text", 300)).alias("good"))


@query(f"""WITH {_LINES}, f AS (SELECT DISTINCT doc_id, 'sha256:' || sha256(line) AS fp FROM ln WHERE line <> ''),
g AS (SELECT DISTINCT 'sha256:' || sha256({_STRIP.format('text')}) AS fp FROM benchmark),
u AS (SELECT fp FROM g UNION SELECT fp FROM f GROUP BY fp HAVING count(*) > 1)
SELECT doc_id, count(*) AS fresh FROM f ANTI JOIN u USING (fp) GROUP BY doc_id""")
def holdout_exclude(read):
    """Lines that are neither a benchmark item nor in any other document: an anti join with a union of fingerprints."""
    own = c.exploded_lines(read("documents")).where("line <> ''").select("doc_id", t.sha_fingerprint("line").alias("fp")).distinct()
    gold = read("benchmark").select(t.sha_fingerprint("text").alias("fp"))
    used = gold.union(own.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")).distinct()
    return own.join(used, "fp", "left_anti").groupBy("doc_id").agg(F.count("*").alias("fresh"))


_NORM = "regexp_replace(regexp_replace(replace(lower({}), 'ё', 'е'), '[\\s\\x{{00a0}}]+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\p{{M}} ]', '', 'g')"


@query(f"""WITH d AS (SELECT doc_id, {_NORM.format(_STRIP.format('text'))} AS t FROM documents), b AS (SELECT item_id, {_NORM.format(_STRIP.format('text'))} AS q FROM benchmark)
SELECT item_id, count(doc_id) AS docs, min(doc_id) AS first_doc FROM b LEFT JOIN d ON q <> '' AND contains(t, q) GROUP BY item_id""")
def quote_in_context(read):
    """Documents that quote each item, after normalisation: one scan, in which no word or n-gram becomes a row."""
    items = read("benchmark").select("item_id", t.normalize_quote(t.nfkc("text")).alias("q"))
    pairs = c.quoting(read("documents").select("doc_id", t.normalize_quote(t.nfkc("text")).alias("t")), items)
    counts = pairs.groupBy("item_id").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))
    return read("benchmark").select("item_id").join(counts, "item_id", "left").select("item_id", F.coalesce("docs", F.lit(0)).alias("docs"), "first_doc")


def _reply_pairs(read):
    w = Window.partitionBy("conv_id").orderBy("turn")
    tokens = lambda x: F.regexp_extract_all(F.lower(x), F.lit("([0-9]+|[a-zа-яё]+)"), 1)
    rows = read("conversations").select("conv_id", "turn", "role", "text", F.lag("role").over(w).alias("before"), F.lag("text").over(w).alias("asked"))
    return rows.where("role = 'assistant' and before = 'user'").select("conv_id", "turn", "text", "asked", tokens("text").alias("p"), tokens("asked").alias("r"))


@query("""WITH l AS (SELECT conv_id, turn, role, text, lag(role) OVER w AS br, lag(text) OVER w AS bt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
x AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[0-9]+|[a-zа-яё]+') AS p, regexp_extract_all(lower(bt), '[0-9]+|[a-zа-яё]+') AS r FROM l WHERE role = 'assistant' AND br = 'user'),
p1 AS (SELECT conv_id, turn, unnest(p) AS g FROM x), r1 AS (SELECT conv_id, turn, unnest(r) AS g FROM x),
p2 AS (SELECT conv_id, turn, unnest(list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1])) AS g FROM x), r2 AS (SELECT conv_id, turn, unnest(list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1])) AS g FROM x),
c1 AS (SELECT conv_id, turn, sum(least(b.n, coalesce(a.n, 0))) / sum(b.n) AS v FROM (SELECT conv_id, turn, g, count(*) AS n FROM r1 GROUP BY ALL) b LEFT JOIN (SELECT conv_id, turn, g, count(*) AS n FROM p1 GROUP BY ALL) a USING (conv_id, turn, g) GROUP BY ALL),
c2 AS (SELECT conv_id, turn, sum(least(b.n, coalesce(a.n, 0))) / sum(b.n) AS v FROM (SELECT conv_id, turn, g, count(*) AS n FROM r2 GROUP BY ALL) b LEFT JOIN (SELECT conv_id, turn, g, count(*) AS n FROM p2 GROUP BY ALL) a USING (conv_id, turn, g) GROUP BY ALL)
SELECT conv_id, turn, round(coalesce(c1.v, 0), 6) AS rouge1, round(coalesce(c2.v, 0), 6) AS rouge2 FROM x LEFT JOIN c1 USING (conv_id, turn) LEFT JOIN c2 USING (conv_id, turn)""")
def rouge_scores(read):
    """ROUGE-1 and ROUGE-2 recall of each answer against the question before it."""
    pairs = _reply_pairs(read)
    key = ["conv_id", "turn"]
    one, two = (m.rouge_recall(pairs, n, key, "p", "r").withColumnRenamed("rouge", f"rouge{n}") for n in (1, 2))
    return one.join(two, key).select(*key, F.round("rouge1", 6).alias("rouge1"), F.round("rouge2", 6).alias("rouge2"))


@query()
def rouge_l(read):
    """ROUGE-L F1: a dynamic programme, so there is no SQL."""
    return _reply_pairs(read).select("conv_id", "turn", F.round(u.rouge_l("p", "r"), 6).alias("rouge_l"))


@query()
def chrfpp(read):
    return _reply_pairs(read).select("conv_id", "turn", F.round(u.chrf_pp("text", "asked"), 6).alias("chrfpp"))


@query("SELECT doc_id, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS rank FROM documents) WHERE rank <= 100")
def dialog_sample(read):
    """A seeded sample of 100 documents, by hash: the sampling operator."""
    top = read("documents").select("doc_id", F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string"))).alias("h")).orderBy("h", "doc_id").limit(100)
    return top.select("doc_id", F.row_number().over(Window.orderBy("h", "doc_id")).alias("rank"))

"""Evaluation sets: tolerant parsing, validation, hold-out and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as p
from ..functions import text as t


def parse_reply(c: Column | str) -> Column:
    """A generator's reply as struct(skip, skip_reason, question, ground_truths, evidence_quote); null if unreadable."""
    body = t.json_body(c)
    j = F.from_json(body, "skip boolean, skip_reason string, question string, ground_truths array<string>, reference string, reference_answer string, evidence_quote string")
    one = F.coalesce(j["reference"], j["reference_answer"])
    truths = F.coalesce(F.when(F.size(j["ground_truths"]) > 0, F.slice(j["ground_truths"], 1, 2)), F.when(one.isNotNull(), F.array(one)))
    return F.when(j.isNotNull(), F.struct(j["skip"].alias("skip"), j["skip_reason"].alias("skip_reason"), j["question"].alias("question"), truths.alias("ground_truths"), j["evidence_quote"].alias("evidence_quote")))


def judge_score(c: Column | str) -> Column:
    """An integer from 1 to 5 in a judge's reply, else null."""
    body = F.coalesce(t.json_body(c), F.lit("{}"))
    raw = F.get_json_object(body, "$.score")
    score = F.when(raw.rlike(r"^\d$"), raw.cast("int"))
    return F.when(score.between(1, 5), score)


def title_in_question(question: Column, title: Column) -> Column:
    """The title, all of its parts, or its first part of three letters or more, in any letter case."""
    q, whole = F.lower(question), F.lower(title)
    parts = F.split(whole, r"\. ")
    return q.contains(whole) | F.forall(parts, lambda x: q.contains(x)) | ((F.length(parts[0]) >= 3) & q.contains(parts[0]))


def script_share(c: Column, letters: str = r"[Ѐ-ӿ]") -> Column:
    """Share of the script among the letters; 0 without letters."""
    n = t.letters(c)
    return F.when(n > 0, F.regexp_count(c, F.lit(letters)) / n).otherwise(0.0)


def validate(df: DataFrame, letters: str = r"[Ѐ-ӿ]", least: float = 0.3) -> DataFrame:
    """Adds ``reason``: ok, or the first rule that the record (title, question, ground_truths, quote, context) breaks."""
    norm = lambda c: t.normalize_quote(t.nfkc(c))
    numeric = F.forall("ground_truths", lambda x: x.rlike(p.java(p.BARE_NUMERIC)))
    reason = (
        F.when(F.coalesce(t.strip("question"), F.lit("")) == "", "no_question")
        .when(F.size("ground_truths") < 1, "no_truth")
        .when(~title_in_question(F.col("question"), F.col("title")), "no_title")
        .when(script_share(F.col("question"), letters) < least, "language")
        .when(F.col("question").rlike(p.java(p.FORBIDDEN)), "forbidden_words")
        .when(numeric, "bare_number")
        .when(~F.contains(norm("context"), norm("quote")) | (norm("quote") == ""), "quote_not_in_context")
        .otherwise("ok")
    )
    return df.withColumn("reason", reason)


def hold_out(chunks: DataFrame, *used: DataFrame) -> DataFrame:
    """Chunks (fingerprint, ...) whose fingerprint is in none of the used sets."""
    out = chunks
    for u in used:
        out = out.join(u.select("fingerprint").distinct(), "fingerprint", "left_anti")
    return out


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the same for the same seed: the first by a hash of the key."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def single_title_groups(chunks: DataFrame, least: int = 2) -> DataFrame:
    """(doc_id, n, title) of documents with enough chunks and exactly one title, none missing."""
    g = chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("title").alias("title"), F.max("title").alias("other"), F.count_if(F.col("title").isNull()).alias("missing"))
    return g.where((F.col("n") >= least) & (F.col("title") == F.col("other")) & (F.col("missing") == 0)).select("doc_id", "n", "title")

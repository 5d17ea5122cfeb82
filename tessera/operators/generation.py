"""Generation of evaluation sets: sampled contexts, a generator hook, fast checks, a critic hook, refills."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as p
from ..functions import text as t
from ..functions.names import numbered_ids
from . import qa
from .hooks import as_column

PARSED = "question string, ground_truths array<string>, evidence array<struct<fragment:int,quote:string>>"


def quotas(n: int, single_share: float) -> tuple[int, int]:
    """Questions on one context and on several."""
    single = round(n * single_share)
    return single, n - single


def single_contexts(chunks: DataFrame, n: int, seed: int) -> DataFrame:
    """(title, fragments, fingerprints) of n chunks (doc_id, title, text, fingerprint), by a hash of seed and text."""
    return qa.sample(chunks, "fingerprint", n, seed).select("title", F.array("text").alias("fragments"), F.array("fingerprint").alias("fingerprints"))


def multi_contexts(chunks: DataFrame, n: int, seed: int, most: int = 3) -> DataFrame:
    """The same of n documents with one title and two chunks or more: 2 to ``most`` chunks of each."""
    order = F.xxhash64("fingerprint", F.lit(seed))
    ranked = chunks.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy(order, "fingerprint"))).where(F.col("__n") <= most)
    groups = qa.sample(qa.single_title_groups(chunks), "doc_id", n, seed).select("doc_id")
    picked = F.transform(F.array_sort(F.collect_list(F.struct("__n", "text", "fingerprint"))), lambda x: F.struct(x["text"].alias("text"), x["fingerprint"].alias("fingerprint")))
    rows = ranked.join(F.broadcast(groups), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("title").alias("title"), picked.alias("c"))  # n documents
    return rows.select("title", F.col("c.text").alias("fragments"), F.col("c.fingerprint").alias("fingerprints"))


def quoting_generator(titles: pd.Series, fragments: pd.Series) -> pd.Series:
    """A stand-in for a generator: asks for the first sentence of each fragment, in the expected JSON."""
    import json
    import re

    out = []
    for title, parts in zip(titles, fragments):
        quotes = [re.split(r"(?<=[.!?])\s", x.strip())[0] for x in parts]
        reply = {"question": f"В игре {title}: что сказано?", "ground_truths": quotes[:1], "evidence": [{"fragment": i + 1, "quote": q} for i, q in enumerate(quotes)]}
        out.append(f"```json\n{json.dumps(reply, ensure_ascii=False)}\n```")
    return pd.Series(out)


def accepting_critic(titles: pd.Series, questions: pd.Series) -> pd.Series:
    """A stand-in for a critic: rejects questions that don't name the title."""
    return pd.Series(["" if (a or "").lower() in (q or "").lower() else "no title" for a, q in zip(titles, questions)])


def generate(contexts: DataFrame, generator: Callable = quoting_generator) -> DataFrame:
    """contexts with question, ground_truths and evidence as parsed from the replies; null if unreadable."""
    reply = as_column(generator, T.StringType())("title", "fragments")
    parsed = F.from_json(t.json_body(F.col("reply")), PARSED)
    return contexts.withColumn("reply", reply).withColumn("r", parsed).select(*contexts.columns, "r.*")


def with_title(question: Column, title: Column) -> Column:
    """The question, with the title put before it if it doesn't name it."""
    q = t.strip(question)
    return F.when(qa.title_in_question(q, title), q).otherwise(t.strip(F.concat(F.lit("В игре "), title, F.lit(" "), q)))


def _norm(c: Column) -> Column:
    return t.normalize_quote(t.nfkc(c))


def validate_evidence(df: DataFrame, letters: str = r"[Ѐ-ӿ]", least: float = 0.3, forbidden: str | None = p.FORBIDDEN) -> DataFrame:
    """df (title, question, ground_truths, evidence, fragments) with the title in the question, and ``reason``: ok or
    the first rule broken. Every fragment needs one quote that stands in it; fragment numbers count from 1."""
    rows = df.withColumn("question", with_title(F.col("question"), F.col("title")))
    normal = F.transform("fragments", lambda x: F.lower(F.regexp_replace(t.strip(x), r"(?U)\s+", " ")))
    item = lambda e, i: F.coalesce(e["fragment"], i + 1)
    quote = lambda e: F.lower(F.regexp_replace(t.strip(e["quote"]), r"(?U)\s+", " "))
    checks = F.transform(
        "evidence",
        lambda e, i: F.when(F.coalesce(t.strip(e["quote"]), F.lit("")) == "", "quote_empty")
        .when((item(e, i) < 1) | (item(e, i) > F.size("fragments")), "bad_fragment")
        .when(~F.contains(F.element_at("__normal", F.greatest(F.lit(1), F.least(item(e, i), F.size("fragments")))), quote(e)), "quote_not_in_fragment"),
    )
    words = F.lit(False) if forbidden is None else F.col("question").rlike(p.java(forbidden))
    reason = (
        F.when(qa.script_share(F.col("question"), letters) < least, "language")
        .when(words, "forbidden_words")
        .when(F.exists("ground_truths", lambda x: x.rlike(p.java(p.BARE_NUMERIC))), "bare_number")
        .when(F.coalesce(F.size("evidence"), F.lit(-1)) != F.size("fragments"), "evidence_length")
        .otherwise(F.coalesce(F.try_element_at(F.filter(checks, lambda x: x.isNotNull()), F.lit(1)), F.lit("ok")))
    )
    return rows.withColumn("__normal", normal).withColumn("reason", reason).drop("__normal")


def criticise(records: DataFrame, critic: Callable = accepting_critic) -> DataFrame:
    """records with ``verdict``: accepted, the critic's reason, or unverified without a title; none without gold."""
    said = as_column(critic, T.StringType())(F.coalesce("title", F.lit("")), "question")
    blank = F.coalesce(t.strip("title"), F.lit("")) == ""
    rows = records.where(F.size("fingerprints") > 0).withColumn("__said", said)
    return rows.withColumn("verdict", F.when(blank, "unverified").when(F.col("__said") == "", "accepted").otherwise(F.col("__said"))).drop("__said")


def critic_pass(records: DataFrame, last: int | None = None, critic: Callable = accepting_critic) -> DataFrame:
    """Records (with ``ord``) that stay: the critic sees the last ones only, all others stay as they are."""
    if last is None:
        return criticise(records, critic).where("verdict in ('accepted', 'unverified')").drop("verdict")
    end = records.agg(F.max("ord")).first()[0] or 0
    old, new = records.where(F.col("ord") <= end - last), records.where(F.col("ord") > end - last)
    return old.unionByName(criticise(new, critic).where("verdict in ('accepted', 'unverified')").drop("verdict"))


def build_set(chunks: DataFrame, n: int, single_share: float, seed: int, write: Callable[[DataFrame, str], DataFrame], rounds: int = 5, generator: Callable = quoting_generator, critic: Callable = accepting_critic) -> DataFrame:
    """Records (id, question_type, title, question, ground_truths, evidence, fingerprints): rounds of sampling, generating,
    checking and criticising until there are n, each round with another seed and without chunks used before.

    ``write(df, name)`` writes a table to shared storage and returns it as read back; it cuts each round's lineage.
    """
    names = ["id", "question_type", "title", "question", "ground_truths", "evidence", "fingerprints"]
    want, done, out = dict(zip(("single_hop", "multi_hop"), quotas(n, single_share))), {"single_hop": 0, "multi_hop": 0}, None
    free = chunks
    for k in range(rounds):
        parts = None
        for kind, pick in (("single_hop", single_contexts), ("multi_hop", multi_contexts)):
            if (left := want[kind] - done[kind]) > 0:
                got = validate_evidence(generate(pick(free, left, seed + k), generator)).where("reason = 'ok'")
                got = criticise(got, critic).where("verdict = 'accepted'").withColumn("question_type", F.lit(kind))
                parts = got if parts is None else parts.unionByName(got)
        if parts is None:
            break
        start = sum(done.values()) + 1
        new = write(parts.withColumn("id", numbered_ids(start, ["question_type", "fingerprints"])).select(*names), f"round-{k}")
        for row in new.groupBy("question_type").count().collect():  # two rows
            done[row[0]] += row[1]
        out = new if out is None else out.unionByName(new)
        free = qa.hold_out(free, new.select(F.explode("fingerprints").alias("fingerprint")))
    return out

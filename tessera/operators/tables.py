"""Catalogue operators: groups, paging, latest rows, reference counts, upserts, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


def ordered_unique(rows: DataFrame, keys: list[str], ord_: str, value: str, first: dict[str, str]) -> DataFrame:
    """keys, titles (distinct values in order of first appearance), first_ord, and the first non-null values."""
    per_value = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(ord_).alias("o"))
    titles = per_value.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", value))), lambda x: x[value]).alias("titles"))
    firsts = rows.groupBy(*keys).agg(F.min(ord_).alias("first_ord"), *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(ord_))).alias(n) for n, c in first.items()])
    return firsts.join(titles, keys, "left")


def history(rows: DataFrame, turns: int = 3, each: int = 600, total: int = 3000) -> DataFrame:
    """(conv_id, history): the last turns, clipped to ``each``, while their running total stays within ``total``."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    last = rows.select("conv_id", "turn", t.clip("text", each).alias("t"), back.alias("back")).where(F.col("back") <= turns)
    running = F.sum(F.length("t")).over(Window.partitionBy("conv_id").orderBy("turn"))
    kept = last.withColumn("running", running).where(F.col("running") <= total)
    return kept.groupBy("conv_id").agg(F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"])).alias("history"))


#: The heading of a prompt's history, its labels, and the mark of a cut text.
HISTORY_HEAD, HISTORY_LABELS, CUT = "Контекст предыдущих вопросов по этой же игре:\n", ("QUESTION", "ANSWER"), "...[обрезано]"


def qa_history(pairs: DataFrame, turns: int = 5, each: int = 500, total: int = 3000) -> DataFrame:
    """(conv_id, history) of question and answer pairs (conv_id, turn, q, a): the last ``turns`` as numbered blocks under a heading.

    Texts are stripped and cut to ``each`` characters; blocks are taken from the oldest while their lengths add up to ``total``
    at most. A conversation whose first block is too long has no history. Null texts are empty.
    """
    ask, say = HISTORY_LABELS
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    last = pairs.withColumn("back", back).where(F.col("back") <= turns)
    w = Window.partitionBy("conv_id").orderBy("turn")
    text = lambda c: t.clip(F.coalesce(c, F.lit("")), each, CUT)
    number = F.row_number().over(w).cast("string")
    block = F.concat(F.lit(ask), number, F.lit(": "), text("q"), F.lit(f"\n{say}"), number, F.lit(": "), text("a"))
    kept = last.select("conv_id", "turn", block.alias("block")).withColumn("upto", F.sum(F.length("block")).over(w)).where(F.col("upto") <= total)
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("turn", "block"))), lambda x: x["block"])
    return kept.groupBy("conv_id").agg(F.concat(F.lit(HISTORY_HEAD), F.array_join(blocks, "\n\n")).alias("history"))


def search_page(df: DataFrame, column: str, search: str | None, order: list[str], skip: int, limit: int) -> DataFrame:
    """A page of the rows whose column contains the search text (% and _ act as wildcards), with the total."""
    found = df if not search or search == "*" else df.where(F.col(column).ilike(f"%{search}%"))
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy(*order).offset(skip).limit(limit).crossJoin(F.broadcast(total))  # one row of totals


def latest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row of each key with the greatest ``by``: an aggregate with map-side combine, no sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def latest_state(log: DataFrame, key: str, state: str, by: list[str]) -> DataFrame:
    """Event log to current state: (key, state, since, changes)."""
    return log.groupBy(key).agg(F.max_by(state, F.struct(*by)).alias("state"), F.max(by[0]).alias("since"), F.count("*").alias("changes"))


def first_keys(df: DataFrame, key: str, ord_: str, n: int) -> DataFrame:
    """All rows of the n keys that appear first."""
    keys = df.groupBy(key).agg(F.min(ord_).alias("__first")).orderBy("__first", key).limit(n).select(key)
    return df.join(F.broadcast(keys), key, "left_semi")  # n rows


def refcounts(owners: DataFrame, owner: str, refs: DataFrame, ref: str, by: str) -> DataFrame:
    """(owner, refs, orphan): distinct users of each owner; orphans have none."""
    counts = refs.groupBy(F.col(ref).alias(owner)).agg(F.count_distinct(by).alias("refs"))
    return owners.select(owner).join(counts, owner, "left").select(owner, F.coalesce("refs", F.lit(0)).alias("refs"), F.col("refs").isNull().alias("orphan"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows without the keys of new ones, and the new ones."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def overlay(old: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows with the values of ``changes`` (same keys, unique) where these aren't null."""
    names = [c for c in changes.columns if c not in keys]
    renamed = changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in names])
    joined = old.join(renamed, keys, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in names else F.col(c) for c in old.columns])


def get_or_create(existing: DataFrame, wanted: DataFrame, title: str) -> DataFrame:
    """Rows of ``wanted`` whose title isn't there yet, ignoring case; one of each."""
    key = F.lower(t.strip(title))
    new = wanted.withColumn("__k", key).dropDuplicates(["__k"])
    return new.join(existing.select(key.alias("__k")).distinct(), "__k", "left_anti").drop("__k")


def delete_cascade(parents: DataFrame, children: DataFrame, key: str, foreign: str, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the rows of the keys in ``gone`` (column key)."""
    ids = gone.select(key).distinct()
    return parents.join(ids, key, "left_anti"), children.join(ids.withColumnRenamed(key, foreign), foreign, "left_anti")


def set_sizes(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: both, only_left, only_right, left, right (distinct keys k), from one pass over each side."""
    tagged = left.select("k", F.lit(1).alias("s")).unionByName(right.select("k", F.lit(2).alias("s")))
    seen = tagged.where("k is not null").groupBy("k").agg(F.bit_or("s").alias("s"))
    return seen.agg(
        F.count_if(F.col("s") == 3).alias("both"), F.count_if(F.col("s") == 1).alias("only_left"), F.count_if(F.col("s") == 2).alias("only_right"), F.count_if(F.col("s") != 2).alias("left"), F.count_if(F.col("s") != 1).alias("right")
    )

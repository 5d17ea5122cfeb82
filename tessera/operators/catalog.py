"""Changes of catalogue tables with their rules, as transforms from a table to its next version.

A rule that is broken raises ``RuleError`` before anything is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .reports import missing_columns
from .tables import delete_cascade, get_or_create

OPEN = ("pending", "processing")


class RuleError(ValueError):
    """A change that the catalogue's rules forbid."""


def find(df: DataFrame, **keys) -> DataFrame:
    """The rows whose columns have the given values; the filter reaches the scan."""
    for k, v in keys.items():
        df = df.where(F.col(k) == v)
    return df


def title_key(c: Column | str) -> Column:
    return F.lower(t.strip(c))


def insert_unique(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """df and the new rows; titles that are there already, or twice among the new ones, break a rule."""
    k = title_key(key)
    twice = new.groupBy(k.alias("k")).agg(F.count("*").alias("n")).where("n > 1").select("k")
    there = df.select(k.alias("k")).join(F.broadcast(new.select(k.alias("k"))), "k", "left_semi")  # an insert's rows
    if not twice.unionByName(there).isEmpty():
        raise RuleError(f"{key} must be unique")
    return df.unionByName(new)


def insert_document(documents: DataFrame, new: DataFrame) -> DataFrame:
    """New documents wait to be processed."""
    return documents.unionByName(new.withColumn("status", F.lit("pending")))


def refuse_open(documents: DataFrame, game: Column) -> None:
    if not documents.where(game & F.col("status").isin(*OPEN)).isEmpty():
        raise RuleError("a document of the game is being processed")


def upload(documents: DataFrame, game_id: int, new: DataFrame) -> DataFrame:
    """The game's document is replaced by the new one, unless the old one is being processed."""
    refuse_open(documents, F.col("game_id") == game_id)
    return insert_document(documents.where(F.col("game_id") != game_id), new.withColumn("game_id", F.lit(game_id).cast("long")))


def check_file(name: str, content: bytes, allowed: tuple[str, ...] = ("pdf", "txt")) -> None:
    if name.rpartition(".")[2].lower() not in allowed or not content:
        raise RuleError("a file that isn't empty, of one of the types " + ", ".join(allowed))


def create_with_document(games: DataFrame, documents: DataFrame, game: DataFrame, document: DataFrame, name: str, content: bytes) -> tuple[DataFrame, DataFrame]:
    check_file(name, content)
    created = insert_unique(games, game, "title")
    return created, upload(documents, game.first()["game_id"], document)


def delete_game(games: DataFrame, documents: DataFrame, game_id: int) -> tuple[DataFrame, DataFrame]:
    """Both tables without the game, unless a document of it is being processed."""
    refuse_open(documents, F.col("game_id") == game_id)
    left, rest = delete_cascade(games, documents, "game_id", "game_id", find(games, game_id=game_id))
    return left.select(games.columns), rest.select(documents.columns)


def emptied(*tables: DataFrame) -> tuple[DataFrame, ...]:
    """The tables without their rows, to be written over them."""
    return tuple(df.limit(0) for df in tables)


def game_documents(games: DataFrame, documents: DataFrame, game_id: int) -> DataFrame:
    if find(games, game_id=game_id).isEmpty():
        raise RuleError("no such game")
    return find(documents, game_id=game_id)


def delete_user(users: DataFrame, user_id: int) -> DataFrame:
    """Without the user; the last administrator stays."""
    if find(users, user_id=user_id, is_admin=True).count() and users.where("is_admin").count() == 1:
        raise RuleError("the last administrator")
    return users.where(F.col("user_id") != user_id)


def page_info(total: Column, page: Column, size: int) -> Column:
    """struct(first, last, more) of a page counted from 0; first and last from 1, 0 if the page is empty."""
    skip = page * size
    there = skip < total
    first = F.when(there, skip + 1).otherwise(0)
    return F.struct(first.cast("long").alias("first"), F.when(there, F.least(total, skip + size)).otherwise(0).cast("long").alias("last"), (skip + size < total).alias("more"))


def language_conflicts(left: DataFrame, right: DataFrame, key: str, n: int = 10) -> DataFrame:
    """Up to n keys whose languages are both there and differ; a manifest is written only if there are none."""
    both = left.select(key, F.col("lang").alias("one")).join(right.select(key, F.col("lang").alias("other")), key)
    return both.where("one <> other").orderBy(key).limit(n)


def bulk_load(manifest: DataFrame, files: DataFrame, games: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(new games, documents) of a manifest (game_title, lang, text_path[, text_sha256]) whose files (path, content) exist.

    Rows with a blank title or path, a path that leaves its root, or a missing or empty file are left out; a
    digest that isn't the file's breaks a rule. With a limit only the first new titles are taken.
    """
    from .corpus import safe_path

    if lacking := missing_columns(manifest, ["game_title", "lang", "text_path"]):
        raise RuleError(f"columns are missing: {', '.join(lacking)}")
    if limit is None and not games.isEmpty():
        raise RuleError("the catalogue isn't empty")
    rows = manifest.where((F.coalesce(t.strip("game_title"), F.lit("")) != "") & (F.coalesce(t.strip("text_path"), F.lit("")) != "") & safe_path(F.col("text_path")))
    there = rows.join(files.where(F.length("content") > 0), F.col("text_path") == F.col("path")).withColumn("sha256", F.sha2("content", 256))
    if "text_sha256" in manifest.columns and not there.where((t.strip("text_sha256") != "") & (F.lower("text_sha256") != F.col("sha256"))).isEmpty():
        raise RuleError("a file isn't the one that its digest names")
    new = get_or_create(games.select("title"), there.select(F.col("game_title").alias("title")), "title").orderBy(title_key("title"))
    new = new if limit is None else new.limit(limit)
    known = games.select("title").unionByName(new).select(title_key("title").alias("__k")).distinct()
    documents = there.join(known, title_key("game_title") == F.col("__k"), "left_semi")
    return new, documents.select("game_title", "lang", "text_path", "sha256", F.decode("content", "UTF-8").alias("text"))

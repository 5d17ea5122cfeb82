"""File names, storage keys, content types, previews and roles as column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Prefixes of content-addressed objects.
SOURCES, PROCESSED = "rules/sources/by-hash/", "rules/processed/by-hash/"
#: Content types by extension; text types name their encoding.
CONTENT_TYPES = {"pdf": "application/pdf", "txt": "text/plain; charset=utf-8", "csv": "text/csv; charset=utf-8", "html": "text/html; charset=utf-8", "json": "application/json", "zip": "application/zip"}


def _extension(extension: Column, default: str) -> Column:
    return F.when(F.coalesce(extension, F.lit("")) == "", F.lit(default)).otherwise(F.lower(F.ltrim(extension, F.lit("."))))


def source_key(doc_id: Column, extension: Column) -> Column:
    return F.concat(F.lit(SOURCES), doc_id, F.lit("."), _extension(extension, "bin"))


def processed_key(doc_id: Column, extension: Column) -> Column:
    return F.concat(F.lit(PROCESSED), doc_id, F.lit("."), _extension(extension, "txt"))


def content_type(filename: Column) -> Column:
    extension = F.lower(F.regexp_extract(filename, r"\.([^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension), F.lit("application/octet-stream"))


def cut(text: Column, n: int, marker: str = "...") -> Column:
    """At most n characters, with a marker if some are cut off; empty for n of 0 or less. For logs and previews."""
    if n <= 0:
        return F.lit("")
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(marker))).otherwise(text)


def file_name_of(page_url: Column, file_url: Column) -> Column:
    """The last segment of the file's path; ``binder1.pdf`` with the path's numeric segments before it; else the
    page's last segment, or "rules", as a PDF."""
    path = lambda u: F.coalesce(F.parse_url(u, F.lit("PATH")), F.lit(""))
    parts = F.filter(F.split(path(file_url), "/"), lambda x: x != "")
    base = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    numbers = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.rlike(r"^\d+$"))
    slug = F.element_at(F.split(F.trim(path(page_url), F.lit("/")), "/"), -1)
    fallback = F.concat(F.when(slug == "", F.lit("rules")).otherwise(slug), F.lit(".pdf"))
    prefixed = F.concat(F.array_join(numbers, "_"), F.lit("_"), base)
    return F.when(base == "", fallback).when((F.lower(base) == "binder1.pdf") & (F.size(numbers) > 0), prefixed).otherwise(base)


def disposition_name(header: Column, fallback: Column) -> Column:
    """The file name of a Content-Disposition header: the encoded form, else the plain one, else the fallback."""
    star = F.regexp_extract(header, r"(?i)filename\*\s*=\s*UTF-8''([^;]+)", 1)
    plain = F.regexp_extract(header, r'(?i)filename\s*=\s*"?([^";]+)"?', 1)
    decoded = F.url_decode(F.replace(star, F.lit("+"), F.lit("%2B")))  # a plus stands for itself here
    return F.when(F.coalesce(header, F.lit("")) == "", fallback).when(star != "", decoded).when(plain != "", plain).otherwise(fallback)


def numbered_ids(start: int, by: list[str]) -> Column:
    """start, start + 1, ... in six digits, in the order of ``by``; over the rows of one accepted batch."""
    return F.lpad((F.row_number().over(Window.orderBy(*by)) + F.lit(start - 1)).cast("string"), 6, "0")


def user_role(is_admin: Column, is_moderator: Column) -> Column:
    return F.when(is_admin, "admin").when(is_moderator, "moderator").otherwise("none")


def expires_at(now: Column, minutes: int) -> Column:
    """Seconds since the epoch at which a token issued now runs out."""
    return F.unix_timestamp(now + F.make_dt_interval(mins=F.lit(minutes)))


#: Latin letters for Cyrillic ones, and for Latin ones that aren't a letter with a mark.
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e io zh z i i k l m n o p r s t u f kh ts ch sh shch - y - e iu ia".replace("-", "").split(" ")))
LATIN = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l"}
_LETTERS = str.maketrans(CYRILLIC | LATIN)


@F.pandas_udf(T.StringType())
def ascii_lower(texts: pd.Series) -> pd.Series:
    """Lower case in ASCII as far as letters have a Latin form: marks go, Cyrillic is transliterated."""

    def one(text: str | None) -> str | None:
        if text is None or text.isascii():
            return text and text.lower()
        plain = unicodedata.normalize("NFC", text).lower().translate(_LETTERS)
        return "".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c))

    return texts.map(one)


def slug(text: Column) -> Column:
    """Runs of a-z and 0-9 joined by underscores, none at the ends; a comma between digits goes."""
    plain = F.regexp_replace(ascii_lower(text), "(?<=[0-9]),(?=[0-9])", "")
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def source_filename(title: Column, extension: Column | str, game: Column | None = None) -> Column:
    """slug_rules.extension, at most 255 characters; without a slug game_<id>, or game where there is no id."""
    kind = F.regexp_replace(F.lower(F.lit(extension) if isinstance(extension, str) else extension), r"^\.+", "")
    tail = F.concat(F.lit("_rules."), F.coalesce(F.nullif(kind, F.lit("")), F.lit("bin")))
    named = F.concat(F.lit("game_"), game.cast("string")) if game is not None else F.lit(None).cast("string")
    base = F.coalesce(F.nullif(slug(F.coalesce(title, F.lit(""))), F.lit("")), named, F.lit("game"))
    return F.concat(F.substr(base, F.lit(1), F.greatest(F.lit(1), F.lit(255) - F.length(tail))), tail)

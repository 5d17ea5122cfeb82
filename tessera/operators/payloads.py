"""Nested payloads: metadata of vector points, gold contexts, task arguments and row constraints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.names import cut

METADATA = ("game_titles", "lang", "source_doc_id")


def _filled(m: Column) -> Column:
    return F.when(F.size(m) > 0, m)


def metadata(*maps: Column, flat: dict[str, Column]) -> Column:
    """The first map (string to string) that has entries, without nulls, and over it the flat values that aren't null."""
    base = F.map_filter(F.coalesce(*map(_filled, maps), F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    names = [F.lit(k) for k in flat]
    own = F.map_filter(F.map_from_arrays(F.array(*names), F.array(*flat.values())), lambda k, v: v.isNotNull())
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k)), own)


def titles(c: Column) -> Column:
    """A title as a list; none if it is blank or missing."""
    return F.when(F.coalesce(t.strip(c), F.lit("")) != "", F.array(c)).otherwise(F.array().cast("array<string>"))


def first_title(c: Column) -> Column:
    return F.try_element_at(F.filter(F.transform(c, t.strip), lambda x: x != ""), F.lit(1))


def lang(nested: Column, flat: Column) -> Column:
    """The nested language, else the flat one, trimmed and in lower case; null if blank."""
    clean = lambda c: F.nullif(F.lower(t.strip(c)), F.lit(""))
    return F.coalesce(clean(nested), clean(flat))


def has_document(flat: Column, nested: Column, document: Column) -> Column:
    return F.coalesce(F.coalesce(flat, nested).cast("string") == document.cast("string"), F.lit(False))


def gold_context(text: Column, titles_: Column, lang_: Column, document: Column) -> Column:
    """struct(text, fingerprint, metadata) of a chunk, with the three metadata keys that are kept."""
    meta = F.struct(titles_.alias("game_titles"), lang_.alias("lang"), document.alias("source_doc_id"))
    return F.struct(text.alias("text"), t.sha_fingerprint(text).alias("fingerprint"), meta.alias("metadata"))


def games(contexts: Column) -> Column:
    """The distinct titles of all contexts, in order."""
    return F.array_distinct(F.flatten(F.transform(contexts, lambda g: g["metadata"]["game_titles"])))


def result(text: Column, title: Column, language: Column, score: Column) -> Column:
    """One retrieved passage with defaults for what is missing."""
    return F.struct(F.coalesce(text, F.lit("")).alias("text"), titles(title).alias("game_titles"), F.coalesce(language, F.lit("")).alias("lang"), F.coalesce(score, F.lit(0.0)).alias("score"))


def sanitized(kwargs: Column, secret: str = "content_base64") -> Column:
    """The arguments without the value of one key."""
    return F.transform_values(kwargs, lambda k, v: F.when(k == secret, F.lit("<omitted>")).otherwise(v))


def snapshot(value: Column, n: int = 4000) -> Column:
    return cut(F.to_json(value), n, "…")


def error_text(traceback: Column, message: Column, n: int = 8000) -> Column:
    return cut(F.coalesce(traceback, message, F.lit("unknown error")), n, "…")


def task_id(own: Column, request: Column) -> Column:
    return F.coalesce(F.nullif(own, F.lit("")), request).cast("string")


def related_entity(task: Column, args: Column, context: Column) -> Column:
    """struct(kind, id): a batch task by the size of its first argument (JSON array), a document task by its first
    argument, else the job context (JSON object)."""
    first = F.get_json_object(args, "$[0]")
    size = F.json_array_length(first)
    number = F.try_to_number(first, F.lit("9999999999999999999")).cast("long")
    kind, id_ = F.get_json_object(context, "$.kind"), F.get_json_object(context, "$.id").try_cast("long")
    pair = lambda k, i: F.struct(k.cast("string").alias("kind"), i.cast("long").alias("id"))
    none = pair(F.lit(None), F.lit(None))
    return (
        F.when(task.contains("process_manifest_index_batch") & (size > 0), pair(F.lit("manifest_index_batch"), size))
        .when(task.contains("process_rules_document") & first.isNotNull(), F.when(number.isNotNull(), pair(F.lit("rules_document"), number)).otherwise(none))
        .when(kind.isNotNull() & id_.isNotNull(), pair(kind, id_))
        .otherwise(none)
    )


def task_title(kind: Column, id_: Column, title: Column) -> Column:
    """What the task list shows: batches by their number of documents."""
    return F.when((kind == "manifest_index_batch") & id_.isNotNull(), F.format_string("Манифест (%d документов)", id_)).otherwise(title)


def skip_or_answer(skip: Column, reason: Column, question: Column, truths: Column, quote: Column) -> Column:
    """Whether a generated record is whole: a skip has its reason, all others question, truths and quote."""
    there = lambda c: F.coalesce(t.strip(c), F.lit("")) != ""
    return F.when(F.coalesce(skip, F.lit(False)), there(reason)).otherwise(there(question) & (F.coalesce(F.size(truths), F.lit(0)) > 0) & there(quote))


def parsed(question: Column, truths: Column, quote: Column, evidence: Column | None = None) -> Column:
    """One record shape for both kinds of generated questions: no quote of its own where there is evidence."""
    empty = F.array().cast("array<struct<fragment:int,quote:string>>")
    return F.struct(
        t.strip(question).alias("question"), F.slice(F.coalesce(truths, F.array().cast("array<string>")), 1, 2).alias("ground_truths"),
        (F.lit("") if evidence is not None else F.coalesce(quote, F.lit(""))).alias("evidence_quote"), (F.coalesce(evidence, empty) if evidence is not None else empty).alias("evidence"),
    )

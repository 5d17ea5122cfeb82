"""Ranked lexical search over a tiered index: postings of high impact first, lower tiers only where proof fails.

A posting's impact is its share of a score before the term's weight. By term, the first tiers hold the postings of the
highest impacts, 1024 and 8192 at most (``TIERS``), whole impact buckets from the top; the last tier are the documents'
forward lists, which hold all postings. ``lexicon`` has each term's weight, and for each upper tier the bucket it ends at and the
*residual bound*: the greatest impact left out.

A search adds up the postings of an upper tier by item and document. A document may have more: for each term not
seen in it at most the residual. An item's result is proved exact if the bound of documents not seen at all
stays below the 20th best sum; then only documents whose bound reaches that sum are scored in full, by their forward
lists. Items without this proof fall through to the next tier. The last one is a scan: each task adds up
its documents' lists for a block of items and keeps the best of each item, so that nothing is joined and no term is hot.

All scores are integers. Bounds: upper tiers hold a fixed number of postings a term, so a hot term or a large group of
equal texts can't swell them (equal impacts that don't fit stay below, and the bound is theirs). Words outside the
items are left out while tokenising, if the items have at most ``VOCABULARY`` terms, which are broadcast then; else a
join leaves them out. The scan takes items in blocks of ``BLOCK``, with at most ``PAIRS`` terms unless one item has more.

Defined results: null and empty texts have no terms, are no documents to N and are never found; rows that share a
doc_id, or have none, are documents of their own (null doc_ids rank last among equals); rows of items that share an
item_id are items of their own; items without terms, or whose terms no document has, give no rows; ties go to the
smaller doc_id; empty tables give no rows; other columns are not read; texts of any length count whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, as_bytes, int64, key_columns, key_filter, may_be_in, partitions, slices

#: Postings of a term in the upper tiers at most.
TIERS = (1024, 8192)
#: Bits of an impact below a bucket.
BUCKET = 8
#: Terms of items that are broadcast; items and their terms in a block of the last tier's scan.
VOCABULARY, BLOCK, PAIRS = 1 << 20, 2048, 1 << 20
#: Bytes of a text that are cut into words at once.
SLICE = 4 << 20
#: Bytes to words: A-Z in lower case, digits and whatever isn't ASCII; all other bytes part words.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, some megabytes at a time."""
    plain, at = text.translate(WORDS), 0
    while at < len(plain):
        end = plain.find(b" ", at + SLICE) if len(plain) - at > SLICE else -1
        end = len(plain) if end < 0 else end
        yield (plain if at == 0 and end == len(plain) else plain[at:end]).split()
        at = end


def forward_lists(rows: DataFrame, ids: list[str], vocabulary: DataFrame | None = None) -> DataFrame:
    """ids, n (all words), terms, tfs (distinct words and how often; only those of the vocabulary, if given)."""
    spark = rows.sparkSession
    known = None if vocabulary is None else [bytes(x) for x in vocabulary.select(F.col("term").cast("binary")).toArrow().column(0).to_pylist()]
    shared = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None if shared.value is None else {w: i for i, w in enumerate(shared.value)}
        names = None if index is None else pa.array([w.decode() for w in shared.value], pa.string())
        for batch in batches:
            sizes, ends, terms, tfs = [], [0], [], []
            for text in as_bytes(batch.column("text")):
                found, n = Counter(), 0
                for part in words(text):
                    n += len(part)
                    found.update(part if index is None else map(index.get, part))
                found.pop(None, None)
                terms += found
                tfs += found.values()
                sizes.append(n)
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            values = pa.array([w.decode() for w in terms], pa.string()) if names is None else names.take(pa.array(terms, pa.int64()))
            lists = [pa.ListArray.from_arrays(offsets, values), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ids], int64(sizes), *lists], [*ids, "n", "terms", "tfs"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ids)
    return rows.select(*ids, "text").mapInArrow(run, f"{schema}, n long, terms array<string>, tfs array<int>")


@dataclass
class Index:
    """forward (rid, doc_id, m, terms, tfs), lexicon (term, df, w, cuts, residuals), postings (tier, term, rid, impact)."""

    forward: DataFrame
    lexicon: DataFrame
    postings: DataFrame
    tiers: tuple[int, ...]


#: An impact, by tf and the document's m.
IMPACT = "(1000000000L * {tf}) div (1000L * {tf} + 12L * {m})"


def build_index(docs: DataFrame, stage: Stage, vocabulary: DataFrame | None = None, tiers: tuple[int, ...] = TIERS) -> Index:
    """Writes the index of documents (doc_id, text). vocabulary (term): the only terms to be searched for."""
    few = None
    if vocabulary is not None:
        vocabulary = stage.write(vocabulary.distinct(), "vocabulary")
        few = vocabulary if vocabulary.count() <= VOCABULARY else None
    rows = key_columns(docs, ["doc_id", "text"]).withColumn("rid", F.monotonically_increasing_id())
    lists = stage.write(forward_lists(rows, ["rid", "doc_id"], few), "forward")
    n_docs, n_words = lists.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    forward = lists.selectExpr("rid", "doc_id", f"100L - 25L + (25L * n * {n_docs}L) div {n_words or 1}L as m", "terms", "tfs").where("size(terms) > 0")
    entries = forward.selectExpr("rid", "m", "inline(arrays_zip(terms, tfs))").selectExpr("rid", "terms as term", f"{IMPACT.format(tf='tfs', m='m')} as impact")
    if vocabulary is not None and few is None:
        entries = entries.join(vocabulary, "term", "left_semi")
    # at most 4000 buckets a term
    buckets = entries.groupBy("term", F.expr(f"cast(shiftright(impact, {BUCKET}) as int)").alias("bucket")).agg(F.count("*").alias("n"), F.max("impact").alias("best"))
    so_far = buckets.withColumn("upto", F.sum("n").over(Window.partitionBy("term").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)))
    inside = [F.col("upto") <= size for size in tiers]
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.sum("n") + 1).cast("double"))).cast("long")
    cuts = F.array(*[F.coalesce(F.min(F.when(x, F.col("bucket"))), F.lit(1 << 30)) for x in inside])
    residuals = F.array(*[F.coalesce(F.max(F.when(~x, F.col("best"))), F.lit(0)) for x in inside])
    lexicon = stage.write(so_far.groupBy("term").agg(F.sum("n").alias("df"), weight.alias("w"), cuts.alias("cuts"), residuals.alias("residuals")), "lexicon")
    of_term = lexicon.select("term", "cuts")
    of_term = F.broadcast(of_term) if few is not None else of_term  # no more rows than the vocabulary
    place = F.expr(f"array_position(transform(cuts, c -> shiftright(impact, {BUCKET}) >= c), true)").cast("int")
    upper = entries.join(of_term, "term").withColumn("tier", place).where("tier > 0").select("tier", "term", "rid", "impact")
    n = partitions(stage.spark)
    # a term's postings lie together, so that a search reads the row groups of its terms
    postings = stage.write(upper.repartitionByRange(n, "term", "tier").sortWithinPartitions("term", "tier"), "postings")
    return Index(forward, lexicon, postings, tiers)


def item_terms(items: DataFrame) -> DataFrame:
    """(qid, term, times) of items (qid, text)."""
    return forward_lists(items, ["qid"]).selectExpr("qid", "inline(arrays_zip(terms, tfs))").withColumnsRenamed({"terms": "term", "tfs": "times"})


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "rid")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "doc_id", "score")


def _by_tier(index: Index, wanted: DataFrame, tier: int, k: int, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """(results of the items proved by the upper ``tier`` tiers, qid of the others). wanted: qid, term, weight, residuals."""
    mine = wanted.select("qid", "term", "weight", F.col("residuals")[tier - 1].alias("residual"))
    # at most TIERS[tier - 1] postings for each term of each item
    found = index.postings.where(F.col("tier") <= tier).join(mine, "term").groupBy("qid", "rid").agg(F.sum(F.col("weight") * F.col("impact")).alias("seen"), F.sum(F.col("weight") * F.col("residual")).alias("known"))
    found = stage.write(found.where("seen > 0"), f"seen_{tier}")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("seen")))).where(F.col("rank") <= k)
    least = best.where(F.col("rank") == k).select("qid", F.col("seen").alias("least"))
    bounds = mine.groupBy("qid").agg(F.sum(F.col("weight") * F.col("residual")).alias("unseen")).join(least, "qid", "left")
    bounds = stage.write(bounds.withColumn("proved", F.expr("unseen = 0 or coalesce(unseen < least, false)")), f"bounds_{tier}")
    candidates = found.join(bounds.where("proved"), "qid").where("seen + unseen - known >= coalesce(least, 1)").select("qid", "rid")
    candidates = stage.write(candidates, f"candidates_{tier}")
    lists = may_be_in(index.forward, "rid", key_filter(candidates.select(F.col("rid").alias("key"))))
    weights = wanted.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("weights"))
    score = f"aggregate(arrays_zip(terms, tfs), 0L, (a, x) -> a + coalesce(weights[x.terms], 0L) * ({IMPACT.format(tf='x.tfs', m='m')}))"
    whole = lists.join(candidates, "rid").join(weights, "qid").selectExpr("qid", "rid", "doc_id", f"{score} as score").where("score > 0")
    return _ranked(whole, k), bounds.where("not proved").select("qid")


def _scan(index: Index, wanted: DataFrame, k: int) -> DataFrame:
    """The k best documents of each item over all forward lists, one scan a block of items."""
    spark = wanted.sparkSession
    sizes = wanted.groupBy("qid").agg(F.count("*").alias("n")).orderBy("qid").toArrow()  # two numbers an item
    qids, counts = np.asarray(sizes.column("qid")), np.asarray(sizes.column("n"))
    blocks = [x for a, b in slices(counts.tolist(), PAIRS) for x in [(i, min(i + BLOCK, b)) for i in range(a, b, BLOCK)]]
    out = None
    for a, b in blocks:
        block = wanted.where(F.col("qid").between(int(qids[a]), int(qids[b - 1]))).select("qid", "term", "weight").orderBy("term").toArrow()
        shared = spark.sparkContext.broadcast((qids[a:b], block.column("term").to_pylist(), np.searchsorted(qids[a:b], np.asarray(block.column("qid"))), np.asarray(block.column("weight"))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, terms, item, weight = shared.value
            names = sorted(set(terms))
            ids = pa.array(names, pa.string())
            at = np.searchsorted(names, terms) if terms else np.zeros(0, np.int64)
            ends = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(names)))))
            none = np.iinfo(np.int64).max
            top = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(own)  # score, doc_id, rid
            for batch in batches:
                rid, m = (np.asarray(batch.column(c)) for c in ("rid", "m"))
                doc = np.asarray(batch.column("doc_id").fill_null(none))
                lists = batch.column("terms")
                row = np.repeat(np.arange(len(rid)), np.asarray(lists.value_lengths()))
                found = np.asarray(pc.index_in(lists.flatten(), ids).fill_null(-1))
                tf = np.asarray(batch.column("tfs").flatten()).astype(np.int64)[found >= 0]
                row, found = row[found >= 0], found[found >= 0]
                impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[row])
                n = ends[found + 1] - ends[found]
                pair = np.repeat(ends[found] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                scores = np.zeros((len(own), len(rid)), np.int64)
                np.add.at(scores, (item[pair], np.repeat(row, n)), weight[pair] * np.repeat(impact, n))
                for i in np.flatnonzero(scores.max(axis=1, initial=0)):
                    s, d, r = top[i]
                    here = np.flatnonzero(scores[i] >= (s[-1] if len(s) == k else 1))
                    if len(here):
                        s, d, r = np.concatenate((s, scores[i][here])), np.concatenate((d, doc[here])), np.concatenate((r, rid[here]))
                        order = np.lexsort((r, d, -s))[:k]
                        top[i] = s[order], d[order], r[order]
            lengths = [len(s) for s, _, _ in top]
            if sum(lengths):
                s, d, r = (np.concatenate(x) for x in zip(*top))
                yield pa.RecordBatch.from_arrays([int64(np.repeat(own, lengths)), int64(r), pa.array(d, mask=d == none), int64(s)], ["qid", "rid", "doc_id", "score"])

        best = index.forward.select("rid", F.col("doc_id").cast("long").alias("doc_id"), "m", "terms", "tfs").mapInArrow(run, "qid long, rid long, doc_id long, score long")
        out = best if out is None else out.unionByName(best)
    return _ranked(out, k)


def search(index: Index, terms: DataFrame, stage: Stage, k: int = 20) -> DataFrame:
    """(qid, rank, doc_id, score): the k best documents of each item. terms: (qid, term, times), written already."""
    wanted = terms.join(index.lexicon, "term").select("qid", "term", (F.col("times") * F.col("w")).cast("long").alias("weight"), "residuals")
    wanted = stage.write(wanted, "wanted")
    parts = []
    for tier in range(1, len(index.tiers) + 1):
        done, left = _by_tier(index, wanted, tier, k, stage)
        parts.append(done)
        if left.isEmpty():
            break
        wanted = stage.write(wanted.join(left, "qid", "left_semi"), f"wanted_{tier}")
    else:
        parts.append(_scan(index, wanted, k))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rank_documents(docs: DataFrame, items: DataFrame, stage: Stage, k: int = 20, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents for each item (item_id, text)."""
    rows = stage.write(key_columns(items, ["item_id", "text"]).withColumn("qid", F.monotonically_increasing_id()), "items")
    terms = stage.write(item_terms(rows), "item_terms")
    index = build_index(docs, stage, terms.select("term"), tiers)
    return search(index, terms, stage, k).join(rows.select("qid", "item_id"), "qid").select("item_id", "rank", "doc_id", "score")

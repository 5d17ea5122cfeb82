"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling.

A source's documents, in a shuffled order fixed by a hash, are cut into blocks. A source of weight w may
start its i-th block (from 0) at slot floor(i / w), its release, and must have it done by slot
ceil((i + 1) / w), its deadline. One block runs in each slot: of the released ones that with the earliest
deadline. With weights that sum to one all deadlines are met, and at every slot each source is less than one
block away from its exact share.

Weights are rounded to multiples of 1 / ``period``, so that the schedule of one period repeats (a source strays at
most half a block a period from its unrounded share). It is worked out on the driver for at most ``components``
sources and all listed ones, whatever the number of rows; blocks then find their slots by joins with it. All
other sources are one component, of the sum of their weights. In it a source of weight w has its i-th row at the
time (i + u) / w, where u is a fraction fixed by a hash of the source, and rows go by time: each source keeps its
own weight, however many there are. When a source runs out, the others share its weight from that slot on, so
every document appears exactly once; sources of weight zero come after all others. Only DataFrame functions
touch the rows.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions

#: The columns that a schedule adds.
ADDED = ("component", "block", "place", "phase", "release", "deadline", "slot", "position")


@dataclass(frozen=True)
class MixConfig:
    """weights: target weight of each source; sources not named share ``rest``. None: the power ``temperature``
    of each source's number of documents; so do those not named share ``rest``. components: most components,
    unless more sources are listed; the smaller sources are one component together. block: documents in a block. bucket: rows that are numbered in one task.
    """

    weights: tuple[tuple[str | None, float], ...] | None = None
    rest: float = 0.0
    temperature: float = 0.5
    components: int = 64
    block: int = 32
    period: int = 16_384
    bucket: int = 4_000
    seed: int = 11


def edf(shares: dict[int, int], period: int, slots: int | None = None) -> list[tuple[int, int]]:
    """(component, block) for the first slots of a period (None: all); the shares are whole numbers that add up to it."""
    waiting = [(0, -(-period // a), c, 0) for c, a in shares.items()]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(period if slots is None else min(slots, period)):
        while waiting and waiting[0][0] <= slot:
            _, deadline, c, i = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, c, i))
        deadline, c, i = heapq.heappop(ready)
        assert slot < deadline
        out.append((c, i))
        if i + 1 < shares[c]:
            heapq.heappush(waiting, ((i + 1) * period // shares[c], -(-(i + 2) * period // shares[c]), c, i + 1))
    return out


def whole_shares(weights: dict[int, float], period: int) -> dict[int, int]:
    """Shares of the period, at least one each, nearest to the weights."""
    total = sum(weights.values())
    exact = {c: w / total * period for c, w in weights.items()}
    shares = {c: max(1, int(x)) for c, x in exact.items()}
    while (left := period - sum(shares.values())) != 0:
        step = 1 if left > 0 else -1
        open_ = [c for c in shares if step > 0 or shares[c] > 1]
        for c in sorted(open_, key=lambda c: (step * (shares[c] - exact[c]), c))[: abs(left)]:
            shares[c] += step
    return shares


def plan(blocks: dict[int, int], weights: dict[int, float], period: int) -> tuple[list[tuple], list[tuple]]:
    """Phases (component, phase, first block, blocks, first slot, share) and slots (component, phase, block in
    the period, slot in the period). A phase ends when a component has run out of blocks."""
    left, at, first = dict(blocks), 0, dict.fromkeys(blocks, 0)
    phases, slots = [], []
    phase = 0
    while open_ := {c: weights[c] for c, n in left.items() if n}:
        active = {c: w for c, w in open_.items() if w > 0} or dict.fromkeys(open_, 1.0)
        shares = whole_shares(active, period)
        table: dict[int, list[int]] = {c: [] for c in active}
        for slot, (c, _) in enumerate(edf(shares, period, sum(left[c] for c in active))):
            table[c].append(slot)
        # a component that the slots worked out don't reach the end of can't be the first to run out
        ends = [(left[c] - 1) // shares[c] * period + table[c][(left[c] - 1) % shares[c]] for c in active if (left[c] - 1) % shares[c] < len(table[c])]
        end = min(ends) + 1
        for c in active:
            used = end // period * shares[c] + sum(s < end % period for s in table[c])
            if used:
                phases.append((c, phase, first[c], used, at, shares[c]))
                slots += [(c, phase, j, s) for j, s in enumerate(table[c][:used])]
            left[c] -= used
            first[c] += used
        at += end
        phase += 1
    return phases, slots


def schedule(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The columns of docs and component, block, place (in the block), phase, release, deadline, slot and
    position (slot * block + place; the order of the mixture). A column of docs by one of these names is left out.

    A null or empty source is a source like any other; texts of any length, null or empty, are only carried along.
    Rows that repeat doc_id, and rows without one, are scheduled one by one; among them the order is by a hash of
    the text, if docs has it. Sources of equal size go by name. An empty table gives no rows.
    """
    return _scheduled(docs, config)[0]


def _scheduled(docs: DataFrame, config: MixConfig) -> tuple[DataFrame, int]:
    """The schedule, and a bound of its positions."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if c.lower() not in ADDED]
    counted = docs.groupBy(F.col("source").alias("source")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("source"))
    listed = dict(config.weights) if config.weights is not None else None
    if listed is None:
        own = counted.limit(config.components - 1).collect()
    else:  # as many rows as are listed
        wanted = spark.createDataFrame([(s,) for s in listed], "listed string")
        own = counted.join(F.broadcast(wanted), F.col("source").eqNullSafe(F.col("listed")), "left_semi").orderBy(F.desc("n"), F.asc_nulls_last("source")).collect()
    total, powers = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.pow("n", F.lit(config.temperature))), F.lit(0.0))).first()
    members = [(i, r.source, r.n) for i, r in enumerate(own)]
    sizes = {i: n for i, _, n in members}
    weights = {i: (float(n) ** config.temperature if listed is None else listed[s]) for i, s, n in members}
    others = len(members)
    powers -= sum(float(n) ** config.temperature for n in sizes.values())
    if rest := total - sum(sizes.values()):
        sizes[others] = rest
        weights[others] = powers if listed is None else config.rest
    period = max(config.period, 4 * len(sizes))
    blocks = {c: -(-n // config.block) for c, n in sizes.items()}
    phases, slots = plan(blocks, weights, period)
    named = _local(spark, [{"component": i, "named": s} for i, s, _ in members], "component int, named string")
    fields = "first", "blocks", "start", "share"
    at: dict[tuple[int, int], list[int]] = {}
    for c, phase, _, slot in slots:  # in the order of a component's blocks
        at.setdefault((c, phase), []).append(slot)
    rows = [{"component": c, "phase": phase, **dict(zip(fields, x)), "slots": at[c, phase]} for c, phase, *x in phases]
    table = _local(spark, rows, "component int, phase int, first bigint, blocks bigint, start bigint, share int, slots array<bigint>")
    phase_table = table.groupBy("component").agg(F.collect_list(F.struct("first", "blocks", "phase", "start", "share")).alias("phases"))
    slot_table = table.select("component", "phase", F.posexplode("slots").alias("j", "at"))

    # a row travels as one struct, so that no column of docs meets a name used here
    tie = F.xxhash64("text") if "text" in names else F.lit(0).cast("long")
    own_columns = [F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col("source").alias("__source"), F.col("doc_id").alias("__id"), tie.alias("__tie")]
    base = docs.select(*own_columns).join(F.broadcast(named), F.col("__source").eqNullSafe(F.col("named")), "left").drop("named")
    base = base.withColumn("component", F.coalesce("component", F.lit(others)))
    buckets = max(1, total // config.bucket)
    numbered = _numbered(base.where(F.col("component") < others), buckets, config)
    if rest:
        numbered = numbered.unionByName(_by_weights(base.where(F.col("component") == others), counted, buckets, powers, config))
    placed = numbered.withColumn("block", F.floor(F.col("__index") / config.block)).withColumn("place", (F.col("__index") % config.block).cast("int"))
    found = placed.join(F.broadcast(phase_table), "component")
    here = F.filter("phases", lambda p: (p["first"] <= F.col("block")) & (F.col("block") < p["first"] + p["blocks"]))
    found = found.withColumn("__p", here[0]).withColumn("phase", F.col("__p.phase")).withColumn("__i", F.col("block") - F.col("__p.first"))
    found = found.withColumn("j", F.col("__i") % F.col("__p.share")).join(F.broadcast(slot_table), ["component", "phase", "j"])
    share, start, i, n = F.col("__p.share"), F.col("__p.start"), F.col("__i"), F.lit(period)
    slot = start + F.floor(i / share) * n + F.col("at")
    out = found.select(
        *[F.col(f"__row.`{c}`").alias(c) for c in names], "component", "block", "place", "phase",
        (start + _div(i * n, share)).alias("release"),
        (start + _div((i + 1) * n + share - 1, share)).alias("deadline"),
        slot.alias("slot"), (slot * config.block + F.col("place")).alias("position"),
    )
    return out, sum(blocks.values()) * config.block


def _local(spark: SparkSession, rows: list[dict], fields: str) -> DataFrame:
    """A small table from the driver, which the JVM reads by itself."""
    kind = ", ".join(f"{n}: {t}" for n, t in (f.split(" ") for f in fields.split(", ")))
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")))


def _div(a: Column, b: Column) -> Column:
    """Whole-number division of non-negative longs."""
    return ((a - a % b) / b).cast("long")


def _numbered(rows: DataFrame, buckets: int, config: MixConfig, by: str = "component") -> DataFrame:
    """__index: the row's number within its component (or another column, not null), by hash.

    Hash buckets split a component, however large, over many tasks; a small table holds the rows before each.
    """
    hashed = rows.withColumn("__h", F.xxhash64("__id", F.lit(config.seed))).withColumn("__b", F.pmod(F.shiftrightunsigned("__h", 20), F.lit(buckets)).cast("long"))
    return _ranked(hashed, by, ["__h", "__id", "__tie"]).drop("__h", "__b")


def _ranked(rows: DataFrame, by: str, order: list) -> DataFrame:
    """__index: the row's number among those of one ``by``, by the bucket __b and the order in it."""
    counts = rows.groupBy(by, "__b").agg(F.count("*").alias("n"))
    before = counts.select(by, "__b", (F.sum("n").over(Window.partitionBy(by).orderBy("__b")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy(by, "__b").orderBy(*order))
    return rows.withColumn("__local", local).join(before, [by, "__b"]).withColumn("__index", F.col("before") + F.col("__local") - 1).drop("__local", "before")


def _by_weights(rows: DataFrame, counted: DataFrame, buckets: int, powers: float, config: MixConfig) -> DataFrame:
    """__index: the row's number in the component of all other sources, each at its own weight.

    ``powers`` is the sum of the weights, so that at most about ``bucket`` rows have their time in one bucket.
    """
    name = lambda c: F.when(F.col(c).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(c).cast("string")))
    key = name("__source")
    weights = counted.select(name("source").alias("__s"), F.pow("n", F.lit(config.temperature)).alias("__w"))
    numbered = _numbered(rows.withColumn("__s", key), buckets, config, "__s").join(weights, "__s")
    offset = F.shiftrightunsigned(F.xxhash64("__s", F.lit(config.seed)), 11) / float(1 << 53)
    timed = numbered.withColumn("__t", (F.col("__index") + offset) / F.col("__w")).withColumn("__b", F.floor(F.col("__t") * powers / config.bucket))
    # rows of one source have their order by hash; a row's number in its source tells equal times apart
    ranked = _ranked(timed.withColumnRenamed("__index", "__i"), "component", ["__t", "__s", "__i"])
    return ranked.drop("__s", "__w", "__t", "__b", "__i")


def mixed(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The rows of docs in the order of the mixture: partition after partition, by position.

    Positions are dense, so that equal ranges of them are partitions of equal size; no sample is drawn. Nulls,
    ties, repeated rows and empty tables: see ``schedule``. All columns of docs come back, whatever their names.
    """
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() in ADDED}
    found, end = _scheduled(docs.withColumnsRenamed(own), config)
    n = partitions(docs.sparkSession)
    part = F.least(F.lit(n - 1), F.floor(F.col("position") * n / F.lit(max(1, end)))).cast("int")
    ordered = found.repartitionById(n, part).sortWithinPartitions("position")
    return ordered.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])

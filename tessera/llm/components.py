"""Connected components over link tables of any size, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (large: the greater ones; small: the lesser ones) to its least neighbour.

    The least neighbours are an aggregate with map-side combine; the join that deals them out is a plain
    equi-join, so that a node with very many links is split by adaptive execution.
    """
    if large:
        around = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        return around.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    down = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return joined.select(F.col("a"), F.col("m").alias("b")).unionByName(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame, stage: Stage, name: str = "components") -> DataFrame:
    """(id, root) for every node of the links (a, b): root is the least id reachable. Loops and repeats are allowed.

    Each round is written to the shared folder; it ends when a round changes nothing.
    """
    pairs = stage.write(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    state, round_ = _state(pairs), 0
    while state[0]:
        round_ += 1
        after = stage.write(_star(_star(pairs, True), False), f"{name}-{round_}")
        new = _state(after)
        stage.drop(f"{name}-{round_ - 1}")
        pairs = after
        if new == state:
            break
        state = new
    nodes = pairs.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return nodes.unionByName(pairs.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def _state(pairs: DataFrame) -> tuple:
    # the sum wraps within a decimal wide enough for any number of rows
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).collect()[0])

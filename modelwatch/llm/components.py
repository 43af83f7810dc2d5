"""Connected components of a table of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.session import materialise

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node reachable) for every linked node.

    ``links`` has two columns of numbers, a and b. Each round hangs a node's
    larger neighbours below its least one, then its smaller neighbours likewise,
    until every node hangs below its root; the number of rounds grows with the
    logarithm of the number of nodes. Minima are taken map-side, and a node with
    very many links is split by Spark's skew join. Every round is written to the
    shared folder, so a lost executor costs one round at most.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    before = _state(edges)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        # every node's larger neighbours, below the least of the node and its neighbours
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        large = materialise(large, "links")
        # every node and its smaller neighbours, below the least of them
        least = large.groupBy(F.col("a").alias("w")).agg(F.min("b").alias("m"))
        moved = large.join(least, F.col("a") == F.col("w")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = materialise(moved.union(least.select(F.col("w").alias("a"), F.col("m").alias("b"))).distinct(), "links")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no components after {MOST_ROUNDS} rounds")
    below = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return below.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Number and a checksum of the links."""
    code = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(code)).first())

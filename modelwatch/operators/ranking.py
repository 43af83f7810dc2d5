"""Newest-N, latest-per-key, running totals and ranks that stay distributed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sizing import join_small


#: Default of spark.sql.optimizer.windowGroupLimitThreshold.
_GROUP_LIMIT_ROWS = 1000


def newest(df: DataFrame, n: int, ts: str, tie: str = "id", by: Sequence[str] = ()) -> DataFrame:
    """The ``n`` newest rows, overall or per key.

    Both forms keep at most ``n`` rows per task and key before the shuffle
    (top-k, or the window group limit that Spark derives from the filter).
    """
    order = [F.col(ts).desc(), F.col(tie).desc()]
    if not by:
        return df.orderBy(*order).limit(n)
    if n > _GROUP_LIMIT_ROWS:
        # beyond the size up to which Spark limits groups before the shuffle, a
        # group is first cut to n rows in each of 256 parts
        df = df.withColumn("_part", F.pmod(F.xxhash64(tie), F.lit(256)))
        df = _first(df, n, [*by, "_part"], order).drop("_part")
    return _first(df, n, by, order)


def _first(df: DataFrame, n: int, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rn", rank).filter(F.col("_rn") <= n).drop("_rn")


def oldest(df: DataFrame, n: int, ts: str, tie: str = "id") -> DataFrame:
    return df.orderBy(F.col(ts), F.col(tie)).limit(n)


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str, tie: str | None = "id") -> DataFrame:
    """The newest whole row of every key, by partial aggregation: a task sends
    one row per key, however many it holds."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(ts, tie) if tie else F.struct(ts)
    best = F.max_by(F.struct(*rest), order).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def running_totals(
    df: DataFrame,
    order_by: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    buckets: int = 200,
) -> DataFrame:
    """Add ``cum_<c>`` and ``total_<c>``: running and overall totals in the order
    of the numeric column ``order_by``, whose values must be distinct per key.

    An ordered window without a fine partition would pass everything through
    one task.  Here value ranges (approximate quantiles) are the partitions:
    each is summed on its own and shifted by the sum of the ranges before it.
    """
    by = list(by)
    cuts = ", ".join(f"{i / buckets!r}D" for i in range(1, buckets))
    edges = df.groupBy(*by).agg(
        F.expr(f"array_distinct(percentile_approx({order_by}, array({cuts}), 1000))").alias("_edges")
    )
    ranged = join_small(df, edges, by)
    below = F.filter("_edges", lambda e: e < F.col(order_by))
    ranged = ranged.withColumn("_range", F.size(below)).drop("_edges")
    parts = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    step = F.col("_range").desc() if descending else F.col("_range").asc()
    prior = W.partitionBy(*by).orderBy(step).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    parts = parts.select(
        *by,
        "_range",
        *[F.coalesce(F.sum(f"_s_{c}").over(prior), F.lit(0)).alias(f"_base_{c}") for c in sums],
        *[F.sum(f"_s_{c}").over(whole).alias(f"total_{c}") for c in sums],
    )
    out = join_small(ranged, parts, [*by, "_range"])
    step = F.col(order_by).desc() if descending else F.col(order_by).asc()
    within = W.partitionBy(*by, "_range").orderBy(step).rowsBetween(W.unboundedPreceding, 0)
    for c in sums:
        out = out.withColumn(f"cum_{c}", F.col(f"_base_{c}") + F.sum(c).over(within))
    return out.drop("_range", *[f"_base_{c}" for c in sums])


def scatter(id_col: str | Column, seed: int) -> Column:
    """A pseudo-random bigint per id.  For one bigint and a fixed seed the hash
    is one-to-one, so distinct ids never tie."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.xxhash64(F.lit(seed), column.cast("bigint"))


def scattered_rank(df: DataFrame, id_col: str, seed: int, buckets: int = 4096) -> DataFrame:
    """Add ``rank``: a random-looking but repeatable permutation 0..n-1.

    Rows are ranked inside hash buckets (even by construction) and shifted by
    the sizes of the buckets before them.
    """
    hashed = df.withColumn("_h", scatter(id_col, seed)).withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)))
    sizes = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    prior = W.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_c").over(prior), F.lit(0)).alias("_base"))
    inside = W.partitionBy("_b").orderBy("_h")
    out = join_small(hashed, offsets, ["_b"])
    return out.withColumn("rank", F.col("_base") + F.row_number().over(inside) - 1).drop("_h", "_b", "_base")

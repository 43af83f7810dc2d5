"""Bin edges and histograms.

Quantile bins come from the reference side; equal-width bins from the joint
range.  All bins are half-open but the last, which is closed; values outside
the edges are counted as bin -1, so nothing is lost silently.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles
from .sizing import join_small, match


def to_long(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, feature); NULL and NaN values are left out."""
    wide = df.select(*keep, *[F.col(f).cast("double").alias(f) for f in features])
    long = wide.unpivot(list(keep), list(features), "feature", "value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def edge_columns(bins: int) -> list[str]:
    return [f"e{i}" for i in range(bins + 1)]


def quantile_profile(
    reference: DataFrame,
    keys: Sequence[str] = ("feature",),
    value: str = "value",
    bins: int = 10,
    method: str = "exact",
    **options,
) -> DataFrame:
    """Bin edges per key: ``n_ref``, ``n_edges``, ``e_last`` and ``e0..e<bins>``.

    Equal quantiles collapse; the freed columns are NULL.  This is the table to
    store once per promoted model, not to rebuild at every check.
    """
    return as_profile(quantiles(reference, keys, value, profile_fractions(bins), method, **options), keys, bins)


def profile_fractions(bins: int) -> list[float]:
    # Multiples of the step, not i / bins: 3 * 0.1 lies just above 0.3, which
    # can part two neighbouring values where the exact decile would be the lower.
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def as_profile(found: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """Profile columns from keys, ``n`` and the quantiles ``q``."""
    edges = F.array_sort(F.array_distinct("q"))
    found = found.select(*keys, F.col("n").alias("n_ref"), edges.alias("_e"))
    # ANSI mode raises on an index past the end, hence the guards.
    columns = [f"if(size(_e) > {i}, _e[{i}], NULL) AS {name}" for i, name in enumerate(edge_columns(bins))]
    return found.selectExpr(*keys, "n_ref", "size(_e) AS n_edges", "try_element_at(_e, -1) AS e_last", *columns)


def quantile_bin(value: str = "value", bins: int = 10, open_ends: bool = False) -> Column:
    """Bin index of the column ``value`` on the profile columns of its row, -1 if none.

    Nested CASEs that halve the edges stay in generated code and compare four
    times for ten bins.  A NULL edge lies behind all others and is not reached.
    """
    names = edge_columns(bins)

    def reached(first: int, last: int) -> str:
        if first > last:
            return str(first - 1)
        middle = (first + last) // 2
        above, below = reached(middle + 1, last), reached(first, middle - 1)
        return f"CASE WHEN `{value}` >= {names[middle]} THEN {above} ELSE {below} END"

    inside = "n_edges >= 2"
    if not open_ends:
        inside += f" AND `{value}` >= e0 AND `{value}` <= e_last"
    return F.expr(f"CASE WHEN {inside} THEN least({reached(1, bins)}, n_edges - 2) ELSE -1 END")


def quantile_counts(
    long: DataFrame,
    profile: DataFrame,
    keys: Sequence[str] = ("feature",),
    value: str = "value",
    side: str = "is_ref",
    bins: int = 10,
    open_ends: bool = False,
    how: str = "inner",
) -> DataFrame:
    """Counts per key and bin for both sides of ``long`` in one pass:
    ``bin``, ``ref_count``, ``cur_count`` (and ``n_edges``).

    Features without a profile drop out; see :func:`unprofiled_features`.  With
    ``how="left"`` they stay, in bin -1 and without ``n_edges``.
    """
    joined = join_small(long, profile, keys, how)
    binned = joined.select(
        *keys, "n_edges", F.col(side).alias("_side"), quantile_bin(value, bins, open_ends).alias("bin")
    )
    return binned.groupBy(*keys, "bin").agg(
        F.max("n_edges").alias("n_edges"),
        F.count_if("_side").alias("ref_count"),
        F.count_if(~F.col("_side")).alias("cur_count"),
    )


def unprofiled_features(long: DataFrame, profile: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Keys that occur in the data but have no reference distribution."""
    return long.select(*keys).distinct().join(profile.select(*keys), list(keys), "left_anti")


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Index on ``bins`` equal bins over [low, high]; edges are ``low + i*width``.

    The quotient can be off by one at an edge, so it is checked against the
    edges themselves.  A range of zero width puts everything in the last bin.
    """
    width = (high - low) / F.lit(float(bins))
    guess = F.floor(F.try_divide(value - low, width)).cast("int")
    guess = F.greatest(F.least(guess, F.lit(bins - 1)), F.lit(0))
    exact = (
        F.when((guess > 0) & (value < low + guess * width), guess - 1)
        .when((guess < bins - 1) & (value >= low + (guess + 1) * width), guess + 1)
        .otherwise(guess)
    )
    return (
        F.when((value < low) | (value > high), F.lit(-1))
        .when(width == 0, F.lit(bins - 1))
        .otherwise(exact)
    )


def equal_width_counts(
    df: DataFrame, value: str, side: str, keys: Sequence[str] = (), bins: int = 20, span: DataFrame | None = None
) -> DataFrame:
    """Counts of both sides on equal bins over the union of their ranges.

    ``span`` (keys, ``_lo``, ``_hi``) saves a pass for callers that know it.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"), F.col(side).alias("_side"))
    rows = rows.filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if span is None:
        span = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    index = equal_width_bin(F.col("_v"), F.col("_lo"), F.col("_hi"), bins)
    return (
        join_small(rows, span, keys)
        .groupBy(*keys, index.alias("bin"))
        .agg(F.count_if("_side").alias("ref_count"), F.count_if(~F.col("_side")).alias("cur_count"))
    )


def histogram(df: DataFrame, value: str, keys: Sequence[str] = (), bins: int = 50) -> DataFrame:
    """Equal-width histogram of one column with its empty bins: ``bin``,
    ``bin_start``, ``bin_end``, ``count`` and ``density``."""
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    rows = rows.filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    span = rows.groupBy(*keys).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    # A constant column gets a range of one around its value.
    flat = F.col("_lo") == F.col("_hi")
    span = span.filter(F.col("_n") > 0).select(
        *keys,
        "_n",
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    )
    index = equal_width_bin(F.col("_v"), F.col("_lo"), F.col("_hi"), bins)
    counted = (
        join_small(rows, span, keys).groupBy(*keys, index.alias("bin")).agg(F.count(F.lit(1)).alias("_c"))
    )
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    count = F.coalesce("_c", F.lit(0)).cast("bigint")
    return match(grid, counted, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_end"),
        count.alias("count"),
        (count / (F.col("_n") * width)).alias("density"),
    )

"""What-if drift: table transforms that leave their input alone.

Random choices hash a unique bigint id, so results do not depend on how the
table is partitioned and survive a lost executor.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import GROUP_LIMIT, Pick, order_statistics
from .ranking import scatter, scattered_rank
from .sizing import attach_row

SEED = 42
SCENARIOS = ("feature_shift", "scale_change", "noise", "label_flip", "class_imbalance", "severe")


def feature_shift(df: DataFrame, features: Sequence[str], shift: float = 1.5, chosen: Sequence[str] | None = None) -> DataFrame:
    """Add a constant to the chosen features (the first five by default)."""
    return df.withColumns({c: F.col(c) + shift for c in (chosen or features[:5])})


def scale_change(df: DataFrame, features: Sequence[str], scale: float = 3.0, chosen: Sequence[str] | None = None) -> DataFrame:
    """Multiply the chosen features (the first five by default)."""
    return df.withColumns({c: F.col(c) * scale for c in (chosen or features[:5])})


def _uniform(id_col: Column, *salt: int) -> Column:
    """Uniform on (0, 1] from 53 hashed bits."""
    bits = F.shiftrightunsigned(F.xxhash64(*[F.lit(s) for s in salt], id_col), 11)
    return (bits.cast("double") + 1.0) / float(1 << 53)


def gaussian(id_col: Column, *salt: int) -> Column:
    """Standard normal value per id (Box-Muller)."""
    radius = F.sqrt(-2.0 * F.ln(_uniform(id_col, *salt, 1)))
    return radius * F.cos(2.0 * math.pi * _uniform(id_col, *salt, 2))


def noise(df: DataFrame, features: Sequence[str], id_col: str, std: float = 0.5, seed: int = SEED) -> DataFrame:
    """Add Gaussian noise to every feature."""
    return df.withColumns(
        {c: F.col(c) + gaussian(F.col(id_col).cast("bigint"), seed, i) * std for i, c in enumerate(features)}
    )


def label_flip(
    df: DataFrame, label: str, id_col: str, ratio: float = 0.15, seed: int = SEED, group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """Flip exactly ``floor(n * ratio)`` labels: those with the smallest hashes.

    Only the hash at that rank is looked up; the table itself is not shuffled.
    """
    hashed = df.select(scatter(id_col, seed).alias("_h"))
    flips = f"floor(n * {float(ratio)!r}D)"
    last = Pick("_cut", ratio, f"greatest({flips} - 1, 0)")
    cut = order_statistics(hashed, [], "_h", [last], group_limit).selectExpr("_cut", f"{flips} > 0 AS _any")
    marked = attach_row(df, cut)
    flip = F.coalesce(F.col("_any") & (scatter(id_col, seed) <= F.col("_cut")), F.lit(False))
    return marked.withColumn(label, F.when(flip, 1 - F.col(label)).otherwise(F.col(label))).select(*df.columns)


def batch_index(df: DataFrame, order_col: str, n_batches: int, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Add ``batch``: equal contiguous batches in the order of a unique number,
    the remainder in the last.

    The borders are order statistics, so no row is numbered or moved.
    """
    if n_batches < 2:
        return df.withColumn("batch", F.lit(0))
    borders = [Pick(f"_c{i}", i / n_batches, f"(n div {n_batches}) * {i}") for i in range(1, n_batches)]
    cuts = order_statistics(df.select(order_col), [], order_col, borders, group_limit).drop("n")
    marked = attach_row(df, cuts)
    batch = " + ".join(f"int(`{order_col}` >= {p.name})" for p in borders)
    return marked.withColumn("batch", F.expr(batch)).select(*df.columns, "batch")


def gradual_drift(
    df: DataFrame, features: Sequence[str], order_col: str, n_batches: int = 10, max_shift: float = 2.0,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Shift every feature by ``max_shift * i / (n_batches - 1)`` in batch i."""
    out = batch_index(df, order_col, n_batches, group_limit)
    shift = F.lit(max_shift) * (F.col("batch") / F.lit(float(max(n_batches - 1, 1))))
    return out.withColumns({c: F.col(c) + shift for c in features})


def class_imbalance(df: DataFrame, label: str, id_col: str, target_ratio: float = 0.15, seed: int = SEED) -> DataFrame:
    """Oversample class 1, drawing with replacement, up to the target share;
    a table that already reaches it is returned as it is.

    ``draws`` numbers are hashed to ranks and grouped, so each chosen row is
    joined once with its number of copies.
    """
    spark = df.sparkSession
    minority = F.col(label) == 1
    counts = df.agg(F.count_if(minority).alias("minor"), F.count_if(~minority | minority.isNull()).alias("major")).first()
    minor, major = counts["minor"], counts["major"]
    target = int(major * target_ratio / (1 - target_ratio))
    if target <= minor or minor == 0:
        return df
    pool = scattered_rank(df.filter(minority), id_col, seed)
    draws = (
        spark.range(target - minor)
        .select(F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(minor)).alias("rank"))
        .groupBy("rank")
        .agg(F.count(F.lit(1)).alias("_copies"))
    )
    extra = (
        pool.join(draws, "rank")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
        .select(*df.columns)
    )
    return df.unionByName(extra)


def drifted_dataset(df: DataFrame, scenario: str, features: Sequence[str], label: str, id_col: str) -> DataFrame:
    """Apply a named scenario with its default strength."""
    if scenario == "feature_shift":
        return feature_shift(df, features)
    if scenario == "scale_change":
        return scale_change(df, features)
    if scenario == "noise":
        return noise(df, features, id_col)
    if scenario == "label_flip":
        return label_flip(df, label, id_col)
    if scenario == "class_imbalance":
        return class_imbalance(df, label, id_col)
    if scenario == "severe":
        shifted = noise(feature_shift(df, features), features, id_col)
        return label_flip(shifted, label, id_col)
    raise ValueError(f"unknown drift scenario {scenario!r}; choose from {', '.join(SCENARIOS)}")

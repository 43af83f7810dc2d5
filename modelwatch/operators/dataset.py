"""Training data: scan, scaling, exact stratified split, weights, assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FEATURES, TARGET
from .prediction_log import recent_labelled, training_rows
from .quantiles import GROUP_LIMIT, Pick, order_statistics
from .ranking import scatter
from .sizing import attach_row, join_small


def load_training_csv(spark: SparkSession, path: str, features: Sequence[str] = FEATURES, target: str = TARGET) -> DataFrame:
    """Labelled CSV: the known columns that exist, by header name.

    Columns are cast by name, since a schema given to the reader would be
    matched by position and an extra leading column would shift it.
    """
    raw = spark.read.csv(path, header=True)
    columns = [F.col(c).cast("double").alias(c) for c in features if c in raw.columns]
    if target in raw.columns:
        columns.append(F.col(target).cast("double").cast("int").alias(target))
    return raw.select(*columns)


# -- scaling ----------------------------------------------------------------

def fit_scaler(df: DataFrame, column: str) -> DataFrame:
    """One row (column, mean, std) with the population deviation; a constant
    column has std 1."""
    std = F.stddev_pop(column)
    return df.agg(
        F.lit(column).alias("column"),
        F.avg(column).alias("mean"),
        F.when(std == 0, 1.0).otherwise(std).alias("std"),
    )


def apply_scaler(df: DataFrame, scaler: DataFrame, column: str) -> DataFrame:
    one = scaler.filter(F.col("column") == column).agg(F.max("mean").alias("_mean"), F.max("std").alias("_std"))
    scaled = attach_row(df, one)
    return scaled.withColumn(column, (F.col(column) - F.col("_mean")) / F.col("_std")).select(*df.columns)


# -- split and weights ------------------------------------------------------

def stratified_split(
    df: DataFrame, label: str, id_col: str, test_fraction: float = 0.2, seed: int = 42, group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """Add ``split``: in every class exactly ``round(n * test_fraction)`` rows are
    ``test``, those with the smallest hashes of the id.  Rows without a label
    are neither: they are ``unlabelled``.

    One order statistic per class decides; no class is gathered or sorted.
    """
    hashed = df.select(F.col(label).alias("_class"), scatter(id_col, seed).alias("_h"))
    rank = f"bigint(round(n * {float(test_fraction)!r}D))"
    # past the end when all rows are test rows; then the largest hash is picked
    first_train = Pick("_cut", test_fraction, f"least({rank}, n - 1)")
    cuts = order_statistics(hashed, ["_class"], "_h", [first_train], group_limit)
    cuts = cuts.selectExpr(f"_class AS `{label}`", "_cut", f"{rank} >= n AS _all")
    marked = join_small(df, cuts, [label])
    test = F.col("_all") | (scatter(id_col, seed) < F.col("_cut"))
    split = F.when(F.col(label).isNull(), "unlabelled").when(test, "test").otherwise("train")
    return marked.withColumn("split", split).select(*df.columns, "split")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights: rows / (classes * rows of the class)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.agg(F.sum("n").alias("_rows"), F.count(F.lit(1)).alias("_classes"))
    return attach_row(sizes, whole).select(
        label, "n", (F.col("_rows") / (F.col("_classes") * F.col("n"))).alias("weight")
    )


def with_class_weight(df: DataFrame, label: str) -> DataFrame:
    return join_small(df, class_weights(df, label).drop("n"), [label])


# -- assembly and storage ---------------------------------------------------

def retraining_dataset(
    original: DataFrame, predictions: DataFrame, names: Sequence[str] = FEATURES, target: str = TARGET,
    n: int = 1000, ts: str = "timestamp",
) -> DataFrame:
    """The original rows plus the newest labelled predictions, by column name."""
    fresh = training_rows(recent_labelled(predictions, n, ts), names, target=target)
    return original.unionByName(fresh, allowMissingColumns=True)


def save_processed(df: DataFrame, path: str) -> None:
    """Store a split dataset, one folder per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def load_processed(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    out = spark.read.parquet(path)
    return out if split is None else out.filter(F.col("split") == split).drop("split")

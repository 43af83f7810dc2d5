"""Classification metrics, ROC and AUC from counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import coverage_band, ratio
from ..session import materialise
from .ranking import running_totals


def confusion_counts(df: DataFrame, y_true: str, y_pred: str, by: Sequence[str] = ()) -> DataFrame:
    """``tn``, ``fp``, ``fn``, ``tp`` and ``n`` per key over labelled rows."""
    t, p = F.col(y_true) == 1, F.col(y_pred) == 1
    known = F.col(y_true).isNotNull() & F.col(y_pred).isNotNull()
    return df.groupBy(*by).agg(
        F.count_if(known & ~t & ~p).alias("tn"),
        F.count_if(known & ~t & p).alias("fp"),
        F.count_if(known & t & ~p).alias("fn"),
        F.count_if(known & t & p).alias("tp"),
        F.count_if(known).alias("n"),
    )


def confusion_matrix(df: DataFrame, y_true: str, y_pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Long 2 x 2 grid (``actual``, ``predicted``, ``count``), empty cells included."""
    cells = confusion_counts(df, y_true, y_pred, by)
    grid = F.explode(
        F.array(
            *[
                F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(c).alias("count"))
                for a, b, c in [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
            ]
        )
    ).alias("cell")
    return cells.select(*by, grid).select(*by, "cell.*")


def metrics_from_counts(counts: DataFrame) -> DataFrame:
    """Add accuracy, f1, precision and recall; a zero denominator gives 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (
        counts.withColumn("accuracy", ratio(tp + tn, F.col("n")))
        .withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))
        .withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
    )


def binary_metrics(df: DataFrame, y_true: str, y_pred: str, by: Sequence[str] = ()) -> DataFrame:
    return metrics_from_counts(confusion_counts(df, y_true, y_pred, by))


def class_report(df: DataFrame, y_true: str, y_pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, f1 and support of each class."""
    counts = confusion_counts(df, y_true, y_pred, by)
    own = F.explode(
        F.array(
            F.struct(F.lit(0).alias("class"), F.col("tn").alias("hit"), F.col("fn").alias("wrong"), F.col("fp").alias("missed")),
            F.struct(F.lit(1).alias("class"), F.col("tp").alias("hit"), F.col("fp").alias("wrong"), F.col("fn").alias("missed")),
        )
    ).alias("c")
    hit, wrong, missed = (F.col(f"c.{x}") for x in ("hit", "wrong", "missed"))
    return counts.select(*by, own).select(
        *by,
        F.col("c.class").alias("class"),
        ratio(hit, hit + wrong).alias("precision"),
        ratio(hit, hit + missed).alias("recall"),
        ratio(2 * hit, 2 * hit + wrong + missed).alias("f1"),
        (hit + missed).alias("support"),
    )


def label_coverage(df: DataFrame, y_true: str = "true_label", by: Sequence[str] = ()) -> DataFrame:
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count(y_true).alias("labelled"))
    out = out.withColumn("coverage_pct", ratio(F.col("labelled") * 100, F.col("total")))
    return out.withColumn("band", coverage_band(F.col("coverage_pct")))


def roc_curve(df: DataFrame, y_true: str, score: str, by: Sequence[str] = (), buckets: int = 200) -> DataFrame:
    """Points (``threshold``, ``fpr``, ``tpr``) by falling score, ties in one
    point; nothing unless both classes occur.

    Rows shrink to one per distinct score before anything is ordered; that
    table is written once, and the running sums are taken over it in score
    ranges side by side.
    """
    known = df.filter(F.col(y_true).isNotNull() & F.col(score).isNotNull())
    steps = known.groupBy(*by, F.col(score).alias("threshold")).agg(
        F.count_if(F.col(y_true) == 1).alias("pos"), F.count_if(F.col(y_true) != 1).alias("neg")
    )
    cum = running_totals(materialise(steps, "scores"), "threshold", ["pos", "neg"], by, descending=True, buckets=buckets)
    cum = cum.filter((F.col("total_pos") > 0) & (F.col("total_neg") > 0))
    return cum.select(
        *by,
        "threshold",
        "pos",
        "neg",
        ratio(F.col("cum_neg"), F.col("total_neg")).alias("fpr"),
        ratio(F.col("cum_pos"), F.col("total_pos")).alias("tpr"),
        "cum_pos",
        "cum_neg",
        "total_pos",
        "total_neg",
    )


def auc(df: DataFrame, y_true: str, score: str, by: Sequence[str] = (), buckets: int = 200) -> DataFrame:
    """Trapezoid area under the ROC curve; the height before a point is its
    running count less its own, so no lag window is needed."""
    points = roc_curve(df, y_true, score, by, buckets)
    before = F.col("cum_pos") - F.col("pos")
    slab = F.col("neg").cast("double") * (before + F.col("cum_pos")) / 2
    area = points.groupBy(*by).agg(
        F.sum(slab).alias("_area"), F.max("total_pos").alias("_p"), F.max("total_neg").alias("_n"),
    )
    return area.filter(F.col("_p").isNotNull()).select(
        *by, (F.col("_area") / (F.col("_p").cast("double") * F.col("_n"))).alias("auc")
    )


def rolling_metrics(df: DataFrame, y_true: str, y_pred: str, ts: str, width: str = "1 day") -> DataFrame:
    """Metrics per tumbling time window."""
    windowed = df.filter(F.col(y_true).isNotNull()).withColumn("_w", F.window(F.col(ts), width))
    out = binary_metrics(windowed, y_true, y_pred, ["_w"])
    return out.withColumn("window_start", F.col("_w.start")).drop("_w")


def metric_trend(rolling: DataFrame, metric: str, ts: str = "window_start") -> DataFrame:
    """Add the change to the window before (``rolling`` is one row per window)."""
    previous = F.lag(metric).over(W.partitionBy(F.lit(0)).orderBy(ts))
    return rolling.withColumn(f"{metric}_change", F.col(metric) - previous)

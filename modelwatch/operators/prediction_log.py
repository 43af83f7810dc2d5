"""The prediction log: late labels, filters, feature extraction, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import class_name, feature_or_zero, micros, missing_features, ratio, truncate_time
from .ranking import newest


# -- labels -----------------------------------------------------------------

def latest_labels(labels: DataFrame, id_col: str = "id", ts: str = "labelled_at") -> DataFrame:
    return labels.groupBy(id_col).agg(F.max_by("true_label", ts).alias("true_label"))


def attach_labels(predictions: DataFrame, labels: DataFrame, id_col: str = "id", ts: str = "labelled_at") -> DataFrame:
    """Every prediction with its newest label, NULL while there is none."""
    return predictions.drop("true_label").join(latest_labels(labels, id_col, ts), id_col, "left")


def unmatched_labels(predictions: DataFrame, labels: DataFrame, id_col: str = "id") -> DataFrame:
    """Labels whose prediction id is unknown."""
    return labels.join(predictions.select(id_col), id_col, "left_anti")


# -- reads ------------------------------------------------------------------

def predictions_between(
    predictions: DataFrame,
    start=None,
    end=None,
    model_version: str | None = None,
    limit: int | None = 1000,
    ts: str = "timestamp",
    tie: str = "id",
) -> DataFrame:
    """Newest first, both ends included; every filter reaches the scan."""
    out = predictions
    if start is not None:
        out = out.filter(F.col(ts) >= F.lit(start))
    if end is not None:
        out = out.filter(F.col(ts) <= F.lit(end))
    if model_version is not None:
        out = out.filter(F.col("model_version") == model_version)
    out = out.orderBy(F.col(ts).desc(), F.col(tie).desc())
    return out if limit is None else out.limit(limit)


def recent(predictions: DataFrame, n: int = 500, ts: str = "timestamp", by: Sequence[str] = ()) -> DataFrame:
    return newest(predictions, n, ts, "id", by)


def recent_labelled(predictions: DataFrame, n: int = 500, ts: str = "timestamp", by: Sequence[str] = ()) -> DataFrame:
    return newest(predictions.filter(F.col("true_label").isNotNull()), n, ts, "id", by)


# -- features ---------------------------------------------------------------

def feature_columns(df: DataFrame, names: Sequence[str], features: str = "features") -> DataFrame:
    """Ordered feature columns from the map; a missing name reads 0."""
    return df.withColumns({n: feature_or_zero(F.col(features), n) for n in names})


def with_missing(df: DataFrame, required: Sequence[str], features: str = "features") -> DataFrame:
    return df.withColumn("missing_features", missing_features(F.col(features), required))


def split_valid(df: DataFrame, required: Sequence[str], features: str = "features") -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with the names they lack)."""
    checked = with_missing(df, required, features)
    complete = F.size("missing_features") == 0
    return checked.filter(complete).drop("missing_features"), checked.filter(~complete)


def training_rows(labelled: DataFrame, names: Sequence[str], features: str = "features", target: str = "Class") -> DataFrame:
    """Rows for retraining: features that exist (NULL otherwise) and the label;
    rows whose features could not be read are skipped."""
    readable = labelled.filter(F.col(features).isNotNull())
    return readable.select(
        *[F.try_element_at(F.col(features), F.lit(n)).alias(n) for n in names],
        F.col("true_label").cast("int").alias(target),
    )


def response_rows(scored: DataFrame, ts: str = "timestamp") -> DataFrame:
    """What a caller gets back per prediction."""
    return scored.select(
        F.col("id").alias("prediction_id"),
        "predicted_label",
        "confidence",
        "model_version",
        ts,
        F.round("latency_ms", 3).alias("latency_ms"),
    )


# -- statistics -------------------------------------------------------------

def prediction_stats(predictions: DataFrame, ts: str = "timestamp", by: Sequence[str] = ()) -> DataFrame:
    """Count, mean latency, throughput per minute and newest version, one scan.

    Rows are first reduced to one per version, in a hash aggregate; picking the
    newest version straight from the log would sort it.
    """
    versions = predictions.groupBy(*by, F.col("model_version").alias("_version")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count("latency_ms").alias("_timed"),
        F.sum("latency_ms").alias("_latency"),
        F.min(ts).alias("_from"),
        F.max(ts).alias("_to"),
    )
    mean = ratio(F.sum("_latency"), F.sum("_timed"))
    out = versions.groupBy(*by).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_predictions"),
        F.round(mean, 3).alias("avg_latency_ms"),
        ((micros(F.max("_to")) - micros(F.min("_from"))) / 60_000_000.0).alias("_minutes"),
        F.max_by("_version", F.struct("_to", "_version")).alias("latest_model_version"),
    )
    rate = F.round(ratio(F.col("total_predictions"), F.col("_minutes")), 2)
    return out.withColumn("predictions_per_minute", F.when(F.col("_minutes") > 0, rate).otherwise(0.0)).drop("_minutes")


def class_balance(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    out = predictions.groupBy(*by, "predicted_label").agg(F.count(F.lit(1)).alias("count"))
    return out.withColumn("class_name", class_name(F.col("predicted_label")))


def positive_rate(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return predictions.groupBy(*by).agg(
        F.avg(F.col("predicted_label").cast("int")).alias("positive_rate"),
        F.avg("confidence").alias("mean_confidence"),
    )


def volume_per_minute(predictions: DataFrame, ts: str = "timestamp", newest_minutes: int | None = 60) -> DataFrame:
    """Predictions per minute, the newest minutes only, in time order."""
    minutes = predictions.groupBy(truncate_time("minute", F.col(ts)).alias("minute")).agg(
        F.count(F.lit(1)).alias("count")
    )
    if newest_minutes is not None:
        minutes = minutes.orderBy(F.col("minute").desc()).limit(newest_minutes)
    return minutes.orderBy("minute")


def enough_samples(window: DataFrame, min_samples: int, by: Sequence[str] = ()) -> DataFrame:
    """Gate: is the window long enough for a check?"""
    return window.groupBy(*by).agg(F.count(F.lit(1)).alias("samples")).withColumn(
        "ready", F.col("samples") >= min_samples
    )



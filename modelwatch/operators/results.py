"""Drift results: the rows a check stores, and what is read back from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.columns import truncate
from ..schemas import REQUIRED_METRICS, TABLES
from .drift import combined_status
from .ranking import latest_per_key, newest, oldest
from .sizing import match

_ONE = "_one"


def drift_summary(
    data: DataFrame | None,
    prediction: DataFrame | None,
    concept: DataFrame | None,
    by: Sequence[str] = (),
) -> DataFrame | None:
    """One row per key with the verdict of each check that ran and the worst of
    them.  A check left out (None) or without a row has NULL columns."""
    keys = list(by) or [_ONE]
    parts = []
    wanted = {
        "data": (data, {"overall_psi": "overall_psi", "drifted_features": "drifted_features",
                        "feature_psi": "feature_psi", "feature_kl": "feature_kl",
                        "out_of_range": "out_of_range", "skipped_features": "skipped_features"}),
        "prediction": (prediction, {"hellinger": "hellinger", "positive_rate_change_pct": "positive_rate_change_pct",
                                    "baseline_positive_rate": "baseline_positive_rate",
                                    "current_positive_rate": "current_positive_rate",
                                    "baseline_mean_confidence": "baseline_mean_confidence",
                                    "current_mean_confidence": "current_mean_confidence"}),
        "concept": (concept, {"metric_deltas": "metric_deltas", "degraded_metrics": "degraded_metrics",
                              "current_metrics": "current_metrics", "baseline_metrics": "baseline_metrics"}),
    }
    for name, (frame, columns) in wanted.items():
        if frame is None:
            continue
        key = [F.col(c) for c in by] or [F.lit(0).alias(_ONE)]
        parts.append(
            frame.select(
                *key,
                F.col("severity").alias(f"{name}_severity"),
                F.col("is_drifted").alias(f"{name}_drifted"),
                *[F.col(c).alias(a) for c, a in columns.items()],
            )
        )
    if not parts:
        return None
    out = parts[0]
    for part in parts[1:]:
        out = match(out, part, keys, "full")
    for name, (frame, columns) in wanted.items():
        if frame is None:
            empty = {f"{name}_severity": "string", f"{name}_drifted": "boolean"}
            out = out.withColumns({c: F.lit(None).cast(t) for c, t in empty.items()})
    status = combined_status(*[F.col(f"{n}_severity") for n in wanted])
    checks = F.array_compact(
        F.array(*[F.when(F.col(f"{n}_severity").isNotNull(), f"{n}_drift") for n in wanted])
    )
    return out.withColumn("overall_status", status).withColumn("checks_performed", checks).drop(_ONE)


def drift_result_rows(
    data: DataFrame | None,
    prediction: DataFrame | None,
    concept: DataFrame | None,
    at: Column,
    window_start: Column | None = None,
    window_end: Column | None = None,
    model_version: Column | None = None,
    settings: Settings | None = None,
    by: Sequence[str] = (),
) -> DataFrame | None:
    """Rows for the result table: one for data (psi), one for prediction
    (hellinger), one per degraded metric for concept or a single ``overall``
    row at 0 when nothing degraded.

    Thresholds are the warning levels and the window is the real one.  The keys
    ``by`` are part of the id; those that the table has no column for are kept as
    ``segment`` in the details.
    """
    settings = settings or Settings()
    start, end = window_start if window_start is not None else at, window_end if window_end is not None else at
    frames = []
    others = [c for c in by if c != "model_version"]
    segment = [F.struct(*others).alias("segment")] if others else []
    key = [F.to_json(F.struct(*others))] if others else []

    def rows(frame, kind, metric, value, threshold, breached, details):
        version = model_version
        if version is None:
            version = F.col("model_version") if "model_version" in frame.columns else F.lit(None).cast("string")
        return frame.select(
            F.xxhash64(at.cast("string"), F.lit(kind), metric, version, *key).alias("id"),
            at.cast("timestamp").alias("timestamp"),
            version.alias("model_version"),
            F.lit(kind).alias("drift_type"),
            metric.alias("metric_name"),
            value.alias("metric_value"),
            threshold.cast("double").alias("threshold"),
            breached.alias("is_breached"),
            start.cast("timestamp").alias("window_start"),
            end.cast("timestamp").alias("window_end"),
            F.to_json(F.struct(*details, *segment)).alias("details_json"),
        )

    if data is not None:
        lost = F.size("out_of_range") > 0 if "out_of_range" in data.columns else F.lit(False)
        frames.append(rows(data, "data", F.lit("psi"), F.col("overall_psi"), F.lit(settings["psi"].warning),
                           F.col("is_drifted") | lost, ["feature_psi", "drifted_features", "severity"]))
    if prediction is not None:
        frames.append(rows(prediction, "prediction", F.lit("hellinger"), F.col("hellinger"),
                           F.lit(settings["hellinger"].warning), F.col("is_drifted"),
                           ["baseline_positive_rate", "current_positive_rate",
                            "baseline_mean_confidence", "current_mean_confidence", "severity"]))
    if concept is not None:
        # explode_outer keeps the healthy check as one row without a metric
        each = concept.withColumn("_m", F.explode_outer("degraded_metrics"))
        metric = F.coalesce(F.concat("_m", F.lit("_drop")), F.lit("overall"))
        drop = F.coalesce(-F.try_element_at("metric_deltas", F.col("_m")), F.lit(0.0))
        limits = F.create_map(*[x for m in REQUIRED_METRICS for x in (F.lit(m), F.lit(settings[f"{m}_drop"].warning))])
        threshold = F.coalesce(F.try_element_at(limits, F.col("_m")), F.lit(0.0))
        frames.append(rows(each, "concept", metric, drop, threshold, F.col("_m").isNotNull(),
                           ["current_metrics", "baseline_metrics", "severity"]))
    if not frames:
        return None
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.select(*TABLES["drift_results"].names)


# -- reads ------------------------------------------------------------------

def drift_history(results: DataFrame, drift_type: str | None = None, limit: int = 50, ts: str = "timestamp") -> DataFrame:
    if drift_type is not None:
        results = results.filter(F.col("drift_type") == drift_type)
    return newest(results, limit, ts)


def latest_results(results: DataFrame, ts: str = "timestamp", by: Sequence[str] = ()) -> DataFrame:
    """The newest row of every drift type (the durable latest summary)."""
    return latest_per_key(results, [*by, "drift_type"], ts)


def model_health(results: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Severity of each family at its last check; ``unknown`` before the first."""
    level = F.get_json_object("details_json", "$.severity")
    latest = latest_results(results.select("id", ts, "drift_type", level.alias("severity")), ts)
    out = latest.agg(
        *[
            F.max(F.when(F.col("drift_type") == kind, F.col("severity"))).alias(f"{kind}_severity")
            for kind in ("data", "prediction", "concept")
        ],
        F.count(F.lit(1)).alias("_n"),
        F.max(ts).alias("last_checked"),
    )
    kinds = [f"{k}_severity" for k in ("data", "prediction", "concept")]
    status = F.when(F.col("_n") == 0, "unknown").otherwise(combined_status(*[F.col(k) for k in kinds]))
    filled = [
        F.when(F.col("_n") == 0, "unknown").otherwise(F.coalesce(F.col(k), F.lit("none"))).alias(k) for k in kinds
    ]
    return out.select(status.alias("status"), *filled, "last_checked")


def health_badge(results: DataFrame, alerts: DataFrame, ts: str = "timestamp") -> DataFrame:
    """No Data, Healthy, Drift Warning, or Drift Critical while an
    unacknowledged CRITICAL alert exists.  Two one-row aggregates."""
    breached = results.agg(F.max_by("is_breached", F.struct(ts, "id")).alias("breached"))
    critical = alerts.agg(
        F.coalesce(F.bool_or((F.col("severity") == "CRITICAL") & ~F.col("acknowledged")), F.lit(False)).alias("c")
    )
    return breached.select("breached", critical.scalar().alias("critical")).select(
        F.when(F.col("breached").isNull(), "No Data")
        .when(~F.col("breached"), "Healthy")
        .when(F.col("critical"), "Drift Critical")
        .otherwise("Drift Warning")
        .alias("badge")
    )


def details_map(results: DataFrame, field: str = "feature_psi") -> DataFrame:
    """Per-feature values out of the details, one row each; rows without the
    field are skipped."""
    values = F.from_json(F.get_json_object("details_json", f"$.{field}"), "map<string,double>")
    rest = [c for c in results.columns if c != "details_json"]
    return results.select(*rest, F.explode(values).alias("feature", "value"))


def feature_names_seen(results: DataFrame) -> DataFrame:
    return details_map(results).select("feature").distinct()


def psi_heatmap(long: DataFrame, features: Sequence[str], ts: str, value: str = "psi", first: int | None = 15) -> DataFrame:
    """Time x feature matrix; the first names in sorted order, missing cells 0."""
    names = sorted(features)[:first]
    wide = long.groupBy(ts).pivot("feature", names).agg(F.max(value))
    return wide.na.fill(0.0, names)


def metric_series(
    results: DataFrame, drift_type: str | None = None, metric: str | None = None,
    limit: int = 100, ts: str = "timestamp", latest: bool = False,
) -> DataFrame:
    """A metric over time.  The limit takes the oldest rows unless ``latest``."""
    if drift_type is not None:
        results = results.filter(F.col("drift_type") == drift_type)
    if metric is not None:
        results = results.filter(F.col("metric_name") == metric)
    cut = newest(results, limit, ts) if latest else oldest(results, limit, ts)
    return cut.withColumn("change", F.col("metric_value") - F.lag("metric_value").over(W.partitionBy(F.lit(0)).orderBy(ts, "id")))


def metric_card(results: DataFrame, metric: str, ts: str = "timestamp") -> DataFrame:
    """Latest concept check: the metric, its baseline and the difference."""
    body = F.col("details_json")
    last = results.filter(F.col("drift_type") == "concept").agg(F.max_by(body, F.struct(ts, "id")).alias("d"))
    now = F.coalesce(F.get_json_object("d", f"$.current_metrics.{metric}").cast("double"), F.lit(0.0))
    base = F.coalesce(F.get_json_object("d", f"$.baseline_metrics.{metric}").cast("double"), F.lit(0.0))
    return last.filter("d IS NOT NULL").select(
        F.lit(metric).alias("metric"), now.alias("current"), base.alias("baseline"), (now - base).alias("delta")
    )


def retraining_listing(events: DataFrame, limit: int = 20, ts: str = "timestamp") -> DataFrame:
    return newest(events, limit, ts).withColumn("trigger_reason", truncate(F.col("trigger_reason"), 60))

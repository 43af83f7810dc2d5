"""Continuous ingest, late labels, windowed counts and scheduled checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import feature_map
from ..operators.prediction_log import split_valid
from ..operators.sizing import match
from ..operators.training import score_transactions
from ..plans.checks import monitor_once
from ..plans.retraining import load_model, production_version
from ..sources.tables import MonitorTables


def _trigger(every: str | None) -> dict[str, object]:
    """A processing-time trigger, or everything there is and then stop."""
    return {"processingTime": every} if every else {"availableNow": True}


def write_append(stream: DataFrame, path: str, checkpoint: str, every: str | None = None,
                 partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Exactly-once file sink."""
    writer = stream.writeStream.outputMode("append").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start()


# -- ingest and scoring -----------------------------------------------------------

def land_predictions(
    stream: DataFrame, tables: MonitorTables, checkpoint: str, name: str = "ingest",
    transform: Callable[[DataFrame], DataFrame] | None = None, every: str | None = None,
) -> StreamingQuery:
    """Append a stream to the prediction table.  Each micro-batch owns its
    folder and replaces it when it is run again, so a restart adds no row twice.
    Rows that ``transform`` turns away (its ``rejected``) go to the table
    ``quarantine`` with the names they lack."""

    def land(batch: DataFrame, batch_id: int) -> None:
        if hasattr(transform, "rejected"):
            tables.land_batch(transform.rejected(batch), name, batch_id, "quarantine")
        tables.land_batch(transform(batch) if transform else batch, name, batch_id)

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start()


def valid_rows(required: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Transform for :func:`land_predictions`: rows with every required feature;
    the others are its ``rejected`` rows."""

    def keep(batch: DataFrame) -> DataFrame:
        return split_valid(_with_features(batch), required)[0]

    keep.rejected = lambda batch: _quarantined(batch, required)
    return keep


def _with_features(batch: DataFrame) -> DataFrame:
    return batch if "features" in batch.columns else batch.withColumn("features", feature_map(F.col("features_json")))


def _quarantined(batch: DataFrame, required: Sequence[str]) -> DataFrame:
    """The rows that lack a required feature, with the names (``missing``)."""
    bad = split_valid(_with_features(batch), required)[1]
    if "features_json" not in bad.columns:
        bad = bad.withColumn("features_json", F.to_json("features"))
    return bad.withColumn("missing", F.concat_ws(",", "missing_features"))


def champion_scorer(tables: MonitorTables, features: Sequence[str], scaled: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """Transform that scores a micro-batch with the model that is in production
    when the batch starts; a promotion takes effect at the next batch."""
    loaded: dict[int, object] = {}

    def score(batch: DataFrame) -> DataFrame:
        version = production_version(tables)
        if version is None:
            raise RuntimeError("no production version to score with")
        if version not in loaded:
            loaded.clear()
            loaded[version] = load_model(tables, version)
        scaler = tables.read("scaler").filter(F.col("version") == version) if scaled else None
        scored, _ = score_transactions(loaded[version], batch, features, scaler, scaled)
        return scored.withColumn("model_version", F.lit(str(version)))

    score.rejected = lambda batch: _quarantined(batch, features)
    return score


# -- late labels ------------------------------------------------------------------

def attach_labels(
    predictions: DataFrame, labels: DataFrame, wait: str = "7 days", lateness: str = "1 hour", how: str = "leftOuter",
    ts: str = "timestamp", label_ts: str = "labelled_at",
) -> DataFrame:
    """Join labels that arrive up to ``wait`` after their prediction.

    State is bounded: a prediction without a label leaves (with NULL, for the
    outer join) once the watermark passes the wait.  The batch join has no
    such bound.
    """
    left = predictions.withWatermark(ts, lateness)
    right = labels.select(F.col("id").alias("_label_id"), label_ts, "true_label").withWatermark(label_ts, lateness)
    in_time = F.col(label_ts).between(F.col(ts), F.col(ts) + F.expr(f"INTERVAL {wait}"))
    return left.join(right, (F.col("id") == F.col("_label_id")) & in_time, how).drop("_label_id")


# -- windowed counts ----------------------------------------------------------------

def volume(stream: DataFrame, ts: str = "timestamp", width: str = "1 minute", lateness: str = "10 minutes",
           by: Sequence[str] = (), slide: str | None = None) -> DataFrame:
    """Rows per tumbling (or sliding) window and key."""
    span = F.window(ts, width, slide) if slide else F.window(ts, width)
    counted = stream.withWatermark(ts, lateness).groupBy(span.alias("w"), *by).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(F.col("w.start").alias("window_start"), *by, "count")


def sessions(stream: DataFrame, ts: str = "timestamp", gap: str = "30 minutes", lateness: str = "10 minutes",
             by: Sequence[str] = ()) -> DataFrame:
    """Runs of rows per key without a pause of ``gap``: their first time, the end
    of the pause after the last, their number."""
    counted = stream.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "count")


def with_open_windows(closed: DataFrame, rows: DataFrame, ts: str = "timestamp", width: str = "1 minute", by: Sequence[str] = ()) -> DataFrame:
    """The windows that a :func:`volume` stream has closed and appended, and those
    still open, counted from the ``rows`` behind the last closed one.  So no
    result is rewritten, and the state holds open windows only."""
    end = closed.agg(F.max(F.col("window_start") + F.expr(f"INTERVAL {width}")).alias("e")).scalar()
    later = rows.filter(F.coalesce(F.col(ts) >= end, F.lit(True)) & F.col(ts).isNotNull())
    counted = later.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("count"))
    return closed.select("window_start", *by, "count").unionByName(counted.select(F.col("w.start").alias("window_start"), *by, "count"))


def with_open_sessions(closed: DataFrame, rows: DataFrame, ts: str = "timestamp", gap: str = "30 minutes", by: Sequence[str] = ()) -> DataFrame:
    """Closed sessions and the open one of each key, as :func:`with_open_windows`."""
    ends = closed.groupBy(*by).agg(F.max("session_end").alias("_end"))
    later = match(rows.filter(F.col(ts).isNotNull()), ends, list(by), "left") if by else rows.withColumn("_end", ends.scalar())
    later = later.filter(F.col("_end").isNull() | (F.col(ts) >= F.col("_end")))
    counted = later.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("count"))
    counted = counted.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "count")
    return closed.select("session_start", "session_end", *by, "count").unionByName(counted)


# -- scheduled checks ---------------------------------------------------------------

def drift_monitor(
    clock: DataFrame, tables: MonitorTables, features: Sequence[str], checkpoint: str,
    every: str | None = "5 minutes", on_decision: Callable[[DataFrame], None] | None = None, **check,
) -> StreamingQuery:
    """Run a monitoring cycle at every trigger that brings rows.

    The check reads the prediction table, not the micro-batch, so the window is
    the newest rows whatever the batch size.  The baseline profile and the
    streak are read from their tables each time.
    """

    def cycle(batch: DataFrame, _id: int) -> None:
        if batch.isEmpty():
            return
        decision = monitor_once(tables, features, **check)
        if decision is not None and on_decision is not None:
            on_decision(decision)

    return clock.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start()

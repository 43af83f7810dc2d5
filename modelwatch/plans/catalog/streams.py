"""Streaming queries, run over the whole events file until it is used up.

Each gives the same rows as its batch twin, which is what the SQL states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...session import scratch_dir
from ...sources.fixtures import ADAPTERS, adapter, adapter_sql
from ...streaming import monitors as M
from ...streaming import repeats as S
from ...streaming import streaks as K
from .registry import query


def _stream(spark, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return spark.sql(ADAPTERS[name], events=events)


def _instants(df: DataFrame, *names: str) -> DataFrame:
    """Watermarks need instants; the tables hold zone-less times."""
    return df.withColumns({n: F.col(n).cast("timestamp") for n in names})


def _finish(spark, start, stream: DataFrame) -> DataFrame:
    root = scratch_dir(spark, "stream")
    out, checkpoint = f"{root}/out", f"{root}/checkpoint"
    started = start(stream, out, checkpoint)
    started.awaitTermination()
    if started.exception() is not None:
        raise started.exception()
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_volume", f"SELECT date_trunc('minute', pred_ts) AS window_start, count(*) AS count FROM ({adapter_sql('predictions')}) p GROUP BY 1")
def stream_volume(spark, sf_dir):
    """Predictions per minute."""
    counted = M.volume(_instants(_stream(spark, sf_dir, "predictions"), "pred_ts"), "pred_ts")
    closed = _finish(spark, M.write_append, counted)
    done = M.with_open_windows(closed, _instants(adapter(spark, sf_dir, "predictions"), "pred_ts"), "pred_ts")
    return done.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_alert_hours", f"SELECT date_trunc('hour', alert_ts) AS window_start, severity, count(*) AS count FROM ({adapter_sql('alerts')}) a GROUP BY 1, 2")
def stream_alert_hours(spark, sf_dir):
    """Alerts per hour and severity."""
    alerts = _instants(_stream(spark, sf_dir, "alerts"), "alert_ts")
    closed = _finish(spark, M.write_append, M.volume(alerts, "alert_ts", "1 hour", by=["severity"]))
    done = M.with_open_windows(closed, _instants(adapter(spark, sf_dir, "alerts"), "alert_ts"), "alert_ts", "1 hour", ["severity"])
    return done.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_sessions", f"""WITH p AS ({adapter_sql('predictions')}),
 s AS (SELECT *, coalesce(pred_ts - lag(pred_ts) OVER w >= INTERVAL 20 MINUTE, true)::INT AS fresh FROM p WINDOW w AS (PARTITION BY model_version ORDER BY pred_ts, id)),
 n AS (SELECT *, sum(fresh) OVER (PARTITION BY model_version ORDER BY pred_ts, id ROWS UNBOUNDED PRECEDING) AS session FROM s)
 SELECT model_version, min(pred_ts) AS session_start, max(pred_ts) + INTERVAL 20 MINUTE AS session_end, count(*) AS count FROM n GROUP BY model_version, session""")
def stream_sessions(spark, sf_dir):
    """Runs of predictions per model without a pause of twenty minutes."""
    rows = _instants(adapter(spark, sf_dir, "predictions"), "pred_ts")
    found = M.sessions(_instants(_stream(spark, sf_dir, "predictions"), "pred_ts"), "pred_ts", "20 minutes", by=["model_version"])
    done = M.with_open_sessions(_finish(spark, M.write_append, found), rows, "pred_ts", "20 minutes", ["model_version"])
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("stream_labels", f"""WITH p AS ({adapter_sql('predictions')})
 SELECT id, predicted_label, true_label, pred_ts + to_minutes(user_id) AS labelled_at FROM p WHERE true_label IS NOT NULL AND user_id <= 120""")
def stream_labels(spark, sf_dir):
    """Labels that arrive within two hours of their prediction."""
    predictions = _instants(_stream(spark, sf_dir, "predictions"), "pred_ts").select("id", "pred_ts", "predicted_label")
    labels = _stream(spark, sf_dir, "predictions").filter(F.col("true_label").isNotNull()).select(
        "id", F.expr("pred_ts + make_dt_interval(0, 0, cast(user_id as int), 0)").alias("labelled_at"), "true_label"
    )
    joined = M.attach_labels(predictions, _instants(labels, "labelled_at"), "2 hours", how="inner", ts="pred_ts")
    done = _finish(spark, M.write_append, joined)
    return done.select("id", "predicted_label", "true_label", F.col("labelled_at").cast("timestamp_ntz").alias("labelled_at"))


@query("stream_dispatch", f"""WITH a AS ({adapter_sql('alerts')}),
 l AS (SELECT *, lag(alert_ts) OVER (PARTITION BY drift_type, metric_name ORDER BY alert_ts, id) AS prev FROM a)
 SELECT drift_type, metric_name, id FROM l WHERE NOT coalesce(alert_ts - prev <= INTERVAL 30 MINUTE, false)""")
def stream_dispatch(spark, sf_dir):
    """Alerts that are sent, repeats suppressed."""
    S.use_rocksdb(spark)
    sent = S.dispatch_stream(_instants(_stream(spark, sf_dir, "alerts"), "alert_ts"), "alert_ts")
    return _finish(spark, M.write_append, sent).select("drift_type", "metric_name", "id")


@query("stream_streak", f"""WITH a AS (SELECT *, severity <> 'RESOLVED' AS breached FROM ({adapter_sql('alerts')}) x),
 n AS (SELECT *, row_number() OVER w AS place, sum((NOT breached)::INT) OVER w AS misses FROM a WINDOW w AS (PARTITION BY metric_name, user ORDER BY alert_ts DESC, id DESC))
 SELECT metric_name, user, count(*) FILTER (misses = 0) AS streak FROM n WHERE place <= 50 GROUP BY ALL""".replace("SELECT *, severity", "SELECT *, id % 40 AS user, severity"))
def stream_streak(spark, sf_dir):
    """Consecutive breaches per key, kept while the results stream in."""
    S.use_rocksdb(spark)
    results = _instants(_stream(spark, sf_dir, "alerts"), "alert_ts")
    results = results.withColumns({"user": F.col("id") % 40, "is_breached": F.col("severity") != "RESOLVED"})
    updates = _finish(spark, M.write_append, K.streak_stream(results, "alert_ts", by=["metric_name", "user"]))
    return K.latest_streaks(updates, ["metric_name", "user"])

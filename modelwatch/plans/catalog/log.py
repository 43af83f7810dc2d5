"""Prediction-log queries over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.columns import feature_map
from ...operators import metrics as M
from ...operators import prediction_log as L
from ...sources.fixtures import adapter, adapter_sql, table
from .registry import query, r6

_P = f"WITH p AS ({adapter_sql('predictions')}) "


def _predictions(spark, sf_dir) -> DataFrame:
    return adapter(spark, sf_dir, "predictions")


def _ntz(text: str):
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


# -- reads --------------------------------------------------------------------

@query("predictions_filtered", _P + """SELECT id, pred_ts, model_version, predicted_label FROM p
 WHERE pred_ts >= TIMESTAMP '2024-01-05 00:00:00' AND pred_ts <= TIMESTAMP '2024-01-20 00:00:00' AND model_version = 'v2'
 ORDER BY pred_ts DESC, id DESC LIMIT 1000""")
def predictions_filtered(spark, sf_dir):
    found = L.predictions_between(
        _predictions(spark, sf_dir), _ntz("2024-01-05 00:00:00"), _ntz("2024-01-20 00:00:00"), "v2", 1000, "pred_ts"
    )
    return found.select("id", "pred_ts", "model_version", "predicted_label")


@query("labelled_recent", _P + "SELECT id, pred_ts, true_label, predicted_label FROM p WHERE true_label IS NOT NULL ORDER BY pred_ts DESC, id DESC LIMIT 500")
def labelled_recent(spark, sf_dir):
    found = L.recent_labelled(_predictions(spark, sf_dir), 500, "pred_ts")
    return found.select("id", "pred_ts", "true_label", "predicted_label")


@query("recent_window", _P + "SELECT id, pred_ts, model_version FROM p ORDER BY pred_ts DESC, id DESC LIMIT 500")
def recent_window(spark, sf_dir):
    return L.recent(_predictions(spark, sf_dir), 500, "pred_ts").select("id", "pred_ts", "model_version")


@query("recent_window_by_model", _P + """SELECT model_version, id, pred_ts FROM p
 QUALIFY row_number() OVER (PARTITION BY model_version ORDER BY pred_ts DESC, id DESC) <= 500""")
def recent_window_by_model(spark, sf_dir):
    found = L.recent(_predictions(spark, sf_dir), 500, "pred_ts", ["model_version"])
    return found.select("model_version", "id", "pred_ts")


# -- late labels ----------------------------------------------------------------

def _label_events(spark, sf_dir) -> DataFrame:
    """Labels an hour after the prediction; some are corrected two hours later."""
    rows = _predictions(spark, sf_dir).filter(F.col("true_label").isNotNull())
    first = rows.select("id", (F.col("pred_ts") + F.expr("INTERVAL 1 HOUR")).alias("labelled_at"), "true_label")
    fixed = rows.filter(F.col("user_id") % 7 == 0).select(
        "id", (F.col("pred_ts") + F.expr("INTERVAL 3 HOUR")).alias("labelled_at"), (1 - F.col("true_label")).alias("true_label")
    )
    return first.unionByName(fixed)


@query("label_attach", _P + """SELECT id, predicted_label,
 CASE WHEN true_label IS NULL THEN NULL WHEN user_id % 7 = 0 THEN 1 - true_label ELSE true_label END AS true_label FROM p""")
def label_attach(spark, sf_dir):
    """Every prediction with its newest label; corrections win."""
    joined = L.attach_labels(_predictions(spark, sf_dir), _label_events(spark, sf_dir))
    return joined.select("id", "predicted_label", "true_label")


@query("unmatched_labels", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events)")
def unmatched_labels(spark, sf_dir):
    """Labels for ids that were never predicted."""
    labels = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return L.unmatched_labels(_predictions(spark, sf_dir), labels)


@query("label_coverage", _P + """SELECT count(*) AS total, count(true_label) AS labelled, round(count(true_label) * 100.0 / count(*), 6) AS coverage_pct,
 CASE WHEN count(true_label) * 100.0 / count(*) > 50 THEN 'good' WHEN count(true_label) * 100.0 / count(*) > 20 THEN 'warning' ELSE 'bad' END AS band FROM p""")
def label_coverage(spark, sf_dir):
    return M.label_coverage(_predictions(spark, sf_dir)).withColumn("coverage_pct", r6("coverage_pct"))


# -- features -------------------------------------------------------------------

def _with_map(spark, sf_dir) -> DataFrame:
    return _predictions(spark, sf_dir).withColumn("features", feature_map(F.col("features_json")))


@query("feature_vector", _P + "SELECT id, CAST(json_extract_string(features_json, '$.k') AS DOUBLE) AS k, CAST(0 AS DOUBLE) AS amount FROM p")
def feature_vector(spark, sf_dir):
    """Ordered features out of the JSON; the absent one reads 0."""
    return L.feature_columns(_with_map(spark, sf_dir), ["k", "amount"]).select("id", "k", "amount")


@query("missing_features", _P + "SELECT id, CASE WHEN json_extract_string(features_json, '$.k') IS NULL THEN 'amount,k' ELSE 'amount' END AS missing FROM p")
def missing_features(spark, sf_dir):
    checked = L.with_missing(_with_map(spark, sf_dir), ["k", "amount"])
    return checked.select("id", F.concat_ws(",", "missing_features").alias("missing"))


@query("quarantine_split", _P + """SELECT 'valid' AS part, count(*) FILTER (json_extract_string(features_json, '$.k') IS NOT NULL) AS n FROM p
 UNION ALL SELECT 'quarantine', count(*) FILTER (json_extract_string(features_json, '$.k') IS NULL) FROM p""")
def quarantine_split(spark, sf_dir):
    valid, bad = L.split_valid(_with_map(spark, sf_dir), ["k"])
    tagged = valid.select(F.lit("valid").alias("part"), F.lit(1).alias("one")).unionByName(
        bad.select(F.lit("quarantine").alias("part"), F.lit(1).alias("one"))
    )
    both = tagged.agg(F.count_if(F.col("part") == "valid").alias("valid"), F.count_if(F.col("part") != "valid").alias("quarantine"))
    return both.unpivot([], ["valid", "quarantine"], "part", "n")


@query("training_rows", _P + "SELECT CAST(json_extract_string(features_json, '$.k') AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS amount, true_label AS label FROM p WHERE true_label IS NOT NULL")
def training_rows(spark, sf_dir):
    labelled = _with_map(spark, sf_dir).filter(F.col("true_label").isNotNull())
    return L.training_rows(labelled, ["k", "amount"], target="label")


@query("response_rows", _P + "SELECT id AS prediction_id, predicted_label, round(confidence, 6) AS confidence, model_version, pred_ts, round(latency_ms, 3) AS latency_ms FROM p")
def response_rows(spark, sf_dir):
    return L.response_rows(_predictions(spark, sf_dir), "pred_ts").withColumn("confidence", r6("confidence"))


# -- statistics -------------------------------------------------------------------

_STATS = """count(*) AS total_predictions, round(avg(latency_ms), 3) AS avg_latency_ms, arg_max(model_version, pred_ts) AS latest_model_version,
 round(count(*) / (date_diff('microsecond', min(pred_ts), max(pred_ts)) / 60000000.0), 2) AS predictions_per_minute FROM p"""


@query("prediction_stats", _P + "SELECT " + _STATS)
def prediction_stats(spark, sf_dir):
    return L.prediction_stats(_predictions(spark, sf_dir), "pred_ts")


@query("prediction_stats_by_model", _P + "SELECT model_version, " + _STATS + " GROUP BY model_version")
def prediction_stats_by_model(spark, sf_dir):
    return L.prediction_stats(_predictions(spark, sf_dir), "pred_ts", ["model_version"])


@query("class_balance", _P + "SELECT predicted_label, count(*) AS count, CASE predicted_label WHEN 0 THEN 'Legitimate' ELSE 'Fraud' END AS class_name FROM p GROUP BY predicted_label")
def class_balance(spark, sf_dir):
    return L.class_balance(_predictions(spark, sf_dir))


@query("volume_per_minute", _P + "SELECT date_trunc('minute', pred_ts) AS minute, count(*) AS count FROM p GROUP BY 1 ORDER BY 1 DESC LIMIT 60")
def volume_per_minute(spark, sf_dir):
    return L.volume_per_minute(_predictions(spark, sf_dir), "pred_ts")


@query("volume_all_minutes", _P + "SELECT date_trunc('minute', pred_ts) AS minute, count(*) AS count FROM p GROUP BY 1")
def volume_all_minutes(spark, sf_dir):
    return L.volume_per_minute(_predictions(spark, sf_dir), "pred_ts", None)


@query("sample_gate", _P + "SELECT model_version, count(*) AS samples, count(*) >= 100 AS ready FROM p GROUP BY 1")
def sample_gate(spark, sf_dir):
    return L.enough_samples(_predictions(spark, sf_dir), 100, ["model_version"])

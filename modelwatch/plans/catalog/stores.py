"""Queries that go through the monitoring tables on disk: everything is first
appended, then read back as current state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...config import DEFAULT_BASELINE_METRICS, Settings
from ...functions.columns import feature_map
from ...operators import alerts as A
from ...operators import drift as D
from ...operators.sizing import attach_row
from ...session import scratch_dir
from ...sources.bucketed import BucketedLog
from ...sources.fixtures import LINE_FEATURES, adapter, adapter_sql, table
from ...sources.tables import MonitorTables
from ...streaming import monitors as M
from ..checks import monitor_once
from .concept import _BASE, metric_sql
from .data_drift import _DECILES, _SHIFTED, _line_long, _sides, divergence_sql
from .prediction_drift import hellinger_sql
from .registry import query, r6

_P = f"WITH p AS ({adapter_sql('predictions')}) "
_CHECKED = ["f_value", "f_latency", "f_flat"]


def _store(spark) -> MonitorTables:
    return MonitorTables(spark, scratch_dir(spark, "tables"))


def _log(rows: DataFrame, features: F.Column) -> DataFrame:
    """Adapter rows as log rows."""
    return rows.select(
        "id", F.col("pred_ts").cast("timestamp").alias("timestamp"), "model_version", features.alias("features"),
        "predicted_label", "confidence", F.lit(9.5).alias("latency_ms"), "true_label",
    )


@query("logged_predictions", _P + """SELECT id, CAST(pred_ts AS DATE) AS day, model_version, CAST(json_extract_string(features_json, '$.k') AS DOUBLE) AS k,
 predicted_label, true_label FROM p""")
def logged_predictions(spark, sf_dir):
    """The log and its labels, appended to two tables and joined again."""
    tables = _store(spark)
    rows = _log(adapter(spark, sf_dir, "predictions"), feature_map(F.col("features_json")))
    tables.log_predictions(rows)
    labels = rows.filter(F.col("true_label").isNotNull()).select(
        "id", (F.col("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("labelled_at"), "true_label"
    )
    tables.log_labels(labels)
    return tables.predictions().select(
        "id", F.col("date").alias("day"), "model_version", F.col("features")["k"].alias("k"), "predicted_label", "true_label"
    )


@query("label_attach_stored", _P + "SELECT id, CAST(pred_ts AS DATE) AS day, model_version, predicted_label, true_label FROM p")
def label_attach_stored(spark, sf_dir):
    """The log and its labels in buckets of the id, labels first wrong and then
    mended by a later append; they are joined where they lie."""
    log = BucketedLog(spark, scratch_dir(spark, "bucketed"), 8)
    rows = _log(adapter(spark, sf_dir, "predictions"), F.lit(None))
    log.log_predictions(rows)
    known = rows.filter(F.col("true_label").isNotNull())
    for hours, label in ((1, 1 - F.col("true_label")), (2, F.col("true_label"))):
        at = F.col("timestamp") + F.expr(f"INTERVAL {hours} HOUR")
        log.log_labels(known.select("id", at.alias("labelled_at"), label.alias("true_label")))
    return log.predictions().select("id", F.col("date").alias("day"), "model_version", "predicted_label", "true_label")


@query("logged_ids_in_order", _P + """, d AS (SELECT CAST(pred_ts AS DATE) > DATE '2024-01-15' AS later, pred_ts, model_version, predicted_label, confidence FROM p, range(2))
 SELECT row_number() OVER (ORDER BY later, pred_ts, model_version, predicted_label, confidence) AS id, pred_ts, model_version, predicted_label, confidence FROM d""")
def logged_ids_in_order(spark, sf_dir):
    """Every prediction twice, in two batches of which the first comes again: ids
    without gaps in the order of time, and equal rows keep one each."""
    tables = _store(spark)
    rows = adapter(spark, sf_dir, "predictions").select(
        "pred_ts", F.col("pred_ts").cast("timestamp").alias("timestamp"), "model_version", "predicted_label", "confidence"
    )
    rows = rows.union(rows)
    later = F.col("pred_ts").cast("date") > F.lit("2024-01-15").cast("date")
    order = ["timestamp", "model_version", "predicted_label", "confidence"]
    for batch, part in (("first", ~later), ("second", later), ("first", ~later)):
        tables.log_in_order(rows.filter(part).drop("pred_ts"), batch, order)
    return tables.read("predictions").select("id", F.col("timestamp").cast("timestamp_ntz").alias("pred_ts"), "model_version", "predicted_label", "confidence")


@query("logged_alerts", f"WITH a AS ({adapter_sql('alerts')}) SELECT id, severity, drift_type, acknowledged OR id IN (SELECT o_custkey FROM orders) AS acknowledged FROM a")
def logged_alerts(spark, sf_dir):
    """Alerts and acknowledgements as tables; the state is their join."""
    tables = _store(spark)
    raised = adapter(spark, sf_dir, "alerts")
    rows = A.alert_rows(raised.withColumn("timestamp", F.col("alert_ts").cast("timestamp")))
    state = raised.select("id", F.col("acknowledged").alias("_ack"))
    rows = rows.join(state, "id").withColumn("acknowledged", F.col("_ack")).drop("_ack")
    tables.append("alerts", rows)
    tables.acknowledge(
        table(spark, sf_dir, "orders").select(
            F.col("o_custkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("acknowledged_at")
        )
    )
    return tables.alerts().select("id", "severity", "drift_type", "acknowledged")


@query("stored_versions", f"""WITH v AS ({adapter_sql('model_versions')}), p AS (SELECT * FROM ({adapter_sql('promotions')}) x WHERE version IN (SELECT version FROM v))
 SELECT version, round(f1_score, 6) AS f1_score, version = (SELECT version FROM p ORDER BY promoted_at DESC, version DESC LIMIT 1) AS is_production FROM v""")
def stored_versions(spark, sf_dir):
    """Versions and promotions as tables; one version is in production."""
    tables = _store(spark)
    tables.append("model_versions", adapter(spark, sf_dir, "model_versions"))
    promotions = adapter(spark, sf_dir, "promotions")
    tables.append("promotions", promotions.withColumn("promoted_at", F.col("promoted_at").cast("timestamp")))
    return tables.versions().select("version", r6("f1_score").alias("f1_score"), "is_production")


@query("stored_profile", f"""WITH {_line_long('features_shifted', [])},
 e AS (SELECT feature, count(*) AS n_ref, list_sort(list_distinct(quantile_cont(value, {_DECILES}))) AS edges FROM long WHERE is_ref GROUP BY feature)
 SELECT feature, n_ref, CAST(len(edges) AS INT) AS n_edges, round(edges[1], 6) AS first_edge, round(edges[-1], 6) AS last_edge FROM e""")
def stored_profile(spark, sf_dir):
    """The baseline of a version: saved, then only its profile is read."""
    tables = _store(spark)
    tables.save_baseline(_sides(spark, sf_dir)[0], LINE_FEATURES, 1)
    profile, _ = tables.load_profile()
    return profile.select(
        "feature", "n_ref", "n_edges", r6("e0").alias("first_edge"), r6("e_last").alias("last_edge")
    )


@query("data_drift_stored", _SHIFTED + "SELECT feature, round(psi, 6) AS psi, round(kl, 6) AS kl FROM psi")
def data_drift_stored(spark, sf_dir):
    """The check as it runs in production: current rows against the stored profile."""
    reference, current = _sides(spark, sf_dir)
    tables = _store(spark)
    tables.save_baseline(reference, LINE_FEATURES, 1)
    profile, counts = tables.load_profile()
    found = D.feature_drift_stored(current, LINE_FEATURES, profile, counts)
    return found.select("feature", r6("psi").alias("psi"), r6("kl").alias("kl"))


# -- a whole monitoring cycle -----------------------------------------------------

# The first half is the baseline; the newest 500 rows are the window, also where
# a small table makes the window reach back into the first half.
_WINDOW = f"""SELECT * FROM ({adapter_sql('predictions_shifted')}) b WHERE NOT is_current
 UNION ALL (SELECT * REPLACE (true AS is_current) FROM ({adapter_sql('predictions_shifted')}) w ORDER BY pred_ts DESC, id DESC LIMIT 500)"""
_WINDOW_LONG = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, NOT is_current AS is_ref, {f} AS value FROM src" for f in _CHECKED
)
_CYCLE = f"""SELECT 'data' AS drift_type, 'psi' AS metric_name, round(max(psi), 6) AS metric_value, max(psi) >= 0.1 AS is_breached
 FROM ({divergence_sql(f"src AS ({_WINDOW}), long AS ({_WINDOW_LONG})")} SELECT * FROM psi) d
UNION ALL SELECT 'prediction', 'hellinger', round(hellinger, 6), hellinger >= 0.1 FROM ({hellinger_sql(_WINDOW)} SELECT * FROM hel) h
UNION ALL SELECT 'concept', metric || '_drop', round(b - cur, 6), true FROM ({metric_sql(f"p AS (SELECT * FROM ({_WINDOW}) z WHERE is_current)")}, {_BASE}
 SELECT metric, CASE metric WHEN 'accuracy' THEN accuracy WHEN 'f1' THEN f1 WHEN 'precision' THEN precision ELSE recall END AS cur, b, warn FROM m, base) c
 WHERE b - cur >= warn"""


@query("monitoring_cycle", _CYCLE)
def monitoring_cycle(spark, sf_dir):
    """Log, label, baseline, then one cycle over the newest 500 rows: what it stores."""
    tables = _store(spark)
    rows = adapter(spark, sf_dir, "predictions_shifted")
    pairs = [x for f in _CHECKED for x in (F.lit(f), F.col(f))]
    logged = _log(rows, F.create_map(*pairs))
    tables.log_predictions(logged)
    tables.log_labels(logged.filter(F.col("true_label").isNotNull()).select("id", F.col("timestamp").alias("labelled_at"), "true_label"))
    first_half = rows.filter(~F.col("is_current"))
    tables.save_baseline(first_half, _CHECKED)
    monitor_once(tables, _CHECKED, DEFAULT_BASELINE_METRICS, first_half, Settings())
    stored = tables.read("drift_results")
    return stored.select("drift_type", "metric_name", r6("metric_value").alias("metric_value"), "is_breached")


# -- every model with a window of its own -------------------------------------------

_BY = ["model_version"]
_WINDOW_BY = f"""SELECT * FROM ({adapter_sql('predictions_shifted')}) b WHERE NOT is_current
 UNION ALL (SELECT * REPLACE (true AS is_current) FROM ({adapter_sql('predictions_shifted')}) w QUALIFY row_number() OVER (PARTITION BY model_version ORDER BY pred_ts DESC, id DESC) <= 500)"""
_LONG_BY = " UNION ALL ".join(f"SELECT model_version, '{f}' AS feature, NOT is_current AS is_ref, {f} AS value FROM src" for f in _CHECKED)
_PSI_BY = f"""({divergence_sql(f"src AS ({_WINDOW_BY}), long AS ({_LONG_BY})", _BY, [])} SELECT model_version, max(psi) AS psi FROM psi GROUP BY 1)"""
_HEL_BY = f"({hellinger_sql(_WINDOW_BY, _BY)} SELECT * FROM hel)"
_DROP_BY = f"""({metric_sql(f"p AS (SELECT * FROM ({_WINDOW_BY}) z WHERE is_current)", keys=_BY)}, {_BASE}
 SELECT model_version, metric, warn, b - CASE metric WHEN 'accuracy' THEN accuracy WHEN 'f1' THEN f1 WHEN 'precision' THEN precision ELSE recall END AS fall FROM m, base)"""


def _watched(spark, sf_dir):
    """A store with the log, its labels and a baseline, and the baseline's rows."""
    tables = _store(spark)
    rows = adapter(spark, sf_dir, "predictions_shifted")
    logged = _log(rows, F.create_map(*[x for f in _CHECKED for x in (F.lit(f), F.col(f))]))
    tables.log_predictions(logged)
    tables.log_labels(logged.filter(F.col("true_label").isNotNull()).select("id", F.col("timestamp").alias("labelled_at"), "true_label"))
    first_half = rows.filter(~F.col("is_current"))
    tables.save_baseline(first_half, _CHECKED)
    return tables, first_half


@query("monitoring_cycle_by_model", f"""SELECT model_version, 'data' AS drift_type, 'psi' AS metric_name, round(psi, 6) AS metric_value, psi >= 0.1 AS is_breached FROM {_PSI_BY} d
UNION ALL SELECT model_version, 'prediction', 'hellinger', round(hellinger, 6), hellinger >= 0.1 FROM {_HEL_BY} h
UNION ALL SELECT model_version, 'concept', metric || '_drop', round(fall, 6), true FROM {_DROP_BY} c WHERE fall >= warn""")
def monitoring_cycle_by_model(spark, sf_dir):
    """One cycle, run twice, over the newest 500 rows of every model: what it stores."""
    tables, first_half = _watched(spark, sf_dir)
    for _ in range(2):
        monitor_once(tables, _CHECKED, DEFAULT_BASELINE_METRICS, first_half, Settings(), _BY)
    stored = tables.read("drift_results")
    return stored.select("model_version", "drift_type", "metric_name", r6("metric_value").alias("metric_value"), "is_breached")


@query("promotion_race", f"""WITH v AS ({adapter_sql('model_versions')}), best AS (SELECT version FROM v ORDER BY f1_score DESC, version LIMIT 1)
 SELECT version, version = (SELECT version FROM best) AS is_production, CAST(1 AS BIGINT) AS promotions FROM v""")
def promotion_race(spark, sf_dir):
    """The three best versions are promoted by writers who all saw the same state:
    the first one wins, and the others are refused."""
    tables = _store(spark)
    tables.append("model_versions", adapter(spark, sf_dir, "model_versions"))
    best = tables.read("model_versions").orderBy(F.col("f1_score").desc(), "version").limit(3).collect()
    seen = tables.promotion_number()
    for at, row in enumerate(best):
        tables.promote(row["version"], datetime(2024, 5, 1 + at), seen)
    return tables.versions().select("version", "is_production", F.lit(tables.promotion_number()).cast("bigint").alias("promotions"))


@query("decision_history", f"""WITH v AS ({adapter_sql('model_versions')}), pr AS (SELECT * FROM ({adapter_sql('promotions')}) x WHERE version IN (SELECT version FROM v)),
 champion AS (SELECT version, f1_score FROM v WHERE version = (SELECT version FROM pr ORDER BY promoted_at DESC, version DESC LIMIT 1)),
 ends AS (SELECT model_version, max(pred_ts) AS check_ts FROM ({adapter_sql('predictions_shifted')}) w GROUP BY 1),
 f1 AS (SELECT model_version, abs(fall) AS fall FROM {_DROP_BY} c WHERE metric = 'f1'),
 dec AS (SELECT * FROM {_PSI_BY} d JOIN {_HEL_BY} h USING (model_version) JOIN f1 USING (model_version) JOIN ends USING (model_version))
 SELECT 'check-' || epoch_us(check_ts) || '-' || model_version AS event_id, check_ts, CASE WHEN psi > 0.25 OR fall > 0.05 OR psi > 0.1 AND fall > 0.02 THEN 'STARTED' ELSE 'REJECTED' END AS status,
 psi > 0.25 AS names_psi, version AS old_version, CAST(NULL AS INT) AS new_version, round(f1_score, 6) AS old_f1, CAST(NULL AS DOUBLE) AS new_f1
 FROM dec, champion WHERE psi > 0.25 OR fall > 0.05 OR psi > 0.1 AND fall > 0.02 OR hellinger > 0.2""")
def decision_history(spark, sf_dir):
    """The decisions of a cycle by model as recorded, with the version that was in
    production when they were taken."""
    tables, first_half = _watched(spark, sf_dir)
    tables.append("model_versions", adapter(spark, sf_dir, "model_versions"))
    tables.append("promotions", adapter(spark, sf_dir, "promotions").withColumn("promoted_at", F.col("promoted_at").cast("timestamp")))
    monitor_once(tables, _CHECKED, DEFAULT_BASELINE_METRICS, first_half, Settings(), _BY)
    return tables.retraining_events().select(
        "event_id", F.col("timestamp").cast("timestamp_ntz").alias("check_ts"), "status",
        F.col("trigger_reason").contains("Critical data drift: PSI").alias("names_psi"),
        "old_version", "new_version", r6("old_f1").alias("old_f1"), "new_f1",
    )


@query("recent_by_model_stored", f"""SELECT model_version, id, pred_ts, true_label FROM ({adapter_sql('predictions_shifted')}) w
 QUALIFY row_number() OVER (PARTITION BY model_version ORDER BY pred_ts DESC, id DESC) <= 500""")
def recent_by_model_stored(spark, sf_dir):
    """The newest 500 rows of every model with their labels, from the tables: only
    the days that the index names are read."""
    window = _watched(spark, sf_dir)[0].recent_by_model(500)
    return window.select("model_version", "id", F.col("timestamp").cast("timestamp_ntz").alias("pred_ts"), "true_label")


@query("labelled_recent_stored", f"""SELECT id, pred_ts, true_label, predicted_label FROM ({adapter_sql('predictions_shifted')}) w
 WHERE true_label IS NOT NULL ORDER BY pred_ts DESC, id DESC LIMIT 500""")
def labelled_recent_stored(spark, sf_dir):
    """The newest 500 labelled rows from the tables."""
    found = _watched(spark, sf_dir)[0].recent_labelled(500)
    return found.select("id", F.col("timestamp").cast("timestamp_ntz").alias("pred_ts"), "true_label", "predicted_label")


@query("failed_detector", f"""WITH w AS (SELECT min(pred_ts) AS first, max(pred_ts) AS last FROM (SELECT * FROM ({adapter_sql('predictions_shifted')}) b ORDER BY pred_ts DESC, id DESC LIMIT 500) x),
 c AS ({_CYCLE})
 SELECT 'prediction' AS drift_type, first AS window_start, last AS window_end, (SELECT count(*) FROM c WHERE drift_type <> 'prediction') AS stored FROM w""")
def failed_detector(spark, sf_dir):
    """A cycle, run twice, in which one detector fails: it is on record, and the
    results of the others are stored."""
    tables = _store(spark)
    rows = adapter(spark, sf_dir, "predictions_shifted")
    logged = _log(rows, F.create_map(*[x for f in _CHECKED for x in (F.lit(f), F.col(f))]))
    tables.log_predictions(logged)
    tables.log_labels(logged.filter(F.col("true_label").isNotNull()).select("id", F.col("timestamp").alias("labelled_at"), "true_label"))
    first_half = rows.filter(~F.col("is_current"))
    tables.save_baseline(first_half, _CHECKED)
    for _ in range(2):
        monitor_once(tables, _CHECKED, DEFAULT_BASELINE_METRICS, first_half.drop("confidence"), Settings())
    stored = tables.read("drift_results").agg(F.count(F.lit(1)).alias("stored"))
    failures = tables.read("detector_failures").select("drift_type", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")])
    return attach_row(failures, stored)


@query("stream_ingest", _P + """SELECT id, pred_ts, model_version, predicted_label FROM p WHERE json_extract_string(features_json, '$.k') IS NOT NULL""")
def stream_ingest(spark, sf_dir):
    """The event stream landed in the prediction table, complete rows only."""
    from .streams import _instants, _stream

    tables = _store(spark)
    rows = _instants(_stream(spark, sf_dir, "predictions"), "pred_ts").withColumnRenamed("pred_ts", "timestamp")
    landing = M.land_predictions(rows, tables, f"{tables.root}/checkpoint", transform=M.valid_rows(["k"]))
    landing.awaitTermination()
    if landing.exception() is not None:
        raise landing.exception()
    return tables.read("predictions").select(
        "id", F.col("timestamp").cast("timestamp_ntz").alias("pred_ts"), "model_version", "predicted_label"
    )

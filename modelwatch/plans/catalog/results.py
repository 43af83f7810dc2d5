"""Full checks per model version, stored results, health, listings over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...config import DEFAULT_BASELINE_METRICS
from ...operators import decision as decide
from ...operators import drift as D
from ...operators import results as R
from ...sources.fixtures import adapter, adapter_sql
from ..checks import DriftCheck, decision_inputs, run_drift_check
from .concept import _BASE, metric_sql
from .data_drift import divergence_sql
from .decisions import DECISION_SQL
from .prediction_drift import hellinger_sql
from .registry import query, r6

_FEATURES = ["f_value", "f_latency", "f_flat"]
_SRC = adapter_sql("predictions_shifted")


def full_check(spark, sf_dir, by: list[str]) -> DriftCheck:
    """All three checks: the second half of the log against the first."""
    rows = adapter(spark, sf_dir, "predictions_shifted")
    reference, current = rows.filter(~F.col("is_current")), rows.filter(F.col("is_current"))
    baseline = DEFAULT_BASELINE_METRICS
    if by:
        values = [F.struct(F.lit(m).alias("metric"), F.lit(v).alias("value")) for m, v in baseline.items()]
        baseline = rows.select(*by).distinct().select(*by, F.explode(F.array(*values)).alias("b")).select(*by, "b.*")
    return run_drift_check(
        current,
        _FEATURES,
        data=lambda w: D.feature_drift(reference, w, _FEATURES, by=by),
        prediction_baseline=reference,
        metric_baseline=baseline,
        by=by,
        ts="pred_ts",
    )


# -- checking SQL ---------------------------------------------------------------

def _parts(keys: list[str]) -> tuple[str, str, str]:
    """The three verdicts as subqueries."""
    k = "".join(f"{c}, " for c in keys)
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    long = " UNION ALL ".join(
        f"SELECT {k}'{f}' AS feature, NOT is_current AS is_ref, {f} AS value FROM src" for f in _FEATURES
    )
    data = divergence_sql(f"src AS ({_SRC}),\nlong AS ({long})", keys) + (
        f"SELECT {k}max(psi) AS overall_psi, coalesce(string_agg(feature, ',' ORDER BY feature DESC) FILTER (psi >= 0.1), '') AS drifted,"
        f" CASE WHEN max(psi) >= 0.25 THEN 2 WHEN max(psi) >= 0.1 THEN 1 ELSE 0 END AS data_rank FROM psi{group}"
    )
    pred = hellinger_sql(_SRC, keys) + (
        f"SELECT {k}hellinger, CASE WHEN hellinger >= 0.2 THEN 2 WHEN hellinger >= 0.1 THEN 1 ELSE 0 END AS pred_rank FROM hel"
    )
    concept = metric_sql(f"p AS (SELECT * FROM ({_SRC}) z WHERE is_current)", keys=keys) + f""", {_BASE},
v AS (SELECT {k}metric, CASE metric WHEN 'accuracy' THEN accuracy WHEN 'f1' THEN f1 WHEN 'precision' THEN precision ELSE recall END AS cur, b, warn, crit FROM m, base)
SELECT {k}max(CASE WHEN b - cur >= crit THEN 2 WHEN b - cur >= warn THEN 1 ELSE 0 END) AS concept_rank,
 max(cur - b) FILTER (metric = 'f1') AS f1_delta,
 list(struct_pack(metric := metric, dropped := b - cur, warn := warn) ORDER BY metric) FILTER (b - cur >= warn) AS degraded FROM v{group}"""
    return data, pred, concept


def _joined(keys: list[str]) -> str:
    data, pred, concept = _parts(keys)
    if keys:
        using = f"USING ({', '.join(keys)})"
        return f"FROM ({data}) d JOIN ({pred}) h {using} JOIN ({concept}) c {using}"
    return f"FROM ({data}) d, ({pred}) h, ({concept}) c"


def _name(rank: str, zero: str = "none") -> str:
    return f"CASE {rank} WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE '{zero}' END"


_SUMMARY = f"""round(overall_psi, 6) AS overall_psi, {_name('data_rank')} AS data_severity, drifted AS drifted_features,
 round(hellinger, 6) AS hellinger, {_name('pred_rank')} AS prediction_severity, round(f1_delta, 6) AS f1_delta,
 {_name('concept_rank')} AS concept_severity, {_name('greatest(data_rank, pred_rank, concept_rank)', 'healthy')} AS overall_status,
 data_rank > 0 AS data_drifted, pred_rank > 0 AS prediction_drifted, concept_rank > 0 AS concept_drifted
"""


def _summary(check: DriftCheck, by: list[str]) -> DataFrame:
    return check.summary.select(
        *by,
        r6("overall_psi").alias("overall_psi"),
        "data_severity",
        F.concat_ws(",", "drifted_features").alias("drifted_features"),
        r6("hellinger").alias("hellinger"),
        "prediction_severity",
        r6(F.col("metric_deltas")["f1"]).alias("f1_delta"),
        "concept_severity",
        "overall_status",
        "data_drifted",
        "prediction_drifted",
        "concept_drifted",
    )


@query("drift_summary", f"SELECT {_SUMMARY} {_joined([])}")
def drift_summary(spark, sf_dir):
    return _summary(full_check(spark, sf_dir, []), [])


@query("drift_summary_by_model", f"SELECT model_version, {_SUMMARY} {_joined(['model_version'])}")
def drift_summary_by_model(spark, sf_dir):
    by = ["model_version"]
    return _summary(full_check(spark, sf_dir, by), by)


@query("drift_result_rows", f"""WITH j AS (SELECT * {_joined(['model_version'])})
SELECT model_version, 'data' AS drift_type, 'psi' AS metric_name, round(overall_psi, 6) AS metric_value, 0.1::DOUBLE AS threshold, data_rank > 0 AS is_breached FROM j
UNION ALL SELECT model_version, 'prediction', 'hellinger', round(hellinger, 6), 0.1, pred_rank > 0 FROM j
UNION ALL SELECT model_version, 'concept', x.metric || '_drop', round(x.dropped, 6), x.warn, true FROM (SELECT model_version, unnest(degraded) AS x FROM j) u
UNION ALL SELECT model_version, 'concept', 'overall', 0.0, 0.0, false FROM j WHERE concept_rank = 0""")
def drift_result_rows(spark, sf_dir):
    rows = full_check(spark, sf_dir, ["model_version"]).results
    return rows.select(
        "model_version", "drift_type", "metric_name", r6("metric_value").alias("metric_value"), "threshold", "is_breached"
    )


@query("model_health", f"""SELECT {_name('greatest(data_rank, pred_rank, concept_rank)', 'healthy')} AS status, {_name('data_rank')} AS data_severity,
 {_name('pred_rank')} AS prediction_severity, {_name('concept_rank')} AS concept_severity, (SELECT max(ts) FROM events) AS last_checked {_joined([])}""")
def model_health(spark, sf_dir):
    health = R.model_health(full_check(spark, sf_dir, []).results)
    return health.withColumn("last_checked", F.col("last_checked").cast("timestamp_ntz"))


_DETAIL = divergence_sql(
    f"src AS ({_SRC}),\nlong AS (" + " UNION ALL ".join(
        f"SELECT model_version, '{f}' AS feature, NOT is_current AS is_ref, {f} AS value FROM src" for f in _FEATURES
    ) + ")", ["model_version"]
)


@query("feature_details", f"""{_DETAIL}, g AS (SELECT DISTINCT model_version, feature FROM long)
 SELECT g.model_version, g.feature, round(coalesce(psi, 0.0), 6) AS psi FROM g LEFT JOIN psi USING (model_version, feature)""")
def feature_details(spark, sf_dir):
    """Per-feature values unpacked again from the stored details."""
    rows = full_check(spark, sf_dir, ["model_version"]).results
    unpacked = R.details_map(rows.filter("drift_type = 'data'"))
    return unpacked.select("model_version", "feature", r6("value").alias("psi"))


@query("feature_names_seen", "SELECT f AS feature FROM (VALUES ('f_value'), ('f_latency'), ('f_flat')) v(f) WHERE EXISTS (SELECT 1 FROM events)")
def feature_names_seen(spark, sf_dir):
    return R.feature_names_seen(full_check(spark, sf_dir, ["model_version"]).results)


@query("metric_card", metric_sql(f"p AS (SELECT * FROM ({_SRC}) z WHERE is_current)") +
       "SELECT 'f1' AS metric, round(f1, 6) AS current, 0.95::DOUBLE AS baseline, round(f1 - 0.95, 6) AS delta FROM m")
def metric_card(spark, sf_dir):
    card = R.metric_card(full_check(spark, sf_dir, []).results, "f1")
    return card.select("metric", r6("current").alias("current"), "baseline", r6("delta").alias("delta"))


@query("retraining_decision_by_model", f"WITH i AS (SELECT model_version, overall_psi, f1_delta, hellinger, 0 AS streak {_joined(['model_version'])}) "
       + DECISION_SQL.format(keys="model_version, "))
def retraining_decision_by_model(spark, sf_dir):
    """Checks, summary and rules in one go, per model version."""
    by = ["model_version"]
    decided = decide.retraining_decision(decision_inputs(full_check(spark, sf_dir, by).summary, by=by))
    return decided.select(
        *by, "should_retrain", "action", "urgency", "reason", F.concat_ws(",", "triggered_rules").alias("triggered_rules")
    )


# -- stored results over time -------------------------------------------------------

_R = f"WITH r AS ({adapter_sql('drift_results')}) "


def _results(spark, sf_dir) -> DataFrame:
    return adapter(spark, sf_dir, "drift_results")


@query("drift_history", _R + "SELECT id, check_day, drift_type, round(metric_value, 6) AS metric_value, is_breached FROM r ORDER BY check_day DESC, id DESC LIMIT 50")
def drift_history(spark, sf_dir):
    found = R.drift_history(_results(spark, sf_dir), None, 50, "check_day")
    return found.select("id", "check_day", "drift_type", r6("metric_value").alias("metric_value"), "is_breached")


@query("drift_history_by_type", _R + "SELECT id, check_day, round(metric_value, 6) AS metric_value, is_breached FROM r WHERE drift_type = 'concept' ORDER BY check_day DESC, id DESC LIMIT 50")
def drift_history_by_type(spark, sf_dir):
    found = R.drift_history(_results(spark, sf_dir), "concept", 50, "check_day")
    return found.select("id", "check_day", r6("metric_value").alias("metric_value"), "is_breached")


@query("latest_results", _R + "SELECT drift_type, id, check_day, round(metric_value, 6) AS metric_value, is_breached FROM r QUALIFY row_number() OVER (PARTITION BY drift_type ORDER BY check_day DESC, id DESC) = 1")
def latest_results(spark, sf_dir):
    found = R.latest_results(_results(spark, sf_dir), "check_day")
    return found.select("drift_type", "id", "check_day", r6("metric_value").alias("metric_value"), "is_breached")


@query("metric_series", _R + """, s AS (SELECT * FROM r WHERE drift_type = 'data' ORDER BY check_day, id LIMIT 100)
 SELECT check_day, round(metric_value, 6) AS metric_value, round(metric_value - lag(metric_value) OVER (ORDER BY check_day, id), 6) AS change FROM s""")
def metric_series(spark, sf_dir):
    found = R.metric_series(_results(spark, sf_dir), "data", "psi", 100, "check_day")
    return found.select("check_day", r6("metric_value").alias("metric_value"), r6("change").alias("change"))


@query("health_badge", _R + f""", a AS ({adapter_sql('alerts')})
 SELECT CASE WHEN (SELECT count(*) FROM r) = 0 THEN 'No Data'
  WHEN NOT (SELECT is_breached FROM r ORDER BY check_day DESC, id DESC LIMIT 1) THEN 'Healthy'
  WHEN EXISTS (SELECT 1 FROM a WHERE severity = 'CRITICAL' AND NOT acknowledged) THEN 'Drift Critical' ELSE 'Drift Warning' END AS badge""")
def health_badge(spark, sf_dir):
    return R.health_badge(_results(spark, sf_dir), adapter(spark, sf_dir, "alerts"), "check_day")


_STREAK = """SELECT count(*) AS streak FROM w WHERE NOT EXISTS
 (SELECT 1 FROM w o WHERE NOT o.is_breached AND (o.check_day, o.id) >= (w.check_day, w.id))"""


@query("breach_streak", _R + ", w AS (SELECT * FROM r ORDER BY check_day DESC, id DESC LIMIT 50) " + _STREAK)
def breach_streak(spark, sf_dir):
    return decide.breach_streak(_results(spark, sf_dir), "check_day")


@query("breach_streak_whole", _R + ", w AS (SELECT * FROM r) " + _STREAK)
def breach_streak_whole(spark, sf_dir):
    return decide.breach_streak(_results(spark, sf_dir), "check_day", last=None)


@query("breach_streak_by_check", _R + ", w AS (SELECT check_day, max(id) AS id, bool_or(is_breached) AS is_breached FROM r GROUP BY 1) " + _STREAK)
def breach_streak_by_check(spark, sf_dir):
    return decide.breach_streak(_results(spark, sf_dir), "check_day", per_check=True)


@query("breach_streak_by_type", _R + """SELECT t.drift_type, (SELECT count(*) FROM r w WHERE w.drift_type = t.drift_type AND NOT EXISTS
 (SELECT 1 FROM r o WHERE o.drift_type = w.drift_type AND NOT o.is_breached AND (o.check_day, o.id) >= (w.check_day, w.id))) AS streak
 FROM (SELECT DISTINCT drift_type FROM r) t""")
def breach_streak_by_type(spark, sf_dir):
    return decide.breach_streak(_results(spark, sf_dir), "check_day", by=["drift_type"])


# -- retraining runs ------------------------------------------------------------------

_E = f"WITH e AS ({adapter_sql('retraining_events')}) "


@query("retraining_history", _E + """SELECT id, event_ts, old_version, status,
 CASE WHEN length(trigger_reason) > 60 THEN left(trigger_reason, 60) || '...' ELSE trigger_reason END AS trigger_reason FROM e ORDER BY event_ts DESC, id DESC LIMIT 20""")
def retraining_history(spark, sf_dir):
    found = R.retraining_listing(adapter(spark, sf_dir, "retraining_events"), 20, "event_ts")
    return found.select("id", "event_ts", "old_version", "status", "trigger_reason")


@query("retraining_state", _E + "SELECT old_version, id, status FROM e QUALIFY row_number() OVER (PARTITION BY old_version ORDER BY event_ts DESC, id DESC) = 1")
def retraining_state(spark, sf_dir):
    """Last event per run (the old version stands for the run)."""
    from ...operators.ranking import latest_per_key

    latest = latest_per_key(adapter(spark, sf_dir, "retraining_events"), ["old_version"], "event_ts")
    return latest.select("old_version", "id", "status")

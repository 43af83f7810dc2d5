"""Classification metrics, concept drift, ROC and AUC over labelled predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...config import DEFAULT_BASELINE_METRICS
from ...functions.columns import metric_delta_band
from ...operators import drift as D
from ...operators import metrics as M
from ...operators.prediction_log import recent_labelled
from ...schemas import REQUIRED_METRICS
from ...sources.fixtures import adapter, adapter_sql
from .registry import query, r6

_P = f"p AS ({adapter_sql('predictions')})"


def _predictions(spark, sf_dir):
    return adapter(spark, sf_dir, "predictions")


def metric_sql(source: str, y: str = "true_label", p: str = "predicted_label", keys: list[str] = ()) -> str:
    """CTEs ending in ``m(keys.., accuracy, f1, precision, recall, n)``."""
    k = "".join(f"{c}, " for c in keys)
    return f"""WITH {source},
c AS (SELECT {k}count(*) FILTER ({y} = 1 AND {p} = 1) AS tp, count(*) FILTER ({y} = 0 AND {p} = 1) AS fp,
      count(*) FILTER ({y} = 1 AND {p} = 0) AS fn, count(*) FILTER ({y} = 0 AND {p} = 0) AS tn,
      avg(CAST({y} = {p} AS INT)) AS accuracy, count({y}) AS n FROM p GROUP BY ALL),
pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision,
       CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall FROM c),
m AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr)
"""


_METRICS = "round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall, n"


def _metrics(frame, by=()):
    return frame.select(*by, *[r6(m).alias(m) for m in REQUIRED_METRICS], "n")


@query("confusion_matrix", f"""WITH {_P} SELECT a.v AS actual, b.v AS predicted, count(p.id) AS count
 FROM (VALUES (0), (1)) a(v), (VALUES (0), (1)) b(v) LEFT JOIN p ON p.true_label = a.v AND p.predicted_label = b.v GROUP BY 1, 2""")
def confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(_predictions(spark, sf_dir), "true_label", "predicted_label")


@query("confusion_matrix_recent", f"""WITH {_P}, w AS (SELECT * FROM p WHERE true_label IS NOT NULL ORDER BY pred_ts DESC, id DESC LIMIT 500)
 SELECT a.v AS actual, b.v AS predicted, count(w.id) AS count
 FROM (VALUES (0), (1)) a(v), (VALUES (0), (1)) b(v) LEFT JOIN w ON w.true_label = a.v AND w.predicted_label = b.v GROUP BY 1, 2""")
def confusion_matrix_recent(spark, sf_dir):
    window = recent_labelled(_predictions(spark, sf_dir), 500, "pred_ts")
    return M.confusion_matrix(window, "true_label", "predicted_label")


@query("binary_metrics", metric_sql(_P) + f"SELECT {_METRICS} FROM m")
def binary_metrics(spark, sf_dir):
    return _metrics(M.binary_metrics(_predictions(spark, sf_dir), "true_label", "predicted_label"))


@query("binary_metrics_by_model", metric_sql(_P, keys=["model_version"]) + f"SELECT model_version, {_METRICS} FROM m")
def binary_metrics_by_model(spark, sf_dir):
    by = ["model_version"]
    return _metrics(M.binary_metrics(_predictions(spark, sf_dir), "true_label", "predicted_label", by), by)


_PAIRS = f"p AS ({adapter_sql('concept_pairs')})"


@query("binary_metrics_documents", metric_sql(_PAIRS, "y_true", "y_pred") + f"SELECT {_METRICS} FROM m")
def binary_metrics_documents(spark, sf_dir):
    return _metrics(M.binary_metrics(adapter(spark, sf_dir, "concept_pairs"), "y_true", "y_pred"))


@query("class_report", f"""WITH {_P}, l AS (SELECT * FROM p WHERE true_label IS NOT NULL)
 SELECT k.v AS class, round(count(*) FILTER (true_label = k.v AND predicted_label = k.v) / count(*) FILTER (predicted_label = k.v), 6) AS precision,
 round(count(*) FILTER (true_label = k.v AND predicted_label = k.v) / count(*) FILTER (true_label = k.v), 6) AS recall,
 round(2 * count(*) FILTER (true_label = k.v AND predicted_label = k.v) / (count(*) FILTER (predicted_label = k.v) + count(*) FILTER (true_label = k.v)), 6) AS f1,
 count(*) FILTER (true_label = k.v) AS support FROM l, (VALUES (0), (1)) k(v) GROUP BY k.v""")
def class_report(spark, sf_dir):
    report = M.class_report(_predictions(spark, sf_dir), "true_label", "predicted_label")
    return report.select("class", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


# -- concept drift ------------------------------------------------------------

_BASE = "base(metric, b, warn, crit) AS (VALUES ('accuracy', 0.98, 0.03, 0.05), ('f1', 0.95, 0.03, 0.05), ('precision', 0.96, 0.05, 0.10), ('recall', 0.94, 0.05, 0.10))"


def _delta_sql(keys: list[str] = ()) -> str:
    k = "".join(f"{c}, " for c in keys)
    return metric_sql(_P, keys=list(keys)) + f""", {_BASE},
v AS (SELECT {k}metric, CASE metric WHEN 'accuracy' THEN accuracy WHEN 'f1' THEN f1 WHEN 'precision' THEN precision ELSE recall END AS cur, b, warn, crit
      FROM m, base WHERE n > 0),
d AS (SELECT *, CASE WHEN b - cur >= crit THEN 2 WHEN b - cur >= warn THEN 1 ELSE 0 END AS rank FROM v)
"""


@query("metric_deltas", _delta_sql() + """SELECT metric, round(cur, 6) AS current, round(CAST(b AS DOUBLE), 6) AS baseline, round(cur - b, 6) AS delta,
 CASE rank WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'none' END AS severity,
 CASE WHEN cur - b >= -0.03 THEN 'good' WHEN cur - b >= -0.05 THEN 'warning' ELSE 'bad' END AS band FROM d""")
def metric_deltas(spark, sf_dir):
    current = M.binary_metrics(_predictions(spark, sf_dir), "true_label", "predicted_label")
    deltas = D.metric_deltas(current, DEFAULT_BASELINE_METRICS)
    return deltas.select(
        "metric", r6("current").alias("current"), r6("baseline").alias("baseline"), r6("delta").alias("delta"),
        "severity", metric_delta_band(F.col("delta")).alias("band"),
    )


_VERDICT = """CASE max(rank) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'none' END AS severity, max(rank) > 0 AS is_drifted,
 coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (rank > 0), '') AS degraded_metrics,
 round(max(cur - b) FILTER (metric = 'f1'), 6) AS f1_delta FROM d"""


def _verdict(check, by=()):
    return check.select(
        *by, "severity", "is_drifted", F.concat_ws(",", "degraded_metrics").alias("degraded_metrics"),
        r6(F.col("metric_deltas")["f1"]).alias("f1_delta"),
    )


@query("concept_drift_check", _delta_sql() + "SELECT " + _VERDICT)
def concept_drift_check(spark, sf_dir):
    return _verdict(D.concept_drift_check(_predictions(spark, sf_dir), DEFAULT_BASELINE_METRICS))


@query("concept_drift_by_model", _delta_sql(["model_version"]) + "SELECT model_version, " + _VERDICT + " GROUP BY model_version")
def concept_drift_by_model(spark, sf_dir):
    by = ["model_version"]
    rows = _predictions(spark, sf_dir)
    values = [F.struct(F.lit(m).alias("metric"), F.lit(v).alias("value")) for m, v in DEFAULT_BASELINE_METRICS.items()]
    baseline = rows.select(*by).distinct().select(*by, F.explode(F.array(*values)).alias("b")).select(*by, "b.*")
    return _verdict(D.concept_drift_check(rows, baseline, by=by), by)


_VM = f"v AS ({adapter_sql('model_versions')})"


@query("baseline_metrics", f"""WITH {_VM}, c AS (SELECT * FROM v WHERE is_production)
 SELECT 'accuracy' AS metric, round(coalesce((SELECT accuracy FROM c), 0.98), 6) AS value UNION ALL
 SELECT 'f1', round(coalesce((SELECT f1_score FROM c), 0.95), 6) UNION ALL
 SELECT 'precision', round(coalesce((SELECT precision FROM c), 0.96), 6) UNION ALL
 SELECT 'recall', round(coalesce((SELECT recall FROM c), 0.94), 6)""")
def baseline_metrics(spark, sf_dir):
    """The production version's metrics; defaults where there are none."""
    production = adapter(spark, sf_dir, "model_versions").filter("is_production")
    return D.baseline_metrics(production, DEFAULT_BASELINE_METRICS).select("metric", r6("value").alias("value"))


@query("missing_baseline_metrics", f"""WITH {_VM}, need(metric) AS (VALUES ('accuracy'), ('f1'), ('precision'), ('recall'))
 SELECT version, metric FROM v, need WHERE (metric = 'f1' AND f1_score < 0.3) OR (metric = 'recall' AND recall < 0.5)""")
def missing_baseline_metrics(spark, sf_dir):
    """Versions whose baseline lacks a required metric (weak values left out here)."""
    versions = adapter(spark, sf_dir, "model_versions").withColumnRenamed("f1_score", "f1")
    weak = versions.withColumn("f1", F.when(F.col("f1") >= 0.3, F.col("f1"))).withColumn(
        "recall", F.when(F.col("recall") >= 0.5, F.col("recall"))
    )
    long = weak.unpivot(["version"], REQUIRED_METRICS, "metric", "value")
    return D.missing_baseline_metrics(long, ["version"])


# -- ROC ------------------------------------------------------------------------

def _roc_sql(keys: list[str] = ()) -> str:
    k = "".join(f"{c}, " for c in keys)
    part = "PARTITION BY " + ", ".join(keys) + " " if keys else ""
    return f"""WITH {_P}, g AS (SELECT {k}confidence AS threshold, count(*) FILTER (true_label = 1) AS a, count(*) FILTER (true_label = 0) AS z
 FROM p WHERE true_label IS NOT NULL GROUP BY ALL),
r AS (SELECT {k}threshold, a, z, sum(z) OVER o / sum(z) OVER ({part}) AS fpr, sum(a) OVER o / sum(a) OVER ({part}) AS tpr
 FROM g WINDOW o AS ({part}ORDER BY threshold DESC))
"""


@query("roc_curve", _roc_sql() + "SELECT round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM r")
def roc_curve(spark, sf_dir):
    points = M.roc_curve(_predictions(spark, sf_dir), "true_label", "confidence")
    return points.select(*[r6(c).alias(c) for c in ("threshold", "fpr", "tpr")])


@query("auc", _roc_sql() + """, t AS (SELECT fpr, tpr, lag(fpr, 1, 0.0) OVER (ORDER BY threshold DESC) AS f0,
 lag(tpr, 1, 0.0) OVER (ORDER BY threshold DESC) AS t0 FROM r) SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS auc FROM t""")
def auc(spark, sf_dir):
    return M.auc(_predictions(spark, sf_dir), "true_label", "confidence").select(r6("auc").alias("auc"))


@query("auc_by_model", _roc_sql(["model_version"]) + """, t AS (SELECT model_version, fpr, tpr,
 lag(fpr, 1, 0.0) OVER (PARTITION BY model_version ORDER BY threshold DESC) AS f0,
 lag(tpr, 1, 0.0) OVER (PARTITION BY model_version ORDER BY threshold DESC) AS t0 FROM r)
 SELECT model_version, round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS auc FROM t GROUP BY 1""")
def auc_by_model(spark, sf_dir):
    found = M.auc(_predictions(spark, sf_dir), "true_label", "confidence", ["model_version"])
    return found.select("model_version", r6("auc").alias("auc"))


@query("model_evaluation", metric_sql(_P) + _roc_sql().replace(f"WITH {_P}", "") + """, t AS (SELECT fpr, tpr, lag(fpr, 1, 0.0) OVER (ORDER BY threshold DESC) AS f0,
 lag(tpr, 1, 0.0) OVER (ORDER BY threshold DESC) AS t0 FROM r)
 SELECT tn, fp, fn, tp, """ + _METRICS + ", round((SELECT sum((fpr - f0) * (tpr + t0) / 2) FROM t), 6) AS auc_roc FROM m")
def model_evaluation(spark, sf_dir):
    """Everything an evaluation reports, from a scored table."""
    from ...operators.training import evaluate

    found = evaluate(_predictions(spark, sf_dir), "true_label")
    rounded = [r6(m).alias(m) for m in [*REQUIRED_METRICS, "auc_roc"]]
    return found.select("tn", "fp", "fn", "tp", "n", *rounded)


# -- over time --------------------------------------------------------------------

_DAILY = metric_sql(f"p AS (SELECT *, CAST(date_trunc('day', pred_ts) AS TIMESTAMP) AS day FROM ({adapter_sql('predictions')}) x WHERE true_label IS NOT NULL)", keys=["day"])


def _rolling(spark, sf_dir):
    rolled = M.rolling_metrics(_predictions(spark, sf_dir), "true_label", "predicted_label", "pred_ts")
    return rolled.withColumn("day", F.col("window_start").cast("timestamp_ntz"))


@query("rolling_metrics", _DAILY + f"SELECT day, {_METRICS} FROM m")
def rolling_metrics(spark, sf_dir):
    return _metrics(_rolling(spark, sf_dir), ["day"])


@query("metric_trend", _DAILY + "SELECT day, round(f1, 6) AS f1, round(f1 - lag(f1) OVER (ORDER BY day), 6) AS f1_change FROM m")
def metric_trend(spark, sf_dir):
    trend = M.metric_trend(_rolling(spark, sf_dir), "f1", "day")
    return trend.select("day", r6("f1").alias("f1"), r6("f1_change").alias("f1_change"))

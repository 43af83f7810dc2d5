"""Model versions: suppliers as versions, orders as promotions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import metrics as M
from ...operators import versions as V
from ...schemas import REQUIRED_METRICS
from ...sources.fixtures import adapter, adapter_sql
from .concept import metric_sql
from .registry import query, r6

_V = f"WITH v AS ({adapter_sql('model_versions')}) "
_VP = f"WITH v AS ({adapter_sql('model_versions')}), p AS (SELECT * FROM ({adapter_sql('promotions')}) x WHERE version IN (SELECT version FROM v)) "


def _versions(spark, sf_dir):
    return adapter(spark, sf_dir, "model_versions")


def _promotions(spark, sf_dir):
    return adapter(spark, sf_dir, "promotions")


@query("version_compare", _V + """, l AS (SELECT version, 'accuracy' AS metric, accuracy AS value FROM v UNION ALL SELECT version, 'f1_score', f1_score FROM v
 UNION ALL SELECT version, 'precision', precision FROM v UNION ALL SELECT version, 'recall', recall FROM v)
 SELECT version, 'v' || version AS label, metric, round(value, 6) AS value, round(value - lag(value) OVER (PARTITION BY metric ORDER BY version), 6) AS change FROM l""")
def version_compare(spark, sf_dir):
    return V.version_changes(_versions(spark, sf_dir)).withColumn("value", r6("value")).withColumn("change", r6("change"))


@query("champion_gate", _V + """, c AS (SELECT * FROM v WHERE is_production)
 SELECT v.version, CASE WHEN NOT EXISTS (SELECT 1 FROM c) THEN 'DEPLOY'
  WHEN v.f1_score > (SELECT f1_score FROM c) AND v.accuracy >= (SELECT accuracy FROM c) * 0.98 THEN 'DEPLOY'
  WHEN v.f1_score > (SELECT f1_score FROM c) * 1.02 THEN 'DEPLOY' ELSE 'KEEP' END AS recommendation FROM v""")
def champion_gate(spark, sf_dir):
    return V.gate_all(_versions(spark, sf_dir)).select("version", "recommendation")


_MODELS = metric_sql(f"p AS ({adapter_sql('predictions')})", keys=["model_version"])


@query("compare_models", _MODELS + """SELECT round(n.f1 - c.f1, 6) AS f1_delta, n.f1 > c.f1 AS is_improved,
 CASE WHEN (n.f1 > c.f1 AND n.accuracy >= 0.98 * c.accuracy) OR n.f1 > 1.02 * c.f1 THEN 'DEPLOY' ELSE 'KEEP' END AS recommendation
 FROM m c, m n WHERE c.model_version = 'v1' AND n.model_version = 'v2'""")
def compare_models(spark, sf_dir):
    """Champion v1 against challenger v2 on their labelled predictions."""
    metrics = M.binary_metrics(adapter(spark, sf_dir, "predictions"), "true_label", "predicted_label", ["model_version"])
    long = metrics.unpivot(["model_version"], REQUIRED_METRICS, "metric", "value")
    side = lambda v: long.filter(F.col("model_version") == v).drop("model_version")
    out = V.compare_models(side("v1"), side("v2"))
    return out.select(r6(F.col("metric_deltas")["f1"]).alias("f1_delta"), "is_improved", "recommendation")


@query("promotion_state", _VP + """SELECT v.version, v.version = (SELECT version FROM p ORDER BY promoted_at DESC, version DESC LIMIT 1) AS is_production,
 (SELECT max(promoted_at) FROM p WHERE p.version = v.version) AS deployed_at FROM v""")
def promotion_state(spark, sf_dir):
    state = V.promotion_state(_versions(spark, sf_dir), _promotions(spark, sf_dir))
    return state.select("version", "is_production", "deployed_at")


@query("unknown_versions", _V + f"SELECT id, version FROM ({adapter_sql('promotions')}) x WHERE version NOT IN (SELECT version FROM v)")
def unknown_versions(spark, sf_dir):
    """Roll-back requests that must be refused."""
    return V.unknown_versions(_promotions(spark, sf_dir), _versions(spark, sf_dir)).select("id", "version")


@query("duplicate_versions", "SELECT CAST(o_custkey % 1200 AS INT) AS version, count(*) AS copies FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_versions(spark, sf_dir):
    return V.duplicate_versions(_promotions(spark, sf_dir))


@query("current_model", _VP + "SELECT version, round(f1_score, 6) AS f1_score FROM v WHERE version = (SELECT version FROM p ORDER BY promoted_at DESC, version DESC LIMIT 1)")
def current_model(spark, sf_dir):
    state = V.promotion_state(_versions(spark, sf_dir), _promotions(spark, sf_dir))
    return V.current_model(state).select("version", r6("f1_score").alias("f1_score"))


@query("version_listing", _V + "SELECT version, round(accuracy, 6) AS accuracy, round(f1_score, 6) AS f1_score FROM v ORDER BY version DESC LIMIT 20")
def version_listing(spark, sf_dir):
    found = V.version_listing(_versions(spark, sf_dir), 20)
    return found.select("version", r6("accuracy").alias("accuracy"), r6("f1_score").alias("f1_score"))


@query("deployment_history", _VP + """, t AS (SELECT v.version, max(promoted_at) AS deployed_at FROM v LEFT JOIN p USING (version) GROUP BY 1)
 SELECT version, deployed_at FROM t ORDER BY deployed_at DESC NULLS LAST, version DESC LIMIT 50""")
def deployment_history(spark, sf_dir):
    state = V.promotion_state(_versions(spark, sf_dir), _promotions(spark, sf_dir))
    return V.deployment_history(state).select("version", "deployed_at")

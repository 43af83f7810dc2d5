"""Adapters: the test tables in the shapes of the monitoring tables.

Each adapter is one SQL text that Spark and the checking engine both read, with
the base table as a placeholder.  Every adapter keeps all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

#: Split points of the two-sided checks.
FEATURE_SPLIT = "TIMESTAMP '1996-01-01 00:00:00'"
EVENT_SPLIT = "TIMESTAMP '2024-01-16 00:00:00'"

LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

_CONFIDENCE = "(CASE WHEN value >= 400 THEN CAST(1 AS DOUBLE) ELSE value / 400 END)"
_TRUE_LABEL = (
    "CASE WHEN event_id % 5 = 0 THEN NULL WHEN user_id % 10 = 0 THEN 1 - CAST(value >= 50 AS INT) "
    "ELSE CAST(value >= 50 AS INT) END"
)

ADAPTERS: dict[str, str] = {
    "predictions": f"""
        SELECT event_id AS id, ts AS pred_ts,
               concat('v', CAST(event_id % 3 + 1 AS STRING)) AS model_version,
               props AS features_json, user_id,
               CAST(value >= 50 AS INT) AS predicted_label,
               {_CONFIDENCE} AS confidence,
               {_TRUE_LABEL} AS true_label,
               5 + value / 10 AS latency_ms
        FROM {{events}}""",
    # the second half's confidences scaled: a hellinger warning
    "predictions_shifted": f"""
        SELECT event_id AS id, ts AS pred_ts, ts >= {EVENT_SPLIT} AS is_current,
               concat('v', CAST(event_id % 3 + 1 AS STRING)) AS model_version,
               CAST(value >= 50 AS INT) AS predicted_label,
               {_CONFIDENCE} * (CASE WHEN ts >= {EVENT_SPLIT} THEN CAST(6 AS DOUBLE) / 10 ELSE CAST(1 AS DOUBLE) END)
                 AS confidence,
               {_TRUE_LABEL} AS true_label,
               value AS f_value, latency AS f_latency, CAST(7 AS DOUBLE) AS f_flat
        FROM (SELECT *, 5 + value / 10 + (CASE WHEN ts >= {EVENT_SPLIT} THEN 3 ELSE 0 END) AS latency FROM {{events}}) e""",
    "features": f"""
        SELECT CASE WHEN l_shipdate < {FEATURE_SPLIT} THEN 'ref' ELSE 'cur' END AS side,
               l_quantity, l_extendedprice, l_discount, l_tax,
               CAST(l_returnflag = 'R' AS INT) AS label, l_returnflag, l_linenumber, l_shipdate, l_orderkey
        FROM {{lineitem}}""",
    # current side drifted: quantity critical, price warning, the others none
    "features_shifted": f"""
        SELECT CASE WHEN l_shipdate < {FEATURE_SPLIT} THEN 'ref' ELSE 'cur' END AS side,
               CASE WHEN l_shipdate < {FEATURE_SPLIT} THEN l_quantity ELSE l_quantity + 10 END AS l_quantity,
               CASE WHEN l_shipdate >= {FEATURE_SPLIT} AND l_quantity > 30 THEN l_extendedprice / 2
                    ELSE l_extendedprice END AS l_extendedprice,
               l_discount, l_tax, l_returnflag, l_linenumber, l_shipdate, l_orderkey
        FROM {{lineitem}}""",
    "alerts": """
        SELECT event_id AS id, ts AS alert_ts,
               CASE WHEN event_type = 'error' THEN 'CRITICAL' WHEN event_type = 'signup' THEN 'RESOLVED' ELSE 'WARNING' END AS severity,
               CASE user_id % 3 WHEN 0 THEN 'data' WHEN 1 THEN 'prediction' ELSE 'concept' END AS drift_type,
               CASE user_id % 3 WHEN 0 THEN 'psi' WHEN 1 THEN 'hellinger' ELSE 'f1_drop' END AS metric_name,
               value / 400 AS metric_value, CAST(1 AS DOUBLE) / 10 AS threshold,
               event_id % 4 = 0 AS acknowledged
        FROM {events}""",
    # one row per day and drift type
    "drift_results": """
        SELECT CAST(date_trunc('day', ts) AS DATE) AS check_day,
               CASE user_id % 3 WHEN 0 THEN 'data' WHEN 1 THEN 'prediction' ELSE 'concept' END AS drift_type,
               CASE user_id % 3 WHEN 0 THEN 'psi' WHEN 1 THEN 'hellinger' ELSE 'f1_drop' END AS metric_name,
               datediff_days * 3 + user_id % 3 AS id,
               avg(value) / 400 AS metric_value, avg(value) >= 45 AS is_breached
        FROM (SELECT *, extract(day FROM ts) AS datediff_days FROM {events}) e
        GROUP BY 1, 2, 3, 4""",
    "model_versions": """
        SELECT CAST(s_suppkey AS INT) AS version, abs(s_acctbal) / 10000 AS f1_score,
               0.5 + (s_suppkey % 50) / CAST(100 AS DOUBLE) AS accuracy,
               0.4 + (s_suppkey % 60) / CAST(100 AS DOUBLE) AS precision,
               0.3 + (s_suppkey % 70) / CAST(100 AS DOUBLE) AS recall,
               s_suppkey = 42 AS is_production
        FROM {supplier}""",
    # orders as promotion requests: some name versions that do not exist
    "promotions": """
        SELECT o_orderkey AS id, CAST(o_custkey % 1200 AS INT) AS version, o_orderdate AS promoted_at
        FROM {orders}""",
    "retraining_events": """
        SELECT o_orderkey AS id, o_orderdate AS event_ts, CAST(o_custkey % 100 AS INT) AS old_version,
               concat('order priority ', o_orderpriority, ' of customer ', CAST(o_custkey AS STRING),
                      ' asked for a retrain because of drift') AS trigger_reason,
               CASE o_orderstatus WHEN 'O' THEN 'STARTED' WHEN 'F' THEN 'COMPLETED' ELSE 'REJECTED' END AS status
        FROM {orders}""",
    # one drift summary per order, with the inputs of the rules and some gaps
    "decision_inputs": """
        SELECT o_orderkey AS id, o_orderdate AS event_ts,
               CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE (o_custkey % 400) / 1000 END AS overall_psi,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey % 161 - 80) / 1000 END AS f1_delta,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_custkey % 31) / 100 END AS hellinger,
               o_orderkey % 6 AS streak
        FROM {orders}""",
    "concept_pairs": "SELECT doc_id AS id, quality AS y_true, 1 - toxic AS y_pred FROM {labels}",
    "order_features": """
        SELECT o_orderkey AS id, o_totalprice AS price, CAST(o_custkey % 97 AS DOUBLE) AS cust,
               CAST(o_orderpriority = '1-URGENT' AS INT) AS label
        FROM {orders}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bases(text: str) -> list[str]:
    return [t for t in BASE_TABLES if "{" + t + "}" in text]


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = ADAPTERS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in _bases(text)})


def adapter_sql(name: str) -> str:
    """The adapter over plain table names, for the checking engine."""
    text = ADAPTERS[name]
    return text.format(**{t: t for t in _bases(text)}).strip()


def with_adapters(body: str, *names: str, more: str = "") -> str:
    """``body`` behind CTEs for the named adapters (and any ``more`` CTEs)."""
    ctes = [f"{n} AS ({adapter_sql(n)})" for n in names]
    if more:
        ctes.append(more)
    return "WITH " + ",\n".join(ctes) + "\n" + body

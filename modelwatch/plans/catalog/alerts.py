"""Alert queries: every event is an alert."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.columns import active_alert_band, truncate
from ...operators import alerts as A
from ...sources.fixtures import adapter, adapter_sql, table
from .registry import query, r6

_A = f"WITH a AS ({adapter_sql('alerts')}) "
_KEPT = ["id", "alert_ts", "severity", "drift_type", "metric_name"]


def _alerts(spark, sf_dir):
    return adapter(spark, sf_dir, "alerts")


@query("active_alerts", _A + f"SELECT {', '.join(_KEPT)} FROM a WHERE NOT acknowledged ORDER BY alert_ts DESC, id DESC LIMIT 20")
def active_alerts(spark, sf_dir):
    return A.active_alerts(_alerts(spark, sf_dir), 20, "alert_ts").select(*_KEPT)


@query("alert_history", _A + f"SELECT {', '.join(_KEPT)} FROM a ORDER BY alert_ts DESC, id DESC LIMIT 50")
def alert_history(spark, sf_dir):
    return A.alert_history(_alerts(spark, sf_dir), 50, ts="alert_ts").select(*_KEPT)


@query("alert_history_filtered", _A + f"SELECT {', '.join(_KEPT)} FROM a WHERE severity = 'CRITICAL' AND drift_type = 'data' ORDER BY alert_ts DESC, id DESC LIMIT 50")
def alert_history_filtered(spark, sf_dir):
    return A.alert_history(_alerts(spark, sf_dir), 50, "CRITICAL", "data", "alert_ts").select(*_KEPT)


@query("alert_ack", _A + """SELECT id, acknowledged OR id IN (SELECT o_custkey FROM orders) AS acknowledged FROM a""")
def alert_ack(spark, sf_dir):
    """Acknowledgement events (order customers as alert ids) applied to alerts."""
    acks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return A.with_acknowledgements(_alerts(spark, sf_dir), acks).select("id", "acknowledged")


@query("unmatched_acknowledgements", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events)")
def unmatched_acknowledgements(spark, sf_dir):
    acks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return A.unmatched_acknowledgements(_alerts(spark, sf_dir), acks)


@query("alert_stats", _A + """SELECT 'all' AS dimension, 'all' AS name, count(*) AS total, count(*) FILTER (NOT acknowledged) AS active FROM a
 UNION ALL SELECT 'severity', severity, count(*), count(*) FILTER (NOT acknowledged) FROM a GROUP BY severity
 UNION ALL SELECT 'drift_type', drift_type, count(*), count(*) FILTER (NOT acknowledged) FROM a GROUP BY drift_type""")
def alert_stats(spark, sf_dir):
    return A.alert_stats(_alerts(spark, sf_dir))


@query("active_alert_card", _A + """SELECT count(*) FILTER (NOT acknowledged) AS active, count(*) AS total,
 CASE WHEN count(*) FILTER (NOT acknowledged) = 0 THEN 'good' WHEN count(*) FILTER (NOT acknowledged) < 3 THEN 'warning' ELSE 'bad' END AS band FROM a""")
def active_alert_card(spark, sf_dir):
    whole = A.alert_stats(_alerts(spark, sf_dir)).filter("dimension = 'all'")
    return whole.select("active", "total", active_alert_band(F.col("active")).alias("band"))


@query("alert_frequency", _A + "SELECT date_trunc('hour', alert_ts) AS hour, severity, count(*) AS count FROM a GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 200")
def alert_frequency(spark, sf_dir):
    return A.alert_frequency(_alerts(spark, sf_dir), 200, "alert_ts")


@query("alert_frequency_wide", _A + """SELECT date_trunc('hour', alert_ts) AS hour, count(*) FILTER (severity = 'CRITICAL') AS critical,
 count(*) FILTER (severity = 'WARNING') AS warning, count(*) FILTER (severity = 'RESOLVED') AS resolved FROM a GROUP BY 1""")
def alert_frequency_wide(spark, sf_dir):
    wide = A.alert_frequency_wide(_alerts(spark, sf_dir), "alert_ts")
    return wide.select("hour", *[F.col(c).alias(c.lower()) for c in ("CRITICAL", "WARNING", "RESOLVED")])


@query("resolved_count", _A + "SELECT count(*) AS resolved FROM a WHERE severity = 'RESOLVED'")
def resolved_count(spark, sf_dir):
    return A.resolved_count(_alerts(spark, sf_dir))


_DEDUP = _A + """, l AS (SELECT *, lag(alert_ts) OVER (PARTITION BY drift_type, metric_name ORDER BY alert_ts, id) AS prev FROM a)
"""
_REPEAT = "coalesce(alert_ts - prev <= INTERVAL 30 MINUTE, false)"


@query("alert_dedup", _DEDUP + f"SELECT id, drift_type, metric_name, {_REPEAT} AS suppressed FROM l")
def alert_dedup(spark, sf_dir):
    flagged = A.suppress_repeats(_alerts(spark, sf_dir), "alert_ts")
    return flagged.select("id", "drift_type", "metric_name", "suppressed")


@query("alert_dispatched", _DEDUP + f"SELECT drift_type, severity, count(*) AS sent FROM l WHERE NOT {_REPEAT} GROUP BY 1, 2")
def alert_dispatched(spark, sf_dir):
    sent = A.dispatched(_alerts(spark, sf_dir), ts="alert_ts")
    return sent.groupBy("drift_type", "severity").agg(F.count(F.lit(1)).alias("sent"))


@query("alert_rows", _A + """SELECT id, severity, drift_type, 'all' AS channel, false AS acknowledged,
 CASE WHEN metric_value > threshold THEN 'EXCEEDED' ELSE 'OK' END AS status,
 format('{:.6f}', round(metric_value, 6)) AS shown_value FROM a""")
def alert_rows(spark, sf_dir):
    """Rows for the alert table; status and value are read back out of the boxed text."""
    raised = _alerts(spark, sf_dir).withColumn("metric_value", r6("metric_value"))
    made = A.alert_rows(raised, "alert_ts")
    return made.select(
        "id", "severity", "drift_type", "channel", "acknowledged",
        F.regexp_extract("message", r"Status   : (\w+)", 1).alias("status"),
        F.regexp_extract("message", r"Value    : (\S+)", 1).alias("shown_value"),
    )


@query("alert_listing", """WITH a AS (SELECT o_orderkey AS id, o_orderdate AS ts, concat(o_orderpriority, ' order ', CAST(o_orderkey AS STRING), ' of customer ', CAST(o_custkey AS STRING),
  repeat(' needs a look', CAST(1 + o_orderkey % 6 AS INT))) AS message FROM orders)
 SELECT id, CASE WHEN length(message) > 80 THEN left(message, 80) || '...' ELSE message END AS short80,
 left(message, 100) AS short100, CASE WHEN length(message) > 60 THEN left(message, 60) || '...' ELSE message END AS short60 FROM a""")
def alert_listing(spark, sf_dir):
    """Texts cut for listings."""
    text = F.concat(
        "o_orderpriority", F.lit(" order "), F.col("o_orderkey").cast("string"), F.lit(" of customer "),
        F.col("o_custkey").cast("string"), F.expr("repeat(' needs a look', cast(1 + o_orderkey % 6 as int))"),
    )
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.alias("message"))
    message = F.col("message")
    return rows.select(
        "id",
        truncate(message, 80).alias("short80"),
        truncate(message, 100, ellipsis=False).alias("short100"),
        truncate(message, 60).alias("short60"),
    )

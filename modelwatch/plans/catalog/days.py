"""Checks between ranges of days, answered from what is stored per day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...session import scratch_dir
from ...sources.days import DayStore
from ...sources.fixtures import adapter, adapter_sql
from ...sources.scores import ScoreStore
from .data_drift import _DECILES, divergence_sql
from .registry import query, r6

_FEATURES = ["f_value", "f_latency"]


def _long(reference: str, current: str) -> str:
    inside = f"date BETWEEN {reference} OR date BETWEEN {current}"
    parts = [f"SELECT model_version, '{f}' AS feature, date BETWEEN {reference} AS is_ref, {f} AS value FROM src" for f in _FEATURES]
    return f"src AS (SELECT * FROM (SELECT *, CAST(pred_ts AS DATE) AS date FROM ({adapter_sql('predictions_shifted')}) x) y WHERE {inside}),\nlong AS ({' UNION ALL '.join(parts)})"


def _days(first: int, last: int) -> tuple[tuple[str, str], str]:
    span = (f"2024-01-{first:02}", f"2024-01-{last:02}")
    return span, f"DATE '{span[0]}' AND DATE '{span[1]}'"


def _stored(spark, sf_dir: str) -> DayStore:
    """The log put in two parts, the second of which is put again."""
    rows = adapter(spark, sf_dir, "predictions_shifted").withColumn("date", F.col("pred_ts").cast("date"))
    store = DayStore(spark, scratch_dir(spark, "days"), ["model_version"])
    store.put(rows.filter("NOT is_current"), _FEATURES)
    for _ in range(2):
        store.put(rows.filter("is_current"), _FEATURES)
    return store


(_FIRST, _FIRST_SQL), (_SECOND, _SECOND_SQL) = _days(1, 15), _days(16, 30)
(_WEEK, _WEEK_SQL), (_LATER, _LATER_SQL) = _days(4, 10), _days(13, 19)
_PSI = "SELECT model_version, feature, round(psi, 6) AS psi, round(kl, 6) AS kl FROM psi"


@query("data_drift_days", divergence_sql(_long(_FIRST_SQL, _SECOND_SQL), ["model_version"]) + _PSI)
def data_drift_days(spark, sf_dir):
    """Drift per model between the halves of the month, from counts per day."""
    found = _stored(spark, sf_dir).drift(_FIRST, _SECOND)
    return found.select("model_version", "feature", r6("psi").alias("psi"), r6("kl").alias("kl"))


@query("data_drift_week_to_week", divergence_sql(_long(_WEEK_SQL, _LATER_SQL), ["model_version"]) + _PSI)
def data_drift_week_to_week(spark, sf_dir):
    """The same store asked for two weeks that nothing was prepared for."""
    found = _stored(spark, sf_dir).drift(_WEEK, _LATER)
    return found.select("model_version", "feature", r6("psi").alias("psi"), r6("kl").alias("kl"))


@query("quantile_edges_days", f"""WITH {_long(*(_days(4, 20)[1],) * 2)},
 q AS (SELECT model_version, feature, list_sort(list_distinct(quantile_cont(value, {_DECILES}))) AS edges FROM long GROUP BY ALL)
 SELECT model_version, feature, CAST(generate_subscripts(edges, 1) - 1 AS INT) AS edge_no, round(unnest(edges), 6) AS edge FROM q""")
def quantile_edges_days(spark, sf_dir):
    """Exact deciles of any range of days: cells bracket them, the values of those
    cells alone are read."""
    profile = _stored(spark, sf_dir).profile(_days(4, 20)[0])
    edges = profile.select("model_version", "feature", F.posexplode(F.array(*[f"e{i}" for i in range(11)])).alias("edge_no", "edge"))
    return edges.filter("edge IS NOT NULL").withColumn("edge", r6("edge"))


_SCORED = "SELECT *, CAST(pred_ts AS DATE) AS day FROM (" + adapter_sql("predictions") + ") x WHERE true_label IS NOT NULL"
_SPANS = [("first", "2024-01-01", "2024-01-15"), ("middle", "2024-01-10", "2024-01-20"), ("month", "2024-01-01", "2024-01-31")]


@query("auc_days", f"""WITH p AS ({_SCORED}), spans(span, low, high) AS (VALUES {', '.join(f"('{n}', DATE '{a}', DATE '{z}')" for n, a, z in _SPANS)}),
 g AS (SELECT span, model_version, confidence, count(*) FILTER (true_label = 1) AS a, count(*) FILTER (true_label = 0) AS z FROM p JOIN spans ON day BETWEEN low AND high GROUP BY ALL),
 r AS (SELECT *, sum(a) OVER (PARTITION BY span, model_version ORDER BY confidence DESC) - a / 2.0 AS won FROM g)
 SELECT span, model_version, CAST(sum(a) AS BIGINT) AS pos, CAST(sum(z) AS BIGINT) AS neg, round(sum(z * won) / (CAST(sum(a) AS DOUBLE) * sum(z)), 6) AS auc FROM r GROUP BY ALL HAVING sum(a) > 0 AND sum(z) > 0""")
def auc_days(spark, sf_dir):
    """AUC by model over three ranges of days, from stored counts."""
    store = ScoreStore(spark, scratch_dir(spark, "scores"), ["model_version"])
    store.put(adapter(spark, sf_dir, "predictions"), day="pred_ts")
    found = [store.auc((a, z)).select(F.lit(n).alias("span"), "model_version", "pos", "neg", r6("auc").alias("auc")) for n, a, z in _SPANS]
    return reduce(DataFrame.unionByName, found)

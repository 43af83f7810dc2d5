"""Prediction drift over events: the first half of January 2024 is the baseline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.columns import confidence_delta_band, hellinger_label, rate_delta_band
from ...operators import bins as B
from ...operators import drift as D
from ...operators.prediction_log import positive_rate, recent
from ...sources.fixtures import EVENT_SPLIT, adapter, adapter_sql
from .data_drift import histogram_sql
from .registry import query, r6


def _sided(spark, sf_dir):
    rows = adapter(spark, sf_dir, "predictions")
    return rows.withColumn("is_current", F.col("pred_ts") >= F.expr(EVENT_SPLIT.replace("TIMESTAMP ", "TIMESTAMP_NTZ ")))


def hellinger_sql(source: str, keys: list[str] = (), bins: int = 20) -> str:
    """CTEs ending in ``hel(keys.., hellinger)`` by a range join on borders."""
    k = "".join(f"{c}, " for c in keys)
    on = "".join(f" AND p.{c} = g.{c}" for c in keys)
    return f"""WITH p AS ({source}),
lim AS (SELECT {k}min(confidence) AS lo, max(confidence) AS hi FROM p GROUP BY ALL),
g AS (SELECT {k}i, lo + i * ((hi - lo) / {bins}.0) AS a,
      CASE WHEN i = {bins} - 1 THEN hi ELSE lo + (i + 1) * ((hi - lo) / {bins}.0) END AS z FROM lim, range({bins}) t(i)),
c AS (SELECT {''.join(f'g.{c}, ' for c in keys)}g.i, count(*) FILTER (NOT is_current) AS b, count(*) FILTER (is_current) AS n
      FROM g JOIN p ON p.confidence >= g.a AND (p.confidence < g.z OR (g.i = {bins} - 1 AND p.confidence = g.z)){on} GROUP BY ALL),
s AS (SELECT *, b / sum(b) OVER w AS pb, n / sum(n) OVER w AS pn FROM c WINDOW w AS ({'PARTITION BY ' + ', '.join(keys) if keys else ''})),
hel AS (SELECT {k}sqrt(sum((sqrt(pb) - sqrt(pn)) ** 2) / 2) AS hellinger FROM s GROUP BY ALL)
"""


_TWO = f"SELECT *, pred_ts >= {EVENT_SPLIT} AS is_current FROM ({adapter_sql('predictions')}) x"
_SHIFTED = adapter_sql("predictions_shifted")


@query("hellinger_confidence", hellinger_sql(_TWO) + "SELECT round(hellinger, 6) AS hellinger FROM hel")
def hellinger_confidence(spark, sf_dir):
    rows = _sided(spark, sf_dir).withColumn("is_ref", ~F.col("is_current"))
    return D.hellinger(B.equal_width_counts(rows, "confidence", "is_ref")).select(r6("hellinger").alias("hellinger"))


@query("equal_width_histogram", hellinger_sql(_SHIFTED) + "SELECT CAST(i AS INT) AS bin, b AS ref_count, n AS cur_count FROM c")
def equal_width_histogram(spark, sf_dir):
    rows = adapter(spark, sf_dir, "predictions_shifted").withColumn("is_ref", ~F.col("is_current"))
    return B.equal_width_counts(rows, "confidence", "is_ref")


_CHECK_COLUMNS = """round(hellinger, 6) AS hellinger, round(b_rate, 6) AS baseline_positive_rate, round(c_rate, 6) AS current_positive_rate,
 round(b_conf, 6) AS baseline_mean_confidence, round(c_conf, 6) AS current_mean_confidence,
 CASE WHEN hellinger >= 0.20 THEN 'critical' WHEN hellinger >= 0.10 THEN 'warning' ELSE 'none' END AS severity,
 hellinger >= 0.10 AS is_drifted,
 round(CASE WHEN b_rate = 0 THEN 0 ELSE (c_rate - b_rate) / b_rate * 100 END, 6) AS positive_rate_change_pct"""
_RATES = """avg(predicted_label) FILTER (NOT is_current) AS b_rate, avg(predicted_label) FILTER (is_current) AS c_rate,
 avg(confidence) FILTER (NOT is_current) AS b_conf, avg(confidence) FILTER (is_current) AS c_conf"""


def _rounded(checked, by=()):
    plain = [*by, "severity", "is_drifted"]
    return checked.select(*plain, *[r6(c).alias(c) for c in checked.columns if c not in plain])


@query("prediction_drift_check", hellinger_sql(_SHIFTED) + f"SELECT {_CHECK_COLUMNS} FROM hel, (SELECT {_RATES} FROM p) r")
def prediction_drift_check(spark, sf_dir):
    return _rounded(D.prediction_drift_check(adapter(spark, sf_dir, "predictions_shifted")))


@query("prediction_drift_stable", hellinger_sql(_TWO) + f"SELECT {_CHECK_COLUMNS} FROM hel, (SELECT {_RATES} FROM p) r")
def prediction_drift_stable(spark, sf_dir):
    return _rounded(D.prediction_drift_check(_sided(spark, sf_dir)))


@query("prediction_drift_by_model", hellinger_sql(_SHIFTED, ["model_version"]) +
       f"SELECT model_version, {_CHECK_COLUMNS} FROM hel JOIN (SELECT model_version, {_RATES} FROM p GROUP BY 1) r USING (model_version)")
def prediction_drift_by_model(spark, sf_dir):
    by = ["model_version"]
    return _rounded(D.prediction_drift_check(adapter(spark, sf_dir, "predictions_shifted"), by=by), by)


@query("prediction_cards", hellinger_sql(_SHIFTED) + f"""SELECT
 CASE WHEN hellinger < 0.10 THEN 'Stable' WHEN hellinger < 0.20 THEN 'Moderate' ELSE 'Significant' END AS label,
 round(c_rate - b_rate, 6) AS rate_delta,
 CASE WHEN abs(c_rate - b_rate) < 0.02 THEN 'good' WHEN abs(c_rate - b_rate) < 0.05 THEN 'warning' ELSE 'bad' END AS rate_band,
 round(c_conf - b_conf, 6) AS confidence_delta,
 CASE WHEN abs(c_conf - b_conf) < 0.05 THEN 'good' ELSE 'warning' END AS confidence_band
 FROM hel, (SELECT {_RATES} FROM p) r""")
def prediction_cards(spark, sf_dir):
    checked = D.prediction_drift_check(adapter(spark, sf_dir, "predictions_shifted"))
    rate = F.col("current_positive_rate") - F.col("baseline_positive_rate")
    conf = F.col("current_mean_confidence") - F.col("baseline_mean_confidence")
    return checked.select(
        hellinger_label(F.col("hellinger")).alias("label"),
        r6(rate).alias("rate_delta"),
        rate_delta_band(rate).alias("rate_band"),
        r6(conf).alias("confidence_delta"),
        confidence_delta_band(conf).alias("confidence_band"),
    )


@query("confidence_histogram_recent", histogram_sql(
    f"SELECT * FROM ({adapter_sql('predictions')}) p ORDER BY pred_ts DESC, id DESC LIMIT 500", "confidence", 50))
def confidence_histogram_recent(spark, sf_dir):
    """Confidences of the newest 500 predictions on 50 equal bins."""
    window = recent(adapter(spark, sf_dir, "predictions"), 500, "pred_ts")
    return _histogram(window)


@query("confidence_histogram", histogram_sql(adapter_sql("predictions"), "confidence", 50))
def confidence_histogram(spark, sf_dir):
    return _histogram(adapter(spark, sf_dir, "predictions"))


def _histogram(rows):
    return B.histogram(rows, "confidence").select(
        "bin", F.round("bin_start", 4).alias("bin_start"), "count", r6("density").alias("density")
    )


@query("positive_rate_trend", f"""SELECT CAST(pred_ts AS DATE) AS day, round(avg(predicted_label), 6) AS positive_rate,
 round(avg(confidence), 6) AS mean_confidence FROM ({adapter_sql('predictions')}) p GROUP BY 1""")
def positive_rate_trend(spark, sf_dir):
    rows = adapter(spark, sf_dir, "predictions").withColumn("day", F.col("pred_ts").cast("date"))
    return positive_rate(rows, ["day"]).select(
        "day", r6("positive_rate").alias("positive_rate"), r6("mean_confidence").alias("mean_confidence")
    )


@query("prediction_baseline_rows", f"""SELECT predicted_label, round(confidence, 6) AS confidence FROM
 (SELECT * FROM ({adapter_sql('predictions')}) p ORDER BY pred_ts DESC, id DESC LIMIT 500) w""")
def prediction_baseline_rows(spark, sf_dir):
    """Baseline for prediction drift: the newest window, since it is long enough."""
    window = recent(adapter(spark, sf_dir, "predictions"), 500, "pred_ts")
    return D.prediction_baseline(window, 100).select("predicted_label", r6("confidence").alias("confidence"))

"""Queries over rows that lack a key, a label or a feature, values beyond the
reference, and cycles that run twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...config import DEFAULT_BASELINE_METRICS, Settings
from ...operators import alerts as A
from ...operators import bins as B
from ...operators import dataset as S
from ...operators import drift as D
from ...operators import inject as J
from ...operators.results import drift_result_rows
from ...operators.sizing import attach_row
from ...sources.fixtures import LINE_FEATURES, adapter, adapter_sql
from ...streaming import monitors as M
from ..checks import monitor_once
from ..retraining import retrain
from .data_drift import _cut
from .registry import ORACLES, query, r6
from .stores import _CHECKED, _CYCLE, _P, _log, _store
from .streams import _instants, _stream

_NULLED = f"""WITH a AS (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN NULL ELSE metric_name END AS metric_name) FROM ({adapter_sql('alerts')}) x),
 l AS (SELECT *, lag(alert_ts) OVER (PARTITION BY drift_type, metric_name ORDER BY alert_ts, id) AS prev FROM a)
 SELECT id, metric_name, coalesce(alert_ts - prev <= INTERVAL 30 MINUTE, false) AS suppressed FROM l"""


@query("alert_dedup_null_metric", _NULLED)
def alert_dedup_null_metric(spark, sf_dir):
    """Alerts whose text names no metric repeat among themselves."""
    raised = adapter(spark, sf_dir, "alerts")
    raised = raised.withColumn("metric_name", F.when(F.col("id") % 3 != 0, F.col("metric_name")))
    return A.suppress_repeats(raised, "alert_ts").select("id", "metric_name", "suppressed")


_FEATURES = f"SELECT *, nullif(l_returnflag, 'R') AS k FROM ({adapter_sql('features')}) x"


@query("drift_by_nullable_key", f"""WITH f AS ({_FEATURES}), n AS (SELECT k, count(*) FILTER (side = 'ref') AS ref_rows, count(*) FILTER (side = 'cur') AS cur_rows FROM f GROUP BY k)
 SELECT k, unnest({LINE_FEATURES!r}) AS feature, ref_rows, cur_rows FROM n WHERE ref_rows > 0 AND cur_rows > 0""")
def drift_by_nullable_key(spark, sf_dir):
    """Rows without the key are a group like the others."""
    rows = adapter(spark, sf_dir, "features").withColumn("k", F.expr("nullif(l_returnflag, 'R')"))
    reference, current = _cut(rows)
    return D.feature_drift(reference, current, LINE_FEATURES, by=["k"]).select("k", "feature", "ref_rows", "cur_rows")


@query("split_with_unlabelled", f"""WITH o AS (SELECT CASE WHEN id % 10 > 0 THEN label END AS label FROM ({adapter_sql('order_features')}) x),
 c AS (SELECT label, count(*) AS n FROM o GROUP BY label)
 SELECT label, 'test' AS split, CAST(round(n * 0.2) AS BIGINT) AS n FROM c WHERE label IS NOT NULL
 UNION ALL SELECT label, 'train', n - CAST(round(n * 0.2) AS BIGINT) FROM c WHERE label IS NOT NULL
 UNION ALL SELECT label, 'unlabelled', n FROM c WHERE label IS NULL""")
def split_with_unlabelled(spark, sf_dir):
    """Rows without a label come out marked, not lost."""
    rows = adapter(spark, sf_dir, "order_features").withColumn("label", F.when(F.col("id") % 10 > 0, F.col("label")))
    return S.stratified_split(rows, "label", "id").groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


_BEYOND = f"SELECT * REPLACE (CASE WHEN side = 'cur' THEN l_quantity + 1000 ELSE l_quantity END AS l_quantity) FROM ({adapter_sql('features')}) x"
_RANGES = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, min({f}) FILTER (side = 'cur') > max({f}) FILTER (side = 'ref') OR max({f}) FILTER (side = 'cur') < min({f}) FILTER (side = 'ref') AS lost FROM b"
    for f in LINE_FEATURES
)


@query("out_of_range_check", f"""WITH b AS ({_BEYOND}), r AS ({_RANGES})
 SELECT string_agg(feature, ',' ORDER BY feature) FILTER (lost) AS out_of_range, bool_or(lost) AS noticed, bool_or(lost) AS is_breached FROM r""")
def out_of_range_check(spark, sf_dir):
    """A feature that left its reference range altogether is named, and the
    check is not healthy."""
    rows = adapter(spark, sf_dir, "features")
    rows = rows.withColumn("l_quantity", F.when(F.col("side") == "cur", F.col("l_quantity") + 1000).otherwise(F.col("l_quantity")))
    reference, current = _cut(rows)
    check = D.data_drift_check(D.feature_drift(reference, current, LINE_FEATURES), LINE_FEATURES)
    stored = drift_result_rows(check, None, None, F.lit("2024-01-01 00:00:00")).select("is_breached")
    named = check.select(F.concat_ws(",", "out_of_range").alias("out_of_range"), (F.col("severity") != "none").alias("noticed"))
    return attach_row(named, stored)


@query("monitoring_cycle_twice", f"SELECT count(*) AS results, count(*) AS ids FROM ({_CYCLE}) c")
def monitoring_cycle_twice(spark, sf_dir):
    """A second cycle over the same window records nothing."""
    tables = _store(spark)
    rows = adapter(spark, sf_dir, "predictions_shifted")
    logged = _log(rows, F.create_map(*[x for f in _CHECKED for x in (F.lit(f), F.col(f))]))
    tables.log_predictions(logged)
    tables.log_labels(logged.filter(F.col("true_label").isNotNull()).select("id", F.col("timestamp").alias("labelled_at"), "true_label"))
    first_half = rows.filter(~F.col("is_current"))
    tables.save_baseline(first_half, _CHECKED)
    for _ in range(2):
        monitor_once(tables, _CHECKED, DEFAULT_BASELINE_METRICS, first_half, Settings())
    return tables.read("drift_results").agg(F.count(F.lit(1)).alias("results"), F.count_distinct("id").alias("ids"))


@query("stream_quarantine", _P + """SELECT id, concat_ws(',', CASE WHEN json_extract_string(features_json, '$.k') IS NULL THEN 'k' END,
 CASE WHEN json_extract_string(features_json, '$.region') IS NULL THEN 'region' END) AS missing FROM p
 WHERE json_extract_string(features_json, '$.k') IS NULL OR json_extract_string(features_json, '$.region') IS NULL""")
def stream_quarantine(spark, sf_dir):
    """What the ingest turns away, with the names that were missing."""
    tables = _store(spark)
    rows = _instants(_stream(spark, sf_dir, "predictions"), "pred_ts").withColumnRenamed("pred_ts", "timestamp")
    landing = M.land_predictions(rows, tables, f"{tables.root}/checkpoint", transform=M.valid_rows(["k", "region"]))
    landing.awaitTermination()
    if landing.exception() is not None:
        raise landing.exception()
    return tables.read("quarantine").select("id", "missing")


@query("retrain_then_monitor", f"SELECT count(*) > 0 AS promoted, 'NO_ACTION' AS action FROM ({adapter_sql('features')}) x")
def retrain_then_monitor(spark, sf_dir):
    """A promotion on undrifted rows does not call for the next one: the baseline
    it saves is in the units of the log."""
    tables = _store(spark)
    tables.create_all()
    rows = adapter(spark, sf_dir, "features").select(
        *[F.col(f).cast("double").alias(f) for f in LINE_FEATURES],
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) > 40000).cast("int").alias("label"),
        F.xxhash64("l_orderkey", "l_linenumber").alias("id"),
    )
    settings = Settings()
    promoted = retrain(tables, rows.drop("id"), "first", LINE_FEATURES, "label", "l_extendedprice", settings)
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod("id", F.lit(2_592_000)))
    tables.log_predictions(
        rows.select(
            "id", at.alias("timestamp"), F.lit("1").alias("model_version"), F.lit(1.0).alias("latency_ms"),
            F.create_map(*[x for f in LINE_FEATURES for x in (F.lit(f), F.col(f))]).alias("features"),
            F.col("label").alias("predicted_label"), F.lit(0.9).alias("confidence"),
        )
    )
    decision = monitor_once(tables, LINE_FEATURES, settings=settings)
    return decision.select(F.lit(promoted).alias("promoted"), "action")


# -- the way of groups that are too large for one task --------------------------

@query("quantile_edges_narrow", ORACLES["quantile_edges"])
def quantile_edges_narrow(spark, sf_dir):
    """Deciles by sketches first, exact inside the brackets."""
    reference, _ = _cut(adapter(spark, sf_dir, "features"))
    profile = B.quantile_profile(B.to_long(reference, LINE_FEATURES), group_limit=500, accuracy=200)
    edges = profile.select("feature", F.posexplode(F.array(*B.edge_columns(10))).alias("edge_no", "edge"))
    return edges.filter("edge is not null").select("feature", "edge_no", r6("edge").alias("edge"))


@query("gradual_drift_narrow", ORACLES["gradual_drift"])
def gradual_drift_narrow(spark, sf_dir):
    rows = adapter(spark, sf_dir, "order_features").select("id", F.col("price").cast("double").alias("price"), F.col("cust").cast("double").alias("cust"))
    moved = J.gradual_drift(rows, ["price", "cust"], "id", group_limit=500)
    return moved.select("id", "batch", r6("price").alias("price"), r6("cust").alias("cust"))


@query("stratified_split_counts_narrow", ORACLES["stratified_split_counts"])
def stratified_split_counts_narrow(spark, sf_dir):
    parts = S.stratified_split(adapter(spark, sf_dir, "order_features"), "label", "id", group_limit=500)
    return parts.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))

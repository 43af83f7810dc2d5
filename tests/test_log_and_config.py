from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from modelwatch.config import Threshold, load_settings, thresholds_frame
from modelwatch.functions import columns as C
from modelwatch.operators import prediction_log as L
from modelwatch.operators import results as R
from modelwatch.schemas import FEATURES, TRAINING
from tests.conftest import rows

T0 = datetime(2024, 3, 1, 8, 0)


def test_settings_layers():
    plain = load_settings(env={})
    assert (plain.window_size, plain.min_samples, plain.dedup_minutes) == (500, 100, 30)
    assert plain["hellinger"] == Threshold(0.10, 0.20)
    got = load_settings({"window_size": 50, "thresholds": {"psi": (0.2, 0.3)}}, {"MODELWATCH_PSI_CRITICAL": "0.9", "MODELWATCH_SEED": "7"})
    assert (got.window_size, got.seed, got["psi"]) == (50, 7, Threshold(0.2, 0.9))
    with pytest.raises(KeyError):
        load_settings({"nonsense": 1}, {})
    with pytest.raises(KeyError):
        load_settings({"thresholds": {"nonsense": (1, 2)}}, {})


def test_threshold_table(spark):
    table = {r["metric"]: (r["warning"], r["critical"]) for r in thresholds_frame(spark).collect()}
    assert len(table) == 8 and table["recall_drop"] == (0.05, 0.10)


def test_feature_order():
    assert FEATURES[0] == "V1" and FEATURES[-1] == "Amount" and len(FEATURES) == 29
    assert TRAINING.names[-1] == "Class"


def _predictions(spark):
    data = [
        (1, T0, "1", '{"V1": 0.1, "Amount": 100.0}', 1, 0.95, None, 15.5),
        (2, T0 + timedelta(minutes=1), "1", '{"V1": 0.2}', 0, 0.05, 1, 12.0),
        (3, T0 + timedelta(minutes=2), "2", "not json", 1, 0.88, 1, 14.0),
    ]
    df = spark.createDataFrame(
        data,
        "id bigint, timestamp timestamp, model_version string, features_json string, predicted_label int, "
        "confidence double, true_label int, latency_ms double",
    )
    return df.withColumn("features", C.feature_map(F.col("features_json")))


def test_features_default_to_zero_and_bad_json_is_null(spark):
    got = rows(L.feature_columns(_predictions(spark), ["V1", "Amount"]), "id", "V1", "Amount")
    assert got == [(1, 0.1, 100.0), (2, 0.2, 0.0), (3, 0.0, 0.0)]


def test_quarantine_names_what_is_missing(spark):
    valid, bad = L.split_valid(_predictions(spark), ["V1", "Amount"])
    assert rows(valid, "id") == [(1,)]
    assert {r["id"]: r["missing_features"] for r in bad.collect()} == {2: ["Amount"], 3: ["Amount", "V1"]}


def test_training_rows_skip_unreadable_features(spark):
    labelled = _predictions(spark).filter("true_label IS NOT NULL").filter("features IS NOT NULL AND size(features) > 0")
    assert rows(L.training_rows(labelled, ["V1", "Amount"])) == [(0.2, None, 1)]


def test_reads(spark):
    df = _predictions(spark)
    assert [r["id"] for r in L.predictions_between(df, T0, T0 + timedelta(minutes=1)).collect()] == [2, 1]
    assert [r["id"] for r in L.predictions_between(df, model_version="2").collect()] == [3]
    assert [r["id"] for r in L.recent(df, 2).collect()] == [3, 2]
    assert [r["id"] for r in L.recent_labelled(df, 1).collect()] == [3]
    assert rows(L.recent(df, 1, by=["model_version"]), "id") == [(2,), (3,)]


@pytest.mark.parametrize("n", [3, 1500])
def test_newest_per_key_with_one_hot_key(spark, n):
    df = spark.range(6000).select(
        "id", (F.col("id") * 37 % 6000).alias("at"), F.when(F.col("id") % 20 == 0, "cold").otherwise("hot").alias("k")
    )
    kept = L.recent(df.repartition(5), n, "at", ["k"])
    want = []
    for key in ("hot", "cold"):
        want += sorted(((r["at"], r["id"]) for r in df.collect() if r["k"] == key), reverse=True)[:n]
    assert rows(kept, "at", "id") == sorted(want)


def test_labels_attach_by_newest_and_unknown_ids_are_found(spark):
    labels = spark.createDataFrame([(1, T0, 0), (1, T0 + timedelta(hours=1), 1), (9, T0, 1)], "id bigint, labelled_at timestamp, true_label int")
    joined = L.attach_labels(_predictions(spark), labels)
    assert rows(joined.filter("id < 3"), "id", "true_label")[0] == (1, 1)
    assert joined.filter("id = 2").first()["true_label"] is None
    assert rows(L.unmatched_labels(_predictions(spark), labels), "id") == [(9,)]


def test_stats(spark):
    data = [(i, T0 + timedelta(minutes=i), "1", i % 2, 20.0) for i in range(5)]
    df = spark.createDataFrame(data, "id bigint, timestamp timestamp, model_version string, predicted_label int, latency_ms double")
    row = L.prediction_stats(df).first()
    assert (row["total_predictions"], row["avg_latency_ms"], row["predictions_per_minute"], row["latest_model_version"]) == (5, 20.0, 1.25, "1")
    one = L.prediction_stats(df.limit(1)).first()
    assert one["predictions_per_minute"] == 0.0
    none = L.prediction_stats(df.limit(0)).first()
    assert (none["total_predictions"], none["avg_latency_ms"], none["latest_model_version"]) == (0, 0.0, None)
    assert [r["count"] for r in L.volume_per_minute(df, newest_minutes=3).collect()] == [1, 1, 1]
    assert {r["class_name"]: r["count"] for r in L.class_balance(df).collect()} == {"Legitimate": 3, "Fraud": 2}


def test_text_helpers(spark):
    df = spark.createDataFrame([("x" * 81, 0.5, -0.01), ("short", None, 0.02)], "t string, v double, d double")
    got = df.select(
        C.truncate(F.col("t"), 80).alias("a"), C.truncate(F.col("t"), 3, ellipsis=False).alias("b"),
        C.psi_card(F.col("v")).alias("c"), C.delta_arrow(F.col("d")).alias("e"),
    ).collect()
    assert got[0]["a"] == "x" * 80 + "..." and got[0]["b"] == "xxx" and got[0]["c"] == "Critical" and got[0]["e"] == "↓ 0.0100"
    assert got[1]["a"] == "short" and got[1]["c"] is None and got[1]["e"] == "↑ 0.0200"


# -- stored results -------------------------------------------------------------

def _results(spark, data):
    return spark.createDataFrame(
        data, "id bigint, timestamp timestamp, drift_type string, metric_name string, metric_value double, is_breached boolean, details_json string"
    )


def test_health_before_and_after_checks(spark):
    empty = _results(spark, [])
    alerts = spark.createDataFrame([("CRITICAL", False)], "severity string, acknowledged boolean")
    assert R.health_badge(empty, alerts).first()[0] == "No Data"
    assert tuple(R.model_health(empty).first())[:4] == ("unknown",) * 4
    good = _results(spark, [(1, T0, "data", "psi", 0.01, False, '{"severity":"none"}')])
    assert R.health_badge(good, alerts).first()[0] == "Healthy"
    assert tuple(R.model_health(good).first())[:4] == ("healthy", "none", "none", "none")
    bad = _results(spark, [(2, T0 + timedelta(hours=1), "data", "psi", 0.4, True, '{"severity":"critical","feature_psi":{"a":0.4}}')])
    both = good.union(bad)
    assert R.health_badge(both, alerts).first()[0] == "Drift Critical"
    assert R.health_badge(both, alerts.withColumn("acknowledged", F.lit(True))).first()[0] == "Drift Warning"
    assert R.model_health(both).first()["status"] == "critical"
    assert rows(R.details_map(both), "id", "feature", "value") == [(2, "a", 0.4)]
    assert [r["metric_value"] for r in R.metric_series(both, "data", limit=1).collect()] == [0.01]
    assert [r["metric_value"] for r in R.metric_series(both, "data", limit=1, latest=True).collect()] == [0.4]

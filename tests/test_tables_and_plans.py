from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelwatch.config import load_settings
from modelwatch.operators import drift as D
from modelwatch.plans.checks import monitor_once, run_drift_check
from modelwatch.plans.retraining import load_model, production_version, retrain
from modelwatch.schemas import TABLES
from modelwatch.sources.tables import MissingBaseline, MonitorTables
from tests.conftest import rows

T0 = datetime(2024, 5, 1, 0, 0)
NAMES = ["a", "Amount"]


@pytest.fixture
def tables(spark, tmp_path):
    return MonitorTables(spark, str(tmp_path / "store"))


def log_rows(spark, n, shift=0.0, start=0, every=1, version="1", seed=1):
    rng = np.random.default_rng(seed)
    data = []
    for i in range(n):
        a, amount = float(rng.normal(shift)), float(rng.exponential(50))
        label = int(a + rng.normal(0, 0.3) > 0.8)
        data.append((start + i, T0 + timedelta(minutes=every * (start + i)), version, {"a": a, "Amount": amount}, label, float(rng.uniform(0.1, 0.9)), 9.5))
    return spark.createDataFrame(
        data,
        "id bigint, timestamp timestamp, model_version string, features map<string,double>, predicted_label int, confidence double, latency_ms double",
    )


def labels_for(spark, log, flip=False):
    value = (1 - F.col("predicted_label")) if flip else F.col("predicted_label")
    return log.select("id", (F.col("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("labelled_at"), value.alias("true_label"))


def test_round_trip_with_a_late_label(spark, tables):
    first = tables.log_prediction({"V1": 0.1, "Amount": 100.0}, 1, 0.95, "1", 15.5, T0, 1)
    assert first == 1
    row = tables.predictions().first()
    assert (row["features"]["Amount"], row["true_label"], row["latency_ms"]) == (100.0, None, 15.5)
    unknown = tables.log_labels(spark.createDataFrame([(1, T0, 0), (5, T0, 1)], "id bigint, labelled_at timestamp, true_label int"))
    assert rows(unknown, "id") == [(5,)]
    assert tables.predictions().first()["true_label"] == 0


def test_rows_without_an_id_get_a_repeatable_one(spark, tables):
    batch = log_rows(spark, 2).drop("id")
    ids = rows(tables.log_predictions(batch))
    assert len(set(ids)) == 2
    assert ids == rows(MonitorTables(spark, tables.root + "2").log_predictions(batch))


def test_create_all_is_repeatable(tables):
    assert "predictions" in tables.create_all()
    assert tables.create_all() == []
    assert tables.read("predictions").count() == 0


def test_recent_reads_only_the_days_it_needs(spark, tables):
    log = log_rows(spark, 50, every=60)
    tables.log_predictions(log)
    tables.log_labels(labels_for(spark, log.filter("id < 30")))
    recent = tables.recent_predictions(10)
    assert sorted(r["id"] for r in recent.collect()) == list(range(40, 50))
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert sorted(r["id"] for r in tables.recent_labelled(10).collect()) == list(range(20, 30))
    assert tables.recent_labelled(100).count() == 30


def test_a_replayed_micro_batch_adds_nothing(spark, tables):
    log = log_rows(spark, 20)
    tables.log_predictions(log.filter("id < 5"))
    for _ in range(2):
        tables.land_batch(log.filter("id >= 5"), "ingest", 0)
    assert tables.read("predictions").count() == 20


def test_acknowledge_and_promote(spark, tables):
    alerts = spark.createDataFrame([(1, T0, "WARNING", "data", "psi", "m", "all", False)], TABLES["alerts"])
    tables.append("alerts", alerts)
    acks = spark.createDataFrame([(1, T0), (8, T0)], "id bigint, acknowledged_at timestamp")
    assert rows(tables.acknowledge(acks), "id") == [(8,)]
    assert tables.alerts().first()["acknowledged"] is True
    tables.append("model_versions", spark.createDataFrame([(1, 0.9), (2, 0.8)], "version int, f1_score double"))
    assert tables.promote(1, T0) and tables.promote(2, T0 + timedelta(days=1))
    assert not tables.promote(7, T0)
    assert rows(tables.versions().filter("is_production"), "version") == [(2,)]
    assert tables.promote(1, T0 + timedelta(days=2))  # roll back
    assert production_version(tables) == 1


def test_baseline_must_exist_and_reads_back(spark, tables):
    with pytest.raises(MissingBaseline):
        tables.load_baseline()
    df = spark.createDataFrame([(float(i), 7.0) for i in range(100)], "a double, Amount double")
    tables.save_baseline(df, NAMES, 3)
    assert tables.baseline_version() == 3 and tables.load_baseline().count() == 200
    profile, counts = tables.load_profile()
    assert {r["feature"]: r["n_edges"] for r in profile.collect()} == {"a": 11, "Amount": 1}
    assert counts.agg(F.sum("ref_count")).first()[0] == 200


# -- checks -------------------------------------------------------------------

def window_of(spark, **columns):
    names = list(columns)
    return spark.createDataFrame([tuple(r) for r in zip(*columns.values())], names)


def test_an_empty_window_is_healthy(spark):
    empty = spark.createDataFrame([], "timestamp timestamp, a double, predicted_label int, confidence double, true_label int")
    check = run_drift_check(empty, ["a"], prediction_baseline=empty, metric_baseline={})
    assert check.summary is None and check.results is None and check.status == "healthy"


def test_a_failing_detector_does_not_stop_the_others(spark):
    n = 60
    window = spark.range(n).select(
        F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("timestamp"), F.lit(0.5).alias("a"),
        (F.col("id") % 2).cast("int").alias("predicted_label"), (F.col("id") / n).alias("confidence"),
        (F.col("id") % 2).cast("int").alias("true_label"),
    )

    def broken(_w):
        raise RuntimeError("no reference")

    check = run_drift_check(
        window, ["a"], data=broken, prediction_baseline=window, metric_baseline={"accuracy": 1.0, "f1": 1.0, "precision": 1.0, "recall": 1.0}
    )
    assert check.failed == {"data": "no reference"}
    row = check.summary.first()
    assert row["checks_performed"] == ["prediction_drift", "concept_drift"] and row["data_severity"] is None
    assert check.status == "healthy"
    stored = rows(check.results, "drift_type", "metric_name", "metric_value", "is_breached")
    assert stored == [("concept", "overall", 0.0, False), ("prediction", "hellinger", 0.0, False)]
    window_times = check.results.select("window_start", "window_end").distinct().collect()
    assert len(window_times) == 1 and window_times[0][0] < window_times[0][1]


def test_monitoring_cycle_stores_and_decides(spark, tables):
    settings = load_settings({"window_size": 200, "min_samples": 100}, {})
    base = log_rows(spark, 400)
    reference = base.select(*[F.col("features")[n].alias(n) for n in NAMES])
    tables.save_baseline(reference, NAMES)
    tables.log_predictions(log_rows(spark, 50, start=0))
    assert monitor_once(tables, NAMES, settings=settings) is None  # gate
    good = log_rows(spark, 300, start=50, seed=9)
    tables.log_predictions(good)
    quiet = monitor_once(tables, NAMES, prediction_baseline=base, settings=settings).first()
    assert quiet["action"] == "NO_ACTION"
    assert tables.read("retraining_events").count() == 0
    bad = log_rows(spark, 300, shift=1.5, start=400, seed=10)
    tables.log_predictions(bad)
    tables.log_labels(labels_for(spark, bad, flip=True))
    metrics = {"accuracy": 0.98, "f1": 0.95, "precision": 0.96, "recall": 0.94}
    decision = monitor_once(tables, NAMES, metrics, base, settings).first()
    assert decision["action"] == "RETRAIN" and decision["urgency"] == "HIGH"
    assert "critical_data_drift" in decision["triggered_rules"] and "f1_degradation" in decision["triggered_rules"]
    assert rows(tables.read("retraining_events"), "status") == [("STARTED",)]
    kinds = tables.read("drift_results").groupBy("drift_type").count()
    assert dict(rows(kinds)) == {"data": 2, "prediction": 2, "concept": 4}


def test_keyed_check_equals_single_checks(spark):
    rng = np.random.default_rng(0)
    data = []
    for k, shift in (("m1", 0.0), ("m2", 1.0)):
        for i in range(150):
            data.append((k, T0, False, float(rng.normal()), int(rng.integers(2)), float(rng.random()), 1))
            data.append((k, T0, True, float(rng.normal(shift)), int(rng.integers(2)), float(rng.random() * (1 - shift / 2)), 1))
    df = spark.createDataFrame(data, "m string, timestamp timestamp, now boolean, a double, predicted_label int, confidence double, true_label int")

    def check(part, by):
        ref, cur = part.filter("NOT now"), part.filter("now")
        return run_drift_check(
            cur, ["a"], data=lambda w: D.feature_drift(ref, w, ["a"], by=by), prediction_baseline=ref, by=by
        ).summary.select(*by, "overall_psi", "hellinger", "overall_status")

    keyed = {r["m"]: (r["overall_psi"], r["hellinger"], r["overall_status"]) for r in check(df, ["m"]).collect()}
    for m in ("m1", "m2"):
        alone = check(df.filter(F.col("m") == m), []).first()
        assert keyed[m][0] == pytest.approx(alone[0]) and keyed[m][1] == pytest.approx(alone[1]) and keyed[m][2] == alone[2]


# -- retraining -----------------------------------------------------------------

def test_retraining_promotes_then_rejects_then_fails(spark, tables):
    settings = load_settings({"num_trees": 3, "max_depth": 3}, {})
    rng = np.random.default_rng(4)
    data = []
    for _ in range(600):
        a = float(rng.normal())
        data.append((a, float(rng.exponential(30)), int(a + rng.normal(0, 0.2) > 0.5)))
    original = spark.createDataFrame(data, "a double, Amount double, Class int")
    log = log_rows(spark, 120)
    tables.log_predictions(log)
    tables.log_labels(labels_for(spark, log))
    assert retrain(tables, original, "first", NAMES, settings=settings)
    assert production_version(tables) == 1
    assert tables.baseline_version() == 1
    assert load_model(tables, 1) is not None
    # the same data cannot beat itself
    assert not retrain(tables, original, "again", NAMES, settings=settings)
    assert production_version(tables) == 1
    # a run that breaks is recorded and leaves production alone
    assert not retrain(tables, original, "broken", NAMES, scaled="absent", settings=settings)
    events = {r["trigger_reason"]: (r["status"], r["new_version"], r["old_version"]) for r in tables.retraining_events().collect()}
    assert events == {"first": ("COMPLETED", 1, None), "again": ("REJECTED", None, 1), "broken": ("FAILED", None, 1)}
    assert tables.read("retraining_events").count() == 6
    assert rows(tables.read("alerts"), "severity") == [("CRITICAL",), ("RESOLVED",), ("WARNING",)]
    version = tables.versions().first()
    assert 0 < version["f1_score"] <= 1 and 0 < version["auc_roc"] <= 1
    assert tables.read("scaler").count() == 1


def test_baseline_of_a_promotion_is_its_training_rows_without_a_join(spark, tables, monkeypatch):
    settings = load_settings({"num_trees": 2, "max_depth": 2}, {})
    rng = np.random.default_rng(5)
    data = [(float(rng.normal()), float(i), i % 2 if i % 7 else None) for i in range(300)]
    original = spark.createDataFrame(data, "a double, Amount double, Class int")
    plans, save = [], tables.save_baseline

    def seen(df, *args):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        save(df, *args)

    monkeypatch.setattr(tables, "save_baseline", seen)
    assert retrain(tables, original, "first", NAMES, settings=settings)
    assert len(plans) == 1 and "Join" not in plans[0]
    held = [r["value"] for r in tables.load_baseline(1).filter("feature = 'Amount'").collect()]
    labelled = {b: c for _, b, c in data if c is not None}
    assert len(held) == len(set(held)) and set(held) <= set(labelled)  # in the units of the log
    sizes = {c: sum(v == c for v in labelled.values()) for c in (0, 1)}
    assert {c: sum(labelled[v] == c for v in held) for c in (0, 1)} == {c: n - round(n * 0.2) for c, n in sizes.items()}
    scaler = tables.read("scaler").first()
    assert scaler["mean"] == pytest.approx(149.5) and scaler["std"] == pytest.approx(np.arange(300).std())


def test_ids_in_order(spark, tmp_path):
    tables = MonitorTables(spark, str(tmp_path / "ids"))
    log = log_rows(spark, 60).drop("id")
    first, second = log.union(log), log.limit(7)
    assert rows(tables.log_in_order(first, "a")) == [(i,) for i in range(1, 121)]
    assert rows(tables.log_in_order(second, "b")) == [(i,) for i in range(121, 128)]
    for _ in range(2):  # a retry changes nothing
        assert tables.log_in_order(first.repartition(5), "a").count() == 120
    held = [(r["id"], r["timestamp"]) for r in tables.read("predictions").orderBy("id").collect()]
    assert [i for i, _ in held] == list(range(1, 128))
    assert [t for _, t in held[:120]] == sorted(t for _, t in held[:120])
    with pytest.raises(ValueError, match="had 120 rows"):
        tables.log_in_order(second, "a")
    assert tables.log_in_order(log.limit(0), "none").count() == 0
    assert rows(tables.log_in_order(second, "c")) == [(i,) for i in range(128, 135)]


def test_a_check_whose_detectors_all_failed_is_unknown(spark, tmp_path):
    tables = MonitorTables(spark, str(tmp_path / "failing"))
    log = log_rows(spark, 150)
    tables.save_baseline(log.select(*[F.col("features")[x].alias(x) for x in NAMES]), NAMES)
    tables.log_predictions(log)
    broken = lambda _w: 1 / 0
    window = log.select("*", *[F.col("features")[x].alias(x) for x in NAMES])
    check = run_drift_check(window, NAMES, data=broken)
    assert check.status == "unknown" and check.summary is None and set(check.failed) == {"data"}
    assert [(r["drift_type"], r["message"]) for r in check.failures.collect()] == [("data", "division by zero")]
    assert run_drift_check(window.limit(0), NAMES, data=broken).status == "healthy"


# -- windows and cycles by model ---------------------------------------------------

def test_windows_by_model_read_only_the_days_they_need(spark, tables):
    busy, idle = log_rows(spark, 200, start=1000, every=60, version="busy"), log_rows(spark, 12, every=60, version="idle", seed=2)
    tables.log_predictions(idle)
    tables.log_predictions(busy)
    tables.log_labels(labels_for(spark, busy.union(idle).filter("id % 2 = 0")))
    window = tables.recent_by_model(5)
    assert rows(window, "model_version", "id") == [("busy", i) for i in range(1195, 1200)] + [("idle", i) for i in range(7, 12)]
    assert window.filter("true_label IS NULL").count() == window.filter("id % 2 = 1").count()
    wanted = spark.createDataFrame([("idle", T0.date()), ("busy", None)], "model_version string, date date")
    plan = tables._on_days(wanted)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(date" in plan or "PartitionFilters: [" in plan and "date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    days = {r["day"] for r in tables._day_index().collect()}
    assert days == {r["date"] for r in tables.read("predictions").select("date").distinct().collect()}


def test_an_index_that_promises_too_much_is_noticed(spark, tables):
    tables.log_predictions(log_rows(spark, 40, every=120))
    ghost = spark.createDataFrame([("1", (T0 + timedelta(days=9)).date(), 1000), ("gone", T0.date(), 7)], "model_version string, day date, n bigint")
    tables.append("prediction_days", ghost)  # as after a write that failed
    assert rows(tables.recent_by_model(30), "id") == [(i,) for i in range(10, 40)]
    assert rows(tables.recent_by_model(300), "id") == [(i,) for i in range(40)]
    assert rows(tables.recent_predictions(30), "id") == [(i,) for i in range(10, 40)]
    assert tables.recent_predictions(300).count() == 40


def test_a_log_without_an_index_and_rows_without_a_time_or_model(spark, tables):
    old = log_rows(spark, 10).withColumn("date", F.to_date("timestamp"))
    old.write.partitionBy("date").parquet(tables.path("predictions"))
    late = log_rows(spark, 3, start=100).withColumn("timestamp", F.lit(None).cast("timestamp")).withColumn("model_version", F.lit(None).cast("string"))
    tables.log_predictions(late)
    assert tables.recent_by_model(20).groupBy("model_version").count().count() == 2
    assert rows(tables.recent_by_model(2), "id") == [(8,), (9,), (101,), (102,)]
    assert tables.recent_predictions(20).count() == 13


def test_empty_log_has_no_windows(spark, tables):
    assert tables.recent_by_model(5).count() == 0 and tables.recent_predictions(5).count() == 0


def test_cycle_by_model_equals_single_cycles(spark, tables, tmp_path):
    settings = load_settings({"window_size": 200, "min_samples": 100}, {})
    base = log_rows(spark, 400)
    reference = base.select(*[F.col("features")[n].alias(n) for n in NAMES])
    parts = {
        "good": log_rows(spark, 250, start=1000, version="good", seed=5),
        "bad": log_rows(spark, 250, shift=1.5, start=5000, version="bad", seed=6),
        "short": log_rows(spark, 50, start=9000, version="short", seed=7),
    }
    both = [base.withColumn("model_version", F.lit(v)) for v in parts]
    tables.save_baseline(reference, NAMES)
    for log in parts.values():
        tables.log_predictions(log)
    tables.append("model_versions", spark.createDataFrame([(3, 0.9)], "version int, f1_score double"))
    tables.promote(3, T0)
    found = monitor_once(tables, NAMES, None, both[0].union(both[1]).union(both[2]), settings, ["model_version"])
    found = {r["model_version"]: (r["action"], round(r["overall_psi"], 9), round(r["hellinger"], 9)) for r in found.collect()}
    assert set(found) == {"good", "bad"}
    for version in found:
        alone = MonitorTables(spark, str(tmp_path / version))
        alone.save_baseline(reference, NAMES)
        alone.log_predictions(parts[version])
        single = monitor_once(alone, NAMES, None, base, settings).first()
        assert found[version] == (single["action"], round(single["overall_psi"], 9), round(single["hellinger"], 9))
    assert rows(tables.retraining_events(), "old_version", "old_f1") == [(3, 0.9)]
    windows = rows(tables.read("drift_results"), "model_version", "window_end")
    assert len(set(windows)) == 2  # every model has its own window
    with pytest.raises(ValueError):
        monitor_once(tables, NAMES, by=["predicted_label"])

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelwatch.config import load_settings
from modelwatch.operators import alerts as A
from modelwatch.plans.retraining import retrain
from modelwatch.sources.tables import MonitorTables
from modelwatch.streaming import monitors as M
from modelwatch.operators.decision import breach_streak
from modelwatch.streaming import repeats as S
from modelwatch.streaming import streaks as K
from tests.conftest import rows
from tests.test_tables_and_plans import NAMES, log_rows

T0 = datetime(2024, 1, 1, 12, 0, 0)


def run(query):
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def file_stream(spark, folder, *batches):
    """Each frame becomes one file, each file one micro-batch."""
    for i, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_dispatch_over_many_batches_equals_the_batch_form(spark, tmp_path):
    S.use_rocksdb(spark)
    rng = np.random.default_rng(8)
    data = sorted((float(rng.integers(0, 3000)), i, "hot" if rng.random() < 0.6 else "cold") for i in range(200))
    frame = spark.createDataFrame(
        [(i, T0 + timedelta(minutes=m), k, "psi") for m, i, k in data],
        "id bigint, timestamp timestamp, drift_type string, metric_name string",
    )
    middle = T0 + timedelta(minutes=1500)
    stream = file_stream(spark, str(tmp_path / "in"), frame.filter(F.col("timestamp") < middle), frame.filter(F.col("timestamp") >= middle))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    run(M.write_append(S.dispatch_stream(stream), out, checkpoint))
    got = rows(spark.read.parquet(out), "drift_type", "id")
    assert got == rows(A.dispatched(frame), "drift_type", "id")
    assert 0 < len(got) < 200


def test_dispatch_of_late_alerts(spark, tmp_path):
    S.use_rocksdb(spark)
    schema = "id bigint, timestamp timestamp, drift_type string, metric_name string"
    make = lambda *rs: spark.createDataFrame([(i, T0 + timedelta(minutes=m), "data", k) for i, m, k in rs], schema)
    batches = [make((1, 0, "psi"), (2, 300, "psi"), (3, 300, None)), make((4, 120, "psi"), (5, 310, "psi"), (6, 20, "psi"), (7, 320, None))]
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    run(M.write_append(S.dispatch_stream(file_stream(spark, str(tmp_path / "in"), *batches)), out, checkpoint))
    got = sorted(r["id"] for r in spark.read.parquet(out).collect())
    assert got == [1, 2, 3, 4] == sorted(r["id"] for r in A.dispatched(batches[0].union(batches[1])).collect())


def test_idle_keys_lose_their_state(spark, tmp_path):
    """Three keys alert once; when the watermark has passed, only the busy one is held."""
    S.use_rocksdb(spark)
    schema = "id bigint, timestamp timestamp, drift_type string, metric_name string"
    make = lambda *rs: spark.createDataFrame([(i, T0 + timedelta(hours=h), k, "psi") for i, h, k in rs], schema)
    batches = [make((1, 0, "a"), (2, 0, "b"), (3, 1, "c")), make((4, 100, "busy")), make((5, 200, "busy")), make((6, 300, "busy"), (7, 1, "late"))]
    stream = S.dispatch_stream(file_stream(spark, str(tmp_path / "in"), *batches))
    query = M.write_append(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    run(query)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held[:1]) > held[-1] > 0
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3, 4, 5, 6]


def test_streak_of_disordered_results_equals_the_batch_form(spark, tmp_path):
    S.use_rocksdb(spark)
    rng = np.random.default_rng(3)
    data = [(i, T0 + timedelta(minutes=int(rng.integers(0, 90))), ["a", "b", None][i % 3], bool(rng.random() < 0.9)) for i in range(240)]
    frame = spark.createDataFrame(data, "id bigint, timestamp timestamp, model_version string, is_breached boolean")
    batches = [frame.filter((F.xxhash64("id") % 4).cast("int") == i) for i in range(-3, 4)]  # any order
    for last in (50, 5):
        out = str(tmp_path / f"out{last}")
        stream = file_stream(spark, str(tmp_path / f"in{last}"), *batches)
        run(M.write_append(K.streak_stream(stream, last=last), out, str(tmp_path / f"cp{last}")))
        updates = spark.read.parquet(out)
        wanted = {r["model_version"]: r["streak"] for r in breach_streak(frame, by=["model_version"], last=last).collect()}
        assert {r["model_version"]: r["streak"] for r in K.latest_streaks(updates).collect()} == wanted
        assert updates.count() > 10


def test_late_labels_join_and_unlabelled_rows_leave_with_null(spark, tmp_path):
    at = lambda h: T0 + timedelta(hours=h)
    schema, label_schema = "id bigint, timestamp timestamp", "id bigint, labelled_at timestamp, true_label int"
    # the rows far ahead only move the watermark
    p = file_stream(spark, str(tmp_path / "p"), spark.createDataFrame([(1, at(0)), (2, at(0)), (3, at(0))], schema), spark.createDataFrame([(9, at(100))], schema))
    l = file_stream(  # noqa: E741
        spark, str(tmp_path / "l"), spark.createDataFrame([(1, at(1), 1), (3, at(9), 1)], label_schema), spark.createDataFrame([(8, at(100), 0)], label_schema)
    )
    out = str(tmp_path / "out")
    run(M.write_append(M.attach_labels(p, l, wait="2 hours"), out, str(tmp_path / "cp")))
    assert {r["id"]: r["true_label"] for r in spark.read.parquet(out).collect()} == {1: 1, 2: None, 3: None}


def test_windows_slide_and_close_behind_the_watermark(spark, tmp_path):
    data = [(T0 + timedelta(minutes=m),) for m in (0, 1, 1, 30, 500)]
    stream = file_stream(spark, str(tmp_path / "in"), spark.createDataFrame(data, "timestamp timestamp"))
    run(M.write_append(M.volume(stream, width="10 minutes"), str(tmp_path / "o1"), str(tmp_path / "c1")))
    assert rows(spark.read.parquet(str(tmp_path / "o1")), "count") == [(1,), (3,)]  # the last window is open
    run(M.write_append(M.volume(stream, width="10 minutes", slide="5 minutes"), str(tmp_path / "o2"), str(tmp_path / "c2")))
    assert spark.read.parquet(str(tmp_path / "o2")).agg(F.sum("count")).first()[0] == 8
    whole = spark.createDataFrame(data, "timestamp timestamp")
    assert rows(M.with_open_windows(spark.read.parquet(str(tmp_path / "o1")), whole, width="10 minutes"), "count") == [(1,), (1,), (3,)]
    none = spark.read.parquet(str(tmp_path / "o1")).limit(0)
    assert rows(M.with_open_windows(none, whole, width="10 minutes"), "count") == [(1,), (1,), (3,)]


def test_sessions_close_and_the_open_ones_are_read_beside_them(spark, tmp_path):
    data = [(T0 + timedelta(minutes=m), k) for k, ms in (("a", (0, 5, 14, 40, 400, 405)), (None, (0, 9, 18, 390))) for m in ms]
    schema = "timestamp timestamp, k string"
    early, late = spark.createDataFrame(data[::-1], schema), spark.createDataFrame([(T0 + timedelta(minutes=406), "a")], schema)
    stream = file_stream(spark, str(tmp_path / "in"), early, late)
    run(M.write_append(M.sessions(stream, gap="10 minutes", by=["k"]), str(tmp_path / "out"), str(tmp_path / "cp")))
    closed = spark.read.parquet(str(tmp_path / "out"))
    assert rows(closed, "count") == [(1,), (3,), (3,)]
    whole = M.with_open_sessions(closed, early.union(late), gap="10 minutes", by=["k"])
    got = sorted(((r["k"] or "", (r["session_start"] - T0).total_seconds() / 60, r["count"]) for r in whole.collect()))
    assert got == [("", 0, 3), ("", 390, 1), ("a", 0, 3), ("a", 40, 1), ("a", 400, 3)]


def test_ingest_keeps_valid_rows_once(spark, tmp_path):
    tables = MonitorTables(spark, str(tmp_path / "store"))
    log = log_rows(spark, 30)
    bad = log.filter("id < 3").withColumn("id", F.col("id") + 100).withColumn("features", F.create_map(F.lit("a"), F.lit(1.0)))
    stream = file_stream(spark, str(tmp_path / "in"), log.filter("id < 20").union(bad), log.filter("id >= 20"))
    for _ in range(2):  # the restart finds nothing new
        run(M.land_predictions(stream, tables, str(tmp_path / "cp"), transform=M.valid_rows(NAMES)))
    assert rows(tables.read("predictions"), "id") == [(i,) for i in range(30)]


@pytest.mark.parametrize("n", [40, 300])
def test_drift_monitor_runs_behind_the_gate(spark, tmp_path, n):
    tables = MonitorTables(spark, str(tmp_path / "store"))
    settings = load_settings({"window_size": 200}, {})
    log = log_rows(spark, n, shift=1.5)
    tables.save_baseline(log_rows(spark, 400).select(*[F.col("features")[x].alias(x) for x in NAMES]), NAMES)
    tables.log_predictions(log)
    decisions = []
    clock = file_stream(spark, str(tmp_path / "in"), log)
    run(M.drift_monitor(clock, tables, NAMES, str(tmp_path / "cp"), every=None, on_decision=lambda d: decisions.append(d.first()["action"]), settings=settings))
    assert decisions == (["RETRAIN"] if n >= 100 else [])
    assert tables.read("drift_results").count() == len(decisions)


def test_a_promotion_takes_effect_at_the_next_batch(spark, tmp_path):
    tables = MonitorTables(spark, str(tmp_path / "store"))
    settings = load_settings({"num_trees": 2, "max_depth": 2}, {})
    log = log_rows(spark, 200)
    original = log.select(*[F.col("features")[n].alias(n) for n in NAMES], F.col("predicted_label").alias("Class"))
    assert retrain(tables, original, "first", NAMES, settings=settings)
    raw = log.select("id", "timestamp", "features", F.lit(1.0).alias("latency_ms"))
    scorer = M.champion_scorer(tables, NAMES, "Amount")
    stream = file_stream(spark, str(tmp_path / "in"), raw.filter("id < 100"), raw.filter("id >= 100"))
    seen = []

    def scored(batch):
        seen.append(1)
        if len(seen) == 2:  # a second version goes live between the batches
            from modelwatch.plans.retraining import load_model, model_path

            load_model(tables, 1).save(model_path(tables, 2))
            tables.append("model_versions", spark.createDataFrame([(2, 0.9)], "version int, f1_score double"))
            tables.append("scaler", tables.read("scaler").withColumn("version", F.lit(2)))
            tables.promote(2, datetime(2100, 1, 1))
        return scorer(batch)

    run(M.land_predictions(stream, tables, str(tmp_path / "cp"), "scored", scored))
    counts = dict(rows(tables.read("predictions").groupBy("model_version").count()))
    assert counts == {"1": 100, "2": 100}
    assert tables.read("predictions").filter("confidence IS NULL OR predicted_label IS NULL").count() == 0

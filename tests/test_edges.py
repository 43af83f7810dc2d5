"""Rows without keys or labels, values beyond the reference, repeated cycles."""

from datetime import datetime

from pyspark.sql import functions as F

from modelwatch.operators import alerts as A
from modelwatch.operators import dataset as S
from modelwatch.operators import drift as D
from modelwatch.operators.bins import histogram
from modelwatch.operators.results import drift_result_rows, drift_summary
from modelwatch.operators.quantiles import _brackets, _tagged
from modelwatch.operators.sizing import join_small, match
from modelwatch.streaming import monitors as M

AT = datetime(2024, 1, 1)


def test_null_keys_meet(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "v int, k string")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, w int")
    assert sorted(tuple(r) for r in match(left, right, ["k"]).select("v", "w").collect()) == [(1, 10), (2, 20)]
    for limit in (50_000, 0):  # broadcast, shuffle
        got = join_small(left, right, ["k"], "left", limit)
        assert got.columns == ["k", "v", "w"] and sorted((r.v, r.w) for r in got.collect()) == [(1, 10), (2, 20), (3, None)]
    full = match(right, left, ["k"], "full")
    assert sorted((r.k or "", r.w, r.v) for r in full.collect()) == [("", 20, 2), ("a", 10, 1), ("c", None, 3)]


def test_no_alert_is_lost(spark):
    rows = [(1, AT, "data", "psi"), (2, AT, "data", None), (3, None, "data", "psi"), (4, AT, "data", None)]
    raised = spark.createDataFrame(rows, "id long, timestamp timestamp, drift_type string, metric_name string")
    got = {r.id: r.suppressed for r in A.suppress_repeats(raised).collect()}
    assert got == {1: False, 2: False, 3: False, 4: True}
    assert A.dispatched(raised).count() == 3


def test_no_group_is_lost(spark):
    df = spark.range(400).select(
        F.when(F.col("id") % 2 == 0, "a").alias("k"), (F.col("id") % 50).cast("double").alias("x"), (F.col("id") % 4 < 2).alias("ref")
    )
    per = D.feature_drift(df.filter("ref"), df.filter("not ref"), ["x"], by=["k"])
    assert sorted(r.k or "" for r in per.collect()) == ["", "a"]
    assert histogram(df, "x", ["k"], 5).groupBy("k").agg(F.sum("count").alias("n")).filter("n = 200").count() == 2


def test_unlabelled_rows_are_marked(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 10 != 0, F.col("id") % 2).alias("label"))
    parts = {(r.label, r.split): r["count"] for r in S.stratified_split(df, "label", "id").groupBy("label", "split").count().collect()}
    assert sum(parts.values()) == 100 and parts[None, "unlabelled"] == 10 and sum(n for (k, s), n in parts.items() if s == "test") == 18


def test_total_drift_is_no_good_news(spark):
    ref = spark.range(200).select((F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    moved = ref.withColumn("x", F.col("x") + 50)
    check = D.data_drift_check(D.feature_drift(ref, moved, ["x", "y"]), ["x", "y", "z"])
    row = check.first()
    assert row.out_of_range == ["x"] and row.skipped_features == ["z"] and row.severity == "unknown"
    assert drift_summary(check, None, None).first().overall_status == "unknown"
    assert drift_result_rows(check, None, None, F.lit(AT)).first().is_breached


def test_result_rows_keep_their_segment(spark):
    ref = spark.range(400).select(F.when(F.col("id") % 2 == 0, "n").otherwise("s").alias("region"), (F.col("id") % 20).cast("double").alias("x"))
    check = D.data_drift_check(D.feature_drift(ref, ref, ["x"], by=["region"]), ["x"], ["region"])
    stored = drift_result_rows(check, None, None, F.lit(AT), by=["region"])
    ids = {r.id: F for r in stored.collect()}
    regions = {r[0] for r in stored.select(F.get_json_object("details_json", "$.segment.region")).collect()}
    assert len(ids) == 2 and regions == {"n", "s"}


def test_rejected_rows_carry_the_missing_names(spark):
    batch = spark.createDataFrame([(1, {"a": 1.0, "b": 2.0}), (2, {"a": 1.0}), (3, None)], "id long, features map<string,double>")
    keep = M.valid_rows(["a", "b"])
    assert [r.id for r in keep(batch).collect()] == [1]
    assert sorted((r.id, r.missing) for r in keep.rejected(batch).collect()) == [(2, "b"), (3, "a,b")]


def test_brackets_stay_narrow_on_ordered_rows(spark):
    rows = spark.range(400_000, numPartitions=16).select(F.col("id").cast("double").alias("_v"))
    ranks = [i / 10 for i in range(1, 10)]
    kept = _tagged(rows, [], ranks, _brackets(rows, [], ranks, 10_000)).filter("_cell is not null").count()
    assert 0 < kept < 0.02 * 400_000


def test_missing_names_and_states_in_alert_counts(spark):
    raised = [(1, None, "data", None), (2, "WARNING", None, True), (3, "WARNING", "data", False)]
    alerts = spark.createDataFrame(raised, "id long, severity string, drift_type string, acknowledged boolean")
    got = {(r.dimension, r.name): (r.total, r.active) for r in A.alert_stats(alerts).collect()}
    assert got == {
        ("all", "all"): (3, 2), ("severity", None): (1, 1), ("severity", "WARNING"): (2, 1),
        ("drift_type", None): (1, 0), ("drift_type", "data"): (2, 2),
    }

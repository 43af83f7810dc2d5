import numpy as np
import pytest
from pyspark.sql import functions as F

from modelwatch.operators import dataset as S
from modelwatch.operators import versions as V
from tests.conftest import rows


def test_csv_is_read_by_name(spark, tmp_path):
    path = tmp_path / "train.csv"
    path.write_text("Time,V2,V1,Class\n0,2.5,1.5,0\n9,4.5,3.5,1\n")
    got = S.load_training_csv(spark, str(path))
    assert got.columns == ["V1", "V2", "Class"]
    assert rows(got) == [(1.5, 2.5, 0), (3.5, 4.5, 1)]


def test_scaler_uses_the_population_deviation(spark):
    values = [1.0, 2.0, 4.0, 9.0]
    df = spark.createDataFrame([(v, 7.0) for v in values], "Amount double, flat double")
    fitted = S.fit_scaler(df, "Amount")
    got = sorted(r["Amount"] for r in S.apply_scaler(df, fitted, "Amount").collect())
    np.testing.assert_allclose(got, (np.array(values) - np.mean(values)) / np.std(values))
    assert {r["flat"] for r in S.apply_scaler(df, S.fit_scaler(df, "flat"), "flat").collect()} == {0.0}


@pytest.mark.parametrize("limit", [10**6, 30])
def test_split_is_exact_per_class_and_stable(spark, limit):
    df = spark.range(1003).select("id", (F.col("id") % 50 == 0).cast("int").alias("y"))
    parts = S.stratified_split(df.repartition(5), "y", "id", group_limit=limit)
    counts = {(r["y"], r["split"]): r["count"] for r in parts.groupBy("y", "split").count().collect()}
    assert counts == {(0, "test"): 196, (0, "train"): 786, (1, "test"): 4, (1, "train"): 17}
    again = S.stratified_split(df.repartition(2), "y", "id", group_limit=limit)
    assert rows(again, "id", "split") == rows(parts, "id", "split")


def test_split_fractions_at_the_ends(spark):
    df = spark.range(20).select("id", F.lit(1).alias("y"))
    for fraction, want in ((0.0, 0), (1.0, 20)):
        assert S.stratified_split(df, "y", "id", fraction).filter("split = 'test'").count() == want


def test_weights_are_balanced(spark):
    df = spark.createDataFrame([(0,)] * 8 + [(1,)] * 2, "y int")
    assert rows(S.class_weights(df, "y"), "y", "weight") == [(0, 10 / 16), (1, 10 / 4)]
    total = S.with_class_weight(df, "y").groupBy("y").agg(F.sum("weight")).collect()
    assert {round(r[1], 9) for r in total} == {5.0}


def test_processed_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "train"), (2.0, "test")], "x double, split string")
    S.save_processed(df, str(tmp_path / "p"))
    assert rows(S.load_processed(spark, str(tmp_path / "p"), "test")) == [(2.0,)]
    assert S.load_processed(spark, str(tmp_path / "p")).count() == 2


# -- versions -----------------------------------------------------------------

@pytest.fixture(scope="module")
def versions(spark):
    return spark.createDataFrame(
        [(1, 0.95, 0.90), (2, 0.98, 0.95), (3, 0.93, 0.91), (4, 0.50, 0.93)], "version int, accuracy double, f1_score double"
    )


def test_gate_weighs_f1_against_accuracy(spark, versions):
    state = versions.withColumn("is_production", F.col("version") == 1)
    got = dict(rows(V.gate_all(state), "version", "recommendation"))
    # 3: better F1, 97.9 % of the accuracy, not 2 % better; 4: clearly better F1
    assert got == {1: "KEEP", 2: "DEPLOY", 3: "KEEP", 4: "DEPLOY"}
    nobody = versions.withColumn("is_production", F.lit(False))
    assert {r["recommendation"] for r in V.gate_all(nobody).collect()} == {"DEPLOY"}


def test_promotion_leaves_exactly_one_in_production(spark, versions):
    events = spark.createDataFrame([(1, 1), (2, 2), (9, 9), (1, 3)], "version int, promoted_at int")
    state = V.promotion_state(versions, events)
    assert rows(V.current_model(state), "version", "deployed_at") == [(1, 3)]
    assert [r["version"] for r in V.deployment_history(state, 2).collect()] == [1, 2]
    assert rows(V.unknown_versions(events, versions), "version") == [(9,)]
    nothing = V.promotion_state(versions, events.limit(0))
    assert nothing.filter("is_production").count() == 0 and nothing.count() == 4


def test_listing_changes_and_duplicates(spark, versions):
    assert [r["version"] for r in V.version_listing(versions, 2).collect()] == [4, 3]
    change = {(r["version"], r["metric"]): r["change"] for r in V.version_changes(versions, ["accuracy", "f1_score"]).collect()}
    assert change[(1, "accuracy")] is None and change[(2, "f1_score")] == pytest.approx(0.05)
    assert rows(V.duplicate_versions(versions.union(versions.limit(1))), "version", "copies") == [(1, 2)]


def test_compare_models_needs_both_sides(spark):
    side = lambda f1, acc: spark.createDataFrame([("f1", f1), ("accuracy", acc)], "metric string, value double")
    row = V.compare_models(side(0.90, 0.95), side(0.95, 0.98)).first()
    assert row["recommendation"] == "DEPLOY" and row["is_improved"] and row["metric_deltas"]["f1"] == pytest.approx(0.05)
    assert V.compare_models(side(0.90, 0.95), side(0.89, 0.99)).first()["recommendation"] == "KEEP"


def test_registered_forests_are_the_whole_ones(spark, monkeypatch):
    import __spark_entry__ as entry
    from modelwatch.config import Settings
    from modelwatch.plans.catalog import edges
    from modelwatch.operators import training

    class Seen(Exception):
        pass

    def stop(*args):
        raise Seen((args[-1].num_trees, args[-1].max_depth))

    monkeypatch.setattr(training, "train_forest", stop)
    monkeypatch.setattr(edges, "retrain", stop)
    wanted = (Settings().num_trees, Settings().max_depth)
    for name in ("forest_evaluation", "score_transactions", "feature_importance", "retrain_then_monitor"):
        with pytest.raises(Seen) as seen:
            entry.queries()[name](spark, "/root/testdata/sf0.001")
        assert seen.value.args[0] == wanted == (200, 15), name

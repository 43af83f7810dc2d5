import numpy as np
import pytest
from pyspark.sql import functions as F

from modelwatch.operators import inject as J
from tests.conftest import rows

NAMES = [f"f{i}" for i in range(6)]


@pytest.fixture(scope="module")
def wide(spark):
    columns = [(F.col("id") * (i + 1) % 17).cast("double").alias(n) for i, n in enumerate(NAMES)]
    return spark.range(500).select("id", *columns, (F.col("id") % 10 == 0).cast("int").alias("y")).repartition(3)


def test_shift_and_scale_touch_the_first_five_only(wide):
    base = {r["id"]: r for r in wide.collect()}
    for r in J.feature_shift(wide, NAMES).collect():
        assert [r[n] - base[r["id"]][n] for n in NAMES] == [1.5] * 5 + [0.0]
    for r in J.scale_change(wide, NAMES, chosen=["f5"]).collect():
        assert r["f5"] == base[r["id"]]["f5"] * 3 and r["f0"] == base[r["id"]]["f0"]


def test_noise_is_normal_repeatable_and_independent_of_partitions(wide):
    clean = {r["id"]: r for r in wide.collect()}
    one = {r["id"]: r for r in J.noise(wide, NAMES, "id").collect()}
    two = {r["id"]: r for r in J.noise(wide.repartition(7), NAMES, "id").collect()}
    assert one == two
    z = np.array([[(one[i][n] - clean[i][n]) / 0.5 for n in NAMES] for i in clean])
    assert abs(z.mean()) < 0.06 and abs(z.std() - 1) < 0.06
    assert abs(np.corrcoef(z.T)[0, 1]) < 0.15


@pytest.mark.parametrize("limit", [10**6, 20])
@pytest.mark.parametrize("ratio, flips", [(0.15, 75), (0.0, 0), (0.001, 0), (1.0, 500)])
def test_label_flip_is_exact(wide, ratio, flips, limit):
    flipped = J.label_flip(wide.withColumn("old", F.col("y")), "y", "id", ratio, group_limit=limit)
    assert flipped.filter("old <> y").count() == flips
    assert flipped.count() == 500


@pytest.mark.parametrize("n, batches", [(500, 10), (103, 10), (7, 10), (20, 1)])
def test_batches_are_contiguous_with_the_rest_in_the_last(spark, n, batches):
    df = spark.range(n).select((F.col("id") * 3).alias("id"), F.lit(0.0).alias("f0")).repartition(4)
    got = [r["batch"] for r in J.batch_index(df, "id", batches).orderBy("id").collect()]
    size = n // batches
    assert got == [min(i // size, batches - 1) if size else batches - 1 for i in range(n)]


def test_gradual_drift_rises_to_the_maximum(spark):
    df = spark.range(100).select("id", F.lit(0.0).alias("f0"))
    got = [r["f0"] for r in J.gradual_drift(df, ["f0"], "id", 5, 2.0).orderBy("id").collect()]
    assert got == [0.0] * 20 + [0.5] * 20 + [1.0] * 20 + [1.5] * 20 + [2.0] * 20


def test_oversampling_reaches_the_target_exactly(wide):
    grown = J.class_imbalance(wide, "y", "id", 0.4)
    counts = dict(rows(grown.groupBy("y").count()))
    assert counts == {0: 450, 1: int(450 * 0.4 / (1 - 0.4))}
    assert grown.filter("y = 1").select("id").distinct().count() <= 50
    assert grown.filter("y = 1").select("id").distinct().count() == 50  # every original stays
    again = J.class_imbalance(wide.repartition(6), "y", "id", 0.4)
    assert rows(again, "id") == rows(grown, "id")


def test_a_met_target_changes_nothing(wide):
    assert rows(J.class_imbalance(wide, "y", "id", 0.05)) == rows(wide)


def test_scenarios_compose_and_unknown_ones_are_refused(wide):
    for name in J.SCENARIOS:
        assert J.drifted_dataset(wide, name, NAMES, "y", "id").columns == wide.columns
    severe = J.drifted_dataset(wide, "severe", NAMES, "y", "id")
    assert severe.join(wide.select("id", F.col("y").alias("old")), "id").filter("old <> y").count() == 75
    with pytest.raises(ValueError):
        J.drifted_dataset(wide, "earthquake", NAMES, "y", "id")

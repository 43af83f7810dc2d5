import numpy as np
import pytest

from modelwatch.operators.quantiles import Pick, order_statistics, quantiles
from modelwatch.operators.ranking import running_totals, scattered_rank
from pyspark.sql import functions as F

PROBS = [i / 10 for i in range(11)]


def _skewed(seed=3, n=3000):
    """Three groups; one holds most rows, and one value a third of them."""
    rng = np.random.default_rng(seed)
    out = []
    for key, size in (("hot", n), ("cold", 40), ("one", 1)):
        values = rng.lognormal(size=size).round(3)
        values[: size // 3] = 1.25
        out += [(key, float(v)) for v in values]
    rng.shuffle(out)
    return [(k, float(v)) for k, v in out]


@pytest.mark.parametrize("limit, accuracy", [(10**6, 10_000), (10, 100), (10, 10_000), (200, 50)])
def test_quantiles_match_numpy_on_every_path(spark, limit, accuracy):
    data = _skewed()
    df = spark.createDataFrame(data, "k string, v double").repartition(7)
    got = {r["k"]: (r["n"], r["q"]) for r in quantiles(df, ["k"], "v", PROBS, group_limit=limit, accuracy=accuracy).collect()}
    for key in ("hot", "cold", "one"):
        values = np.array([v for k, v in data if k == key])
        assert got[key][0] == len(values)
        np.testing.assert_allclose(got[key][1], np.quantile(values, PROBS), rtol=1e-12)


def test_approximate_quantiles_are_data_values(spark):
    df = spark.range(1, 1001).select(F.col("id").cast("double").alias("v"))
    q = quantiles(df, [], "v", [0.0, 0.5, 1.0], method="approx").first()["q"]
    assert q[0] == 1.0 and q[2] == 1000.0 and abs(q[1] - 500) <= 1
    with pytest.raises(ValueError):
        quantiles(df, [], "v", [0.5], method="guess")


@pytest.mark.parametrize("limit", [10**6, 20])
def test_order_statistics_give_the_value_at_a_rank(spark, limit):
    df = spark.range(5000).select((F.col("id") * 7 % 5000).alias("v")).repartition(5)
    picks = [Pick("a", 0.25, "n div 4"), Pick("b", 0.9, "floor(n * 0.9)")]
    row = order_statistics(df, [], "v", picks, limit, accuracy=500).first()
    assert (row["n"], row["a"], row["b"]) == (5000, 1250, 4500)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_match_a_plain_cumulative_sum(spark, descending):
    rng = np.random.default_rng(1)
    order = np.unique(rng.exponential(size=700))
    weight = rng.integers(1, 9, len(order))
    df = spark.createDataFrame([(float(o), int(w)) for o, w in zip(order, weight)], "o double, w bigint")
    got = running_totals(df, "o", ["w"], descending=descending, buckets=16).orderBy("o").collect()
    plain = np.cumsum(weight[::-1])[::-1] if descending else np.cumsum(weight)
    assert [r["cum_w"] for r in got] == plain.tolist()
    assert {r["total_w"] for r in got} == {int(weight.sum())}


def test_scattered_rank_is_a_permutation_independent_of_partitioning(spark):
    df = spark.range(1000)
    one = {r["id"]: r["rank"] for r in scattered_rank(df.repartition(3), "id", 42, buckets=16).collect()}
    two = {r["id"]: r["rank"] for r in scattered_rank(df.repartition(8), "id", 42, buckets=16).collect()}
    assert one == two
    assert sorted(one.values()) == list(range(1000))
    assert one != {r["id"]: r["rank"] for r in scattered_rank(df, "id", 43, buckets=16).collect()}

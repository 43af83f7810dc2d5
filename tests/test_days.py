import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from modelwatch.operators import drift as D
from modelwatch.sources.days import DayStore

FEATURES = ["a", "b", "flat", "late"]


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    made = []
    for i in range(4000):
        d = rng.randrange(12)
        key = rng.choice(["x", "x", "x", "y", None])
        made.append((day(d), key, rng.gauss(d, 3), float(rng.randrange(6)), 7.0, None if d < 3 else rng.expovariate(1) * (100 if d > 8 else 1)))
    made += [(day(11), "new", 1.0, 2.0, 7.0, float("nan")), (None, "x", 1e9, 1e9, 1e9, 1e9)]
    return spark.createDataFrame(made, "date date, k string, a double, b double, flat double, late double").repartition(4).cache()


@pytest.fixture(scope="module")
def store(spark, rows, tmp_path_factory):
    kept = DayStore(spark, str(tmp_path_factory.mktemp("days")), ["k"], cells=20)
    for first in (0, 3, 6):  # the grid knows the first three days only
        kept.put(rows.filter(F.col("date").between(F.lit(day(first)), F.lit(day(first + 2)))), FEATURES)
    kept.put(rows.filter(F.col("date") >= F.lit(day(9))), FEATURES)
    return kept


def plain(df):
    known = df.withColumns({c: F.round(c, 9) for c in ("psi", "kl")})
    columns = ["k", "feature", "psi", "kl", "ref_rows", "cur_rows", "cur_dropped", "severity"]
    return sorted((tuple(r) for r in known.select(*columns).collect()), key=str)


@pytest.mark.parametrize("spans", [((0, 5), (6, 11)), ((4, 4), (0, 11)), ((0, 2), (9, 11)), ((3, 11), (11, 11))])
def test_any_range_is_as_from_the_rows(store, rows, spans):
    ref, cur = (rows.filter(F.col("date").between(F.lit(day(a)), F.lit(day(b)))) for a, b in spans)
    wanted = plain(D.feature_drift(ref, cur, FEATURES, by=["k"]))
    got = plain(store.drift(*((day(a), day(b)) for a, b in spans)))
    assert got == wanted and len(got) >= 9


def test_large_cells_are_ranked_in_ranges(store):
    span = (day(0), day(11))
    fractions = [0.0, 0.1, 0.5, 0.999, 1.0]
    one = sorted((tuple(r) for r in store.quantiles(fractions, span).collect()), key=str)
    assert sorted((tuple(r) for r in store.quantiles(fractions, span, group_limit=3).collect()), key=str) == one


def test_a_day_that_is_put_again_counts_once(store, rows):
    before = sorted(tuple(r) for r in store.summed((day(0), day(11))).filter("k = 'x'").collect())
    store.put(rows.filter(F.col("date") == F.lit(day(4))), FEATURES)
    assert sorted(tuple(r) for r in store.summed((day(0), day(11))).filter("k = 'x'").collect()) == before


def test_sketches_alone_are_near(store, rows):
    got = {(r.k, r.feature): r for r in store.sketched([0.5], (day(0), day(11))).collect()}
    inside = rows.filter("k = 'x' AND date IS NOT NULL")
    n, below = inside.count(), inside.filter(F.col("a") <= got["x", "a"].q[0]).count()
    assert got["x", "a"].n == n and abs(below / n - 0.5) < 0.05


def test_few_values_are_read(store):
    """Whole cells come from their counts: only the days of the span are
    opened, and of the values only those in cells that an edge cuts."""
    span = (day(3), day(4))
    plan = store._read("values", span)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    profile = store.profile((day(0), day(11)))
    cells = store.summed(span).count()
    cut = store._values(span, store.summed(span).limit(2).select("k", "feature", "cell")).select("k", "feature", "cell").distinct().count()
    assert cut <= 2 < cells and store.counts(span, profile).count() > 0

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelwatch.config import Settings, Threshold, DEFAULT_THRESHOLDS
from modelwatch.operators import bins as B
from modelwatch.operators import drift as D

TEST_LIMITS = Settings(
    thresholds={
        **DEFAULT_THRESHOLDS,
        "kl_divergence": Threshold(0.5, 1.5),
        "accuracy_drop": Threshold(0.02, 0.05),
        "precision_drop": Threshold(0.03, 0.05),
        "recall_drop": Threshold(0.03, 0.05),
    }
)


def frame(spark, **columns):
    names = list(columns)
    return spark.createDataFrame([tuple(float(v) for v in row) for row in zip(*columns.values())], names)


def brute(expected, actual, bins=10):
    """(psi, kl) by explicit intervals."""
    edges = np.unique(np.quantile(expected, np.linspace(0, 1, bins + 1)))

    def share(values):
        counts = []
        for i in range(len(edges) - 1):
            last = i == len(edges) - 2
            counts.append(sum(1 for v in values if edges[i] <= v and (v < edges[i + 1] or (last and v == edges[i + 1]))))
        total = sum(counts)
        return [c / total + 1e-6 for c in counts] if total else None

    p, q = share(expected), share(actual)
    if not p:
        return 0.0, 0.0
    if q is None:
        return None, None
    return (
        sum((b - a) * math.log(b / a) for a, b in zip(p, q)),
        sum(a * math.log(a / b) for a, b in zip(p, q)),
    )


def drift(spark, ref, cur, **options):
    found = D.feature_drift(frame(spark, x=ref), frame(spark, x=cur), ["x"], **options).collect()
    assert len(found) == 1
    return found[0]


def test_same_distribution_is_stable(spark):
    rng = np.random.default_rng(42)
    row = drift(spark, rng.normal(0, 1, 1000), rng.normal(0, 1, 1000), settings=TEST_LIMITS)
    assert row["psi"] < 0.10 and row["kl"] < 0.5
    assert row["severity"] == "none"


def test_shifted_distribution_is_critical(spark):
    rng = np.random.default_rng(42)
    ref, cur = rng.normal(0, 1, 1000), rng.normal(1.5, 1.2, 1000)
    row = drift(spark, ref, cur, settings=TEST_LIMITS)
    psi, kl = brute(ref, cur)
    assert row["psi"] == pytest.approx(psi, abs=1e-9) and row["kl"] == pytest.approx(kl, abs=1e-9)
    assert row["psi"] > 0.25 and row["severity"] == "critical"


def _cases(seed, low, high, longest, n=40):
    """Random small samples, many of them with ties, per case number."""
    rng = np.random.default_rng(seed)
    return {c: rng.integers(low, high, rng.integers(1, longest)).astype(float).tolist() for c in range(n)}


def test_divergence_matches_brute_force(spark):
    refs, curs = _cases(1, 0, 13, 60), _cases(2, -3, 16, 60)
    refs[40], curs[40] = [0.0] * 8 + [2.0] * 3, [0.0]  # a decile just above a value
    refs[41], curs[41] = [1.0, 2.0], [9.0]  # nothing in range
    make = lambda cases: spark.createDataFrame([(c, v) for c, vs in cases.items() for v in vs], "case int, x double")
    found = {r["case"]: r for r in D.feature_drift(make(refs), make(curs), ["x"], by=["case"]).collect()}
    assert set(found) == set(refs)
    for c, row in found.items():
        psi, kl = brute(np.array(refs[c]), np.array(curs[c]))
        if psi is None:
            assert row["psi"] is None and row["severity"] == "unknown"
        else:
            assert row["psi"] == pytest.approx(psi, abs=1e-9), c
            assert row["kl"] == pytest.approx(kl, abs=1e-9), c
            assert row["psi"] >= -1e-9


def test_identical_samples_have_no_divergence(spark):
    row = drift(spark, range(100), range(100))
    assert row["psi"] == 0 and row["kl"] == 0


def test_constant_reference_reads_zero(spark):
    row = drift(spark, [5.0] * 20, [1.0, 5.0, 9.0])
    assert (row["psi"], row["kl"], row["severity"]) == (0.0, 0.0, "none")


def test_values_out_of_range_are_dropped_but_counted(spark):
    row = drift(spark, range(100), [*range(100), 500, 600])
    assert row["psi"] == 0 and row["cur_dropped"] == 2
    opened = drift(spark, range(100), [*range(100), *[500] * 100], open_ends=True)
    assert opened["psi"] > 0.25


def test_a_feature_wholly_out_of_range_is_unknown_and_hides_nothing(spark):
    ref = frame(spark, a=range(50), b=range(50))
    cur = frame(spark, a=[1000] * 50, b=[40 + i / 10 for i in range(50)])
    per = D.feature_drift(ref, cur, ["a", "b"])
    found = {r["feature"]: r for r in per.collect()}
    assert found["a"]["psi"] is None and found["a"]["severity"] == "unknown"
    check = D.data_drift_check(per, ["a", "b"]).first()
    assert check["severity"] == "critical" and check["drifted_features"] == ["b"] and check["unknown_features"] == 1
    only = D.data_drift_check(per.filter("feature = 'a'"), ["a"]).first()
    assert only["severity"] == "unknown" and not only["is_drifted"]


def test_unknown_features_are_skipped_and_reported(spark):
    ref, cur = frame(spark, a=range(20)), frame(spark, a=range(20), b=range(20))
    profile = B.quantile_profile(B.to_long(ref, ["a"]))
    long = B.to_long(cur, ["a", "b"]).withColumn("is_ref", F.lit(False))
    assert [r["feature"] for r in B.unprofiled_features(long, profile).collect()] == ["b"]
    assert {r["feature"] for r in B.quantile_counts(long, profile).collect()} == {"a"}


def test_null_and_nan_values_do_not_count(spark):
    ref = frame(spark, x=range(50))
    cur = spark.createDataFrame([(float(i),) for i in range(50)] + [(None,), (float("nan"),)], "x double")
    assert D.feature_drift(ref, cur, ["x"]).first()["psi"] == 0


def test_keyed_drift_equals_one_check_per_key(spark):
    rng = np.random.default_rng(5)
    make = lambda shift: [(k, float(v)) for k, m in (("a", 0), ("b", 3)) for v in rng.normal(m + shift, 1, 200)]
    ref = spark.createDataFrame(make(0), "k string, x double")
    cur = spark.createDataFrame(make(0.4), "k string, x double")
    keyed = {r["k"]: r for r in D.feature_drift(ref, cur, ["x"], by=["k"]).collect()}
    for k in "ab":
        alone = D.feature_drift(ref.filter(F.col("k") == k), cur.filter(F.col("k") == k), ["x"]).first()
        assert keyed[k]["psi"] == pytest.approx(alone["psi"], abs=1e-12)
        assert keyed[k]["kl"] == pytest.approx(alone["kl"], abs=1e-12)


def test_stored_profile_gives_the_same_result(spark):
    rng = np.random.default_rng(6)
    ref = frame(spark, x=rng.normal(size=300), y=rng.exponential(size=300))
    cur = frame(spark, x=rng.normal(0.5, 1, 200), y=rng.exponential(2, 200))
    long = B.to_long(ref, ["x", "y"])
    profile = B.quantile_profile(long)
    counts = D.reference_counts(long, profile)
    stored = {r["feature"]: r["psi"] for r in D.feature_drift_stored(cur, ["x", "y"], profile, counts).collect()}
    fresh = {r["feature"]: r["psi"] for r in D.feature_drift(ref, cur, ["x", "y"]).collect()}
    assert stored == pytest.approx(fresh, abs=1e-12)


def test_top_drifted_breaks_ties_by_name(spark):
    per = spark.createDataFrame([("b", 0.2), ("a", 0.2), ("c", 0.9)], "feature string, psi double")
    assert [r["feature"] for r in D.top_drifted(per, 2).collect()] == ["c", "a"]


def test_verdict_reaches_thresholds_inclusively(spark):
    def verdict(value):
        per = spark.createDataFrame([("x", value, 0.0)], "feature string, psi double, kl double")
        return D.data_drift_check(per, ["x"]).first()["severity"]

    assert [verdict(v) for v in (0.0999, 0.10, 0.2499, 0.25)] == ["none", "warning", "warning", "critical"]


# -- prediction drift ---------------------------------------------------------

def sides(spark, base, current):
    data = [(False, int(l), float(c)) for l, c in base] + [(True, int(l), float(c)) for l, c in current]
    return spark.createDataFrame(data, "is_current boolean, predicted_label int, confidence double")


def brute_hellinger(p, q, bins=20):
    edges = np.linspace(min(min(p), min(q)), max(max(p), max(q)), bins + 1)
    a, b = np.histogram(p, edges)[0], np.histogram(q, edges)[0]
    a, b = a / a.sum(), b / b.sum()
    return float(np.sqrt(np.sum((np.sqrt(a) - np.sqrt(b)) ** 2)) / np.sqrt(2))


def test_same_confidences_do_not_drift_and_moved_ones_do(spark):
    rng = np.random.default_rng(42)
    labels = rng.binomial(1, 0.02, 500)
    conf = rng.uniform(0.85, 0.99, 500)
    base = list(zip(labels, conf))
    same = D.prediction_drift_check(sides(spark, base, base)).first()
    assert same["hellinger"] == 0 and same["severity"] == "none" and not same["is_drifted"]
    moved = rng.uniform(0.50, 0.75, 500)
    row = D.prediction_drift_check(sides(spark, base, list(zip(rng.binomial(1, 0.3, 500), moved)))).first()
    assert row["hellinger"] == pytest.approx(brute_hellinger(conf, moved), abs=1e-9)
    assert row["severity"] == "critical"


def test_hellinger_matches_numpy(spark):
    base, cur = _cases(3, 0, 41, 50), _cases(4, 0, 41, 50)
    data = [(c, now, 0, v / 40) for now, cases in ((False, base), (True, cur)) for c, vs in cases.items() for v in vs]
    df = spark.createDataFrame(data, "case int, is_current boolean, predicted_label int, confidence double")
    for row in D.prediction_drift_check(df, by=["case"]).collect():
        want = brute_hellinger([v / 40 for v in base[row["case"]]], [v / 40 for v in cur[row["case"]]])
        assert row["hellinger"] == pytest.approx(want, abs=1e-9)
        assert 0 <= row["hellinger"] <= 1 + 1e-12


def test_separate_supports_are_at_distance_one(spark):
    row = D.prediction_drift_check(sides(spark, [(0, 0.1)] * 5, [(0, 0.9)] * 5)).first()
    assert row["hellinger"] == pytest.approx(1.0)


def test_rate_change_is_zero_on_a_zero_baseline(spark):
    row = D.prediction_drift_check(sides(spark, [(0, 0.1), (0, 0.2)], [(1, 0.1), (1, 0.2)])).first()
    assert row["positive_rate_change_pct"] == 0.0
    half = D.prediction_drift_check(sides(spark, [(1, 0.1), (0, 0.2)], [(1, 0.1), (1, 0.2)])).first()
    assert half["positive_rate_change_pct"] == pytest.approx(100.0)


def test_short_logs_get_the_stand_in_baseline(spark):
    log = spark.createDataFrame([(1, 0.4)] * 5, "predicted_label int, confidence double")
    assert D.prediction_baseline(log, 5).count() == 5
    stand_in = D.prediction_baseline(log, 6)
    assert stand_in.count() == 500
    assert stand_in.distinct().collect() == [(0, 0.95)]


# -- concept drift ------------------------------------------------------------

BASE = {"accuracy": 0.95, "f1": 0.90, "precision": 0.92, "recall": 0.88}


def labelled(spark, pairs):
    return spark.createDataFrame(pairs, "true_label int, predicted_label int")


def test_perfect_labels_do_not_drift_and_flipped_ones_do(spark):
    truth = [0, 1, 0, 1, 1, 0, 0, 1, 0, 1]
    good = D.concept_drift_check(labelled(spark, [(t, t) for t in truth]), BASE, settings=TEST_LIMITS).first()
    assert not good["is_drifted"] and good["degraded_metrics"] == [] and good["severity"] == "none"
    bad = D.concept_drift_check(labelled(spark, [(t, 1 - t) for t in truth]), BASE, settings=TEST_LIMITS).first()
    assert bad["severity"] == "critical"
    assert bad["degraded_metrics"] == ["accuracy", "f1", "precision", "recall"]
    assert bad["metric_deltas"]["f1"] == pytest.approx(-0.9)


def test_no_label_no_concept_check(spark):
    assert D.concept_drift_check(labelled(spark, [(None, 1)]), BASE).count() == 0


def test_baseline_must_be_complete(spark):
    with pytest.raises(ValueError):
        D.concept_drift_check(labelled(spark, [(1, 1)]), {"accuracy": 0.9})
    long = spark.createDataFrame([("m", "accuracy", 0.9), ("m", "f1", None)], "model string, metric string, value double")
    assert [r["metric"] for r in D.missing_baseline_metrics(long, ["model"]).collect()] == ["f1", "precision", "recall"]


def test_baseline_metrics_fall_back_to_defaults(spark):
    none = spark.createDataFrame([], "accuracy double, f1_score double, precision double, recall double")
    assert {r["metric"]: r["value"] for r in D.baseline_metrics(none, BASE).collect()} == BASE
    one = spark.createDataFrame([(0.7, 0.6, None, 0.5)], none.schema)
    assert {r["metric"]: r["value"] for r in D.baseline_metrics(one, BASE).collect()} == {
        "accuracy": 0.7, "f1": 0.6, "precision": 0.92, "recall": 0.5
    }


# -- bins -----------------------------------------------------------------------

def test_histogram_matches_numpy(spark):
    cases = {c: [v / 4 for v in vs] for c, vs in _cases(5, -20, 20, 60).items()}
    cases[40] = [3.0, 3.0]
    df = spark.createDataFrame([(c, v) for c, vs in cases.items() for v in vs], "case int, x double")
    got = B.histogram(df, "x", ["case"], bins=7).orderBy("case", "bin").collect()
    for c, values in cases.items():
        low, high = (min(values), max(values)) if min(values) < max(values) else (min(values) - 0.5, max(values) + 0.5)
        edges = [low + i * ((high - low) / 7.0) for i in range(7)] + [high]
        mine = [r for r in got if r["case"] == c]
        assert [r["count"] for r in mine] == np.histogram(values, bins=edges)[0].tolist()
        assert sum(r["density"] for r in mine) * (high - low) / 7 == pytest.approx(1.0)


def test_histogram_of_nothing_is_empty(spark):
    assert B.histogram(spark.createDataFrame([], "x double"), "x").count() == 0


def test_a_group_without_reference_is_unknown(spark):
    ref = spark.createDataFrame([("a", float(i), 2.0 * i) for i in range(40)], "g string, x double, y double")
    cur = spark.createDataFrame([(g, float(i), 2.0 * i) for g in ("a", "new", None) for i in range(40)], "g string, x double, y double")
    profile = B.quantile_profile(B.to_long(ref, ["x", "y"], ["g"]), ["g", "feature"])
    counts = D.reference_counts(B.to_long(ref, ["x", "y"], ["g"]), profile, ["g", "feature"])
    for found in (
        D.feature_drift(ref, cur, ["x", "y"], ["g"]),
        D.feature_drift_stored(cur, ["x", "y"], profile, counts, ["g"], ["g"]),
    ):
        got = {r.g: r for r in D.data_drift_check(found, ["x", "y"], ["g"]).collect()}
        assert set(got) == {"a", "new", None} and got["a"].severity == "none" and got["a"].skipped_features == []
        for g in ("new", None):
            assert (got[g].overall_psi, got[g].severity, got[g].is_drifted) == (None, "unknown", False)
            assert got[g].skipped_features == ["x", "y"] and got[g].out_of_range == []

    sides = [(g, now, i % 2, i / 10) for g in ("a", "new") for now in (True, False) for i in range(8) if g == "a" or now]
    rows = spark.createDataFrame(sides, "g string, is_current boolean, predicted_label int, confidence double")
    got = {r.g: r for r in D.prediction_drift_check(rows, by=["g"]).collect()}
    assert got["a"].severity == "none"
    assert (got["new"].hellinger, got["new"].severity, got["new"].is_drifted) == (None, "unknown", False)
    assert got["new"].current_positive_rate == 0.5 and got["new"].baseline_positive_rate is None

    labelled = rows.withColumn("true_label", rows.predicted_label)
    base = spark.createDataFrame([("a", m, 1.0) for m in ("accuracy", "f1", "precision", "recall")], "g string, metric string, value double")
    got = {r.g: r for r in D.concept_drift_check(labelled, base, by=["g"]).collect()}
    assert got["a"].severity == "none" and got["new"].severity == "unknown" and not got["new"].is_drifted
    assert got["new"].current_metrics["accuracy"] == 1.0 and got["new"].metric_deltas["accuracy"] is None

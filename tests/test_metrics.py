import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator

from modelwatch.operators import metrics as M
from modelwatch.config import load_settings
from modelwatch.operators.training import evaluate, feature_importance, score, search_forest


def labelled(spark, pairs, schema="y int, p int"):
    return spark.createDataFrame(pairs, schema)


def test_confusion_matrix_has_its_empty_cells(spark):
    got = {(r["actual"], r["predicted"]): r["count"] for r in M.confusion_matrix(labelled(spark, [(1, 1), (None, 1)]), "y", "p").collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 1}


def test_zero_denominators_give_zero(spark):
    row = M.binary_metrics(labelled(spark, [(0, 0), (0, 0)]), "y", "p").first()
    assert (row["accuracy"], row["f1"], row["precision"], row["recall"]) == (1.0, 0.0, 0.0, 0.0)
    empty = M.binary_metrics(labelled(spark, []), "y", "p").first()
    assert (empty["n"], empty["accuracy"]) == (0, 0.0)


def test_class_report_sides_mirror(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 0)] * 3 + [(1, 1)] * 7
    got = {r["class"]: r for r in M.class_report(labelled(spark, pairs), "y", "p").collect()}
    assert got[1]["precision"] == pytest.approx(7 / 9) and got[1]["recall"] == pytest.approx(7 / 10)
    assert got[0]["precision"] == pytest.approx(5 / 8) and got[0]["recall"] == pytest.approx(5 / 7)
    assert got[0]["support"] == 7 and got[1]["support"] == 10


def test_coverage_bands(spark):
    def band(pairs):
        return M.label_coverage(labelled(spark, pairs, "true_label int, p int")).first()["band"]

    assert band([(1, 1)] * 6 + [(None, 1)] * 4) == "good"
    assert band([(1, 1)] * 5 + [(None, 1)] * 5) == "warning"
    assert band([(1, 1)] * 2 + [(None, 1)] * 8) == "bad"


def _scored(spark, n=400, seed=2):
    rng = np.random.default_rng(seed)
    y = rng.binomial(1, 0.3, n)
    score = np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1).round(2)  # many ties
    score[: n // 3] = 0.5
    data = [(int(a), float(b)) for a, b in zip(y, score)]
    return data, spark.createDataFrame(data, "y int, s double")


def test_auc_counts_pairs_and_agrees_with_the_evaluator(spark):
    data, df = _scored(spark)
    pos = [s for y, s in data if y == 1]
    neg = [s for y, s in data if y == 0]
    pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    got = M.auc(df, "y", "s", buckets=9).first()["auc"]
    assert got == pytest.approx(pairs, abs=1e-12)
    other = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0).evaluate(df)
    assert got == pytest.approx(other, abs=1e-9)


def test_roc_starts_low_and_ends_at_one(spark):
    _, df = _scored(spark)
    points = sorted((r["fpr"], r["tpr"]) for r in M.roc_curve(df, "y", "s").collect())
    assert points[-1] == (1.0, 1.0)
    assert all(a[1] <= b[1] for a, b in zip(points, points[1:]))


def test_one_class_has_no_curve(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, s double")
    assert M.roc_curve(df, "y", "s").count() == 0
    assert M.auc(df, "y", "s").count() == 0


def test_evaluate_by_key_keeps_keys_without_a_curve(spark):
    df = spark.createDataFrame(
        [("a", 1, 1, 0.9), ("a", 0, 0, 0.1), ("b", 1, 1, 0.8)], "k string, y int, predicted_label int, confidence double"
    )
    got = {r["k"]: r["auc_roc"] for r in evaluate(df, "y", ["k"]).collect()}
    assert got == {"a": 1.0, "b": None}


def test_forest_search_finds_the_feature_that_matters(spark):
    rng = np.random.default_rng(0)
    data = [(float(a), float(b), int(a > 0.3)) for a, b in rng.normal(size=(300, 2))]
    df = spark.createDataFrame(data, "a double, b double, y int")
    settings = load_settings({"num_trees": 2, "max_depth": 2}, {})
    found = search_forest(df, ["a", "b"], "y", {"maxDepth": [1, 3]}, folds=2, parallelism=1, settings=settings)
    assert len(found.avgMetrics) == 2 and max(found.avgMetrics) > 0.9
    importance = {r["feature"]: r["importance"] for r in feature_importance(found.bestModel, ["a", "b"]).collect()}
    assert importance["a"] > importance["b"]
    assert evaluate(score(found.bestModel, df), "y").first()["auc_roc"] > 0.9

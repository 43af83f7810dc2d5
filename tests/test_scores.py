from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelwatch.operators.metrics import auc
from modelwatch.sources.scores import ScoreStore

D0 = date(2024, 5, 1)
SCHEMA = "m string, date date, true_label int, confidence double"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    out = []
    for i in range(1500):
        m = ["a", "b", None][i % 3]
        y = int(rng.random() < 0.3)
        # few distinct scores for a, a hot cell for b, scores beyond [0, 1] for the rest
        s = round(float(rng.random() * (1 + y) / 2), 1) if m == "a" else 0.9995 + rng.random() / 2000 if m == "b" else float(rng.normal(y, 2))
        out.append((m, D0 + timedelta(days=int(rng.integers(0, 6))), None if i % 17 == 0 else y, None if i % 23 == 0 else float("nan") if i % 29 == 0 else s))
    return spark.createDataFrame(out, SCHEMA)


def _brute(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    return sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg)) if pos and neg else None


def _wanted(data, first, last, key):
    groups = {}
    for r in data.collect():
        if r["true_label"] is not None and r["confidence"] is not None and r["confidence"] == r["confidence"] and first <= r["date"] <= last:
            groups.setdefault(key(r), []).append((r["confidence"], r["true_label"]))
    return {k: round(v, 9) for k, v in ((k, _brute(g)) for k, g in groups.items()) if v is not None}


@pytest.mark.parametrize("limit", [10**9, 10])
def test_any_range_of_days_equals_all_pairs(spark, tmp_path, data, limit):
    store = ScoreStore(spark, str(tmp_path / "s"), ["m"], cells=20)
    late = F.col("date") >= F.lit(D0 + timedelta(days=3))
    store.put(data.filter(~late))
    store.put(data.filter(late).limit(50))  # labels still missing
    store.put(data.filter(late))
    for days in ((0, 5), (1, 3), (4, 4)):
        span = tuple(D0 + timedelta(days=d) for d in days)
        got = {r["m"]: round(r["auc"], 9) for r in store.auc(span, limit).collect()}
        assert got == _wanted(data, *span, lambda r: r["m"])
    whole = {r["m"]: round(r["auc"], 9) for r in auc(data.filter("NOT isnan(confidence)"), "true_label", "confidence", ["m"]).collect()}
    assert whole == {r["m"]: round(r["auc"], 9) for r in store.auc((D0, D0 + timedelta(days=5))).collect()}


def test_by_day_without_keys(spark, tmp_path, data):
    store = ScoreStore(spark, str(tmp_path / "s"), cells=7)
    store.put(data)
    span = (D0, D0 + timedelta(days=5))
    assert {r["date"]: round(r["auc"], 9) for r in store.auc_by_day(span).collect()} == _wanted(data, *span, lambda r: r["date"])
    assert [round(r["auc"], 9) for r in store.auc(span).collect()] == list(_wanted(data, *span, lambda r: 0).values())


def test_one_class_and_no_rows(spark, tmp_path):
    store = ScoreStore(spark, str(tmp_path / "s"), ["m"])
    store.put(spark.createDataFrame([("a", D0, 1, 0.2), ("a", D0, 1, 0.4)], SCHEMA))
    assert store.auc((D0, D0)).count() == 0 and store.auc((D0 + timedelta(days=1), D0 + timedelta(days=1))).count() == 0

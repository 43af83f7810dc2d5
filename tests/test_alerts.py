from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelwatch.operators import alerts as A
from tests.conftest import rows

T0 = datetime(2024, 1, 1, 12, 0, 0)


def alert_frame(spark, data):
    """data: (id, minutes after T0, drift type, metric)"""
    return spark.createDataFrame(
        [(i, T0 + timedelta(minutes=m), d, x) for i, m, d, x in data],
        "id bigint, timestamp timestamp, drift_type string, metric_name string",
    )


def brute_suppressed(data, reach=30):
    out = {}
    for i, m, d, x in data:
        out[i] = any(
            d2 == d and x2 == x and (m2, i2) < (m, i) and m - m2 <= reach for i2, m2, d2, x2 in data
        )
    return out


def test_repeats_within_the_window_are_suppressed_and_extend_it(spark):
    data = [(1, 0, "data", "psi"), (2, 20, "data", "psi"), (3, 45, "data", "psi"), (4, 76, "data", "psi"), (5, 0, "concept", "f1")]
    got = {r["id"]: r["suppressed"] for r in A.suppress_repeats(alert_frame(spark, data)).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False, 5: False}


def test_exactly_the_window_is_still_a_repeat(spark):
    data = [(1, 0, "d", "m"), (2, 30, "d", "m"), (3, 60.001, "d", "m")]
    got = {r["id"]: r["suppressed"] for r in A.suppress_repeats(alert_frame(spark, data)).collect()}
    assert got == {1: False, 2: True, 3: False}


def test_equal_times_send_the_lowest_id(spark):
    data = [(7, 5, "d", "m"), (3, 5, "d", "m"), (9, 5, "d", "m")]
    got = {r["id"]: r["suppressed"] for r in A.suppress_repeats(alert_frame(spark, data)).collect()}
    assert got == {3: False, 7: True, 9: True}


@pytest.mark.parametrize("seed", range(4))
def test_suppression_matches_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    data = [
        # one key holds most alerts; some times coincide
        (i, float(rng.integers(0, 1500)), "hot" if rng.random() < 0.5 else f"t{rng.integers(3)}", f"m{rng.integers(2)}")
        for i in range(150)
    ]
    df = alert_frame(spark, data).repartition(5)
    want = brute_suppressed(data)
    assert {r["id"]: r["suppressed"] for r in A.suppress_repeats(df).collect()} == want
    assert {r["id"] for r in A.dispatched(df).collect()} == {i for i, s in want.items() if not s}
    assert A.dispatched(df).columns == df.columns


def test_many_slots_take_the_shuffle_join(spark, monkeypatch):
    from modelwatch.operators import sizing

    data = [(i, i * 10.0, "d", f"m{i % 7}") for i in range(120)]
    df = alert_frame(spark, data)
    want = rows(A.suppress_repeats(df), "id", "suppressed")
    monkeypatch.setattr(sizing, "gather_small", lambda small, max_rows=0: None)
    assert rows(A.suppress_repeats(df), "id", "suppressed") == want


def test_metric_can_be_read_from_the_message(spark):
    df = spark.createDataFrame([("psi is high",), ("f1_drop of model",), ("nothing",)], "message string")
    got = [r[0] for r in df.select(A.metric_in_message(F.col("message"), ["psi", "f1_drop"])).collect()]
    assert got == ["psi", "f1_drop", None]


def test_boxed_message(spark):
    raised = spark.createDataFrame(
        [(T0, "critical", "data", "psi", 0.31, 0.25), (T0, "resolved", "concept", "f1_drop", 0.01, 0.03)],
        "timestamp timestamp, severity string, drift_type string, metric_name string, metric_value double, threshold double",
    )
    made = A.alert_rows(raised).orderBy("drift_type", ascending=False).collect()
    assert [(r["severity"], r["channel"], r["acknowledged"]) for r in made] == [("CRITICAL", "all", False), ("RESOLVED", "all", False)]
    lines = made[0]["message"].split("\n")
    assert len(lines) == 9
    assert lines[1] == "│  " + f"{'🔴 CRITICAL — DATA DRIFT':<43s}" + "│"
    assert lines[3] == "│  Metric   : " + f"{'psi':<31s}" + "│"
    assert lines[4] == "│  Value    : " + f"{0.31:<31.6f}" + "│"
    assert lines[6] == "│  Status   : " + f"{'EXCEEDED':<31s}" + "│"
    assert lines[7] == "│  Time     : " + f"{'2024-01-01 12:00:00 UTC':<31s}" + "│"
    assert "Status   : OK" in made[1]["message"]
    assert len(lines[0]) == 47


def _table(spark):
    return spark.createDataFrame(
        [
            (1, T0, "CRITICAL", "data", "psi", False),
            (2, T0 + timedelta(hours=1), "WARNING", "data", "psi", True),
            (3, T0 + timedelta(hours=1), "RESOLVED", "concept", "f1", False),
        ],
        "id bigint, timestamp timestamp, severity string, drift_type string, metric_name string, acknowledged boolean",
    )


def test_acknowledgement_and_unknown_ids(spark):
    acks = spark.createDataFrame([(1,), (1,), (99,)], "id bigint")
    assert rows(A.with_acknowledgements(_table(spark), acks), "id", "acknowledged") == [(1, True), (2, True), (3, False)]
    assert rows(A.unmatched_acknowledgements(_table(spark), acks), "id") == [(99,)]


def test_listings_and_counts(spark):
    table = _table(spark)
    assert [r["id"] for r in A.active_alerts(table, 5).collect()] == [3, 1]
    assert [r["id"] for r in A.alert_history(table, 2).collect()] == [3, 2]
    assert [r["id"] for r in A.alert_history(table, severity="CRITICAL").collect()] == [1]
    stats = {(r["dimension"], r["name"]): (r["total"], r["active"]) for r in A.alert_stats(table).collect()}
    assert stats[("all", "all")] == (3, 2)
    assert stats[("drift_type", "data")] == (2, 1) and stats[("severity", "RESOLVED")] == (1, 1)
    assert A.resolved_count(table).first()[0] == 1
    assert A.alert_frequency(table, None).count() == 3
    assert A.alert_frequency_wide(table).count() == 2

from datetime import datetime, timedelta

import pytest

from modelwatch.operators import decision as decide

SCHEMA = "overall_psi double, f1_delta double, hellinger double, streak bigint"


def decision(spark, psi=0.02, f1=-0.01, hel=0.04, streak=0, **options):
    df = spark.createDataFrame([(psi, f1, hel, streak)], SCHEMA)
    return decide.retraining_decision(df, **options).first()


def test_quiet_summary_needs_no_action(spark):
    row = decision(spark)
    assert (row["action"], row["urgency"], row["should_retrain"], row["triggered_rules"]) == ("NO_ACTION", "NONE", False, [])
    assert row["reason"] == "No drift rules triggered."


def test_critical_psi_retrains(spark):
    row = decision(spark, psi=0.35)
    assert (row["action"], row["urgency"]) == ("RETRAIN", "HIGH")
    assert row["triggered_rules"] == ["critical_data_drift"]
    assert row["reason"] == "Critical data drift: PSI 0.3500 > 0.2500"


def test_falling_f1_retrains(spark):
    row = decision(spark, f1=-0.07)
    assert (row["action"], row["urgency"], row["triggered_rules"]) == ("RETRAIN", "HIGH", ["f1_degradation"])


def test_rising_f1_counts_unless_signed(spark):
    assert decision(spark, f1=0.07)["action"] == "RETRAIN"
    assert decision(spark, f1=0.07, signed=True)["action"] == "NO_ACTION"
    assert decision(spark, f1=-0.07, signed=True)["action"] == "RETRAIN"


def test_moderate_drift_with_a_small_drop(spark):
    row = decision(spark, psi=0.15, f1=-0.03)
    assert (row["action"], row["urgency"]) == ("RETRAIN", "MEDIUM")
    assert row["triggered_rules"] == ["moderate_drift_with_perf_drop"]


def test_prediction_shift_is_flagged_unless_retraining(spark):
    assert decision(spark, hel=0.3)["action"] == "FLAG_FOR_REVIEW"
    row = decision(spark, hel=0.3, psi=0.4)
    assert row["action"] == "RETRAIN" and " | " in row["reason"] and row["urgency"] == "HIGH"


def test_streak_overrides_the_flag(spark):
    row = decision(spark, hel=0.3, streak=3)
    assert (row["action"], row["urgency"]) == ("RETRAIN", "MEDIUM")
    assert row["triggered_rules"] == ["prediction_shift", "sustained_warning"]


@pytest.mark.parametrize("at", [dict(psi=0.25), dict(f1=-0.05), dict(hel=0.20), dict(streak=2), dict(psi=0.10, f1=-0.03)])
def test_rules_are_strict_at_their_limits(spark, at):
    assert decision(spark, **at)["action"] == "NO_ACTION"


def test_missing_checks_are_silent(spark):
    assert decision(spark, psi=None, f1=None, hel=None, streak=None)["action"] == "NO_ACTION"
    assert decision(spark, psi=None, f1=-0.2)["triggered_rules"] == ["f1_degradation"]


def test_only_actions_are_recorded(spark):
    df = spark.createDataFrame([(0.4, 0.0, 0.0, 0), (0.0, 0.0, 0.3, 0), (0.0, 0.0, 0.0, 0)], SCHEMA)
    assert sorted(r["status"] for r in decide.decision_events(decide.retraining_decision(df)).collect()) == ["REJECTED", "STARTED"]


T0 = datetime(2024, 1, 1)


def results(spark, breaches, key="m"):
    """Newest first."""
    n = len(breaches)
    return spark.createDataFrame(
        [(i, T0 + timedelta(minutes=n - i), key, b) for i, b in enumerate(breaches)],
        "id bigint, timestamp timestamp, model string, is_breached boolean",
    )


@pytest.mark.parametrize("breaches", [[], [False], [True, True, False, True], [True] * 60])
def test_streak_counts_back_to_the_first_clear_row(spark, breaches):
    whole = next((i for i, b in enumerate(breaches) if not b), len(breaches))
    df = results(spark, breaches)
    assert decide.breach_streak(df).first()["streak"] == min(whole, 50)
    assert decide.breach_streak(df, last=None).first()["streak"] == whole


def test_streak_per_key_and_per_check(spark):
    df = results(spark, [True, False], "a").union(results(spark, [True, True, True], "b"))
    want = {"a": 1, "b": 3}
    for last in (50, None):
        assert {r["model"]: r["streak"] for r in decide.breach_streak(df, by=["model"], last=last).collect()} == want
    # three rows of one time are one check
    one = spark.createDataFrame([(i, T0, True) for i in range(3)], "id bigint, timestamp timestamp, is_breached boolean")
    assert decide.breach_streak(one).first()["streak"] == 3
    assert decide.breach_streak(one, per_check=True).first()["streak"] == 1

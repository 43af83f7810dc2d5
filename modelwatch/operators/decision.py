"""Breach streaks and the retraining rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Settings
from .ranking import newest
from .sizing import attach_row

#: Fixed values of the rules that are not thresholds.
PERF_DROP = 0.02
STREAK_ROWS = 50
STREAK_LIMIT = 3
NO_RULE = "No drift rules triggered."


def breach_streak(
    results: DataFrame,
    ts: str = "timestamp",
    tie: str = "id",
    by: Sequence[str] = (),
    last: int | None = STREAK_ROWS,
    per_check: bool = False,
) -> DataFrame:
    """Breached rows from the newest back to the first that is not.

    ``per_check`` counts checks (rows of one time) instead of rows.  With
    ``last`` at most that many rows per key are ordered; without it the streak
    over the whole history comes from two aggregates and no ordering at all.
    """
    by = list(by)
    rows = results.select(*by, ts, tie, "is_breached")
    if per_check:
        rows = rows.groupBy(*by, ts).agg(F.max(tie).alias(tie), F.bool_or("is_breached").alias("is_breached"))
    if last is not None:
        rows = newest(rows, last, ts, tie, by)
        order = W.partitionBy(*(by or [F.lit(0)])).orderBy(F.col(ts).desc(), F.col(tie).desc())
        misses = F.sum(F.when(F.col("is_breached"), 0).otherwise(1)).over(
            order.rowsBetween(W.unboundedPreceding, 0)
        )
        return rows.withColumn("_m", misses).groupBy(*by).agg(F.count_if(F.col("_m") == 0).alias("streak"))
    at = F.struct(F.col(ts).alias("t"), F.col(tie).alias("i"))
    clear = rows.groupBy(*by).agg(F.max(F.when(~F.col("is_breached"), at)).alias("_clear"))
    if by:
        placed = rows.join(clear, by)
    else:
        placed = rows.withColumn("_clear", clear.scalar())
    newer = F.col("_clear").isNull() | (at > F.col("_clear"))
    return placed.groupBy(*by).agg(F.count_if(newer).alias("streak"))


def retraining_decision(
    summary: DataFrame, settings: Settings | None = None, signed: bool = False
) -> DataFrame:
    """Apply the five rules to (overall_psi, f1_delta, hellinger, streak).

    All comparisons are strict.  A NULL input silences its rules.  An F1 change
    counts in both directions unless ``signed`` is set.
    """
    settings = settings or Settings()
    psi, f1, hel, streak = (F.col(c) for c in ("overall_psi", "f1_delta", "hellinger", "streak"))
    drop = F.greatest(-f1, F.lit(0.0)) if signed else F.abs(f1)
    psi_hi, psi_lo = settings["psi"].critical, settings["psi"].warning
    f1_hi, hel_hi = settings["f1_drop"].critical, settings["hellinger"].critical

    def text(fmt, *args):
        return F.format_string(fmt, *args)

    # Rule names, their urgency and the wording of their reasons.
    # All but the prediction shift ask for a retrain.
    rules = [
        ("critical_data_drift", psi > psi_hi, 0,
         text("Critical data drift: PSI %.4f > %.4f", psi, F.lit(psi_hi))),
        ("f1_degradation", drop > f1_hi, 0,
         text("F1 degradation: |Δf1| %.4f > %.4f", drop, F.lit(f1_hi))),
        ("moderate_drift_with_perf_drop", (psi > psi_lo) & (drop > PERF_DROP), 1,
         text("Moderate drift with perf drop: PSI %.4f > %.4f AND |Δf1| %.4f > 0.02", psi, F.lit(psi_lo), drop)),
        ("prediction_shift", hel > hel_hi, 1,
         text("Prediction shift: Hellinger %.4f > %.4f", hel, F.lit(hel_hi))),
        ("sustained_warning", streak >= STREAK_LIMIT, 1,
         text("Sustained warnings: %d consecutive breaches (threshold: 3)", streak)),
    ]
    fired = {name: F.coalesce(cond, F.lit(False)) for name, cond, _, _ in rules}
    names = F.array_compact(F.array(*[F.when(fired[n], n) for n, *_ in rules]))
    reasons = F.concat_ws(" | ", *[F.when(fired[n], reason) for n, _, _, reason in rules])
    rank = F.least(*[F.when(fired[n], r).otherwise(3) for n, _, r, _ in rules])
    retrain = F.lit(False)
    for name in fired:
        if name != "prediction_shift":
            retrain = retrain | fired[name]
    action = F.when(retrain, "RETRAIN").when(fired["prediction_shift"], "FLAG_FOR_REVIEW").otherwise("NO_ACTION")
    return summary.withColumns(
        {
            "should_retrain": retrain,
            "action": action,
            "urgency": F.when(rank == 0, "HIGH").when(rank == 1, "MEDIUM").otherwise("NONE"),
            "reason": F.when(reasons == "", NO_RULE).otherwise(reasons),
            "triggered_rules": names,
        }
    )


def decision_events(decisions: DataFrame, ts: str = "timestamp", champion: DataFrame | None = None) -> DataFrame:
    """Audit rows: RETRAIN opens as STARTED, a flag is REJECTED, the rest is
    not recorded.  ``champion`` (version, f1_score; one row or none) gives the
    version that was in production then, as ``old_version`` and ``old_f1``."""
    acted = decisions.filter(F.col("action") != "NO_ACTION")
    if champion is not None:
        held = champion.agg(F.max("version").alias("old_version"), F.max("f1_score").alias("old_f1"))
        acted = attach_row(acted, held)
    return acted.withColumn("status", F.when(F.col("should_retrain"), "STARTED").otherwise("REJECTED")).withColumnRenamed(
        "reason", "trigger_reason"
    )

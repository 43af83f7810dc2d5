"""The retraining rules over one summary per order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import decision as decide
from ...sources.fixtures import adapter, adapter_sql
from .registry import query

_I = f"WITH i AS ({adapter_sql('decision_inputs')}) "

# Long form: one row per fired rule, then put together again.
DECISION_SQL = """, rules(no, name, rank, retrain) AS (VALUES (1, 'critical_data_drift', 0, true), (2, 'f1_degradation', 0, true),
 (3, 'moderate_drift_with_perf_drop', 1, true), (4, 'prediction_shift', 1, false), (5, 'sustained_warning', 1, true)),
f AS (SELECT i.*, r.*, CASE r.no WHEN 1 THEN printf('Critical data drift: PSI %.4f > 0.2500', overall_psi)
  WHEN 2 THEN printf('F1 degradation: |Δf1| %.4f > 0.0500', abs(f1_delta))
  WHEN 3 THEN printf('Moderate drift with perf drop: PSI %.4f > 0.1000 AND |Δf1| %.4f > 0.02', overall_psi, abs(f1_delta))
  WHEN 4 THEN printf('Prediction shift: Hellinger %.4f > 0.2000', hellinger)
  ELSE printf('Sustained warnings: %d consecutive breaches (threshold: 3)', streak) END AS why,
  coalesce(CASE r.no WHEN 1 THEN overall_psi > 0.25 WHEN 2 THEN abs(f1_delta) > 0.05 WHEN 3 THEN overall_psi > 0.1 AND abs(f1_delta) > 0.02
  WHEN 4 THEN hellinger > 0.2 ELSE streak >= 3 END, false) AS fired FROM i, rules r)
SELECT {keys}coalesce(bool_or(fired AND retrain), false) AS should_retrain,
 CASE WHEN bool_or(fired AND retrain) THEN 'RETRAIN' WHEN bool_or(fired) THEN 'FLAG_FOR_REVIEW' ELSE 'NO_ACTION' END AS action,
 CASE min(rank) FILTER (fired) WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'NONE' END AS urgency,
 coalesce(string_agg(why, ' | ' ORDER BY no) FILTER (fired), 'No drift rules triggered.') AS reason,
 coalesce(string_agg(name, ',' ORDER BY no) FILTER (fired), '') AS triggered_rules FROM f GROUP BY ALL"""


@query("retraining_decision", _I + DECISION_SQL.format(keys="id, "))
def retraining_decision(spark, sf_dir):
    decided = decide.retraining_decision(adapter(spark, sf_dir, "decision_inputs"))
    return decided.select(
        "id", "should_retrain", "action", "urgency", "reason", F.concat_ws(",", "triggered_rules").alias("triggered_rules")
    )


@query("decision_events", _I + """SELECT id, event_ts, CASE WHEN overall_psi > 0.25 OR abs(f1_delta) > 0.05 OR (overall_psi > 0.1 AND abs(f1_delta) > 0.02) OR streak >= 3
 THEN 'STARTED' ELSE 'REJECTED' END AS status FROM i
 WHERE overall_psi > 0.25 OR abs(f1_delta) > 0.05 OR (overall_psi > 0.1 AND abs(f1_delta) > 0.02) OR hellinger > 0.2 OR streak >= 3""")
def decision_events(spark, sf_dir):
    """What is recorded: no row without an action."""
    decided = decide.retraining_decision(adapter(spark, sf_dir, "decision_inputs"))
    return decide.decision_events(decided, "event_ts").select("id", "event_ts", "status")


@query("decision_signed", _I + """SELECT id, coalesce(overall_psi > 0.25, false) OR coalesce(f1_delta < -0.05, false)
 OR coalesce(overall_psi > 0.1 AND f1_delta < -0.02, false) OR streak >= 3 AS should_retrain FROM i""")
def decision_signed(spark, sf_dir):
    """The rules when only a falling F1 counts."""
    return decide.retraining_decision(adapter(spark, sf_dir, "decision_inputs"), signed=True).select("id", "should_retrain")

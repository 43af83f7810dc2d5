"""The full drift check and the monitoring cycle around it."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import decision as decide
from ..operators import drift as D
from ..operators.prediction_log import enough_samples, feature_columns
from ..operators.results import drift_result_rows, drift_summary
from ..operators.sizing import attach_row, join_small, match, settle
from ..sources.tables import MonitorTables

log = logging.getLogger(__name__)

_FAILURE = "drift_type string, message string, window_start timestamp, window_end timestamp"


@dataclass
class DriftCheck:
    """Outcome of one check: a summary row per key (None when nothing ran), the
    rows to store, and the detectors that failed."""

    summary: DataFrame | None = None
    results: DataFrame | None = None
    failed: dict[str, str] = field(default_factory=dict)
    failures: DataFrame | None = None

    @property
    def status(self) -> str:
        """Overall status of an unkeyed check; healthy when nothing was to run,
        unknown when everything that ran failed."""
        row = self.summary.select("overall_status").first() if self.summary is not None else None
        return row[0] if row else "unknown" if self.failed else "healthy"


def _isolated(name: str, build: Callable[[], DataFrame], failed: dict[str, str]) -> DataFrame | None:
    """Run one detector to its (small) result, so that its failure stays its own."""
    try:
        return settle(build(), name)
    except Exception as err:  # noqa: BLE001
        log.exception("%s check failed", name)
        failed[name] = str(err).splitlines()[0] if str(err) else type(err).__name__
        return None


def run_drift_check(
    window: DataFrame,
    features: Sequence[str],
    data: Callable[[DataFrame], DataFrame] | None = None,
    prediction_baseline: DataFrame | None = None,
    metric_baseline: Mapping[str, float] | DataFrame | None = None,
    by: Sequence[str] = (),
    ts: str = "timestamp",
    settings: Settings | None = None,
) -> DriftCheck:
    """All configured checks on ``window`` (a frame of predictions, with feature
    columns).

    ``data`` maps the window to per-feature drift, which lets the caller choose
    between a raw reference and a stored profile.  A detector without its
    baseline is left out, and concept drift uses labelled rows only.  An empty
    window gives an empty, healthy check.
    """
    settings = settings or Settings()
    out = DriftCheck()
    if window.isEmpty():
        log.warning("drift check on an empty window")
        return out
    branches: dict[str, Callable[[], DataFrame]] = {}
    if data is not None:
        branches["data"] = lambda: D.data_drift_check(data(window), features, by, settings)
    if prediction_baseline is not None:
        def both() -> DataFrame:
            columns = [*by, "predicted_label", "confidence"]
            sides = window.select(*columns).withColumn("is_current", F.lit(True)).unionByName(
                prediction_baseline.select(*columns).withColumn("is_current", F.lit(False))
            )
            return D.prediction_drift_check(sides, by=by, settings=settings)

        branches["prediction"] = both
    if metric_baseline is not None:
        branches["concept"] = lambda: D.concept_drift_check(
            window.filter(F.col("true_label").isNotNull()), metric_baseline, by=by, settings=settings
        )
    # The branches share no result, so their jobs are submitted side by side.
    with ThreadPoolExecutor(max_workers=4) as pool:
        span = pool.submit(lambda: window.agg(F.min(ts), F.max(ts)).first())
        started = {name: pool.submit(_isolated, name, build, out.failed) for name, build in branches.items()}
        parts: dict[str, DataFrame | None] = {
            name: started[name].result() if name in started else None for name in ("data", "prediction", "concept")
        }
        first, last = span.result()
    out.summary = drift_summary(parts["data"], parts["prediction"], parts["concept"], by)
    if out.failed:
        spark = window.sparkSession
        found = spark.createDataFrame([(n, m, first, last) for n, m in sorted(out.failed.items())], _FAILURE)
        out.failures = found.withColumn("timestamp", F.col("window_end")).withColumn("id", F.xxhash64("timestamp", "drift_type"))
    if out.summary is not None:
        start, end = F.lit(first), F.lit(last)
        if by:  # every key has a window of its own
            spans = settle(window.groupBy(*by).agg(F.min(ts).alias("_start"), F.max(ts).alias("_end")), "spans")
            parts = {name: part if part is None else match(part, spans, by, "left") for name, part in parts.items()}
            start, end = F.col("_start"), F.col("_end")
        out.results = drift_result_rows(
            parts["data"], parts["prediction"], parts["concept"], end, start, end, settings=settings, by=by
        )
    return out


def decision_inputs(summary: DataFrame, streak: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The four inputs of the rules; a check that did not run gives NULL."""
    have = set(summary.columns)
    columns = {
        "overall_psi": F.col("overall_psi") if "overall_psi" in have else F.lit(None).cast("double"),
        "f1_delta": F.try_element_at("metric_deltas", F.lit("f1")) if "metric_deltas" in have else F.lit(None).cast("double"),
        "hellinger": F.col("hellinger") if "hellinger" in have else F.lit(None).cast("double"),
    }
    inputs = summary.select(*by, *[c.alias(n) for n, c in columns.items()])
    if streak is None:
        return inputs.withColumn("streak", F.lit(0).cast("bigint"))
    if by:
        return match(inputs, streak, by, "left")
    return inputs.withColumn("streak", streak.scalar())


def _append_new(tables: MonitorTables, name: str, rows: DataFrame, key: str) -> None:
    """Append the few ``rows`` of a check that the table does not hold yet, so that
    a cycle over the same window, or its replay, adds nothing."""
    rows = settle(rows, name)
    times = rows.agg(F.min("timestamp")).first()[0]
    held = tables.read(name).filter(F.col("timestamp") >= F.lit(times)).select(key) if times is not None else None
    tables.append(name, rows if held is None else rows.join(held, key, "left_anti"))


def _undecided(keys: DataFrame, failed: Mapping[str, str]) -> DataFrame:
    reason = "No detector gave a result: " + " | ".join(f"{n}: {m}" for n, m in sorted(failed.items()))
    verdict = {"should_retrain": False, "action": "UNKNOWN", "urgency": "NONE", "reason": reason}
    return keys.withColumns({c: F.lit(v) for c, v in verdict.items()}).withColumn("triggered_rules", F.array().cast("array<string>"))


def monitor_once(
    tables: MonitorTables,
    features: Sequence[str],
    metric_baseline: Mapping[str, float] | DataFrame | None = None,
    prediction_baseline: DataFrame | None = None,
    settings: Settings | None = None,
    by: Sequence[str] = (),
) -> DataFrame | None:
    """One monitoring cycle: newest window, gate, check, store, decide, record.

    Returns the decision (one row), or None below the minimum of samples.  Failed
    detectors are stored; when all failed, the action is UNKNOWN.  The
    window is a top-k of fixed size, so it is kept between the branches.  A second
    cycle over the same window decides again, but records nothing twice.

    With ``by=["model_version"]`` every model has a window, a gate, a streak and a
    decision of its own, all from one run; models below the minimum are left
    out.  ``prediction_baseline`` and a frame of metrics then have the key too;
    the stored profile of the features is the same for all.
    """
    settings = settings or Settings()
    by = list(by)
    if by not in ([], ["model_version"]):
        raise ValueError(f"a cycle runs over the whole log or by model_version, not by {by}")
    rows = tables.recent_by_model(settings.window_size) if by else tables.recent_predictions(settings.window_size)
    whole = feature_columns(rows, features).persist()
    try:
        gate = settle(enough_samples(whole, settings.min_samples, by).filter("ready"), "gate")
        if gate.isEmpty():
            return None
        window = join_small(whole, gate.select(*by), by) if by else whole
        profile, counts = tables.load_profile()
        check = run_drift_check(
            window,
            features,
            data=lambda w: D.feature_drift_stored(w, features, profile, counts, by, settings=settings),
            prediction_baseline=prediction_baseline,
            metric_baseline=metric_baseline,
            by=by,
            settings=settings,
        )
        if check.failures is not None:
            _append_new(tables, "detector_failures", check.failures, "id")
        if check.summary is None:
            return _undecided(gate.select(*by), check.failed) if check.failed else None
        _append_new(tables, "drift_results", check.results, "id")
        streak = decide.breach_streak(tables.read("drift_results"), by=by)
        # a baseline may have more keys than the windows
        summary = join_small(check.summary, gate.select(*by), by) if by else check.summary
        inputs = decision_inputs(summary, streak, by)
        decision = settle(decide.retraining_decision(inputs, settings), "decision")
        last = window.groupBy(*by).agg(F.max("timestamp").alias("timestamp"))
        timed = match(decision, last, by) if by else attach_row(decision, last)
        events = decide.decision_events(timed, champion=tables.versions().filter("is_production"))
        name = F.concat_ws("-", F.lit("check"), F.unix_micros("timestamp").cast("string"), *by)
        _append_new(tables, "retraining_events", events.withColumn("event_id", name).withColumn("seq", F.lit(0)), "event_id")
        return decision
    finally:
        whole.unpersist()

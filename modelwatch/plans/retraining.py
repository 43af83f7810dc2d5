"""A retraining run: assemble, scale, split, train, compare, deploy or keep."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import training as T
from ..operators.alerts import alert_rows
from ..operators.dataset import apply_scaler, fit_scaler, retraining_dataset, stratified_split
from ..operators.forest import Forest
from ..operators.sizing import settle
from ..operators.versions import compare_models
from ..schemas import FEATURES, REQUIRED_METRICS, TARGET
from ..session import materialise
from ..sources.tables import MonitorTables

log = logging.getLogger(__name__)

#: Newest labelled predictions that join the original rows.
RECENT_LABELLED = 1000


def model_path(tables: MonitorTables, version: int) -> str:
    return f"{tables.root}/models/v{version}"


def load_model(tables: MonitorTables, version: int) -> Forest:
    return Forest.load(tables.spark, model_path(tables, version))


def production_version(tables: MonitorTables) -> int | None:
    row = tables.versions().filter("is_production").select("version").first()
    return row[0] if row else None


class _Run:
    """Writes the audit events of one run; its current state is the last one."""

    def __init__(self, tables: MonitorTables, reason: str, old_version: int | None, old_f1: float | None) -> None:
        self.tables, self.id, self.seq = tables, uuid.uuid4().hex, 0
        self.base = {"trigger_reason": reason, "old_version": old_version, "old_f1": old_f1}

    def mark(self, status: str, new_version: int | None = None, new_f1: float | None = None) -> None:
        row = (
            self.id, self.seq, datetime.now(timezone.utc), self.base["trigger_reason"], self.base["old_version"],
            new_version, self.base["old_f1"], new_f1, status,
        )
        self.seq += 1
        schema = self.tables.read("retraining_events").schema
        self.tables.append("retraining_events", self.tables.spark.createDataFrame([row], schema))

    def alert(self, severity: str, new_f1: float, message: str) -> None:
        row = (datetime.now(timezone.utc), severity, "retraining", "retraining_status", new_f1,
               float(self.base["old_f1"] or 0.0), message)
        raised = self.tables.spark.createDataFrame(
            [row],
            "timestamp timestamp, severity string, drift_type string, metric_name string, "
            "metric_value double, threshold double, message string",
        )
        self.tables.append("alerts", alert_rows(raised))


def _long(metrics: DataFrame) -> DataFrame:
    return metrics.unpivot([], [*REQUIRED_METRICS, "auc_roc"], "metric", "value")


def _scored(model: Forest, rows: DataFrame, target: str) -> DataFrame:
    """Scored once, for all that is computed from the scores."""
    return materialise(T.score(model, rows).select(target, "predicted_label", "confidence"), "scored")


def retrain(
    tables: MonitorTables,
    original: DataFrame,
    reason: str,
    features: Sequence[str] = FEATURES,
    target: str = TARGET,
    scaled: str | None = "Amount",
    settings: Settings | None = None,
    recent: int = RECENT_LABELLED,
) -> bool:
    """Train a challenger and promote it if it beats the champion on the same
    test rows, or if there is no champion.  True when it was promoted.  ``recent``
    newest labelled predictions join the original rows.  A run during which another
    version was promoted has compared itself with the wrong champion: it is
    rejected, and its version stays recorded out of production."""
    settings = settings or Settings()
    seen = tables.promotion_number()
    old_version = production_version(tables)
    old_f1 = None
    if old_version is not None:
        old_f1 = tables.versions().filter(F.col("version") == old_version).first()["f1_score"]
    run = _Run(tables, reason, old_version, old_f1)
    run.mark("STARTED")
    try:
        fresh = tables.recent_labelled(recent)
        combined = retraining_dataset(original, fresh, features, target, recent)
        # Row ids are given once and written down, so every later pass and
        # every recomputed task sees the same ones.
        rows = materialise(
            combined.na.fill(0.0, list(features)).withColumn("row_id", F.monotonically_increasing_id()), "dataset"
        )
        # split before scaling, so that the raw training rows need no join later
        rows = materialise(stratified_split(rows, target, "row_id", seed=settings.seed), "split")
        scaler = settle(fit_scaler(rows, scaled), "scaler") if scaled else None
        prepared = apply_scaler(rows, scaler, scaled) if scaled else rows
        train = prepared.filter("split = 'train'")
        test = prepared.filter("split = 'test'")
        model = T.train_forest(train, features, target, settings)
        new = materialise(T.evaluate(_scored(model, test, target), target), "metrics")
        new_f1 = new.first()["f1"]
        deploy = True
        if old_version is not None:
            current = T.evaluate(_scored(load_model(tables, old_version), test, target), target)
            verdict = compare_models(_long(current), _long(new)).first()
            deploy = verdict["recommendation"] == "DEPLOY"
        if not deploy:
            run.mark("REJECTED", new_f1=new_f1)
            run.alert("WARNING", new_f1, f"Retraining rejected: the new model is no better than version {old_version}.")
            return False
        now = datetime.now(timezone.utc)
        version = tables.new_version(run.id)
        model.save(model_path(tables, version))
        tables.append(
            "model_versions",
            new.withColumnRenamed("f1", "f1_score")
            .withColumn("version", F.lit(version))
            .withColumn("run_id", F.lit(run.id))
            .withColumn("training_date", F.lit(now)),
        )
        if scaler is not None:
            tables.append("scaler", scaler.withColumn("version", F.lit(version)))
        if not tables.promote(version, now, seen):
            run.mark("REJECTED", version, new_f1)
            run.alert("WARNING", new_f1, f"Retraining rejected: another version was promoted while version {version} was trained.")
            return False
        # the log holds raw features, and so does the baseline that it is compared with
        tables.save_baseline(rows.filter("split = 'train'"), features, version)
        run.mark("COMPLETED", version, new_f1)
        run.alert("RESOLVED", new_f1, f"Retraining completed: version {version} is in production. Trigger: {reason}")
        return True
    except Exception as err:
        log.exception("retraining failed")
        run.mark("FAILED")
        run.alert("CRITICAL", 0.0, f"Retraining failed: {type(err).__name__}")
        return False

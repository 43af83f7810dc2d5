"""Schemas of the monitoring tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Canonical feature order of the training table.
FEATURES: list[str] = [f"V{i}" for i in range(1, 29)] + ["Amount"]
TARGET = "Class"
REQUIRED_METRICS: list[str] = ["accuracy", "f1", "precision", "recall"]


_TYPES: dict[str, T.DataType] = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "date": T.DateType(),
    "features": T.MapType(T.StringType(), T.DoubleType()),
}


def _table(columns: str) -> T.StructType:
    """``"id bigint, features features"`` to a schema, without a session."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind.lower()]) for name, kind in pairs])


TRAINING = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in FEATURES] + [T.StructField(TARGET, T.IntegerType())]
)

TABLES: dict[str, T.StructType] = {
    "predictions": _table(
        "id BIGINT, timestamp TIMESTAMP, model_version STRING, features features, "
        "predicted_label INT, confidence DOUBLE, latency_ms DOUBLE"
    ),
    # Late labels, acknowledgements and promotions are events of their own:
    # files are only ever appended to, the current state is the latest row per key.
    "quarantine": _table(
        "id BIGINT, timestamp TIMESTAMP, model_version STRING, features_json STRING, missing STRING"
    ),
    # per logged batch: its first id and its number of ids
    "id_marks": _table("batch STRING, first_id BIGINT, n BIGINT"),
    # which days hold how many rows of a model; never fewer rows or days than the log has
    "prediction_days": _table("model_version STRING, day DATE, n BIGINT"),
    "labels": _table("id BIGINT, labelled_at TIMESTAMP, true_label INT"),
    "drift_results": _table(
        "id BIGINT, timestamp TIMESTAMP, model_version STRING, drift_type STRING, "
        "metric_name STRING, metric_value DOUBLE, threshold DOUBLE, is_breached BOOLEAN, "
        "window_start TIMESTAMP, window_end TIMESTAMP, details_json STRING"
    ),
    "detector_failures": _table(
        "id BIGINT, timestamp TIMESTAMP, drift_type STRING, message STRING, window_start TIMESTAMP, window_end TIMESTAMP"
    ),
    "alerts": _table(
        "id BIGINT, timestamp TIMESTAMP, severity STRING, drift_type STRING, metric_name STRING, "
        "message STRING, channel STRING, acknowledged BOOLEAN"
    ),
    "acknowledgements": _table("id BIGINT, acknowledged_at TIMESTAMP"),
    "model_versions": _table(
        "version INT, run_id STRING, accuracy DOUBLE, f1_score DOUBLE, precision DOUBLE, "
        "recall DOUBLE, auc_roc DOUBLE, training_date TIMESTAMP"
    ),
    "promotions": _table("version INT, promoted_at TIMESTAMP"),
    "retraining_events": _table(
        "event_id STRING, seq INT, timestamp TIMESTAMP, trigger_reason STRING, old_version INT, "
        "new_version INT, old_f1 DOUBLE, new_f1 DOUBLE, status STRING"
    ),
    "scaler": _table("version INT, column STRING, mean DOUBLE, std DOUBLE"),
}

# Tables that grow with traffic are partitioned by day.
DAILY: dict[str, str] = {
    "predictions": "timestamp",
    "quarantine": "timestamp",
    "drift_results": "timestamp",
    "detector_failures": "timestamp",
    "alerts": "timestamp",
}

"""Thresholds and monitoring constants (fixed values, overridable)."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Threshold:
    warning: float
    critical: float


# Default warning / critical pairs per metric.
DEFAULT_THRESHOLDS: dict[str, Threshold] = {
    "psi": Threshold(0.10, 0.25),
    "kl_divergence": Threshold(0.05, 0.15),
    "hellinger": Threshold(0.10, 0.20),
    "distribution_shift": Threshold(0.05, 0.15),
    "accuracy_drop": Threshold(0.03, 0.05),
    "f1_drop": Threshold(0.03, 0.05),
    "precision_drop": Threshold(0.05, 0.10),
    "recall_drop": Threshold(0.05, 0.10),
}

# Metrics used when no production version has any.
DEFAULT_BASELINE_METRICS: dict[str, float] = {
    "accuracy": 0.98,
    "f1": 0.95,
    "precision": 0.96,
    "recall": 0.94,
}


@dataclass(frozen=True)
class Settings:
    window_size: int = 500
    min_samples: int = 100
    check_interval_minutes: int = 5
    dedup_minutes: int = 30
    # random-forest defaults
    num_trees: int = 200
    max_depth: int = 15
    min_samples_split: int = 5
    seed: int = 42
    thresholds: Mapping[str, Threshold] = field(default_factory=lambda: dict(DEFAULT_THRESHOLDS))

    def __getitem__(self, metric: str) -> Threshold:
        return self.thresholds[metric]


_INT_FIELDS = (
    "window_size", "min_samples", "check_interval_minutes", "dedup_minutes",
    "num_trees", "max_depth", "min_samples_split", "seed",
)


def load_settings(
    overrides: Mapping[str, object] | None = None,
    env: Mapping[str, str] | None = None,
) -> Settings:
    """Defaults, then ``overrides``, then ``MODELWATCH_*`` variables.

    ``overrides`` may hold any plain setting and ``thresholds`` as
    ``{metric: (warning, critical)}``.  Variables are named after the setting
    (``MODELWATCH_WINDOW_SIZE``) or the threshold (``MODELWATCH_PSI_WARNING``).
    """
    env = os.environ if env is None else env
    overrides = dict(overrides or {})
    thresholds = dict(DEFAULT_THRESHOLDS)
    for metric, pair in dict(overrides.pop("thresholds", {})).items():
        if metric not in thresholds:
            raise KeyError(f"unknown threshold: {metric}")
        thresholds[metric] = pair if isinstance(pair, Threshold) else Threshold(*pair)
    for metric, pair in list(thresholds.items()):
        for level in ("warning", "critical"):
            raw = env.get(f"MODELWATCH_{metric.upper()}_{level.upper()}")
            if raw is not None:
                pair = replace(pair, **{level: float(raw)})
        thresholds[metric] = pair
    plain = {k: int(overrides[k]) for k in _INT_FIELDS if k in overrides}
    unknown = set(overrides) - set(plain)
    if unknown:
        raise KeyError(f"unknown settings: {sorted(unknown)}")
    for name in _INT_FIELDS:
        raw = env.get(f"MODELWATCH_{name.upper()}")
        if raw is not None:
            plain[name] = int(raw)
    return Settings(thresholds=thresholds, **plain)


def thresholds_frame(spark: SparkSession, settings: Settings | None = None) -> DataFrame:
    """The threshold table: eight rows, one per metric."""
    settings = settings or Settings()
    rows = [(m, t.warning, t.critical) for m, t in settings.thresholds.items()]
    return spark.createDataFrame(rows, "metric string, warning double, critical double")

"""All named queries; importing the modules registers them."""

from . import alerts, concept, data_drift, dataset, days, decisions, inject, log, prediction_drift, results, stores, streams, versions, edges  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

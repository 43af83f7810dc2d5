"""Composed jobs: drift checks, retraining, and the catalog of named queries."""

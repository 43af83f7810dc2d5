"""modelwatch: watch machine-learning models in production with Spark.

Prediction logs, late labels, baselines, drift results, alerts and model
versions are DataFrames; every operator is a function from DataFrame to
DataFrame that takes grouping keys, so one job answers for every model.
"""

__version__ = "0.1.0"

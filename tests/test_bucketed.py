from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from modelwatch.operators.prediction_log import attach_labels
from modelwatch.sources.bucketed import BucketedLog
from tests.conftest import rows

T0 = datetime(2024, 5, 1)


@pytest.fixture
def log(spark, tmp_path):
    return BucketedLog(spark, str(tmp_path / "log"), 4)


def _rows(spark, first, n):
    made = spark.range(first, first + n).withColumn("timestamp", F.lit(T0) + F.make_dt_interval(hours=F.col("id").cast("int")))
    return made.select("id", "timestamp", F.lit("v1").alias("model_version"), (F.col("id") % 2).cast("int").alias("predicted_label"))


def _labels(spark, pairs):
    return spark.createDataFrame([(i, T0 + timedelta(days=d), v) for i, d, v in pairs], "id bigint, labelled_at timestamp, true_label int")


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_labels_meet_the_log_without_moving_it(spark, log):
    log.log_predictions(_rows(spark, 0, 60))
    log.log_predictions(_rows(spark, 60, 40))
    labels = [(i, 9, i % 3 == 0) for i in range(0, 100, 3)]
    log.log_labels(_labels(spark, [(i, d, int(v)) for i, d, v in labels]))
    log.log_labels(_labels(spark, [(3, 10, 0), (6, 8, 0), (777, 10, 1), (3, 10, 0)]))
    found = log.predictions()
    assert "Exchange" not in _plan(found)
    got = dict(rows(found, "id", "true_label"))
    assert got == {i: (0 if i == 3 else 1 if i % 3 == 0 else None) for i in range(100)}
    both = attach_labels(spark.table(log.table("predictions")), spark.table(log.table("labels")))
    assert rows(both.select(*found.columns).drop("features")) == rows(found.drop("features"))
    lost = log.unmatched_labels()
    assert rows(lost, "id") == [(777,)] and "Exchange" not in _plan(lost)


def test_a_range_of_days_reads_its_partitions(spark, log):
    log.log_predictions(_rows(spark, 0, 100))
    day = log.predictions("2024-05-02", "2024-05-02")
    assert rows(day, "id") == [(i,) for i in range(24, 48)]
    plan = _plan(day)
    assert "PartitionFilters: [isnotnull(date" in plan and "Exchange" not in plan


def test_null_ids_extra_columns_and_empty_tables(spark, log):
    assert log.predictions().count() == 0 and log.unmatched_labels().count() == 0
    log.log_predictions(_rows(spark, 0, 2).withColumn("id", F.when(F.col("id") > 0, F.col("id"))).withColumn("true_label", F.lit(9)))
    log.log_labels(_labels(spark, [(None, 1, 1), (1, 1, 1)]))
    assert {tuple(r) for r in log.predictions().select("id", "true_label").collect()} == {(1, 1), (None, None)}


def test_reopened_by_another_session(spark, tmp_path):
    root = str(tmp_path / "log")
    BucketedLog(spark, root, 4).log_predictions(_rows(spark, 0, 30))
    other = BucketedLog(spark.newSession(), root, 4)
    other.log_labels(_labels(spark, [(5, 1, 1)]))
    assert other.predictions().filter("true_label = 1").count() == 1 and other.predictions().count() == 30

"""Predictions and labels bucketed alike by id, so that they meet where they lie."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prediction_log import latest_labels
from ..schemas import TABLES


class BucketedLog:
    """Two tables below ``root`` in the session's catalog, both in ``buckets``
    buckets of the id; predictions also in a partition per day.

    An append moves the new rows to their buckets, once.  After that a day's
    predictions are joined to their labels bucket by bucket, without a shuffle
    of either side, and labels that come late are small appends.  A bucket of a
    day should fit a task, so choose their number by the rows of a busy day; it
    cannot change later.  A new session that opens the same ``root`` must name
    the same number.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._prefix = f"log_{hashlib.sha1(self.root.encode()).hexdigest()[:12]}"
        for name, by in (("predictions", "PARTITIONED BY (date) "), ("labels", "")):
            columns = [f"{f.name} {f.dataType.simpleString()}" for f in TABLES[name].fields]
            columns += ["date date"] if by else []
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self.table(name)} ({', '.join(columns)}) USING parquet {by}"
                f"CLUSTERED BY (id) INTO {buckets} BUCKETS LOCATION '{self.root}/{name}'"
            )
            if by and spark.conf.get("spark.sql.catalogImplementation") == "hive":
                spark.catalog.recoverPartitions(self.table(name))

    def table(self, name: str) -> str:
        return f"{self._prefix}_{name}"

    def _append(self, name: str, rows: DataFrame) -> None:
        fields = [(f.name, f.dataType) for f in TABLES[name].fields]
        out = rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])
        if name == "predictions":
            out = out.withColumn("date", F.to_date("timestamp"))
        # a task holds one bucket, so an append writes a file per bucket (and day)
        out.repartition(self.buckets, "id").write.insertInto(self.table(name))

    def log_predictions(self, rows: DataFrame) -> None:
        """Append predictions; columns that the table lacks are left out."""
        self._append("predictions", rows)

    def log_labels(self, rows: DataFrame) -> None:
        """Append labels; the newest of an id counts, so one that comes again
        changes nothing."""
        self._append("labels", rows.filter(F.col("id").isNotNull()))

    def _predictions(self, first=None, last=None) -> DataFrame:
        rows = self.spark.table(self.table("predictions"))
        if first is not None:
            rows = rows.filter(F.col("date") >= F.lit(first).cast("date"))
        if last is not None:
            rows = rows.filter(F.col("date") <= F.lit(last).cast("date"))
        return rows

    def predictions(self, first=None, last=None) -> DataFrame:
        """Every prediction (of the days ``first`` to ``last``) with its newest
        label, NULL while there is none.  Labels are grouped and joined within
        their bucket; a merge join spills where a bucket is large."""
        labels = latest_labels(self.spark.table(self.table("labels")))
        return self._predictions(first, last).join(labels.hint("merge"), "id", "left")

    def unmatched_labels(self) -> DataFrame:
        """Labels whose prediction is unknown, found bucket by bucket."""
        return self.spark.table(self.table("labels")).join(self._predictions().select("id").hint("merge"), "id", "left_anti")

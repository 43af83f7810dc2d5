"""Scores of labelled rows by day, kept so that the AUC of any range of days comes
from sums.

``scores``  date, keys, cell, score, pos, neg: a row per distinct score
``cells``   date, keys, cell, pos, neg: their sums

Cells cut the range of scores into equal steps, so equal scores share a cell
and cells are ordered like their scores.  A pair of rows of different cells is
decided by its cells; pairs within one need its scores only where it holds both
classes.  So the result is exact, ties included, whatever the step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.quantiles import GROUP_LIMIT
from ..operators.ranking import running_totals
from ..operators.sizing import join_small, settle

Span = tuple[object, object]


class ScoreStore:
    """Tables below ``root`` for rows with the columns ``by`` (such as the model
    version).  ``cells`` steps lie between ``low`` and ``high``; scores beyond fall
    into the outer ones, which makes these larger and nothing wrong."""

    def __init__(self, spark: SparkSession, root: str, by: Sequence[str] = (), cells: int = 1000, low: float = 0.0, high: float = 1.0) -> None:
        self.spark, self.root, self.by = spark, root.rstrip("/"), list(by)
        self.cells, self.low, self.high = cells, low, high

    def _read(self, name: str, span: Span) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.root}/{name}")
        return rows.filter(F.col("date").between(*(F.lit(d).cast("date") for d in span)))

    def _write(self, name: str, rows: DataFrame) -> None:
        """Replaces the days that ``rows`` has, and no others."""
        out = rows.hint("rebalance", "date").sortWithinPartitions("date", *self.by, "cell")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{self.root}/{name}")

    def put(self, rows: DataFrame, y_true: str = "true_label", score: str = "confidence", day: str = "date") -> None:
        """Store whole days; one that is there already is replaced, so a day whose
        labels have grown is simply put again.  Rows without a label, score or day
        are left out, NaN scores too; a NULL key is a group of its own."""
        known = rows.select(*self.by, F.col(day).cast("date").alias("date"), F.col(score).cast("double").alias("score"), F.col(y_true).alias("_y"))
        known = known.filter("date IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND _y IS NOT NULL")
        step = F.floor((F.col("score") - self.low) / (self.high - self.low) * self.cells)
        cell = F.greatest(F.lit(0), F.least(F.lit(self.cells - 1), step)).cast("int").alias("cell")
        counts = [F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") != 1).alias("neg")]
        self._write("scores", known.groupBy("date", *self.by, cell, "score").agg(*counts))
        days = [r["date"] for r in known.select("date").distinct().collect()]  # the days of one call
        written = self.spark.read.parquet(f"{self.root}/scores").filter(F.col("date").isin(days))
        self._write("cells", written.groupBy("date", *self.by, "cell").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))

    def auc(self, span: Span, group_limit: int = GROUP_LIMIT) -> DataFrame:
        """keys, pos, neg, ``auc`` over a range of days; no row for a key without
        both classes.  Cells with both classes are ordered score by score; those
        with more than ``group_limit`` rows in ranges of scores side by side."""
        whole = W.partitionBy(*self.by)
        above = whole.orderBy(F.col("cell").desc()).rowsBetween(W.unboundedPreceding, -1)
        summed = self._read("cells", span).groupBy(*self.by, "cell").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        # a row per key and cell that is in use
        summed = settle(summed.withColumn("_above", F.coalesce(F.sum("pos").over(above), F.lit(0))), "cells")
        inside = self._inside(span, summed.filter("pos > 0 AND neg > 0"), group_limit)
        between = summed.select(*self.by, "pos", "neg", (F.col("neg").cast("double") * F.col("_above")).alias("_won"))
        zero = F.lit(0).cast("bigint")
        both = between.unionByName(inside.select(*self.by, zero.alias("pos"), zero.alias("neg"), "_won"))
        out = both.groupBy(*self.by).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("_won").alias("_won"))
        return out.filter("pos > 0 AND neg > 0").select(*self.by, "pos", "neg", (F.col("_won") / (F.col("pos").cast("double") * F.col("neg"))).alias("auc"))

    def _inside(self, span: Span, mixed: DataFrame, group_limit: int) -> DataFrame:
        """keys, ``_won``: pairs within a cell whose positive has the higher score,
        ties half, summed by cell."""
        group = [*self.by, "cell"]
        met = join_small(self._read("scores", span).withColumnsRenamed({"pos": "_p", "neg": "_n"}), mixed.select(*group), group)
        steps = met.groupBy(*group, "score").agg(F.sum("_p").alias("pos"), F.sum("_n").alias("neg"))
        if (mixed.agg(F.max(F.col("pos") + F.col("neg"))).first()[0] or 0) > group_limit:
            ranked = running_totals(steps, "score", ["pos"], group, descending=True)
        else:
            so_far = W.partitionBy(*group).orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, 0)
            ranked = steps.withColumn("cum_pos", F.sum("pos").over(so_far))
        won = F.col("neg").cast("double") * (F.col("cum_pos") - F.col("pos") / 2)
        return ranked.groupBy(*group).agg(F.sum(won).alias("_won"))

    def auc_by_day(self, span: Span) -> DataFrame:
        """date, keys, pos, neg, ``auc`` for every day of the range, in one pass."""
        daily = _Daily(self)
        return daily.auc(span)


class _Daily(ScoreStore):
    """The same tables with the day as one more key."""

    def __init__(self, store: ScoreStore) -> None:
        super().__init__(store.spark, store.root, ["date", *store.by], store.cells, store.low, store.high)

"""Feature values by day, kept so that any range of days is answered from sums.

``sketches``  date, keys, feature, n, sketch: quantile sketches, merged by aggregate
``grid``      feature and the edges of its cells, from the merged sketches of the first days
``cells``     date, keys, feature, cell, n, low, high: exact counts and ranges
``values``    date, keys, feature, cell, value, n: the distinct values

Counts of a cell add up over days exactly.  So the summed cells bracket every
wanted rank for certain, whatever the grid: which cell holds it and how many
rows lie before it are known, not estimated.  Only the values of those few
cells are read, to rank them, and of cells that an edge runs through, to split
them.  A grid that no longer fits makes cells uneven, never results wrong.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import bins as B
from ..operators.drift import judged
from ..operators.quantiles import GROUP_LIMIT, interpolate
from ..operators.ranking import running_totals
from ..operators.sizing import join_small

Span = tuple[object, object]


class DayStore:
    """Tables below ``root`` for rows with the columns ``by`` (such as the model
    version).  Days are Parquet partitions, so a range reads its days only."""

    def __init__(self, spark: SparkSession, root: str, by: Sequence[str] = (), cells: int = 100) -> None:
        self.spark, self.root, self.by, self.cells = spark, root.rstrip("/"), list(by), cells
        self.keys = [*self.by, "feature"]

    def _read(self, name: str, span: Span | None = None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.root}/{name}")
        if span is None:
            return rows
        return rows.filter(F.col("date").between(*(F.lit(d).cast("date") for d in span)))

    def _write(self, name: str, rows: DataFrame) -> None:
        """Replaces the days that ``rows`` has, and no others."""
        out = rows.hint("rebalance", "date").sortWithinPartitions("date", "feature")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{self.root}/{name}")

    # -- writing --------------------------------------------------------------

    def put(self, rows: DataFrame, features: Sequence[str], day: str = "date") -> None:
        """Store whole days; one that is there already is replaced, so a run that
        is repeated adds nothing twice.  NULL and NaN values are left out, a NULL
        key is a group of its own, rows without a day are not stored."""
        dated = rows.withColumn("date", F.col(day).cast("date")).filter("date IS NOT NULL")
        long = B.to_long(dated, features, [*self.by, "date"])
        keys = ["date", *self.keys]
        sketch = F.kll_sketch_agg_double("value").alias("sketch")
        self._write("sketches", long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), sketch))
        grid = self._grid(features)
        placed = join_small(long, grid, ["feature"]).withColumn("cell", B.quantile_bin("value", self.cells, open_ends=True))
        self._write("values", placed.groupBy(*keys, "cell", "value").agg(F.count(F.lit(1)).alias("n")))
        span = dated.agg(F.min("date"), F.max("date")).first()
        written = self._read("values", (span[0], span[1])).join(F.broadcast(dated.select("date").distinct()), "date", "left_semi")
        sums = [F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")]
        self._write("cells", written.groupBy(*keys, "cell").agg(*sums))

    def _grid(self, features: Sequence[str]) -> DataFrame:
        """The stored grid, with a row for each of ``features`` that had none yet."""
        path = f"{self.root}/grid"
        try:
            known = {r["feature"] for r in self.spark.read.parquet(path).select("feature").collect()}  # a row per feature
        except AnalysisException as err:
            if "PATH_NOT_FOUND" not in str(err):
                raise
            known = set()
        new = [f for f in features if f not in known]
        if new:
            fractions = [i / self.cells for i in range(self.cells + 1)]
            found = self.sketched(fractions, None, by=()).filter(F.col("feature").isin(new))
            B.as_profile(found, ["feature"], self.cells).write.mode("append").parquet(path)
        return self.spark.read.parquet(path)

    # -- reading --------------------------------------------------------------

    def sketched(self, fractions: Sequence[float], span: Span | None, by: Sequence[str] | None = None) -> DataFrame:
        """keys, ``n`` and approximate quantiles ``q``, from merged sketches alone."""
        keys = [*(self.by if by is None else by), "feature"]
        merged = self._read("sketches", span).groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("_s"))
        wanted = F.array(*[F.lit(float(f)) for f in fractions])
        return merged.select(*keys, "n", F.kll_sketch_get_quantile_double("_s", wanted).alias("q"))

    def summed(self, span: Span) -> DataFrame:
        """keys, cell, n, low, high over a range of days."""
        sums = [F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")]
        return self._read("cells", span).groupBy(*self.keys, "cell").agg(*sums)

    def _values(self, span: Span, cells: DataFrame) -> DataFrame:
        """keys, cell, the other columns of the few ``cells``, value, c (its rows)."""
        rest = [c for c in cells.columns if c not in (*self.keys, "cell")]
        met = join_small(self._read("values", span).withColumnRenamed("n", "_m"), cells, [*self.keys, "cell"])
        return met.groupBy(*self.keys, "cell", *rest, "value").agg(F.sum("_m").alias("c"))

    def quantiles(self, fractions: Sequence[float], span: Span, group_limit: int = GROUP_LIMIT) -> DataFrame:
        """keys, ``n`` and the exact linear-interpolated quantiles ``q``."""
        whole = W.partitionBy(*self.keys)
        before = whole.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
        placed = self.summed(span).select(
            *self.keys, "cell", F.col("n").alias("_size"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"), F.sum("n").over(whole).alias("_n")
        )
        needed = placed.filter(self._holds(fractions, "_base", "_base + _size"))
        inside = self._values(span, needed)
        group = [*self.keys, "cell"]
        if (needed.agg(F.max("_size")).first()[0] or 0) > group_limit:
            ranked = running_totals(inside, "value", ["c"], group).withColumnRenamed("cum_c", "_upto")
        else:
            so_far = W.partitionBy(*group).orderBy("value").rowsBetween(W.unboundedPreceding, 0)
            ranked = inside.withColumn("_upto", F.sum("c").over(so_far))
        ranked = ranked.withColumn("_to", F.col("_base") + F.col("_upto")).withColumn("_from", F.col("_to") - F.col("c"))
        covering = F.collect_list(F.struct("_from", "_to", F.col("value").alias("_cell"))).alias("_cells")
        found = ranked.filter(self._holds(fractions, "_from", "_to")).groupBy(*self.keys).agg(F.max("_n").alias("n"), covering)
        return interpolate(found, self.keys, fractions)

    @staticmethod
    def _holds(fractions: Sequence[float], first: str, end: str) -> Column:
        """Do the ranks from ``first`` up to ``end`` hold one next to a fraction?"""
        parts = [f"({first} <= ceil({p!r}D * (_n - 1)) AND floor({p!r}D * (_n - 1)) < {end})" for p in fractions]
        return F.expr(" OR ".join(parts))

    def profile(self, span: Span, bins: int = 10) -> DataFrame:
        """The exact bin edges of a range of days, as a profile."""
        return B.as_profile(self.quantiles(B.profile_fractions(bins), span), self.keys, bins)

    def counts(self, span: Span, profile: DataFrame, bins: int = 10) -> DataFrame:
        """keys, bin, n_edges, n: rows per bin of ``profile``.  Cells within a bin
        are added as they are; values are read of those that an edge cuts."""
        edges = join_small(self.summed(span), profile, self.keys, "left")
        low, high = B.quantile_bin("low", bins), B.quantile_bin("high", bins)
        cut = F.coalesce((low != high) | ((F.col("low") < F.col("e0")) & (F.col("high") > F.col("e_last"))), F.lit(False))
        placed = edges.withColumns({"bin": low, "_cut": cut})
        plain = placed.filter(~F.col("_cut")).select(*self.keys, "bin", "n_edges", "n")
        split = self._values(span, placed.filter("_cut").select(*self.keys, "cell"))
        split = join_small(split, profile, self.keys, "left").withColumn("bin", B.quantile_bin("value", bins))
        both = plain.union(split.select(*self.keys, "bin", "n_edges", F.col("c").alias("n")))
        return both.groupBy(*self.keys, "bin").agg(F.max("n_edges").alias("n_edges"), F.sum("n").alias("n"))

    def drift(self, reference: Span, current: Span, bins: int = 10, settings: Settings | None = None) -> DataFrame:
        """PSI and KL per key and feature between two ranges of days, as
        :func:`feature_drift` gives them for the rows themselves."""
        profile = self.profile(reference, bins)
        zero = F.lit(0).cast("bigint")
        ref = self.counts(reference, profile, bins).select(*self.keys, "bin", "n_edges", F.col("n").alias("ref_count"), zero.alias("cur_count"))
        cur = self.counts(current, profile, bins).select(*self.keys, "bin", "n_edges", zero.alias("ref_count"), F.col("n").alias("cur_count"))
        sums = [F.max("n_edges").alias("n_edges"), F.sum("ref_count").alias("ref_count"), F.sum("cur_count").alias("cur_count")]
        return judged(ref.union(cur).groupBy(*self.keys, "bin").agg(*sums), self.keys, settings or Settings())

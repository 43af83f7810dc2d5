"""What-if drift over lineitem and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import inject as J
from ...sources.fixtures import LINE_FEATURES, adapter, adapter_sql
from .registry import query, r6

_F = f"WITH f AS ({adapter_sql('features')}) "
_O = f"WITH o AS ({adapter_sql('order_features')}) "


def _orders(spark, sf_dir):
    return adapter(spark, sf_dir, "order_features")


@query("inject_shift", _F + "SELECT side, round(l_quantity + 1.5, 6) AS l_quantity, round(l_extendedprice + 1.5, 6) AS l_extendedprice, l_discount, l_tax FROM f")
def inject_shift(spark, sf_dir):
    moved = J.feature_shift(adapter(spark, sf_dir, "features"), LINE_FEATURES, chosen=LINE_FEATURES[:2])
    return moved.select("side", *[r6(c).alias(c) for c in LINE_FEATURES[:2]], *LINE_FEATURES[2:])


@query("inject_scale", _F + "SELECT side, " + ", ".join(f"round({c} * 3.0, 6) AS {c}" for c in LINE_FEATURES) + " FROM f")
def inject_scale(spark, sf_dir):
    moved = J.scale_change(adapter(spark, sf_dir, "features"), LINE_FEATURES)
    return moved.select("side", *[r6(c).alias(c) for c in LINE_FEATURES])


@query("gradual_drift", _O + """, n AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS rn, count(*) OVER () // 10 AS size FROM o),
 b AS (SELECT *, least(rn // size, 9) AS batch FROM n)
 SELECT id, CAST(batch AS INT) AS batch, round(price + 2.0 * (batch / 9.0), 6) AS price, round(cust + 2.0 * (batch / 9.0), 6) AS cust FROM b""")
def gradual_drift(spark, sf_dir):
    moved = J.gradual_drift(_orders(spark, sf_dir), ["price", "cust"], "id")
    return moved.select("id", "batch", r6("price").alias("price"), r6("cust").alias("cust"))


@query("label_flip_counts", _O + "SELECT count(*) AS n, CAST(floor(count(*) * 0.15) AS BIGINT) AS flipped FROM o")
def label_flip_counts(spark, sf_dir):
    """Exactly 15 percent of the labels change."""
    before = _orders(spark, sf_dir)
    after = J.label_flip(before.withColumn("old", F.col("label")), "label", "id")
    return after.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("old") != F.col("label")).alias("flipped"))


@query("class_imbalance_counts", _O + """, c AS (SELECT count(*) FILTER (label = 1) AS minor, count(*) FILTER (label = 0) AS major FROM o)
 SELECT 0 AS label, major AS n FROM c UNION ALL SELECT 1, greatest(minor, CAST(floor(major * 0.4 / (1 - 0.4)) AS BIGINT)) FROM c""")
def class_imbalance_counts(spark, sf_dir):
    grown = J.class_imbalance(_orders(spark, sf_dir), "label", "id", 0.4)
    return grown.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("inject_noise")
def inject_noise(spark, sf_dir):
    return J.noise(_orders(spark, sf_dir), ["price", "cust"], "id")


@query("inject_severe")
def inject_severe(spark, sf_dir):
    return J.drifted_dataset(_orders(spark, sf_dir), "severe", ["price", "cust"], "label", "id")


def _moved(column, shift):
    """Does the change of a column have the mean and the spread that were asked for?"""
    change = F.col(column) - F.col(f"old_{column}")
    near = (F.abs(F.avg(change) - shift) < 0.06) & (F.abs(F.stddev(change) - 0.5) < 0.05)
    return near.alias(f"{column}_moved")


def _kept(rows):
    return rows.withColumns({f"old_{c}": F.col(c) for c in ("price", "cust", "label")})


@query("noise_facts", _O + "SELECT count(*) AS n, count(DISTINCT id) AS ids, true AS price_moved, true AS cust_moved FROM o")
def noise_facts(spark, sf_dir):
    """Every row once, its values changed by noise of mean 0 and deviation 0.5."""
    after = J.noise(_kept(_orders(spark, sf_dir)), ["price", "cust"], "id")
    return after.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), *[_moved(c, 0.0) for c in ("price", "cust")]
    )


@query("severe_facts", _O + """SELECT count(*) AS n, count(DISTINCT id) AS ids, CAST(floor(count(*) * 0.15) AS BIGINT) AS flipped,
 true AS price_moved, true AS cust_moved FROM o""")
def severe_facts(spark, sf_dir):
    """Every row once, shifted by 1.5 with noise, and 15 percent of the labels flipped."""
    after = J.drifted_dataset(_kept(_orders(spark, sf_dir)), "severe", ["price", "cust"], "label", "id")
    return after.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"),
        F.count_if(F.col("label") != F.col("old_label")).alias("flipped"), *[_moved(c, 1.5) for c in ("price", "cust")],
    )

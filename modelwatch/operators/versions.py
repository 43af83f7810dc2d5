"""Model versions: comparison, promotion, roll-back, listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import version_label

VERSION_METRICS = ["accuracy", "f1_score", "precision", "recall"]


def recommendation(new_f1: Column, new_acc: Column, cur_f1: Column, cur_acc: Column) -> Column:
    """DEPLOY for a better F1 at 98 % of the accuracy, or an F1 better by 2 %."""
    better = (new_f1 > cur_f1) & (new_acc >= cur_acc * 0.98)
    clearly = new_f1 > cur_f1 * 1.02
    return F.when(better | clearly, "DEPLOY").otherwise("KEEP")


def compare_models(champion: DataFrame, challenger: DataFrame) -> DataFrame:
    """One row from two long metric frames (metric, value) of the same test split."""
    both = champion.withColumnRenamed("value", "current").join(challenger.withColumnRenamed("value", "new"), "metric")

    def pick(metric: str, side: str) -> Column:
        return F.max(F.when(F.col("metric") == metric, F.col(side)))

    wide = both.agg(
        F.map_from_entries(F.collect_list(F.struct("metric", F.col("new") - F.col("current")))).alias("metric_deltas"),
        *[pick(m, s).alias(f"_{s}_{m}") for m in ("f1", "accuracy") for s in ("current", "new")],
    )
    verdict = recommendation(*[F.col(c) for c in ("_new_f1", "_new_accuracy", "_current_f1", "_current_accuracy")])
    return wide.select(
        "metric_deltas", (F.col("_new_f1") > F.col("_current_f1")).alias("is_improved"), verdict.alias("recommendation")
    )


def gate_all(versions: DataFrame) -> DataFrame:
    """Every version's recommendation against the production version."""
    champion = versions.filter("is_production").agg(
        F.max("f1_score").alias("_f1"), F.max("accuracy").alias("_acc")
    )
    return versions.select(
        "*", champion.select(F.struct("_f1", "_acc").alias("c")).scalar().alias("_c")
    ).withColumn(
        "recommendation",
        # without a champion anything is deployed
        F.when(F.col("_c._f1").isNull(), "DEPLOY").otherwise(
            recommendation(F.col("f1_score"), F.col("accuracy"), F.col("_c._f1"), F.col("_c._acc"))
        ),
    ).drop("_c")


def promotion_state(versions: DataFrame, promotions: DataFrame, order: Sequence[str] = ("promoted_at", "version")) -> DataFrame:
    """``is_production`` and ``deployed_at`` from promotion events: exactly one
    production version, the one promoted last (by ``order``) among those that exist."""
    known = promotions.join(versions.select("version"), "version", "left_semi")
    current = known.agg(F.max_by("version", F.struct(*order)).alias("v"))
    times = known.groupBy("version").agg(F.max("promoted_at").alias("deployed_at"))
    out = versions.drop("is_production", "deployed_at").join(times, "version", "left")
    return out.withColumn("_p", current.scalar()).withColumn(
        "is_production", F.coalesce(F.col("version") == F.col("_p"), F.lit(False))
    ).drop("_p")


def unknown_versions(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """Promotion or roll-back requests for versions that do not exist."""
    return requests.join(versions.select("version"), "version", "left_anti")


def duplicate_versions(versions: DataFrame) -> DataFrame:
    """Versions recorded more than once (the version number must be unique)."""
    return versions.groupBy("version").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def current_model(state: DataFrame) -> DataFrame:
    return state.filter("is_production")


def version_listing(versions: DataFrame, limit: int | None = None) -> DataFrame:
    out = versions.orderBy(F.col("version").desc())
    return out if limit is None else out.limit(limit)


def deployment_history(state: DataFrame, limit: int = 50) -> DataFrame:
    return state.orderBy(F.col("deployed_at").desc_nulls_last(), F.col("version").desc()).limit(limit)


def version_changes(versions: DataFrame, metrics: Sequence[str] = VERSION_METRICS) -> DataFrame:
    """Every metric of every version with its change to the version before."""
    long = versions.select("version", *metrics).unpivot(["version"], list(metrics), "metric", "value")
    before = F.lag("value").over(W.partitionBy("metric").orderBy("version"))
    return long.select(
        "version", version_label(F.col("version")).alias("label"), "metric", "value", (F.col("value") - before).alias("change")
    )

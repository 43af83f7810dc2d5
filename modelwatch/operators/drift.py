"""Data, prediction and concept drift; every check answers for all keys at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.columns import overall_status, ratio, severity, severity_name, severity_rank
from ..schemas import REQUIRED_METRICS
from . import bins as B
from .metrics import binary_metrics
from .quantiles import largest_group
from .sizing import attach_row, join_small, match, settle

#: Fixed value: added to every share, after normalising, before the logarithm.
EPSILON = 1e-6


# -- data drift -------------------------------------------------------------

def divergences(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """PSI and KL per key from two-sided bin counts, both in one pass.

    Bins that are empty on both sides add ln(1) = 0, so no grid is needed.  A
    key with a single edge has no bins: both values are 0.  A side that lies
    wholly outside the edges has no shares: both values are NULL, as they are
    for a key without edges or reference (``ref_rows`` is 0).
    """
    whole = W.partitionBy(*keys)
    used = F.col("bin") >= 0
    ref_total = F.sum(F.when(used, F.col("ref_count"))).over(whole)
    cur_total = F.sum(F.when(used, F.col("cur_count"))).over(whole)
    shares = counts.withColumn("_rt", ref_total).withColumn("_ct", cur_total)
    p = ratio(F.col("ref_count"), F.col("_rt"), None) + EPSILON
    q = ratio(F.col("cur_count"), F.col("_ct"), None) + EPSILON
    flat = F.max("n_edges") < 2
    return shares.groupBy(*keys).agg(
        F.when(flat, F.lit(0.0)).otherwise(F.sum(F.when(used, (q - p) * F.ln(q / p)))).alias("psi"),
        F.when(flat, F.lit(0.0)).otherwise(F.sum(F.when(used, p * F.ln(p / q)))).alias("kl"),
        F.sum(F.when(F.col("n_edges").isNotNull(), F.col("ref_count")).otherwise(0)).alias("ref_rows"),
        F.sum("cur_count").alias("cur_rows"),
        F.coalesce(F.sum(F.when(~used, F.col("cur_count"))), F.lit(0)).alias("cur_dropped"),
    )


def feature_drift(
    reference: DataFrame,
    current: DataFrame,
    features: Sequence[str],
    by: Sequence[str] = (),
    bins: int = 10,
    settings: Settings | None = None,
    profile: DataFrame | None = None,
    open_ends: bool = False,
    reference_by: Sequence[str] | None = None,
    method: str = "exact",
) -> DataFrame:
    """PSI and KL per (key, feature) of the current rows; one without a reference
    has NULL values and severity ``unknown``.

    Give a stored ``profile`` to skip finding the edges.  ``reference_by`` names
    the keys the reference is split by when it is coarser than ``by`` (such as
    one baseline for every time bucket).
    """
    settings = settings or Settings()
    by = list(by)
    ref_by = by if reference_by is None else list(reference_by)
    ref_long = B.to_long(reference, features, ref_by)
    cur_long = B.to_long(current, features, by)
    ref_keys = [*ref_by, "feature"]
    if profile is None:
        # a feature has at most as many values as its group has rows
        biggest = largest_group(reference, ref_by)
        profile = B.quantile_profile(ref_long, ref_keys, bins=bins, method=method, biggest=biggest)
    if ref_by == by:
        both = ref_long.withColumn("is_ref", F.lit(True)).unionByName(
            cur_long.withColumn("is_ref", F.lit(False))
        )
        counts = B.quantile_counts(both, profile, [*by, "feature"], bins=bins, open_ends=open_ends, how="left")
    else:
        ref_counts = reference_counts(ref_long, profile, ref_keys, bins)
        counts = _against_reference(cur_long, profile, ref_counts, by, ref_keys, bins, open_ends)
    return judged(counts, [*by, "feature"], settings)


def reference_counts(
    reference: DataFrame, profile: DataFrame, keys: Sequence[str] = ("feature",), bins: int = 10
) -> DataFrame:
    """Bin counts of the reference on its own edges, to be stored beside them."""
    bin_of = B.quantile_bin("value", bins).alias("bin")
    binned = join_small(reference, profile, keys).groupBy(*keys, bin_of)
    return binned.agg(F.count(F.lit(1)).alias("ref_count"))


def feature_drift_stored(
    current: DataFrame,
    features: Sequence[str],
    profile: DataFrame,
    ref_counts: DataFrame,
    by: Sequence[str] = (),
    reference_by: Sequence[str] = (),
    bins: int = 10,
    settings: Settings | None = None,
    open_ends: bool = False,
) -> DataFrame:
    """:func:`feature_drift` against a stored profile and its counts: the
    reference values are not read at all."""
    ref_keys = [*reference_by, "feature"]
    cur_long = B.to_long(current, features, by)
    counts = _against_reference(cur_long, profile, ref_counts, list(by), ref_keys, bins, open_ends)
    return judged(counts, [*by, "feature"], settings or Settings())


def _against_reference(cur_long, profile, ref_counts, by, ref_keys, bins, open_ends):
    """Every current group beside the counts of its one reference group, if any.

    Binned counts are folded to one short array per group on either side, so
    the current rows are read once and the join is small on small.
    """
    keys = list(dict.fromkeys([*by, *ref_keys]))
    bin_of = B.quantile_bin("value", bins, open_ends).alias("bin")
    cur = join_small(cur_long, profile, ref_keys, "left").groupBy(*keys, bin_of)
    cur = cur.agg(F.max("n_edges").alias("n_edges"), F.count(F.lit(1)).alias("cur_count"))
    cur = cur.groupBy(*keys).agg(
        F.max("n_edges").alias("n_edges"),
        F.collect_list(F.struct("bin", F.lit(0).cast("bigint").alias("ref_count"), "cur_count")).alias("_cur"),
    )
    ref = ref_counts.groupBy(*ref_keys).agg(
        F.collect_list(F.struct("bin", "ref_count", F.lit(0).cast("bigint").alias("cur_count"))).alias("_ref")
    )
    both = match(cur, ref, ref_keys, "left").selectExpr(*keys, "n_edges", "inline(if(_ref IS NULL, _cur, concat(_cur, _ref)))")
    return both.groupBy(*keys, "bin").agg(
        F.max("n_edges").alias("n_edges"),
        F.sum("ref_count").alias("ref_count"),
        F.sum("cur_count").alias("cur_count"),
    )


def judged(counts: DataFrame, keys: Sequence[str], settings: Settings) -> DataFrame:
    psi, kl = settings["psi"], settings["kl_divergence"]
    return (
        divergences(counts, keys)
        .filter(F.col("cur_rows") > 0)
        .withColumn("severity", severity(F.col("psi"), psi.warning, psi.critical))
        .withColumn("kl_severity", severity(F.col("kl"), kl.warning, kl.critical))
    )


def data_drift_check(
    per_feature: DataFrame,
    features: Sequence[str],
    by: Sequence[str] = (),
    settings: Settings | None = None,
) -> DataFrame:
    """Overall verdict per key: worst PSI, its severity, drifted features in
    feature order, and the per-feature values as maps.

    A feature whose current values all lie outside the reference range has no
    PSI; it is named in ``out_of_range``, the check is then never better than
    ``unknown``, and its stored result counts as a breach.  ``skipped_features`` were asked for and have no
    value or no reference; with nothing measured at all the verdict is ``unknown``.
    A key without any reference has no overall PSI.
    """
    psi = (settings or Settings())["psi"]
    place = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature"))
    drifted = F.collect_list(
        F.when(F.col("psi") >= psi.warning, F.struct(place.alias("at"), F.col("feature").alias("name")))
    )
    known = F.col("ref_rows") > 0 if "ref_rows" in per_feature.columns else F.lit(True)
    out = per_feature.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(known).alias("_known"),
        F.max("psi").alias("_psi"),
        F.sort_array(drifted).getField("name").alias("drifted_features"),
        F.map_from_entries(F.collect_list(F.when(known, F.struct("feature", "psi")))).alias("feature_psi"),
        F.map_from_entries(F.collect_list(F.when(known, F.struct("feature", "kl")))).alias("feature_kl"),
        F.count_if(known & F.col("psi").isNull()).alias("unknown_features"),
        F.sort_array(F.collect_list(F.when(known & _out_of_range(per_feature), F.col("feature")))).alias("out_of_range"),
        F.array_except(F.array(*[F.lit(f) for f in features]), F.collect_set(F.when(known, F.col("feature")))).alias("skipped_features"),
    )
    strange = (F.col("_rows") > 0) & (F.col("_known") == 0)
    overall = F.when(~strange, F.coalesce("_psi", F.lit(0.0))).alias("overall_psi")
    out = out.select(*by, overall, *[c for c in out.columns if c not in (*by, "_rows", "_known", "_psi")])
    level = severity(F.col("overall_psi"), psi.warning, psi.critical)
    # Nothing measurable at all is not "none".
    blind = F.forall(F.map_values("feature_psi"), lambda v: v.isNull()) & (F.size("feature_psi") > 0)
    lost = F.size("out_of_range") > 0
    unknown = blind | (lost & (level == "none"))
    return out.withColumn("severity", F.when(unknown, "unknown").otherwise(level)).withColumn(
        "is_drifted", F.col("severity").isin("warning", "critical")
    )


def _out_of_range(per_feature: DataFrame) -> Column:
    if "cur_dropped" not in per_feature.columns:
        return F.lit(False)
    return F.col("psi").isNull() & (F.col("cur_dropped") > 0) & (F.col("cur_dropped") == F.col("cur_rows"))


def top_drifted(per_feature: DataFrame, n: int = 5) -> DataFrame:
    return per_feature.orderBy(F.col("psi").desc(), F.col("feature")).limit(n)


# -- prediction drift -------------------------------------------------------

def hellinger(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Hellinger distance per key from two-sided bin counts."""
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    p = ratio(F.col("ref_count"), F.sum("ref_count").over(whole))
    q = ratio(F.col("cur_count"), F.sum("cur_count").over(whole))
    gap = counts.select(*keys, F.pow(F.sqrt(p) - F.sqrt(q), 2).alias("_g"))
    return gap.groupBy(*keys).agg((F.sqrt(F.sum("_g")) / F.sqrt(F.lit(2.0))).alias("hellinger"))


def prediction_drift_check(
    df: DataFrame,
    side: str = "is_current",
    label: str = "predicted_label",
    confidence: str = "confidence",
    by: Sequence[str] = (),
    bins: int = 20,
    settings: Settings | None = None,
) -> DataFrame:
    """Confidence shift and rate shift of the current against the baseline rows
    of ``df``; ``side`` is true for current rows.  One row per key with current rows; without
    baseline rows or without confidences the distance is NULL and the severity
    ``unknown``."""
    limits = (settings or Settings())["hellinger"]
    rows = df.select(*by, side, F.col(label).cast("int").alias("_label"), F.col(confidence).alias("_conf"))
    rows = rows.withColumn("_is_ref", ~F.col(side))
    now, base = F.col(side), ~F.col(side)
    measured = F.when(~F.isnan("_conf"), F.col("_conf"))
    # rates and the range of the bins come from the same pass
    rates = rows.groupBy(*by).agg(
        F.count_if(now).alias("_now"),
        F.min(measured).alias("_lo"),
        F.max(measured).alias("_hi"),
        F.avg(F.when(base, F.col("_label"))).alias("baseline_positive_rate"),
        F.avg(F.when(now, F.col("_label"))).alias("current_positive_rate"),
        F.avg(F.when(base, F.col("_conf"))).alias("baseline_mean_confidence"),
        F.avg(F.when(now, F.col("_conf"))).alias("current_mean_confidence"),
    )
    rates = settle(rates, "rates")
    span = rates.select(*by, "_lo", "_hi")
    distance = hellinger(B.equal_width_counts(rows, "_conf", "_is_ref", by, bins, span), by)
    joined = match(rates, distance, by, "left") if by else attach_row(rates, distance)
    joined = joined.filter("_now > 0").drop("_lo", "_hi", "_now")
    both = F.col("baseline_mean_confidence").isNotNull() & F.col("current_mean_confidence").isNotNull()
    joined = joined.withColumn("hellinger", F.when(both, F.col("hellinger")))
    old, new = F.col("baseline_positive_rate"), F.col("current_positive_rate")
    return (
        joined.withColumn("severity", severity(F.col("hellinger"), limits.warning, limits.critical))
        .withColumn("is_drifted", F.col("severity").isin("warning", "critical"))
        .withColumn("positive_rate_change_pct", F.when(old == 0, 0.0).otherwise(F.try_divide(new - old, old) * 100))
    )


def default_prediction_baseline(spark, rows: int = 500) -> DataFrame:
    """Stand-in baseline while the log is shorter than the minimum: label 0,
    confidence 0.95."""
    return spark.range(rows).select(F.lit(0).alias("predicted_label"), F.lit(0.95).alias("confidence"))


def prediction_baseline(window: DataFrame, min_samples: int) -> DataFrame:
    """``window`` (a newest-N frame) when it is long enough, else the stand-in."""
    if window.limit(min_samples).count() >= min_samples:
        return window.select("predicted_label", "confidence")
    return default_prediction_baseline(window.sparkSession)


# -- concept drift ----------------------------------------------------------

def missing_baseline_metrics(baseline: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Required metrics that a long baseline (by.., metric, value) lacks."""
    need = F.array(*[F.lit(m) for m in REQUIRED_METRICS])
    have = F.collect_set(F.when(F.col("value").isNotNull(), F.col("metric")))
    held = baseline.groupBy(*by).agg(have.alias("_have"))
    return held.select(*by, F.explode(F.array_sort(F.array_except(need, F.col("_have")))).alias("metric"))


def metric_deltas(current: DataFrame, baseline: Mapping[str, float] | DataFrame, by: Sequence[str] = (),
                  settings: Settings | None = None) -> DataFrame:
    """Long form: one row per (key, metric) with current, baseline, delta, drop
    and severity.  ``current`` is wide (one row per key); ``baseline`` is a
    mapping or a long frame (by.., metric, value).  Without a baseline value the
    delta is NULL and the severity ``unknown``."""
    settings = settings or Settings()
    by = list(by)
    long = current.unpivot(by, REQUIRED_METRICS, "metric", "current")
    if isinstance(baseline, DataFrame):
        long = join_small(long, baseline.select(*by, "metric", F.col("value").alias("baseline")), [*by, "metric"], "left")
    else:
        lacking = set(REQUIRED_METRICS) - set(baseline)
        if lacking:
            raise ValueError(f"baseline lacks metrics: {sorted(lacking)}")
        pairs = F.create_map(*[x for m in REQUIRED_METRICS for x in (F.lit(m), F.lit(float(baseline[m])))])
        long = long.withColumn("baseline", pairs[F.col("metric")])
    warning = F.create_map(*[x for m in REQUIRED_METRICS for x in (F.lit(m), F.lit(settings[f"{m}_drop"].warning))])
    critical = F.create_map(*[x for m in REQUIRED_METRICS for x in (F.lit(m), F.lit(settings[f"{m}_drop"].critical))])
    delta = F.col("current") - F.col("baseline")
    return (
        long.withColumn("delta", delta)
        .withColumn("drop", -delta)
        .withColumn("severity", severity(F.col("drop"), warning[F.col("metric")], critical[F.col("metric")]))
    )


def concept_drift_check(
    labelled: DataFrame,
    baseline: Mapping[str, float] | DataFrame,
    y_true: str = "true_label",
    y_pred: str = "predicted_label",
    by: Sequence[str] = (),
    settings: Settings | None = None,
) -> DataFrame:
    """Metric drops against the baseline; rows without a label do not count.
    No row for a key without any label."""
    current = binary_metrics(labelled, y_true, y_pred, by).filter(F.col("n") > 0)
    deltas = metric_deltas(current, baseline, by, settings)
    bad = F.col("severity").isin("warning", "critical")
    packed = {
        name: F.map_from_entries(F.collect_list(F.struct("metric", column))).alias(name)
        for name, column in [("current_metrics", "current"), ("baseline_metrics", "baseline"), ("metric_deltas", "delta")]
    }
    out = deltas.groupBy(*by).agg(
        *packed.values(),
        F.sort_array(F.collect_list(F.when(bad, F.col("metric")))).alias("degraded_metrics"),
        F.max(severity_rank(F.col("severity"))).alias("_rank"),
        F.count(F.lit(1)).alias("_m"),
    )
    return (
        out.filter(F.col("_m") > 0)
        .withColumn("severity", severity_name(F.col("_rank")))
        .withColumn("is_drifted", F.col("severity").isin("warning", "critical"))
        .drop("_rank", "_m")
    )


def baseline_metrics(production: DataFrame, defaults: Mapping[str, float]) -> DataFrame:
    """Long baseline from the production version's row; defaults fill the gaps,
    or stand in for the whole row when there is none."""
    renamed = production.withColumnRenamed("f1_score", "f1")
    one = renamed.agg(*[F.coalesce(F.max(m), F.lit(float(defaults[m]))).alias(m) for m in REQUIRED_METRICS])
    return one.unpivot([], REQUIRED_METRICS, "metric", "value")


def combined_status(*severities) -> F.Column:
    """Worst of several severity columns; missing checks (NULL) do not count."""
    return overall_status(F.greatest(*[severity_rank(s) for s in severities]))

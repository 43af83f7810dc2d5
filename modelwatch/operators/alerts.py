"""Alerts: rows, acknowledgement, listings, counts, repeat suppression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import alert_message, micros, truncate_time
from .ranking import newest
from .sizing import join_small


def alert_rows(raised: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Rows for the alert table from (ts, severity, drift_type, metric_name,
    metric_value, threshold[, message])."""
    boxed = alert_message(
        F.col("severity"), F.col("drift_type"), F.col("metric_name"),
        F.col("metric_value"), F.col("threshold"), F.col(ts),
    )
    text = F.coalesce("message", boxed) if "message" in raised.columns else boxed
    identity = F.xxhash64(F.col(ts).cast("string"), "drift_type", "metric_name", "severity", "metric_value")
    return raised.select(
        (F.col("id") if "id" in raised.columns else identity).alias("id"),
        F.col(ts),
        F.upper("severity").alias("severity"),
        "drift_type",
        "metric_name",
        text.alias("message"),
        F.lit("all").alias("channel"),
        F.lit(False).alias("acknowledged"),
    )


def alerts_from_drift(results: DataFrame, ts: str = "timestamp") -> DataFrame:
    """One alert per breached drift result (documented behaviour; opt in)."""
    level = F.coalesce(F.get_json_object("details_json", "$.severity"), F.lit("warning"))
    return alert_rows(results.filter("is_breached").withColumn("severity", level).drop("id"), ts)


# -- acknowledgement --------------------------------------------------------

def with_acknowledgements(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Current state: acknowledged in the row itself or by a later event."""
    seen = acks.select("id").distinct().withColumn("_ack", F.lit(True))
    state = F.coalesce("acknowledged", F.lit(False)) | F.coalesce("_ack", F.lit(False))
    return alerts.join(seen, "id", "left").withColumn("acknowledged", state).drop("_ack")


def unmatched_acknowledgements(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    return acks.join(alerts.select("id"), "id", "left_anti")


# -- listings ---------------------------------------------------------------

def active_alerts(alerts: DataFrame, limit: int = 20, ts: str = "timestamp") -> DataFrame:
    return newest(alerts.filter(~F.coalesce("acknowledged", F.lit(False))), limit, ts)


def alert_history(
    alerts: DataFrame, limit: int = 50, severity: str = "All", drift_type: str = "All", ts: str = "timestamp"
) -> DataFrame:
    out = alerts
    if severity != "All":
        out = out.filter(F.col("severity") == severity)
    if drift_type != "All":
        out = out.filter(F.col("drift_type") == drift_type)
    return newest(out, limit, ts)


# -- counts -----------------------------------------------------------------

def alert_stats(alerts: DataFrame) -> DataFrame:
    """Totals overall, by severity and by type: one scan, grouping sets.  An
    alert without acknowledgement state is active; a missing severity or type
    is counted under a NULL name."""
    sets = alerts.groupingSets([[], ["severity"], ["drift_type"]], "severity", "drift_type")
    out = sets.agg(
        F.grouping_id("severity", "drift_type").alias("_g"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.coalesce("acknowledged", F.lit(False))).alias("active"),
    )
    return out.select(
        F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "severity").otherwise("drift_type").alias("dimension"),
        F.when(F.col("_g") == 3, "all").otherwise(F.coalesce("severity", "drift_type")).alias("name"),
        "total",
        "active",
    )


def alert_frequency(alerts: DataFrame, limit: int | None = 200, ts: str = "timestamp", latest: bool = False) -> DataFrame:
    """Alerts per hour and severity.  The limit takes the oldest rows unless
    ``latest`` is set."""
    hours = alerts.groupBy(truncate_time("hour", F.col(ts)).alias("hour"), "severity").agg(
        F.count(F.lit(1)).alias("count")
    )
    if limit is None:
        return hours
    first = F.col("hour").desc() if latest else F.col("hour").asc()
    return hours.orderBy(first, "severity").limit(limit)


def alert_frequency_wide(alerts: DataFrame, ts: str = "timestamp") -> DataFrame:
    """One row per hour, one column per severity."""
    wide = alerts.groupBy(truncate_time("hour", F.col(ts)).alias("hour"))
    return wide.pivot("severity", ["CRITICAL", "WARNING", "RESOLVED"]).count().na.fill(0)


def resolved_count(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count_if(F.col("severity") == "RESOLVED").alias("resolved"))


# -- repeats ----------------------------------------------------------------

def metric_in_message(message: Column, metrics: Sequence[str]) -> Column:
    """The first of ``metrics`` that the text mentions, for alerts that carry
    their metric only in the message."""
    return F.coalesce(*[F.when(F.contains(message, F.lit(m)), m) for m in metrics])


def suppress_repeats(
    alerts: DataFrame,
    ts: str = "timestamp",
    tie: str = "id",
    keys: Sequence[str] = ("drift_type", "metric_name"),
    minutes: int = 30,
) -> DataFrame:
    """Add ``suppressed``: an earlier alert of the same key lies within the window.

    Suppressed alerts extend the window.  Time is cut into slots as long as the
    window: only the first alert of a (key, slot) can have nothing within reach,
    and only the last alert of the slot before can be within its reach.  So a
    key is reduced to two values per slot before the shuffle, however many
    alerts it holds.
    """
    keys = list(keys)
    slotted = alerts.withColumn("_slot", _slot(ts, minutes))
    slots = _slot_heads(slotted, ts, tie, keys, minutes, F.struct(F.col(tie).alias("tie")))
    slots = slots.select(*keys, "_slot", F.when(F.col("_opens"), F.col("_head.tie")).alias("_sent"))
    joined = join_small(slotted, slots, [*keys, "_slot"])
    sent = F.coalesce(F.col(tie) == F.col("_sent"), F.lit(False))
    return joined.withColumn("suppressed", ~sent).select(*alerts.columns, "suppressed")


def dispatched(
    alerts: DataFrame,
    ts: str = "timestamp",
    tie: str = "id",
    keys: Sequence[str] = ("drift_type", "metric_name"),
    minutes: int = 30,
) -> DataFrame:
    """The alerts that are sent: the slot heads themselves, so nothing is joined
    back to the table."""
    keys = list(keys)
    rest = [c for c in alerts.columns if c not in keys]
    slotted = alerts.withColumn("_slot", _slot(ts, minutes))
    heads = _slot_heads(slotted, ts, tie, keys, minutes, F.struct(*rest)).filter("_opens")
    return heads.select(*keys, "_head.*").select(*alerts.columns)


def _slot(ts: str, minutes: int) -> Column:
    """Start of the slot, in microseconds."""
    at = micros(F.col(ts))
    return at - F.pmod(at, F.lit(minutes * 60_000_000))


def _slot_heads(
    slotted: DataFrame, ts: str, tie: str, keys: list[str], minutes: int, head: Column
) -> DataFrame:
    """Per key and slot: its first alert (``_head``) and whether that one has
    nothing within reach (``_opens``)."""
    at = micros(F.col(ts))
    slots = slotted.groupBy(*keys, "_slot").agg(
        F.min_by(head, F.struct(at.alias("at"), F.col(tie).alias("tie"))).alias("_head"),
        F.min(at).alias("_first"),
        F.max(at).alias("_last"),
    )
    before = F.lag("_last").over(W.partitionBy(*keys).orderBy("_slot"))
    opens = before.isNull() | (F.col("_first") - before > minutes * 60_000_000)
    return slots.withColumn("_opens", opens)

"""Alert repeat suppression on a stream."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import micros

# Executors need no copy of the package: what they run is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Gate(StatefulProcessor):
    """Per key: the stretches of time with alerts, gaps up to the reach included.

    An alert is sent if no stretch reaches up to it, whether newer alerts were
    seen before or not.  Stretches older than ``lateness`` are forgotten, so the
    state of a key holds at most lateness / reach of them.  Once the watermark
    has passed the reach of the last one, no alert that may still come can
    repeat any, and the timer of the key clears its state.
    """

    def __init__(self, reach: int, lateness: int) -> None:
        self.reach, self.lateness = reach, lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("stretches", "first bigint, last bigint")

    def joined(self, stretches: list[tuple]) -> list[tuple]:
        """Sorted (first, id, last) with neighbours within reach made one."""
        out: list[tuple] = []
        for first, first_id, last in sorted(stretches, key=lambda s: s[:2]):
            if out and first - out[-1][2] <= self.reach:
                out[-1] = (*out[-1][:2], max(out[-1][2], last))
            else:
                out.append((first, first_id, last))
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: list[tuple] = []
        for spans in rows:
            columns = (spans["first_at"], spans["first_id"], spans["last_at"])
            new = self.joined([*new, *((int(a), int(i), int(z)) for a, i, z in zip(*columns))])
        seen = [tuple(s) for s in self.seen.get()]
        sent = [
            (*key, first_id, first)
            for first, first_id, _ in new
            if not any(a <= first and first - z <= self.reach for a, z in seen)
        ]
        kept = self.joined([(a, 0, z) for a, z in seen] + [(a, 0, z) for a, _, z in new])
        if kept:
            oldest = kept[-1][2] - self.lateness
            self.seen.put([(a, z) for a, _, z in kept if z >= oldest])
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((kept[-1][2] + self.reach) // 1000 + 1)
        columns = [f"k{i}" for i in range(len(key))] + ["id", "at"]
        yield pd.DataFrame(sent, columns=columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def dispatch_stream(
    alerts: DataFrame, ts: str = "timestamp", tie: str = "id",
    keys: Sequence[str] = ("drift_type", "metric_name"), minutes: int = 30, lateness_hours: int = 24,
) -> DataFrame:
    """Ids and times of the alerts to send: those without another of their key
    in the ``minutes`` before.  Alerts may be up to ``lateness_hours`` behind the
    newest one, which is the watermark: older ones are dropped, and keys without
    newer alerts lose their state.  A NULL key is a key like others; alerts without a time are left out.

    Before the shuffle every task folds its alerts to one span (first, last)
    per key and slot of that length; inside a slot all gaps are shorter than
    the reach, so only a span's first alert can be sent.  A key that holds most
    of the alerts therefore sends a handful of rows to its state.
    """
    keys = list(keys)
    reach = minutes * 60_000_000
    at = micros(F.col(ts))
    rows = alerts.filter(F.col(ts).isNotNull()).select(*keys, F.col(tie).cast("bigint").alias("first_id"), at.alias("first_at"))
    rows = rows.withColumn("last_at", F.col("first_at")).withColumn("slot", F.col("first_at") - F.pmod("first_at", F.lit(reach)))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ordered = batch.sort_values(["first_at", "first_id"])
            grouped = ordered.groupby([*keys, "slot"], sort=False, as_index=False, dropna=False)
            yield grouped.agg(first_id=("first_id", "first"), first_at=("first_at", "first"), last_at=("last_at", "max"))[
                [*keys, "first_id", "first_at", "last_at"]
            ]

    types = dict(rows.dtypes)
    kept = ", ".join(f"{k} {types[k]}" for k in keys)
    spans = rows.mapInPandas(fold, f"{kept}, first_id bigint, first_at bigint, last_at bigint")
    spans = spans.withColumn("seen_at", F.timestamp_micros("last_at")).withWatermark("seen_at", f"{lateness_hours} hours")
    out = ", ".join(f"k{i} {types[k]}" for i, k in enumerate(keys))
    sent = spans.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Gate(reach, lateness_hours * 3_600_000_000), outputStructType=f"{out}, id bigint, at bigint", outputMode="append", timeMode="EventTime"
    )
    return sent.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.col("id").alias(tie), F.timestamp_micros("at").alias(ts))

"""Consecutive breaches, kept up to date on a stream of check results."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import micros
from ..operators.decision import STREAK_ROWS

# Executors need no copy of the package: what they run is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _Streak(StatefulProcessor):
    """Per key: the newest results by time and id, whenever they arrived.  A late
    result takes its place among them, or none if it is older than all."""

    def __init__(self, last: int) -> None:
        self.last = last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "at bigint, id bigint, breached boolean")
        self.updates = handle.getValueState("updates", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {(at, i): breached for at, i, breached in self.recent.get()}
        for frame in rows:
            for at, i, breached in zip(frame["at"], frame["id"], frame["breached"]):
                held[int(at), int(i)] = bool(breached)
        kept = sorted(held.items(), reverse=True)[: self.last]
        streak = next((n for n, (_, breached) in enumerate(kept) if not breached), len(kept))
        self.recent.put([(at, i, breached) for (at, i), breached in kept])
        number = self.updates.get()[0] + 1 if self.updates.exists() else 1
        self.updates.update((number,))
        columns = [f"k{i}" for i in range(len(key))] + ["streak", "at", "update_no"]
        yield pd.DataFrame([(*key, streak, kept[0][0][0], number)], columns=columns)

    def close(self) -> None:
        pass


def streak_stream(
    results: DataFrame, ts: str = "timestamp", tie: str = "id", by: Sequence[str] = ("model_version",), last: int = STREAK_ROWS
) -> DataFrame:
    """``by``, ``streak``, ``ts`` (of the newest result) and ``update_no`` whenever
    results of a key arrive: what :func:`breach_streak` gives for all results so
    far, in whatever order they came.  See :func:`latest_streaks`.

    A NULL key is a key like others; results without a time, id or verdict are
    left out.  The state of a key is ``last`` results; a task sends no more than
    that per key and Arrow batch to it, however many it reads.
    """
    by = list(by)
    columns = [*by, micros(F.col(ts)).alias("at"), F.col(tie).cast("bigint").alias("id"), F.col("is_breached").alias("breached")]
    rows = results.select(*columns).dropna(subset=["at", "id", "breached"])

    def newest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ordered = batch.sort_values(["at", "id"], ascending=False)
            yield ordered.groupby(by, sort=False, dropna=False).head(last)

    types = dict(rows.dtypes)
    kept = ", ".join(f"`{k}` {types[k]}" for k in by)
    few = rows.mapInPandas(newest, f"{kept}, at bigint, id bigint, breached boolean")
    out = ", ".join(f"k{i} {types[k]}" for i, k in enumerate(by))
    found = few.groupBy(*by).transformWithStateInPandas(
        statefulProcessor=_Streak(last), outputStructType=f"{out}, streak bigint, at bigint, update_no bigint", outputMode="append", timeMode="none"
    )
    return found.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(by)], "streak", F.timestamp_micros("at").alias(ts), "update_no")


def latest_streaks(updates: DataFrame, by: Sequence[str] = ("model_version",)) -> DataFrame:
    """The current streak of every key from what :func:`streak_stream` has written."""
    return updates.groupBy(*by).agg(F.max_by("streak", "update_no").alias("streak"))

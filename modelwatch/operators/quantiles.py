"""Exact order statistics and quantiles per group, without sorting whole groups.

Groups are reduced to distinct values with counts and ranked by a running
count.  Groups beyond ``group_limit`` rows are narrowed first: a sketch brackets
every wanted rank, rows outside the brackets are only counted, and rows inside
(about ``10 / accuracy`` of the group per rank) are ranked exactly, in value
ranges side by side if a bracket is itself beyond the limit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise
from .ranking import running_totals
from .sizing import join_small, match, settle

#: Rows per group up to which a group may be ranked in one task.
GROUP_LIMIT = 2_000_000


@dataclass(frozen=True)
class Pick:
    """One wanted value: its 0-based rank as SQL over the group size ``n``, and
    the fraction of the group below it, which places the bracket.  (SQL text,
    because building long expressions call by call costs more than running them.)"""

    name: str
    fraction: float
    rank: str


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the biggest group: a count that reads the key columns only."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    picks: Sequence[Pick],
    group_limit: int = GROUP_LIMIT,
    accuracy: int = 10_000,
) -> DataFrame:
    """One row per group: keys, ``n`` and one column per pick."""
    keys = list(keys)
    rows = _rows(df, keys, value)
    fractions = [p.fraction for p in picks]
    brackets = None
    if largest_group(rows, keys) > group_limit:
        brackets = _brackets(rows, keys, fractions, accuracy)
    found = _hit_cells(rows, keys, [(p.rank, p.rank) for p in picks], fractions, brackets, group_limit)
    return found.selectExpr(*keys, "n", *[f"{_at_rank(p.rank)} AS {p.name}" for p in picks])


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    method: str = "exact",
    group_limit: int = GROUP_LIMIT,
    accuracy: int = 10_000,
    biggest: int | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles: keys, ``n`` and the array ``q``.

    ``method='approx'`` takes ``percentile_approx`` instead.  ``biggest`` is an
    upper bound of the group sizes, for callers that know one.
    """
    keys = list(keys)
    rows = _rows(df, keys, value)
    wanted = f"array({', '.join(f'{p!r}D' for p in probs)})"
    if method == "approx":
        return rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.expr(f"percentile_approx(_v, {wanted}, {accuracy})").alias("q")
        )
    if method != "exact":
        raise ValueError(f"unknown method: {method}")
    if biggest is None:
        biggest = largest_group(rows, keys)
    brackets = _brackets(rows, keys, probs, accuracy) if biggest > group_limit else None
    ranks = [(f"floor({p!r}D * (n - 1))", f"ceil({p!r}D * (n - 1))") for p in probs]
    return interpolate(_hit_cells(rows, keys, ranks, probs, brackets, group_limit), keys, probs)


def interpolate(found: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """keys, ``n`` and the array ``q`` of linear-interpolated quantiles from the
    values (``_cells``) that cover the ranks next to each of them."""
    wanted = f"array({', '.join(f'{p!r}D' for p in probs)})"
    # From the nearer neighbour, so that a fraction just above a rank cannot fall
    # below its value (the built-in percentile can).
    neighbours = (
        f"transform({wanted}, p -> named_struct('t', p * (n - 1) - floor(p * (n - 1)), "
        f"'a', {_at_rank('floor(p * (n - 1))')}, 'b', {_at_rank('ceil(p * (n - 1))')}))"
    )
    mixed = (
        "transform(_near, x -> CASE WHEN x.a = x.b THEN x.a WHEN x.t < 0.5 THEN x.a + (x.b - x.a) * x.t "
        "ELSE x.b - (x.b - x.a) * (1 - x.t) END)"
    )
    return found.selectExpr(*keys, "n", f"{neighbours} AS _near").selectExpr(*keys, "n", f"{mixed} AS q")


def _at_rank(rank: str) -> str:
    """SQL for the value that covers a rank."""
    return f"filter(_cells, c -> c._from <= {rank} AND {rank} < c._to)[0]._cell"


def _rows(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())


def _spread(fractions: Sequence[float]) -> list[float]:
    return sorted({min(max(f, 0.0), 1.0) for f in fractions})


def _brackets(rows: DataFrame, keys: list[str], fractions: Sequence[float], accuracy: int) -> DataFrame:
    """For every wanted fraction of every group two values that are sure to
    enclose it.  One pass; the result is small and already computed."""
    margin = 5.0 / accuracy
    fractions = _spread(fractions)
    lows = [max(f - margin, 0.0) for f in fractions]
    highs = [min(f + margin, 1.0) for f in fractions]
    probs = ", ".join(f"{x!r}D" for x in lows + highs)
    # Spark makes a sketch per task and merges them, so the order of the rows
    # does not matter.
    sketches = rows.groupBy(*keys).agg(
        F.expr(f"percentile_approx(_v, array({probs}), {accuracy})").alias("_q"),
        F.min("_v").alias("_mn"),
        F.max("_v").alias("_mx"),
        F.count(F.lit(1)).alias("_n"),
    )
    k = len(fractions)
    bounds = []
    # The margin covers the sketch's error (1 / accuracy) and rounding by a few
    # rows; groups too small for that are bracketed by their whole range.
    few = F.col("_n") <= 20 * accuracy
    for i in range(k):
        low = F.col("_mn") if lows[i] == 0.0 else F.when(few, F.col("_mn")).otherwise(F.col("_q")[i])
        high = F.col("_mx") if highs[i] == 1.0 else F.when(few, F.col("_mx")).otherwise(F.col("_q")[k + i])
        bounds += [low.alias(f"_lo{i}"), high.alias(f"_hi{i}")]
    return settle(sketches.select(*keys, *bounds), "brackets")


def _tagged(rows: DataFrame, keys: list[str], fractions: Sequence[float], brackets: DataFrame) -> DataFrame:
    """Rows with a segment: odd ones are brackets and keep their value, even ones
    are the gaps between and are only counted (``_cell`` NULL)."""
    joined = join_small(rows, brackets, keys)
    seg = cell = "CASE"
    k = len(_spread(fractions))
    for i in range(k):
        seg += f" WHEN _v < _lo{i} THEN {2 * i} WHEN _v <= _hi{i} THEN {2 * i + 1}"
        cell += f" WHEN _v < _lo{i} THEN NULL WHEN _v <= _hi{i} THEN _v"
    return joined.selectExpr(*keys, f"{seg} ELSE {2 * k} END AS _seg", f"{cell} END AS _cell")


def _hit_cells(
    rows: DataFrame,
    keys: list[str],
    ranks: Sequence[tuple[str, str]],
    fractions: Sequence[float],
    brackets: DataFrame | None,
    group_limit: int,
) -> DataFrame:
    """Per group ``n`` and ``_cells``: the few distinct values (with the ranks
    ``_from`` up to ``_to`` they cover) that lie at one of the wanted ranks."""
    if brackets is None:
        placed = _placed_whole(rows, keys)
    else:
        placed = _placed_narrow(_tagged(rows, keys, fractions, brackets), keys, group_limit)
    hit = " OR ".join(f"(_from <= {high} AND {low} < _to)" for low, high in ranks)
    return placed.filter(hit).groupBy(*keys).agg(
        F.max("n").alias("n"), F.collect_list(F.struct("_from", "_to", "_cell")).alias("_cells")
    )


def _counted(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))


def _placed_whole(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values of groups within the limit with the ranks they cover."""
    cells = _counted(rows.withColumnRenamed("_v", "_cell"), [*keys, "_cell"])
    group = W.partitionBy(*(keys or [F.lit(0)]))
    so_far = group.orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)
    return (
        cells.withColumn("_to", F.sum("_c").over(so_far))
        .withColumn("n", F.sum("_c").over(group))
        .withColumn("_from", F.col("_to") - F.col("_c"))
    )


def _placed_narrow(tagged: DataFrame, keys: list[str], group_limit: int) -> DataFrame:
    """Distinct bracketed values with the ranks they cover in the whole group."""
    # about a hundredth of the input; written once, read by the steps below
    cells = materialise(_counted(tagged, [*keys, "_seg", "_cell"]), "cells")
    # Ranks restart in each segment, so a window holds one bracket, not a group.
    segments = cells.groupBy(*keys, "_seg").agg(F.sum("_c").alias("_size"))
    group = W.partitionBy(*(keys or [F.lit(0)]))
    before = group.orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    segments = segments.select(
        *keys,
        "_seg",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"),
        F.sum("_size").over(group).alias("n"),
    )
    inside = cells.filter(F.col("_cell").isNotNull())
    if largest_group(inside, [*keys, "_seg"]) > group_limit:
        upto = running_totals(inside, "_cell", ["_c"], [*keys, "_seg"]).withColumnRenamed("cum__c", "_upto")
    else:
        so_far = W.partitionBy(*keys, "_seg").orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)
        upto = inside.withColumn("_upto", F.sum("_c").over(so_far))
    return (
        match(upto, segments, [*keys, "_seg"])
        .withColumn("_to", F.col("_base") + F.col("_upto"))
        .withColumn("_from", F.col("_to") - F.col("_c"))
    )

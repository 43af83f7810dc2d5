"""Joins against small sides whose size is checked, never assumed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Most rows a side may have to be broadcast (a profile row is about 200 bytes).
SMALL_SIDE_ROWS = 50_000


def gather_small(small: DataFrame, max_rows: int = SMALL_SIDE_ROWS) -> DataFrame | None:
    """``small`` as a local relation, or None when it has more than ``max_rows``.

    At most ``max_rows + 1`` rows reach the driver, which is what a broadcast
    of them would cost as well.
    """
    table = small.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return None
    return small.sparkSession.createDataFrame(table, schema=small.schema)


def settle(small: DataFrame, label: str = "table", max_rows: int = SMALL_SIDE_ROWS) -> DataFrame:
    """Compute a frame that is expected to be small, once: a local relation, or
    beyond ``max_rows`` a table in the scratch folder."""
    local = gather_small(small, max_rows)
    return local if local is not None else materialise(small, label)


def match(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys with the keys once, like a join by name, but NULL keys
    meet: rows without a key belong to a group of their own and are not lost."""
    on = list(on)
    rest = [c for c in right.columns if c not in on]
    named = right.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(on)], *rest)
    return _matched(left, named, on, rest, how)


def _matched(left: DataFrame, named: DataFrame, on: list[str], rest: list[str], how: str) -> DataFrame:
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(on)])
    keys = [F.coalesce(c, f"_key{i}").alias(c) if how in ("full", "right") else F.col(c) for i, c in enumerate(on)]
    return left.join(named, same, how).select(*keys, *[c for c in left.columns if c not in on], *rest)


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_rows: int = SMALL_SIDE_ROWS,
) -> DataFrame:
    """Broadcast join while ``small`` is small, else a shuffle join (AQE splits
    hot keys); NULL keys meet.  Without keys ``small`` must be a single row; it is attached as
    a scalar subquery, not as a cross join."""
    if not on:
        return attach_row(big, small)
    local = gather_small(small, max_rows)
    if local is None:
        return match(big, small, on, how)
    rest = [c for c in local.columns if c not in on]
    named = local.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(on)], *rest)
    return _matched(big, F.broadcast(named), list(on), rest, how)


def attach_row(big: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame to every row of ``big``."""
    name = "_row"
    packed = row.select(F.struct(*[F.col(c) for c in row.columns]).alias(name)).scalar()
    out = big.withColumn(name, packed)
    return out.select(*big.columns, *[F.col(f"{name}.{c}").alias(c) for c in row.columns])

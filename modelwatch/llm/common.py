"""What the operators of this subpackage share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of a word is ASCII only: 20 and 09 to 0D.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def runs_on_workers(module: str) -> None:
    """Send this module's functions to Python workers by value, so that the
    executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


runs_on_workers(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def map_rows(
    df: DataFrame,
    start: Callable[[], Callable[..., tuple]],
    schema: str,
    chunk: int = 512,
) -> DataFrame:
    """One output row per input row, made in Arrow batches.

    ``start()`` runs once per task and returns the function that maps the
    values of a row (the columns of ``df`` in order) to the values of
    ``schema``.
    """
    out = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in df.sparkSession.createDataFrame([], schema).schema])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                rows = [f(*row) for row in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out
                )

    return df.mapInArrow(run, schema)


_ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<double>": pa.list_(pa.float64()),
}


def word_count(text: str) -> object:
    """Words of a text column; none for a null text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")

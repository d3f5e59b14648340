"""Helpers of the corpus operators: row-wise Arrow operators and tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructField, StructType

from ..session import checkpoint_folder

#: Rows handed to a kernel at once hold about this many characters, so that working arrays stay small.
SLICE_CHARS = 1_000_000
#: Rows of a batch that a kernel gets at once, so that what it returns stays small too.
SLICE_ROWS = 2048


def spans(sizes: Sequence[int], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to about ``limit``; a larger row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def append_columns(df: DataFrame, inputs: Sequence[str], fields: Sequence[tuple[str, DataType]],
                   kernel: Callable[[], Callable[..., Sequence[pa.Array]]]) -> DataFrame:
    """All columns of ``df`` and the new ``fields``, computed batch by batch from ``inputs`` without a shuffle.

    ``kernel()`` runs once per task and returns a function from Arrow arrays to Arrow arrays. A column of ``df`` that
    carries the name of a new one is replaced, unless it is itself an input."""
    fresh = {name.lower() for name, _ in fields}
    kept = [c for c in df.columns if c.lower() not in fresh]
    order = [*kept, *[c for c in inputs if c not in kept]]
    places = [order.index(c) for c in inputs]
    schema = StructType([df.schema[c] for c in kept] + [StructField(name, kind) for name, kind in fields])
    width = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = kernel()
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(start, SLICE_ROWS)
                made = work(*[batch.column(i) for i in places])
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], names=[f.name for f in schema.fields])

    return df.select(*[f"`{c}`" for c in order]).mapInArrow(run, schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the cluster's shared folder: computed once, and readable after executors are lost."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df

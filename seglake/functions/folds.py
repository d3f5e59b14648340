"""Folds whose next step needs the last result.

Rows are shuffled by key, sorted inside partitions and streamed through Python
in Arrow batches. Memory is one batch plus the state; no group is gathered. One
key runs in one task, so callers cut keys at the points where the state resets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], schema: str,
                start: Callable[[tuple], object], step: Callable[[object, dict], Iterator[tuple]],
                finish: Callable[[object], Iterator[tuple]] | None = None) -> DataFrame:
    """``step(state, row)`` mutates the state and yields output tuples;
    ``finish(state)`` yields what is left when a key ends."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            out: list[tuple] = []
            columns = list(pdf.columns)
            data = {c: pdf[c].tolist() for c in columns}
            for i in range(len(pdf)):
                row = {c: data[c][i] for c in columns}
                now = tuple(row[k] for k in keys)
                if now != key:
                    if key is not None and finish is not None:
                        out.extend(finish(state))
                    key, state = now, start(now)
                out.extend(step(state, row))
            yield pd.DataFrame(out, columns=names)
        if key is not None and finish is not None:
            yield pd.DataFrame(list(finish(state)), columns=names)

    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.mapInPandas(run, schema)

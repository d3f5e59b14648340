"""Folds over long sessions in many tasks, by speculation.

A session is cut into blocks of consecutive rows. Every block is folded at once from a guess: the state that a short run over
the rows just before the block leaves. Where the guess equals the state in which the block before really ended, the block is
right; the other blocks are folded again from that state, until no border differs. The first block of a session starts right, so
what is left at the end is what one fold over the whole session yields. Bounded states forget their past soon, and then few
blocks are folded twice."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .ordered import BLOCK_ROWS, rows_block, with_halo


def _plain(value):
    return value.tolist() if hasattr(value, "tolist") else list(value)


def dump(state: dict) -> str:
    return json.dumps({k: v for k, v in state.items() if k != "key"}, sort_keys=True, ensure_ascii=False, default=_plain)


def load(fold, key: tuple, text: str | None) -> dict:
    fresh = fold.start(key)
    return fresh if text is None else {**fresh, **json.loads(text)}


def fold_blocks(df: DataFrame, keys: list[str], order: list[str], at: str, fold, warm: int = 64, width: int = BLOCK_ROWS) -> DataFrame:
    """What ``fold`` yields over the rows of each key in ``order``, with ``width`` positions of ``at`` in a task.

    ``at`` is an integer that never decreases along the order. ``warm`` positions before a block make its guess; the fold's state
    must survive JSON. The result does not depend on either number."""
    schema = fold.schema(df, keys)
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    place = [*keys, "_blk"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where = state = begun = None

        def closed() -> list[tuple]:
            return [] if begun is None else [(*where[:-1], *[None] * (len(names) - len(keys)), where[-1], begun, dump(state))]

        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.to_dict("records"):
                now = tuple(row[k] for k in place)
                if now != where:
                    out += closed()
                    where, begun, state = now, None, load(fold, now[:-1], row["_begin"])
                if row["_own"] and begun is None:
                    begun = dump(state)
                made = list(fold.step(state, row))
                if row["_own"]:
                    out += [(*m, now[-1], None, None) for m in made]
            yield pd.DataFrame(out, columns=[*names, "_blk", "_start", "_end"])
        yield pd.DataFrame(closed(), columns=[*names, "_blk", "_start", "_end"])

    def tried(rows: DataFrame) -> DataFrame:
        placed = rows.repartition(*place).sortWithinPartitions(*place, "_own", *order)
        return cut(placed.mapInPandas(run, f"{schema}, _blk long, _start string, _end string"))

    def borders(table: DataFrame, no: int) -> DataFrame:
        return table.where("_end IS NOT NULL").select(*place, "_start", "_end", F.lit(no).alias("_round"))

    width = max(width, warm, 1)
    own = df.withColumn("_blk", rows_block(at, width).cast("bigint")).withColumn("_own", F.lit(True))
    tables = [tried(with_halo(df, at, warm, 0, width).withColumn("_begin", F.lit(None).cast("string")))]
    states = borders(tables[0], 0)
    along = Window.partitionBy(*keys).orderBy("_blk")
    while True:
        seen = states.withColumn("_begin", F.lag("_end").over(along))
        wrong = cut(seen.where("_begin <> _start").select(*place, "_begin"))
        if wrong.isEmpty():
            break
        tables.append(tried(own.join(wrong, place)))
        kept = states.join(wrong, place, "left_anti")
        states = cut(kept.unionByName(borders(tables[-1], len(tables) - 1)))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.to_dict("records"):
                out.extend(fold.finish(load(fold, tuple(row[k] for k in keys), row["_end"])))
            yield pd.DataFrame(out, columns=names)

    result = states.groupBy(*keys).agg(F.max_by("_end", "_blk").alias("_end")).mapInPandas(ends, schema)
    for no, table in enumerate(tables):
        rows = table.where("_end IS NULL")
        rows = rows if len(tables) == 1 else rows.join(states.where(F.col("_round") == no), place, "left_semi")
        result = result.unionByName(rows.select(*names))
    return result

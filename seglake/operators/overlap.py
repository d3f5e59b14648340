"""Overlap trimming: cut from a line what the line before already said."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordered import BLOCK_ROWS, prev, rows_block, scan
from ..functions.speculative import fold_blocks
from ..streaming.folds import Fold, on_stream

MARKS = frozenset(".,!?:()[]{}*\"'")


def cut_repeat(base: str, said: str, head: int = 0, edits: int = 0, least: int = 3) -> str:
    """Drop the longest word-aligned prefix of ``base`` whose letters (no space,
    no marks, case folded) end ``said``; ``head`` leading letters may be wrong
    and ``edits`` letters may differ."""
    letters, where = [], []
    for i, ch in enumerate(base):
        if not ch.isspace() and ch not in MARKS:
            letters.append(ch)
            where.append(i)
    key = "".join(letters).casefold()
    full = "".join(ch for ch in said if not ch.isspace() and ch not in MARKS).casefold()
    for n in range(min(len(letters), len(key)), least - 1, -1):
        if n < len(where) and where[n] - 1 == where[n - 1]:
            continue  # inside a word
        rest = where[n - 1] + 1  # marks that close the repeated part go with it, marks that open the next one stay
        while rest < len(base) and base[rest] in MARKS:
            rest += 1
        rest = len(base) - len(base[rest:].lstrip())
        for skip in range(head + 1):
            want = key[skip:n]
            if want and len(want) <= len(full) and sum(a != b for a, b in zip(full[-len(want):], want)) <= edits:
                return base[rest:]
    return base


def trim_overlap(lines: DataFrame, keys: list[str], order: str, text: str = "text", head: int = 0, edits: int = 0,
                 least: int = 3) -> DataFrame:
    """Compare each row with the raw row before it."""

    @F.pandas_udf(T.StringType())
    def cut(base: pd.Series, said: pd.Series) -> pd.Series:
        return pd.Series([b if s is None or b is None else cut_repeat(b, s, head, edits, least) for b, s in zip(base, said)])

    s = scan(lines, keys, [order], rows_block(order), _said=prev(text))
    return s.withColumn(text, cut(text, "_said")).drop("_said")


class KeptRow(Fold):
    """Compare each row with the last row that was kept; rows left empty are dropped. State: the text of that row."""

    columns = "seq long, text string"

    def __init__(self, head: int = 0, edits: int = 0, least: int = 3):
        self.rules = (head, edits, least)

    def start(self, key):
        return {**super().start(key), "said": None}

    def step(self, s, row):
        text = row["text"]
        rest = text if s["said"] is None or not text else cut_repeat(text, s["said"], *self.rules)
        if rest:
            s["said"] = rest
            yield (*s["key"], row["seq"], rest)


def trim_kept_overlap(lines: DataFrame, head: int = 0, edits: int = 0, least: int = 3, width: int = BLOCK_ROWS) -> DataFrame:
    """``lines``: session_id, seq, text. Streams take the rows as they arrive; tables are folded in blocks of ``width`` rows."""
    src, fold = lines.select("session_id", "seq", "text"), KeptRow(head, edits, least)
    if src.isStreaming:
        return on_stream(src, ["session_id"], ["seq"], fold)
    return fold_blocks(src, ["session_id"], ["seq"], "seq", fold, 16, width)

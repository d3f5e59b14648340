"""Benchmark decontamination: windows of ten words of the items are a broadcast hash set, and training texts are scanned for them.

The items are taken in blocks of bounded size, one broadcast each; more blocks mean more passes, and the passes are joined."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

from .common import append_columns, written

WINDOW = 10
#: Characters of benchmark text whose windows are broadcast at once.
BLOCK_CHARS = 8_000_000
#: So many blocks are looked for in a row before the rows are written and read again.
CHAINED = 4
#: Lower-cases A-Z and turns every other ASCII character but digits and a-z into a blank.
TO_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TO_WORDS).split()


class Windows:
    """The windows of a block of items. Words are numbered from 1, 0 is any other word."""

    def __init__(self, items: list[tuple[str, str | None]], size: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.owners: dict[int, dict[bytes, set[str]]] = {}
        for item, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words(text)], dtype=np.int32)
            if len(ids):
                n = min(size, len(ids))
                for p in range(len(ids) - n + 1):
                    self.owners.setdefault(n, {}).setdefault(ids[p:p + n].tobytes(), set()).add(item)

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, positions of words inside an occurring window, and the items whose windows occur."""
        own = words(text)
        ids = np.fromiter(map(self.number.get, own, repeat(0)), dtype=np.int32, count=len(own))
        items: set[str] = set()
        hit = np.zeros(len(own) + 1, dtype=np.int32)
        unknown = np.cumsum(ids == 0)
        for n, owners in self.owners.items():
            if len(ids) < n:
                continue
            inside = unknown[n - 1:] - np.concatenate(([0], unknown[:len(ids) - n]))
            for p in np.flatnonzero(inside == 0):
                found = owners.get(ids[p:p + n].tobytes())
                if found:
                    hit[p] += 1
                    hit[p + n] -= 1
                    items |= found
        return len(own), np.flatnonzero(np.cumsum(hit[:-1])), items


def blocks(benchmark: DataFrame, limit: int = BLOCK_CHARS) -> list[DataFrame]:
    """The items in parts of about ``limit`` characters. A longer item is a part of its own."""
    items = benchmark.select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // limit)
    if parts <= 1:
        return [items]
    key = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    return [items.where(key == i) for i in range(parts)]


FOUND = [("n_words", LongType()), ("hits", ArrayType(IntegerType())), ("items", ArrayType(StringType()))]


def one_pass(docs: DataFrame, block: DataFrame, size: int, text: str, prefix: str) -> DataFrame:
    items = [(str(r["item_id"]), r["text"]) for r in block.where("text IS NOT NULL").collect()]
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def kernel():
        windows = Windows(sent.value, size)

        def work(column):
            rows = [windows.scan(t) for t in column.to_pylist()]
            return [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                    pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string()))]

        return work

    return append_columns(docs, [text], [(prefix + name, kind) for name, kind in FOUND], kernel)


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text: str = "text", prefix: str = "",
         limit: int = BLOCK_CHARS) -> DataFrame:
    """Adds n_words, hits (positions of words inside any occurrence of a window) and items (sorted item ids as text).

    A window is ``size`` consecutive words of an item; a shorter item that has words is one window. Null texts have no words.
    Blocks of windows are looked for one after the other in the same rows, which are not shuffled.
    An item with a null id counts as item ``None``. Every row of ``docs`` is returned with its other columns."""
    more = "_decontaminate_more_"
    names = [f"{prefix}hits", f"{prefix}items"]
    done = docs
    for turn, part in enumerate(blocks(benchmark, limit)):
        if not turn:
            done = one_pass(docs, part, size, text, prefix)
            continue
        done = one_pass(done if turn % CHAINED else written(done, "hits"), part, size, text, more)
        both = {name: F.array_sort(F.array_union(name, more + name.removeprefix(prefix))) for name in names}
        kept = [c for c in done.columns if not c.startswith(more)]
        done = done.select(*[both[c].alias(c) if c in both else F.col(f"`{c}`") for c in kept])
    return done


def remove_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Rows without any window of the benchmark, columns as they are."""
    found = find(docs, benchmark, size, prefix="_decontaminate_")
    return found.where(F.size("_decontaminate_hits") == 0).select(*[f"`{c}`" for c in docs.columns])


def cut_words(text: str, hits: list[int]) -> str:
    """``text`` without its words at ``hits`` and without the marks between two neighbouring ones."""
    raw = text.encode("utf-8", "replace")
    spread = np.frombuffer(raw.translate(TO_WORDS), dtype=np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], spread, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    kept, last, gone = [], 0, set(hits)
    for i in sorted(gone):
        if i - 1 not in gone:
            kept.append(raw[last:starts[i]])
        last = ends[i]
    kept.append(raw[last:])
    return b"".join(kept).decode("utf-8", "replace")


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """All rows; the words of windows are cut out of ``text``, which is otherwise left as it is (also null)."""
    found = find(docs, benchmark, size, prefix="_decontaminate_")

    def kernel():
        def work(texts, hits):
            return [pa.array([cut_words(t, h) if h else t for t, h in zip(texts.to_pylist(), hits.to_pylist())], pa.string())]

        return work

    cleaned = append_columns(found, ["text", "_decontaminate_hits"], [("_decontaminate_text", StringType())], kernel)
    return cleaned.withColumn("text", F.col("_decontaminate_text")).select(*[f"`{c}`" for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated from the columns of ``find``."""
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))

"""Removal of passages that an earlier document holds already, by difference-cover anchors.

A window is ``WINDOW`` consecutive words. Anchors of ``ANCHOR`` words are hashed only where a word's place in its document is, modulo
``PERIOD``, in ``COVER``. Every difference modulo the period is one of two cover places, so two equal windows hold an anchor at
the same offset in both, wherever they stand. Only around anchors that more than one document holds are the windows themselves
hashed (128 bits of word hashes, 96 kept) and compared; the least document per window decides.

Documents travel in packed blocks of bounded size. A block tells each anchor and each window once, however many of its
documents hold it, so a passage of a third of all documents is one row per block. Answers go back to the blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordered import shared
from .common import spans

WINDOW, ANCHOR, PERIOD = 13, 7, 7
COVER = np.array([0, 1, 3])
#: Place of a document without id: after all others.
LAST = np.iinfo(np.int64).max
_FACTORS = np.array([xxhash.xxh64_intdigest(b"place %d" % i) | 1 for i in range(2 * WINDOW)], dtype=np.uint64)


def packed(docs: DataFrame) -> DataFrame:
    """Blocks of consecutive rows of about a million characters (a longer text stands alone): block, docs."""
    form = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, options = TaskContext.get().partitionId() << 32, pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            ids, texts = batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string())
            for lo, hi in spans(pc.binary_length(texts).fill_null(0).to_pylist()):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, form, options=options) as out:
                    out.write_batch(pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), texts.slice(lo, hi - lo)], schema=form))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "docs"])
                block += 1

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "block long, docs binary")


class Block:
    """The words of a block's documents, one after the other, and their hashes."""

    def __init__(self, raw: bytes):
        rows = pa.ipc.open_stream(raw).read_all()
        self.ids = rows.column("doc_id").to_pylist()
        self.words = [(t or b"").split() for t in rows.column("text").cast(pa.binary()).to_pylist()]
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        digests = b"".join(map(xxhash.xxh3_128_digest, chain.from_iterable(self.words)))
        self.hashes = np.ascontiguousarray(np.frombuffer(digests, dtype="<u8").reshape(-1, 2).T)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(self.ids)), self.sizes)
        self.key = np.array([LAST if i is None else i for i in self.ids], dtype=np.int64)
        room = self.sizes[self.doc] - (np.arange(len(self.doc)) - self.starts[self.doc])
        self.windows = np.flatnonzero(room >= WINDOW)

    def rolled(self, lane: int, at: np.ndarray, size: int) -> np.ndarray:
        """A hash of the ``size`` words from each of the places ``at``."""
        out = np.zeros(len(at), dtype=np.uint64)
        for i in range(size):
            out += self.hashes[lane][at + i] * _FACTORS[lane * WINDOW + i]
        return out

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Cover places of documents that have a window, and the anchors there."""
        place = np.arange(len(self.doc)) - self.starts[self.doc]
        size = self.sizes[self.doc]
        at = np.flatnonzero(np.isin(place % PERIOD, COVER) & (place <= size - ANCHOR) & (size >= WINDOW))
        return at, self.rolled(0, at, ANCHOR)

    def grouped(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The windows at ``at`` grouped by content: order, group of each place of the order, both hashes in that order."""
        first, second = self.rolled(0, at, WINDOW), self.rolled(1, at, WINDOW) & np.uint64(0x7FFFFFFF)
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        return order, fresh, first, second


def _mapped(df: DataFrame, schema: str, work: Callable[..., Iterator[list[pa.Array]]]) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns):
                for made in work(*[x.as_py() for x in row]):
                    yield pa.RecordBatch.from_arrays(made, names=names)

    return df.mapInArrow(run, schema)


def _anchor_rows(block: int, raw: bytes) -> Iterator[list[pa.Array]]:
    told = np.unique(Block(raw).anchors()[1])
    yield [pa.array(told.view(np.int64)), pa.array(np.full(len(told), block))]


def _window_rows(block: int, raw: bytes, met: list[int] | None) -> Iterator[list[pa.Array]]:
    own = Block(raw)
    at, anchor = own.anchors()
    told, which = np.unique(anchor, return_inverse=True)
    low, high = np.full(len(told), LAST), np.full(len(told), -LAST - 1)
    np.minimum.at(low, which, own.key[own.doc[at]])
    np.maximum.at(high, which, own.key[own.doc[at]])
    hot = (low < high) | np.isin(told, np.array(met or [], dtype=np.int64).view(np.uint64))
    upto = np.zeros(len(own.doc) + 1, dtype=np.int64)
    upto[at[hot[which]] + 1] = 1
    upto = np.cumsum(upto)
    starts = own.windows[upto[own.windows + PERIOD] > upto[own.windows]]
    order, fresh, first, second = own.grouped(starts)
    if not len(order):
        return
    heads = np.flatnonzero(fresh)
    least = np.minimum.reduceat(own.key[own.doc[starts[order]]], heads)
    place = np.minimum.reduceat(starts[order], heads)
    turn = np.argsort(place)  # neighbours in the text stay neighbours in the shuffle
    yield [pa.array(first[heads][turn].view(np.int64)), pa.array(second[heads][turn].astype(np.int32)), pa.array(np.full(len(heads), block)),
           pa.array(place[turn].astype(np.int32)), pa.array(least[turn])]


def _kept_rows(block: int, raw: bytes, told: list[int] | None) -> Iterator[list[pa.Array]]:
    own = Block(raw)
    starts = own.windows
    order, fresh, _, _ = own.grouped(starts)
    gone = np.zeros(len(own.doc) + 1, dtype=np.int64)
    if len(order):
        key = own.key[own.doc[starts[order]]]
        least = np.minimum.reduceat(key, np.flatnonzero(fresh))
        group = np.cumsum(fresh) - 1
        if told:  # an earlier document of another block holds them
            group_at = np.zeros(len(own.doc), dtype=np.int64)
            group_at[starts[order]] = group
            least[group_at[np.array(told)]] = -LAST - 1
        repeated = starts[order][least[group] < key]
        np.add.at(gone, repeated, 1)
        np.add.at(gone, repeated + WINDOW, -1)
    kept = np.cumsum(gone[:-1]) == 0
    for lo, hi in spans([max(1, int(n)) for n in own.sizes]):
        texts, sizes = [], []
        for words, start in zip(own.words[lo:hi], own.starts[lo:hi]):
            stays = list(compress(words, kept[start:start + len(words)].tolist()))
            sizes.append(len(words) - len(stays))
            texts.append(b" ".join(stays))
        yield [pa.array(own.ids[lo:hi], pa.int64()), pa.array(own.sizes[lo:hi]), pa.array(sizes, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed and kept, the words that stay, joined by one space.

    A word goes if a window over it also starts in a document with a smaller doc_id; windows are those of the input. Rows with
    equal doc_id do not remove each other's words. A row without doc_id comes after all others. Null and empty texts have no words,
    texts of fewer than 13 words no window. Repeated rows are returned as often as they come; an empty table gives no rows. Other
    columns are not read. A very long text is one block of its own. ``docs`` is a table, or a plan whose rows come in the same
    order when a task is repeated: blocks are known by task and place."""
    placed = shared(packed(docs), "block")
    anchors = _mapped(placed.select("block", "docs"), "anchor long, block long", _anchor_rows)
    met = anchors.withColumn("_n", F.count("*").over(Window.partitionBy("anchor"))).where("_n > 1")
    met = met.groupBy("block").agg(F.collect_list("anchor").alias("met"))
    windows = _mapped(placed.join(met, "block", "left").select("block", "docs", "met"), "first long, second int, block long, at int, least long", _window_rows)
    known = windows.withColumn("_least", F.min("least").over(Window.partitionBy("first", "second"))).where("_least < least")
    known = known.groupBy("block").agg(F.collect_list("at").alias("told"))
    return _mapped(placed.join(known, "block", "left").select("block", "docs", "told"), "doc_id long, n_words long, n_removed long, kept string", _kept_rows)


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))

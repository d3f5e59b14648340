"""Spelling variants by reduced-alphabet generation.

Letters are hashed to a few symbols. Two words one edit apart have reduced words at most one edit apart, so the full one-edit
neighbourhood of every distinct reduced word is generated and joined with the reduced vocabulary; what meets is verified on
the words themselves. Reduced words travel as 64-bit keys: a clash of keys only adds a candidate.

Null texts have no words, a null doc_id is written ``null`` in the hash. Repeated rows are documents of their own. An empty
table has no words. Only doc_id and text are read, so other columns cannot clash. A text, or a word of it, may be of any length:
a word of n letters has about 16 n neighbours, which are computed from prefix and suffix sums and not from strings."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}
#: One run in so many loses a letter.
ONE_IN = 97
SHORTEST, FEWEST = 5, 3
#: Symbols of the reduced alphabet.
SYMBOLS = 8
#: Distinct words a task counts before it hands them on.
HELD = 1 << 17
#: Keys generated at once.
PIECE = 1 << 19

_STEP = np.uint64(0x9E3779B97F4A7C15)
_VALUE = np.array([xxhash.xxh64_intdigest(b"symbol %d" % s) for s in range(SYMBOLS)], dtype=np.uint64)
_LENGTH = 0xD1B54A32D192ED03


def damaged(doc_id: int | None, run: str) -> str:
    """The run as it is counted: one in 97, by document and run, loses the letter its hash points to."""
    h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
    if h % ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """word and n of the words with at least ``shortest`` letters and ``fewest`` occurrences in all of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for as_written, n in Counter(RUN.findall(text.as_py() or "")).items():
                    word = damaged(doc_id, as_written.translate(LOWER))
                    if len(word) >= shortest:
                        held[word] += n
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def _symbols(words: list[str], length: int) -> np.ndarray:
    """The letters of equally long words as symbols."""
    code = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.uint64).reshape(len(words), length)
    return ((code * _STEP) >> np.uint64(40)) % np.uint64(SYMBOLS)


def _sized(length: int) -> np.uint64:
    return np.uint64(length * _LENGTH % (1 << 64))


def _weights(n: int) -> np.ndarray:
    out = np.full(n, _STEP, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def keys(symbols: np.ndarray) -> np.ndarray:
    """One key per row of symbols: the sum of symbol values weighted by place, and the length."""
    length = symbols.shape[1]
    return (_VALUE[symbols] * _weights(max(length, 1))[:length]).sum(1, dtype=np.uint64) + _sized(length)


def neighbourhoods(symbols: np.ndarray) -> np.ndarray:
    """Per row the keys of everything within one insertion, deletion or replacement, itself among them."""
    m, length = symbols.shape
    value, weight = _VALUE[symbols], _weights(length + 2)
    zero = np.zeros((m, 1), dtype=np.uint64)
    place = np.concatenate((zero, np.cumsum(value * weight[:length], axis=1, dtype=np.uint64)), axis=1)
    moved = np.concatenate((zero, np.cumsum(value * weight[1:length + 1], axis=1, dtype=np.uint64)), axis=1)
    back = np.concatenate((zero, zero, np.cumsum(value[:, 1:] * weight[:length - 1], axis=1, dtype=np.uint64)), axis=1)
    whole = place[:, -1:]
    deleted = place[:, :-1] + (back[:, -1:] - back[:, 1:]) + _sized(length - 1)
    other = (_VALUE[None, :] * weight[:length, None])[None]
    replaced = (whole - value * weight[:length])[:, :, None] + other + _sized(length)
    gap = place + (moved[:, -1:] - moved)
    inserted = gap[:, :, None] + (_VALUE[None, :] * weight[:length + 1, None])[None] + _sized(length + 1)
    return np.concatenate((deleted, replaced.reshape(m, -1), inserted.reshape(m, -1)), axis=1)


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.array([len(w) for w in words])
    for length in np.unique(sizes):
        yield int(length), np.flatnonzero(sizes == length)


def with_key(words: DataFrame) -> DataFrame:
    """Adds the key of the reduced word and the reduced word itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            key, reduced = np.zeros(len(texts), dtype=np.uint64), [b""] * len(texts)
            for length, at in _by_length(texts):
                symbols = _symbols([texts[i] for i in at], length)
                key[at] = keys(symbols)
                for i, row in zip(at, symbols.astype(np.uint8)):
                    reduced[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.view(np.int64)), pa.array(reduced, pa.binary())], names=["word", "n", "key", "reduced"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, key long, reduced binary")


def reduced_pairs(keyed: DataFrame) -> DataFrame:
    """Pairs (key, near) of reduced words in ``keyed`` at most one edit apart, near <= key, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reduced = batch.column(1).to_pylist()
            own = batch.column(0).to_numpy()
            for length, at in _by_length(reduced):
                step = max(1, PIECE // (2 * SYMBOLS * (length + 1)))
                for lo in range(0, len(at), step):
                    part = at[lo:lo + step]
                    symbols = np.frombuffer(b"".join(reduced[i] for i in part), dtype=np.uint8).reshape(len(part), length)
                    near = np.sort(neighbourhoods(symbols).view(np.int64), axis=1)
                    fresh = np.ones(near.shape, dtype=bool)
                    fresh[:, 1:] = near[:, 1:] != near[:, :-1]
                    fresh &= near <= own[part][:, None]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own[part], fresh.sum(1))), pa.array(near[fresh])], names=["key", "near"])

    made = keyed.select("key", "reduced").distinct().mapInArrow(run, "key long, near long")
    there = keyed.select(F.col("key").alias("near")).distinct()
    return made.join(there, "near", "left_semi").select("key", "near").distinct()


def near_words(keyed: DataFrame) -> DataFrame:
    """word, n, other, other_n for every two words that differ by exactly one edit, in both directions."""
    met = reduced_pairs(keyed)
    a = keyed.select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = keyed.select(F.col("key").alias("near"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    pairs = met.join(a, "key").join(b, "near").where("(key <> near OR a < b) AND abs(char_length(a) - char_length(b)) <= 1")
    pairs = pairs.where(F.levenshtein("a", "b", 1) == 1)
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
                    F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    return pairs.select(F.inline(sides))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words of ``forms`` (word, form), by pointer doubling: each round replaces what a word points to by
    what that points to in turn. Counts at least double from form to form, so six rounds reach the end of any chain."""
    up = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "forms")
    while True:
        ahead = up.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("open").alias("on"))
        moved = up.where("open").join(ahead, "root", "left")
        moved = moved.select("word", F.coalesce("next", "root").alias("root"), F.coalesce("on", F.lit(False)).alias("open"))
        up = written(moved.unionByName(up.where("NOT open")), "forms")
        if up.where("open").isEmpty():
            return up.select("word", "root")


def variants(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """Per word of ``docs`` (doc_id, text): word, n, form (its near word of largest n if that is at least twice the word's n, ties
    to the smallest; else null), root (the last form that can be reached, or the word), n_near, form_n."""
    keyed = written(with_key(vocabulary(docs, shortest, fewest)), "vocabulary")
    best = F.min(F.when(F.col("other_n") >= 2 * F.col("n"), F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))))
    told = near_words(keyed).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    told = written(told.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")), "near")
    ends = roots(told.where("form IS NOT NULL"))
    out = keyed.select("word", "n").join(told, "word", "left").join(ends, "word", "left")
    return out.select("word", "n", "form", F.coalesce("root", "word").alias("root"), F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")

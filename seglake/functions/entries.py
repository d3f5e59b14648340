"""Dictionaries of any size: texts meet them by joins on words, or in blocks of bounded size, one after the other."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from . import values as V

#: Characters of the keys and values of a block, which travel to the tasks together.
BLOCK_CHARS = 64_000_000


def blocks(entries: DataFrame, *columns: str, limit: int = BLOCK_CHARS) -> list[DataFrame]:
    """The rows in parts of about ``limit`` characters, dealt by the first column."""
    size = entries.agg(F.sum(sum((F.coalesce(F.length(c), F.lit(0)) for c in columns), F.lit(16)))).first()[0] or 0
    n = max(1, -(-size // limit))
    part = F.pmod(F.xxhash64(columns[0]), F.lit(n))
    return [entries.select(*columns).where(part == i) if n > 1 else entries.select(*columns) for i in range(n)]


def unambiguous(entries: DataFrame) -> DataFrame:
    """One value per key: entries without key or value are no entries, and of several values the greatest is taken."""
    good = entries.filter((F.col("wrong") != "") & F.col("correct").isNotNull())
    return good.groupBy("wrong").agg(F.max("correct").alias("correct"))


class Leftmost:
    """Keys found from left to right, the longest at each place. The first two characters of a place say which lengths can
    be a key there, so a text costs one look-up per place whatever the number of keys."""

    def __init__(self, table: dict[str, str]):
        self.table = table
        lengths: dict[str, set[int]] = {}
        for key in table:
            lengths.setdefault(key[:2], set()).add(len(key))
        self.lengths = {start: sorted(n, reverse=True) for start, n in lengths.items()}

    def at(self, text: str, i: int) -> int:
        """Length of the longest key at ``i``, 0 without one."""
        for start in (text[i:i + 2], text[i]):
            for n in self.lengths.get(start, ()):
                if text[i:i + n] in self.table:
                    return n
        return 0

    def find(self, text: str) -> list[tuple[int, int, str]]:
        found = ((i, self.at(text, i)) for i in range(len(text)))
        return [(i, n, self.table[text[i:i + n]]) for i, n in found if n]

    def replace(self, text: str, earlier: dict[int, tuple[int, str]]) -> str:
        out, i, last = [], 0, 0
        while i < len(text):
            n, m = self.at(text, i), earlier[i][0] if i in earlier else 0
            if n or m:
                out += [text[last:i], self.table[text[i:i + n]] if n > m else earlier[i][1]]
                last = i = i + max(n, m)
            else:
                i += 1
        return "".join([*out, text[last:]])


FOUND = "array<struct<at: int, n: int, to: string>>"


def _block(part: DataFrame, kind: type):
    """The keys of a block, sent once and made ready once per worker."""
    table = part.sparkSession.sparkContext.broadcast({r.wrong: r.correct for r in part.collect()})
    ready: list = []

    def own():
        if not ready:
            ready.append(kind(table.value))
        return ready[0]

    return own


def _noting(part: DataFrame, kind: type):
    """UDF: what was found before, and the places of the keys of this block."""
    own = _block(part, kind)

    @F.pandas_udf(FOUND)
    def noted(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([[*(map(dict, f) if f is not None else ()), *(dict(zip(("at", "n", "to"), x)) for x in (own().find(t) if t else ()))] for t, f in zip(texts, found)])

    return noted


def _replacing(part: DataFrame, kind: type):
    own = _block(part, kind)

    def earlier(found) -> dict[int, tuple[int, str]]:
        best: dict[int, tuple[int, str]] = {}
        for x in found if found is not None else ():
            if x["n"] > best.get(x["at"], (0, ""))[0]:
                best[x["at"]] = (x["n"], x["to"])
        return best

    @F.pandas_udf(T.StringType())
    def done(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([own().replace(t, earlier(f)) if t else t for t, f in zip(texts, found)], dtype=object)

    return done


#: Rows whose texts and entries a task holds as Python objects at once.
SLICE_ROWS = 256
#: Neighbouring rows whose words meet the entries together are two to the power of this.
PAGE_BITS = 10


def _words(held: DataFrame, text: str, pattern: str) -> DataFrame:
    """What ``pattern`` finds in the texts, once for every page of rows."""
    found = F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    return held.select(F.shiftright("_row", PAGE_BITS).alias("_page"), found.alias("wrong")).distinct()


def _swapped(held: DataFrame, used: DataFrame, table: DataFrame, text: str, own: str) -> DataFrame:
    """What ``own`` finds in the texts becomes its value in ``table`` (wrong, correct). Every page of rows is sent the entries that
    its texts hold (``used``) and no others, ahead of the texts, so a task needs no dictionary."""
    kept = [c for c in held.columns if c != "_row"]
    names = [f"_c{i}" for i in range(len(kept))]
    at = kept.index(text)
    none = lambda kind: F.lit(None).cast(kind)
    hits = used.join(table, "wrong").select("_page", "wrong", "correct", *[none(held.schema[c].dataType).alias(n) for c, n in zip(kept, names)])
    texts = held.select(F.shiftright("_row", PAGE_BITS).alias("_page"), none("string").alias("wrong"), none("string").alias("correct"),
                        *[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)])
    runs = re.compile(f"({own})")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, to = None, {}
        for batch in batches:
            pages, is_text = batch.column(0).to_numpy(), batch.column(1).is_null().to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((pages[1:] != pages[:-1]) | (is_text[1:] != is_text[:-1])) + 1 if len(pages) else pages
            for lo, hi in pairwise([0, *turns.tolist(), len(pages)]) if len(pages) else ():
                if pages[lo] != page:
                    page, to = pages[lo], {}
                if not is_text[lo]:
                    to.update(zip(*(batch.column(i).slice(lo, hi - lo).to_pylist() for i in (1, 2))))
                    continue
                for start in range(lo, hi, SLICE_ROWS):
                    part = batch.slice(start, min(SLICE_ROWS, hi - start))
                    done = []
                    for t in part.column(3 + at).to_numpy(zero_copy_only=False):
                        if t and to:
                            pieces = runs.split(t)
                            pieces[1::2] = [to.get(x, x) for x in pieces[1::2]]
                            t = "".join(pieces)
                        done.append(t)
                    yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()) if i == at else part.column(3 + i) for i in range(len(kept))], names=kept)

    parts = max(6 * held.sparkSession.sparkContext.defaultParallelism, int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = hits.unionByName(texts).repartition(parts, "_page").sortWithinPartitions("_page", F.col("wrong").isNull())
    return placed.mapInArrow(run, held.drop("_row").schema)


def replaced(df: DataFrame, entries: DataFrame, text: str, whole_words: bool, limit: int = BLOCK_CHARS) -> DataFrame:
    """Keys in the text become their values: the leftmost first, of several at a place the longest, and what is replaced is not
    looked at again. Rows and entries meet by a join on the words. Where keys may stand inside words, no key reaches over a
    character that is in none, so the runs of key characters take the place of the words: the distinct runs meet the entries in blocks.
    All blocks but the last note where their keys stand, with a written table between them; the last one takes these places into account
    and replaces."""
    held = cut(df.withColumn("_row", F.monotonically_increasing_id()))
    table = unambiguous(entries)
    if whole_words:
        return _swapped(held, _words(held, text, V.WORD_TOKEN), table, text, V.WORD_TOKEN)
    letters = sorted(r.c for r in table.select(F.explode(F.split("wrong", "")).alias("c")).distinct().where("c <> ''").collect())
    if not letters:
        return held.drop("_row")
    pattern = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in letters) + "]+"
    used = cut(_words(held, text, pattern))
    runs = used.select("wrong").distinct()
    *first, last = blocks(table, "wrong", "correct", limit=limit)
    runs = runs.select("wrong", F.col("wrong").alias("correct"), F.lit(None).cast(FOUND).alias("_found"))
    for part in first:
        runs = cut(runs.withColumn("_found", _noting(part, Leftmost)("wrong", "_found")))
    runs = runs.select("wrong", _replacing(last, Leftmost)("correct", "_found").alias("correct"))
    return _swapped(held, used, cut(runs).where("wrong <> correct"), text, "[" + "".join(map(re.escape, letters)) + "]+")


def _holding(part: DataFrame, key: str, text: str):
    """For batches of keys and lower-cased texts one row per entry of the block of which a side occurs in the text."""
    rows = part.collect()
    table = part.sparkSession.sparkContext.broadcast(([r.origin for r in rows], [r.translation for r in rows], [(r.low, r.other) for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        origins, translations, lowered = table.value
        owners: dict[str, list[int]] = {}
        for i, sides in enumerate(lowered):
            for side in {x for x in sides if x}:
                owners.setdefault(side, []).append(i)
        automaton = ahocorasick.Automaton()
        for side, own in owners.items():
            automaton.add_word(side, tuple(own))
        automaton.make_automaton()
        columns = [pa.array(x, pa.string()) for x in (origins, translations)]
        for batch in batches if owners else ():
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts = part.column(text).to_numpy(zero_copy_only=False)
                found = [sorted({i for own in {x for _, x in automaton.iter(t)} for i in own}) if t else [] for t in texts]
                row = pa.array([n for n, f in enumerate(found) for _ in f], pa.int64())
                entry = pa.array([i for f in found for i in f], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(key).take(row), *(c.take(entry) for c in columns)], names=[key, "origin", "translation"])

    return run


def holding_entries(df: DataFrame, glossary: DataFrame, key: str, text: str, limit: int = BLOCK_CHARS) -> DataFrame:
    """key, origin and translation, once each, for every entry of which a side occurs in the lower-cased text. An entry is in one block,
    so only the rows of keys that come back need to be made distinct."""
    kind = df.schema[key].dataType.simpleString()
    entries = glossary.select("origin", "translation").distinct().withColumns({"low": F.lower("origin"), "other": F.lower("translation")})
    again = df.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).select(F.col(key).alias("_key"), F.lit(True).alias("_again"))
    marked = df.join(again, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, text, F.coalesce("_again", F.lit(False)).alias("_again"))
    once, often = [], []
    for part in blocks(entries, "origin", "translation", "low", "other", limit=limit):
        run = _holding(part, key, text)
        for rows, out in ((marked.where("NOT _again"), once), (marked.where("_again"), often)):
            out.append(rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, origin string, translation string"))
    return reduce(DataFrame.unionByName, once).unionByName(reduce(DataFrame.unionByName, often).distinct())


def _holds(part: DataFrame):
    table = part.sparkSession.sparkContext.broadcast([r.side for r in part.collect()])
    ready: list = []

    @F.pandas_udf("array<string>")
    def held(texts: pd.Series) -> pd.Series:
        if not table.value:
            return texts.map(lambda t: [])
        if not ready:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for side in table.value:
                automaton.add_word(side, side)
            automaton.make_automaton()
            ready.append(automaton)
        return texts.map(lambda t: sorted({side for _, side in ready[0].iter(t)}) if t else [])

    return held


def holding(df: DataFrame, sides: DataFrame, key: str, text: str, limit: int = BLOCK_CHARS) -> DataFrame:
    """key and side for every side of ``sides`` that occurs in the text: one pass over the texts per block of sides, with an
    automaton of the block."""
    each = [df.select(key, F.explode(_holds(part)(text)).alias("side")) for part in blocks(sides.select("side").distinct(), "side", limit=limit)]
    return reduce(DataFrame.unionByName, each)

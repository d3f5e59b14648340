"""Hard negatives by segment summary filtering.

A vector is cut into segments, halved from level to level; per segment its mean and its deviation are kept. Over a segment the
inner product of two vectors is the product of the means (times the length) plus or minus at most the product of the
deviations. A row is refined to finer segments only while these bounds leave it a place in the answer; what is left is scored
exactly. Rows are dealt to blocks of bounded size and anchors are streamed past every block: first for their positives, then,
with the positives' scores known, for the negatives.

Of rows that share a vec_id the one with the smallest label, then vector, counts. Rows without vec_id or label, and vectors that
are null or hold a null or non-finite component, take no part. Vectors are compared with those of their own length only. An
empty table, or one without anchors, gives no rows. Only the named columns are read, so other columns cannot clash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Numbers (rows times components) of a block.
NUMBERS = 1 << 20
#: Components of the finest segments, at least.
FINEST = 4
#: Sums below this are exact in floating point.
EXACT = 1 << 52


class Level:
    """Means (times the root of the length) and deviations of the segments of all rows, at one fineness."""

    def __init__(self, rows: np.ndarray, edges: np.ndarray):
        sizes = np.diff(edges)
        total = np.add.reduceat(rows, edges[:-1], axis=1)
        square = np.add.reduceat(rows * rows, edges[:-1], axis=1)
        self.mean = total / np.sqrt(sizes)
        self.deviation = np.sqrt(np.maximum(square - self.mean * self.mean, 0))

    def bounds(self, at: np.ndarray, query: Level) -> tuple[np.ndarray, np.ndarray]:
        middle = self.mean[at] @ query.mean[0]
        spread = self.deviation[at] @ query.deviation[0]
        return middle - spread, middle + spread


class Summaries:
    """Equally long integer rows with the summaries of their segments."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]
        self.edges = [np.arange(n + 1) * rows.shape[1] // n for n in self.parts(rows.shape[1])]
        self.levels = self.summarise(self.rows)
        self.longest = float(np.sqrt(np.square(self.rows.astype(np.float64)).sum(1).max()))
        self.scored = 0

    @staticmethod
    def parts(width: int) -> list[int]:
        """Numbers of segments from coarse to fine."""
        out = [1] if width else []
        while out and width // (2 * out[-1]) >= FINEST:
            out.append(2 * out[-1])
        return out

    def summarise(self, rows: np.ndarray) -> list[Level]:
        return [Level(rows.astype(np.float64), e) for e in self.edges]

    def refined(self, query: np.ndarray, at: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """Places out of ``at`` that no level rules out, and their exact scores. ``keep`` gets bounds and says which rows stay."""
        slack = 1e-9 * self.longest * float(np.sqrt(np.square(query.astype(np.float64)).sum())) + 1e-6
        for level, own in zip(self.levels, self.summarise(query[None])):
            if not len(at):
                break
            low, high = level.bounds(at, own)
            at = at[keep(low - slack, high + slack)]
        self.scored += len(at)
        return at, self.rows[at] @ query

    def nearest(self, query: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of the places ``at`` and their scores; ties to the smaller id."""

        def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            return high >= _kth(low, k)

        return _best(*self.refined(query, at, keep), k)

    def below(self, query: np.ndarray, at: np.ndarray, tops: list[int], k: int, least: int, whole: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each score of ``tops`` the k best of the places ``at`` with least * top <= whole * score <= whole * top."""

        def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            stays = np.zeros(len(low), dtype=bool)
            for top in tops:
                floor = max(least * top / whole - 1e-6, _kth(low[high <= top], k))
                stays |= (low <= top) & (high >= floor)
            return stays

        left, score = self.refined(query, at, keep)
        out = []
        for top in tops:
            fits = (whole * score <= whole * top) & (whole * score >= least * top)
            out.append(_best(left[fits], score[fits], k))
        return out


def _kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def _best(at: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((at, -score))[:k]  # places are in the order of ids
    return at[order], score[order]


def usable(vectors: DataFrame, vector: str = "embedding", label: Column | str = "label", scale: int = 256) -> DataFrame:
    """vec_id, label and row (floor(scale * x) of every component) of the rows that take part, one per vec_id."""
    x = F.transform(vector, lambda e: e.cast("double"))
    fine = F.forall("_x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    label = F.col(label) if isinstance(label, str) else label
    known = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("_x"))
    known = known.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("_x").isNotNull() & fine)
    rows = known.select("vec_id", F.struct("label", F.transform("_x", lambda e: F.floor(e * scale).cast("long")).alias("row")).alias("r"))
    return rows.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.row")


def _past_blocks(rows: DataFrame, anchors: DataFrame, blocks: int, kind: type, schema: str, ask) -> DataFrame:
    """Streams ``anchors`` (vec_id, label, row, tops) past every block of ``rows``. ``ask(summaries, id, label, row, tops)`` yields
    output tuples."""
    names = [part.split()[0] for part in schema.split(", ")]
    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "vec_id", "label", "row",
                        F.lit(None).cast("array<long>").alias("tops"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "vec_id", "label", "row", "tops")
    stream = dealt.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, grown = None, [], {}
        for batch in batches:
            block, asks, ids, labels = (batch.column(i).to_numpy() for i in range(4))
            lists, tops = batch.column(4), batch.column(5)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            found: list[tuple] = []
            for i in range(len(ids)):
                if block[i] != current:
                    current, held, grown = block[i], [], {}
                row = values[offsets[i]:offsets[i + 1]].astype(kind)
                if not asks[i]:
                    held.append((ids[i], labels[i], row))
                    continue
                if held:
                    for n in {len(r) for _, _, r in held}:
                        own = [h for h in held if len(h[2]) == n]
                        told = [np.array([h[j] for h in own], dtype=np.int64) for j in range(2)]
                        grown[n] = Summaries(*told, np.array([h[2] for h in own]).reshape(len(own), n))
                    held = []
                if len(row) in grown:
                    found.extend(ask(grown[len(row)], int(ids[i]), int(labels[i]), row, tops[i].as_py()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=names)

    return stream.mapInArrow(run, schema)


def _first(df: DataFrame, keys: list[str], ident: str, score: str, k: int) -> DataFrame:
    turn = Window.partitionBy(*keys).orderBy(F.desc(score), ident)
    return df.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, least: int = 80, whole: int = 100, numbers: int = NUMBERS) -> DataFrame:
    """Hard negatives for the rows of ``rows`` (vec_id, label, row from ``usable``) where ``anchors`` holds.

    An anchor's positives are its ``positives`` best other rows of its label by integer inner product. Per anchor and positive the
    ``negatives`` best rows of other labels are returned whose score is at least least/whole of the positive's and not above it:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Ties go to the smaller vec_id."""
    rows = written(rows, "vectors")
    square = lambda s, e: s + e.cast("double") * e
    shape = rows.agg(F.sum(F.size("row")).alias("numbers"), F.max(F.aggregate("row", F.lit(0).cast("double"), square)).alias("longest")).first()
    blocks = max(1, -(-(shape["numbers"] or 0) // numbers))
    kind = np.float64 if (shape["longest"] or 0) * whole < EXACT else np.int64
    asking = rows.where(anchors).withColumn("tops", F.array().cast("array<long>"))

    def same(block: Summaries, ident: int, label: int, row: np.ndarray, tops: list[int]) -> Iterator[tuple]:
        at = np.flatnonzero((block.labels == label) & (block.ids != ident))
        for i, score in zip(*block.nearest(row, at, positives)):
            yield ident, int(block.ids[i]), int(score)

    def other(block: Summaries, ident: int, label: int, row: np.ndarray, tops: list[int]) -> Iterator[tuple]:
        at = np.flatnonzero(block.labels != label)
        for top, (places, scores) in zip(tops, block.below(row, at, tops, negatives, least, whole)):
            for i, score in zip(places, scores):
                yield ident, top, int(block.ids[i]), int(score)

    near = _past_blocks(rows, asking, blocks, kind, "anchor_id long, positive_id long, positive_score long", same)
    near = written(_first(near, ["anchor_id"], "positive_id", "positive_score", positives), "positives")
    tops = near.groupBy("anchor_id").agg(F.collect_set("positive_score").alias("tops"))
    asking = asking.drop("tops").join(tops, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    far = _past_blocks(rows, asking, blocks, kind, "anchor_id long, positive_score long, negative_id long, negative_score long", other)
    far = _first(far, ["anchor_id", "positive_score"], "negative_id", "negative_score", negatives)
    out = near.drop("rank").join(far, ["anchor_id", "positive_score"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

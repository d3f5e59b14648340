"""Exact top-k by inner product with M-trees.

Vectors are turned into integers and get one more component that makes all of them equally long, so the largest inner product
is the least distance. Rows are dealt to trees of bounded size. A tree is made of paged nodes: every entry stores its covering
radius and its distance to the parent's pivot. Search opens pages best first; the triangle inequality on the stored distances
rules entries out before any distance is computed. Queries are streamed past each tree, and the best of all trees are merged."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Entries of a page, and numbers (rows times components) of a tree.
PAGE, TREE_NUMBERS = 256, 1 << 19
#: Sums below this are exact in floating point.
EXACT = 1 << 52


class Page:
    """A node. Entries are points (leaf) or child pages with pivots; ``parent`` holds the distances to this page's pivot."""

    __slots__ = ("at", "radius", "parent", "children")

    def __init__(self, at: np.ndarray, parent: np.ndarray, radius: np.ndarray, children: list[Page] | None):
        self.at, self.parent, self.radius, self.children = at, parent, radius, children


class Tree:
    """An M-tree over integer rows. ``longest`` is a bound on their squared length."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, longest: float, page: int = PAGE):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows, self.longest, self.page = ids[order], rows[order], longest, page
        own = np.einsum("ij,ij->i", self.rows, self.rows)
        self.points = np.concatenate((self.rows, np.sqrt(np.maximum(longest - own, 0))[:, None]), axis=1).astype(np.float64)
        self.slack = 1e-6 * max(1.0, np.sqrt(longest))
        self.opened = self.measured = 0
        self.root = self._build(np.arange(len(ids)), 0) if len(ids) else None

    def _apart(self, at: np.ndarray, pivot: int) -> np.ndarray:
        step = self.points[at] - self.points[pivot]
        return np.sqrt(np.einsum("ij,ij->i", step, step))

    def _build(self, at: np.ndarray, pivot: int) -> Page:
        parent = self._apart(at, pivot)
        if len(at) <= self.page:
            return Page(at, parent, np.zeros(len(at)), None)
        fan = min(self.page, -(-len(at) // (self.page // 2)))
        pivots = at[np.linspace(0, len(at) - 1, fan).astype(int)]
        dots = self.points[at] @ self.points[pivots].T
        own = np.einsum("ij,ij->i", self.points[pivots], self.points[pivots])
        nearest = (own - 2 * dots).argmin(1)
        groups = [(p, at[nearest == i]) for i, p in enumerate(pivots) if (nearest == i).any()]
        if max(len(g) for _, g in groups) > 0.9 * len(at):  # equal or nearly equal points: even pieces
            groups = [(g[0], g) for g in np.array_split(at, fan)]
        heads = np.array([p for p, _ in groups])
        radius = np.array([self._apart(g, p).max() for p, g in groups])
        return Page(heads, self._apart(heads, pivot), radius, [self._build(g, p) for p, g in groups])

    def search(self, query: np.ndarray, skip: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (ids, scores) but for id ``skip``; ties go to the smaller id."""
        best_ids, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=self.rows.dtype)
        if self.root is None:
            return best_ids, best
        wide = np.append(query.astype(np.float64), 0.0)
        square = float(wide @ wide) + self.longest
        reach = np.inf
        tie = 0
        first = float(np.linalg.norm(wide - self.points[0]))
        heap = [(0.0, tie, first, self.root)]
        while heap:
            low, _, from_pivot, page = heapq.heappop(heap)
            if low > reach:
                break
            self.opened += 1
            near = np.flatnonzero(np.abs(from_pivot - page.parent) - page.radius <= reach)
            at = page.at[near]
            self.measured += len(at)
            if page.children is None:
                score = self.rows[at] @ query
                if len(best) >= k:
                    good = score >= best[-1]
                    at, score = at[good], score[good]
                ids = self.ids[at]
                if len(ids):
                    other = ids != skip
                    best_ids, best = np.concatenate((best_ids, ids[other])), np.concatenate((best, score[other]))
                    order = np.lexsort((best_ids, -best))[:k]
                    best_ids, best = best_ids[order], best[order]
                    if len(best) >= k:
                        reach = np.sqrt(max(square - 2.0 * float(best[-1]), 0.0)) * (1 + 1e-9) + self.slack
                continue
            away = np.sqrt(np.maximum(square - 2.0 * (self.points[at] @ wide), 0.0))
            floor = np.maximum(away - page.radius[near], low) - self.slack
            for i in np.flatnonzero(floor <= reach):
                tie += 1
                heapq.heappush(heap, (float(max(floor[i], 0.0)), tie, float(away[i]), page.children[near[i]]))
        return best_ids, best


def integers(vectors: DataFrame, vector: str = "embedding", scale: int = 64) -> DataFrame:
    """vec_id and row: floor(scale * x) of every component. Rows without an id, and vectors that are null or hold a null or
    non-finite component, are left out."""
    x = F.transform(vector, lambda e: e.cast("double"))
    fine = F.forall("_x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return vectors.where("vec_id IS NOT NULL").select("vec_id", x.alias("_x")).where(F.col("_x").isNotNull() & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("_x", lambda e: F.floor(e * scale).cast("long")).alias("row"))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20, page: int = PAGE, numbers: int = TREE_NUMBERS) -> DataFrame:
    """Per query its k best rows by integer inner product: query_id, rank (from 1), vec_id, score; ties to the smaller vec_id.

    Both sides have vec_id and row (from ``integers``). A query id that occurs repeatedly asks once, with the smallest of its
    vectors; a candidate that occurs repeatedly is returned as often. A row with the query's own id is no candidate. Vectors are compared
    with those of their own length only. Equal rows and many ties are all considered. ``numbers`` bounds a tree's memory."""
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("row")).alias("width"),
                     F.max(F.aggregate("row", F.lit(0).cast("double"), lambda s, e: s + e.cast("double") * e)).alias("longest")).first()
    width, longest = max(shape["width"] or 1, 1), float(shape["longest"] or 0)
    trees = max(1, -(-shape["n"] * width // numbers))
    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(trees)).cast("int").alias("tree"), F.lit(0).alias("asks"), "vec_id", "row")
    queries = queries.groupBy("vec_id").agg(F.min("row").alias("row"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(1).alias("asks"), "vec_id", "row")
    stream = dealt.unionByName(asked).repartition(trees, "tree").sortWithinPartitions("tree", "asks")
    names = ["query_id", "vec_id", "score"]
    kind = np.float64 if longest < EXACT else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, grown = None, [], None
        for batch in batches:
            tree, asks, ids = (batch.column(i).to_numpy() for i in range(3))
            lists = batch.column(3)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            found: list[tuple] = []
            for i in range(len(ids)):
                if tree[i] != current:
                    current, held, grown = tree[i], [], None
                row = values[offsets[i]:offsets[i + 1]].astype(kind)
                if not asks[i]:
                    held.append((ids[i], row))
                    continue
                if grown is None:
                    grown = {}
                    for n in {len(r) for _, r in held}:
                        own = [(h, r) for h, r in held if len(r) == n]
                        grown[n] = Tree(np.array([h for h, _ in own], dtype=np.int64), np.array([r for _, r in own]).reshape(len(own), n), longest, page)
                    held = []
                if len(row) in grown:
                    best_ids, best = grown[len(row)].search(row, ids[i], k)
                    found.append((np.full(len(best), ids[i], dtype=np.int64), best_ids, best.astype(np.int64)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=names)

    each = stream.mapInArrow(run, "query_id long, vec_id long, score long")
    turn = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

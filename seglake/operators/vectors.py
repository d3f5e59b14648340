"""Exact top-k by cosine similarity.

All-pairs scoring is avoided with pivots, whose number grows with the corpus up to a bound: every corpus vector joins the cell
of its nearest pivot, and cells are cut into pieces of a fixed number of rows. A query first meets one piece of its nearest
cell. The k-th score found there, and the radii of the cells, bound how far away its k nearest vectors can be; by the triangle
inequality it then needs only the cells within that bound. Pieces lie in few large blocks, and a query travels once to a block
that holds any piece it needs, with one bit per piece; so what is shuffled follows the number of blocks, not that of pieces.
Inside a piece, scores are a matrix product."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Fewest and most pivots, and the rows of the corpus for which there is one. Pivots and cell sizes travel to all tasks.
PIVOTS, MOST_PIVOTS, ROWS_PER_PIVOT = 64, 4096, 1024
PIECE_ROWS = 4096
EPS = 1e-5
#: Numbers of a table of rows and pivots that a task holds at once, and routed rows that it hands back at once.
TABLE_NUMBERS, ROUTED_ROWS = 1 << 18, 8192
#: Numbers of a block at most, queries scored at once, and finds after which only the best are held.
BLOCK_NUMBERS, QUERIES, FINDS = 1 << 23, 512, 1 << 16


def _slices(batches, pivots: np.ndarray):
    """The rows of the batches in slices whose table with all pivots is bounded."""
    rows = max(1, TABLE_NUMBERS // max(1, len(pivots)))
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at:at + rows]


def unit(column: str):
    norm = F.sqrt(F.aggregate(F.transform(F.col(column), lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    # named by the outer transform, so that it is computed once and not for every component
    return F.transform(F.array(norm), lambda n: F.transform(F.col(column), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))[0]


class Cells:
    """The corpus dealt to cells: ``placed`` (vec_id, v, cell, dist), and per cell its pivot, size, radius and pieces."""

    def __init__(self, corpus: DataFrame):
        n = min(MOST_PIVOTS, max(PIVOTS, corpus.count() // ROWS_PER_PIVOT))
        # the rows with the smallest id hashes
        self.pivots = pivots = np.array([r["v"] for r in corpus.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).collect()])

        def place(batches):
            for pdf in _slices(batches, pivots):
                d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.stack(pdf["v"].to_numpy()) @ pivots.T))
                cell = d.argmin(axis=1)
                yield pdf.assign(cell=cell.astype("int64"), dist=d[np.arange(len(pdf)), cell])

        self.placed = corpus.mapInPandas(place, "vec_id long, v array<double>, cell long, dist double")
        stats = sorted(tuple(r) for r in self.placed.groupBy("cell").agg(F.count(F.lit(1)), F.max("dist")).collect()) if len(pivots) else []
        self.cells, self.sizes, self.radius = (np.array(x) for x in zip(*stats)) if stats else (np.array([], dtype=int),) * 3
        self.pieces = np.maximum(1, -(-self.sizes // PIECE_ROWS))
        self.pivots = pivots[self.cells] if stats else pivots
        # pieces are numbered through all cells; a block begins with the piece of its edge
        self.starts = np.cumsum(self.pieces) - self.pieces
        rows, tasks = int(self.sizes.sum()), 2 * corpus.sparkSession.sparkContext.defaultParallelism
        width = pivots.shape[1] if len(pivots) else 0
        blocks = max(round(tasks ** 0.5), -(-rows * width // BLOCK_NUMBERS))
        each = np.repeat(self.sizes / self.pieces, self.pieces)  # rows of a piece, about
        self.edges = np.flatnonzero(np.diff((np.cumsum(each) - each) // max(1, -(-rows // blocks)), prepend=-1))
        self.slices = -(-tasks // max(1, len(self.edges)))

    def held(self) -> DataFrame:
        counts = F.element_at(F.create_map(*[F.lit(x) for pair in zip(self.cells.tolist(), self.pieces.tolist()) for x in pair]), F.col("cell"))
        return self.placed.select("cell", F.pmod(F.xxhash64("vec_id"), counts).alias("piece"), F.lit(0).alias("asks"), F.col("vec_id").alias("id"), "v")

    def first(self, queries: DataFrame) -> DataFrame:
        """Each query with one piece of its nearest cell."""
        pivots, cells, pieces = self.pivots, self.cells, self.pieces

        def route(batches):
            for pdf in _slices(batches, pivots):
                near = (np.stack(pdf["v"].to_numpy()) @ pivots.T).argmax(axis=1)
                yield pdf[["query_id", "v"]].assign(cell=cells[near].astype("int64"), piece=(pdf["query_id"].to_numpy() % pieces[near]).astype("int64"))

        return queries.mapInPandas(route, ROUTED)

    def dealt(self) -> DataFrame:
        """The pieces in their blocks, once for every slice of the queries."""
        starts = F.element_at(F.create_map(*[F.lit(x) for pair in zip(self.cells.tolist(), self.starts.tolist()) for x in pair]), F.col("cell"))
        copies = F.explode(F.sequence(F.lit(0), F.lit(self.slices - 1))).alias("copy")
        held = self.held().select((starts + F.col("piece")).cast("int").alias("place"), "id", "v", copies)
        block = sum([(F.col("place") >= e).cast("int") for e in self.edges.tolist()[1:]], F.lit(0))
        slot = block * self.slices + F.col("copy")
        return held.select(slot.alias("slot"), F.lit(0).alias("asks"), "place", "id", "v", F.lit(None).cast("double").alias("least"), F.lit(None).cast("binary").alias("wants"))

    def others(self, queries: DataFrame, need: int) -> DataFrame:
        """Each query with the blocks that hold pieces in reach but the one it met, and these pieces as bits. ``reach`` is the
        distance of the k-th vector found there."""
        pivots, cells, sizes, radius, pieces, starts = self.pivots, self.cells, self.sizes, self.radius, self.pieces, self.starts
        edges = np.append(self.edges, pieces.sum())

        def route(batches):
            for pdf in _slices(batches, pivots):
                v, ident = np.stack(pdf["v"].to_numpy()), pdf["query_id"].to_numpy()
                dots = v @ pivots.T
                near, d = dots.argmax(axis=1), np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots))
                high, low = d + radius, d - radius
                order = high.argsort(axis=1)
                enough = np.minimum((sizes[order].cumsum(axis=1) < need).sum(axis=1), len(cells) - 1)
                bound = np.take_along_axis(high, order, axis=1)[np.arange(len(pdf)), enough]
                reach = pdf["reach"].fillna(np.inf).to_numpy()
                bound = np.minimum(bound, reach)
                wants = np.repeat(low <= (bound + EPS)[:, None], pieces, axis=1)
                wants[np.arange(len(pdf)), starts[near] + ident % pieces[near]] = False
                least, vectors = 1.0 - reach * reach / 2 - 1e-6, pdf["v"].to_numpy()
                for block, (lo, hi) in enumerate(zip(edges, edges[1:])):
                    who = np.flatnonzero(wants[:, lo:hi].any(axis=1))
                    for at in range(0, len(who), ROUTED_ROWS):
                        w = who[at:at + ROUTED_ROWS]
                        bits = np.packbits(wants[w, lo:hi], axis=1)
                        yield pd.DataFrame({"query_id": ident[w], "v": vectors[w], "block": np.int32(block), "least": least[w], "wants": [x.tobytes() for x in bits]})

        return queries.mapInPandas(route, "query_id long, v array<double>, block int, least double, wants binary")

    def scored(self, routed: DataFrame, k: int, exclude_self: bool) -> DataFrame:
        """The k best rows of every block among the wanted pieces, for every query that is sent to it; the queries of a slice stream
        past the block."""
        slices, edges = self.slices, np.append(self.edges, self.pieces.sum())
        slot = F.col("block") * slices + F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int")
        asked = routed.select(slot.alias("slot"), F.lit(1).alias("asks"), F.lit(0).alias("place"), F.col("query_id").alias("id"), "v", "least", "wants")
        stream = self.dealt().unionByName(asked).repartitionById(slices * len(self.edges), F.col("slot")).sortWithinPartitions("slot", "asks", "place")

        def best_of(part: pd.DataFrame, place: np.ndarray, bounds: np.ndarray, ids: np.ndarray, matrix: np.ndarray) -> pd.DataFrame:
            v, qid, least = np.stack(part["v"].to_numpy()), part["id"].to_numpy(), part["least"].to_numpy().copy()
            wants = np.unpackbits(np.stack([np.frombuffer(x, dtype=np.uint8) for x in part["wants"]]), axis=1)
            best, more, n = _nothing(), [], 0

            def settled(best, more):
                best = _top(*[np.concatenate(x) for x in zip(best, *more)], k)
                full = np.flatnonzero(np.bincount(best[0], minlength=len(qid)) == k)
                kth = best[2][np.searchsorted(best[0], full, "right") - 1]
                least[full] = np.maximum(least[full], kth)
                return best

            for lo, hi in zip(bounds, bounds[1:]):
                rows = np.flatnonzero(wants[:, place[lo]])
                if not len(rows):
                    continue
                s = v[rows] @ matrix[lo:hi].T
                r, c = np.nonzero(s >= (least[rows] - 1e-6)[:, None])  # before rounding
                who, found, score = rows[r], ids[lo + c], np.round(s[r, c], 6)
                fits = score >= least[who]
                if exclude_self:
                    fits &= found != qid[who]
                more.append((who[fits], found[fits], score[fits]))
                n += len(more[-1][0])
                if n > FINDS:
                    best, more, n = settled(best, more), [], 0
            who, found, score = settled(best, more)
            return pd.DataFrame({"query_id": qid[who], "vec_id": found, "score": score})

        def score(batches):
            here, rows, block = None, [], None
            for pdf in batches:
                out = [NOTHING]
                for key, part in pdf.groupby("slot", sort=False):
                    if key != here:
                        here, rows, block = key, [], None
                    own = part[part["asks"] == 0]
                    if len(own):
                        rows.append((own["place"].to_numpy() - edges[key // slices], own["id"].to_numpy(), np.stack(own["v"].to_numpy())))
                    asks = part[part["asks"] == 1]
                    if len(asks) and rows:
                        place, ids, matrix = (np.concatenate(x) for x in zip(*rows))
                        block, rows = (place, np.append(np.flatnonzero(np.diff(place, prepend=-1)), len(place)), ids, matrix), []
                    if len(asks) and block:
                        out += [best_of(asks.iloc[at:at + QUERIES], *block) for at in range(0, len(asks), QUERIES)]
                yield pd.concat(out)

        return stream.mapInPandas(score, FOUND)


ROUTED = "query_id long, v array<double>, cell long, piece long"
FOUND = "query_id long, vec_id long, score double"
NOTHING = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def _nothing() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)


def _top(who: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best finds of each query, in order; ties go to the smaller id."""
    order = np.lexsort((ids, -scores, who))
    sorted_who = who[order]
    order = order[np.arange(len(order)) - np.searchsorted(sorted_who, sorted_who) < k]
    return who[order], ids[order], scores[order]


def _scored(held: DataFrame, routed: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """The k best rows of every piece for every query that is sent to it; the queries stream past the piece."""
    asked = routed.select("cell", "piece", F.lit(1).alias("asks"), F.col("query_id").alias("id"), "v")
    stream = held.unionByName(asked).repartition("cell", "piece").sortWithinPartitions("cell", "piece", "asks")

    def best_of(part: pd.DataFrame, ids: np.ndarray, matrix: np.ndarray) -> pd.DataFrame:
        s = np.round(np.stack(part["v"].to_numpy()) @ matrix.T, 6)
        qid = part["id"].to_numpy()
        if exclude_self:
            s[qid[:, None] == ids[None, :]] = -np.inf
        kth = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(qid), -np.inf)
        r, c = np.nonzero((s >= kth[:, None]) & np.isfinite(s))
        who, found, score = _top(r, ids[c], s[r, c], k)
        return pd.DataFrame({"query_id": qid[who], "vec_id": found, "score": score})

    def score(batches):
        here, ids, rows, matrix = None, [], [], None
        for pdf in batches:
            out = [NOTHING]
            for key, part in pdf.groupby(["cell", "piece"], sort=False):
                if key != here:
                    here, ids, rows, matrix = key, [], [], None
                own = part[part["asks"] == 0]
                if len(own):
                    ids.append(own["id"].to_numpy())
                    rows.append(np.stack(own["v"].to_numpy()))
                asks = part[part["asks"] == 1]
                if len(asks) and ids:
                    if matrix is None:
                        ids, matrix = [np.concatenate(ids)], np.concatenate(rows)
                    out += [best_of(asks.iloc[at:at + QUERIES], ids[0], matrix) for at in range(0, len(asks), QUERIES)]
            yield pd.concat(out)

    return stream.mapInPandas(score, FOUND)


def similar_examples(queries: DataFrame, corpus: DataFrame, k: int = 3, exclude_self: bool = True) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best corpus rows per query. Both
    sides have ``vec_id`` and ``embedding``; ties go to the smaller vec_id."""
    q = queries.select(F.col("vec_id").alias("query_id"), unit("embedding").alias("v"))
    own = Cells(corpus.select("vec_id", unit("embedding").alias("v")))
    if not len(own.cells):
        return q.select("query_id", F.lit(None).cast("bigint").alias("vec_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank")).limit(0)
    near = cut(_scored(own.held(), own.first(q), k, exclude_self))
    # scores are rounded, so the k-th vector may be a little farther away
    far = F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * (F.min("score") - 1e-6)))
    reach = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, far).alias("reach"))
    rest = own.others(q.join(reach, "query_id", "left"), k + (1 if exclude_self else 0))
    best = near.unionByName(own.scored(rest, k, exclude_self))
    turn = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(turn)).filter(F.col("rank") <= k)


def example_lines(hits: DataFrame, payloads: DataFrame) -> DataFrame:
    """``source : target`` per query in score order. Payloads are JSON, flat or
    under ``metadata``; hits without both sides are skipped."""
    p = payloads.select(
        "vec_id", F.coalesce(F.get_json_object("payload", "$.metadata.source"), F.get_json_object("payload", "$.source"), F.lit("")).alias("source"),
        F.coalesce(F.get_json_object("payload", "$.metadata.target"), F.get_json_object("payload", "$.target"), F.lit("")).alias("target"))
    j = hits.join(p, "vec_id").filter("source <> '' and target <> ''")
    g = j.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "target"))).alias("a"))
    return g.select("query_id", F.array_join(F.transform("a", lambda x: F.concat(x["source"], F.lit(" : "), x["target"])), "\n").alias("examples"))

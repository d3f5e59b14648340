"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits link at four or fewer differing bits. They are cut into three segments: four differences over three
segments leave one segment with at most one. Every fingerprint is indexed under each segment with one bit wildcarded, so two
segments that differ in at most one bit meet under an equal key. An equality join finds the pairs and the join condition
verifies them. Exact copies are one fingerprint before any pair is formed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from .common import append_columns, spans, written

SEED = 42
WORDS = 4
DISTANCE = 4
#: First bit and length of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None) -> list[int]:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if len(words) <= WORDS:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    start, starts = 0, []
    for word in words:
        starts.append(start)
        start += len(word) + 1
    hashed = xxhash.xxh64_intdigest
    ends = [s - 1 for s in starts[WORDS:]]
    ends.append(len(joined))
    return [hashed(joined[a:b], SEED) for a, b in zip(starts, ends)]


def majorities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per group of consecutive hashes the bits set in over half of them. Eight byte lanes of a word are counted at once
    over runs short enough for a byte; the runs are then added up."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    live = np.flatnonzero(sizes)
    if not len(live):
        return out
    n = sizes[live]
    first = np.cumsum(n) - n
    runs = -(-n // 255)
    owner = np.repeat(np.arange(len(live)), runs)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    cuts = first[owner] + 255 * number
    begins = np.cumsum(runs) - runs
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & LANES, cuts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), begins, axis=0)
        most = (2 * counts > n[:, None]).astype(np.uint8)
        out[live] |= most.view("<u8").ravel() << np.uint64(bit)
    return out


def fingerprints(texts: list[str | None]) -> np.ndarray:
    out = np.zeros(len(texts), dtype=np.uint64)
    for lo, hi in spans([len(t or "") for t in texts], 300_000):
        groups = [shingle_hashes(t) for t in texts[lo:hi]]
        sizes = np.array([len(g) for g in groups])
        flat = np.fromiter((h for g in groups for h in g), dtype=np.uint64, count=int(sizes.sum()))
        out[lo:hi] = majorities(flat, sizes)
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """Adds the fingerprint as a signed long. Null and blank texts have no words and get 0."""

    def kernel():
        return lambda column: [pa.array(fingerprints(column.to_pylist()).view(np.int64), pa.int64())]

    return append_columns(docs, [text], [(name, LongType())], kernel)


def variants(fps: DataFrame) -> DataFrame:
    """One row per fingerprint, segment and wildcarded bit: key holds the segment's other bits in their places, and wild
    (0 to 63) says which bit is open and by that which segment is meant."""
    masks = [((1 << n) - 1) << first for first, n in SEGMENTS for _ in range(n)]
    signed = [m & ~(1 << i) for i, m in enumerate(masks)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in signed]
    wild = F.posexplode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("wild", "mask")
    return fps.select("fp", wild).select("fp", "wild", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a < b) of distinct fingerprints at ``distance`` (at most 4) or fewer differing bits, each once.

    ``fps`` holds distinct fingerprints. A pair meets under several keys; it is kept only in the first segment that differs in
    at most one bit, under the differing bit, or under the segment's first bit if it is equal."""
    one = variants(fps)
    a, b = one.select(F.col("fp").alias("a"), "wild", "key"), one.select(F.col("fp").alias("b"), "wild", "key")
    differing = F.col("a").bitwiseXOR(F.col("b"))

    def within(first: int, n: int):
        mask = ((1 << n) - 1) << first
        return F.bit_count(differing.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast("long")))

    def here(first: int, n: int):
        bit = F.getbit(differing, F.col("wild"))
        return F.col("wild").between(first, first + n - 1) & ((bit == 1) | ((within(first, n) == 0) & (F.col("wild") == first)))

    # Under a common key at most the open bit differs, so the segment itself needs no further test.
    earlier = F.lit(False)
    agreed = F.lit(False)
    for first, n in SEGMENTS:
        agreed = agreed | (here(first, n) & ~earlier)
        earlier = earlier | (within(first, n) <= 1)
    # Spark sizes the 64 rows of a fingerprint as one and would send them all to the driver as a table to broadcast.
    met = a.join(b.hint("merge"), ["wild", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(differing) <= distance) & agreed)
    return met.select("a", "b")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node that can be reached.

    Large and small stars in turn: nodes point to the least of their neighbours until nothing moves. Each round is a written
    table; only its row count and checksum reach the driver."""
    stars = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "stars")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    now = state(stars)
    for _ in range(rounds):
        if not now[0]:
            break
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = written(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        stars = written(small.where("u > v").distinct(), "stars")
        before, now = now, state(stars)
        if before == now:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def roots_of(prints: DataFrame, distance: int = DISTANCE) -> tuple[DataFrame, DataFrame]:
    """Links between distinct fingerprints of ``prints`` (doc_id, fp), and per linked fingerprint its component's root."""
    found = written(links(prints.select("fp").distinct(), distance), "links")
    return found, components(found)


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that can be
    reached, itself included) and n_links (other fingerprints within ``distance``).

    Null and blank texts share fingerprint zero. Repeated rows are returned as often as they come. A null doc_id is passed
    over by the minimum: component_id is null only where all ids of the component are."""
    prints = written(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fp"), "prints")
    found, roots = roots_of(prints, distance)
    degree = found.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    own = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    placed = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").join(degree, "fp", "left")
    placed = placed.withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = placed.join(least, "root").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return prints.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row of ``docs`` per component: the smallest doc_id (null ids last, then the smaller fingerprint). Of repeated
    rows one stays. All columns are returned as they are."""
    printed = with_fingerprint(docs, name="_simhash_fp")
    prints = written(printed.select("doc_id", F.col("_simhash_fp").alias("fp")), "prints")
    _, roots = roots_of(prints, distance)
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "fp")
    own = prints.groupBy("fp").agg(F.min(order).alias("first"))
    placed = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    chosen = placed.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    chosen = chosen.select(F.struct("first.doc_id", "first.fp").alias("_simhash_key"))
    keyed = printed.withColumn("_simhash_key", F.struct("doc_id", F.col("_simhash_fp").alias("fp")))
    met = keyed.join(chosen, "_simhash_key", "left_semi")  # structs are equal also where a field is null in both
    turn = Window.partitionBy("_simhash_key").orderBy(F.xxhash64("text"))
    return met.withColumn("_simhash_turn", F.row_number().over(turn)).where("_simhash_turn = 1").select(*[f"`{c}`" for c in docs.columns])

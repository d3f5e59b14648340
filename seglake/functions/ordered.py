"""Ordered computations that do not need a whole session in one task.

A plain ``Window.partitionBy(session)`` puts every row of a session into one
task, and one session may hold a third of a table. The helpers here split each
session into blocks of consecutive rows instead:

``scan``       unbounded look-back (running sums, previous value, last known
               value ...). Each block is computed alone, one summary row per
               block is carried along the session, and the carry is joined back.
``with_halo``  bounded look-around (n-grams, next word, last 40 words ...). Rows
               near a block edge are copied into the neighbouring block, so that
               one shuffle and a block-local window are enough.

``block`` is any integer column that never decreases along the order, such as
``seq div 65536`` for dense sequence numbers or ``ts_ms div 3600000`` for times.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536
BLOCK_MS = 3_600_000


def rows_block(seq: str, rows: int = BLOCK_ROWS) -> Column:
    return F.floor(F.col(seq) / F.lit(rows))


def time_block(ms: str, width: int = BLOCK_MS) -> Column:
    return F.floor(F.col(ms) / F.lit(width))


@dataclass(frozen=True)
class Scan:
    """One ordered computation over ``value``."""

    kind: str
    value: Column
    default: object = None


def prev(value: Column | str, default=None) -> Scan:
    """Value of the row before."""
    return Scan("prev", _col(value), default)


def following(value: Column | str, default=None) -> Scan:
    """Value of the row after."""
    return Scan("next", _col(value), default)


def running_sum(value: Column | str) -> Scan:
    return Scan("sum", _col(value))


def running_max(value: Column | str) -> Scan:
    return Scan("max", _col(value))


def max_before(value: Column | str) -> Scan:
    """Largest value of the earlier rows."""
    return Scan("max_before", _col(value))


def row_no() -> Scan:
    """1-based position along the order."""
    return Scan("sum", F.lit(1).cast("bigint"))


def last_known(value: Column | str) -> Scan:
    """Latest non-null value up to and including this row."""
    return Scan("ffill", _col(value))


def before_known(value: Column | str) -> Scan:
    """Latest non-null value of an earlier row."""
    return Scan("ffill_before", _col(value))


def next_known(value: Column | str) -> Scan:
    """Earliest non-null value of a later row."""
    return Scan("bfill_after", _col(value))


def whole_sum(value: Column | str) -> Scan:
    return Scan("whole_sum", _col(value))


def whole_max(value: Column | str) -> Scan:
    return Scan("whole_max", _col(value))


def whole_min(value: Column | str) -> Scan:
    return Scan("whole_min", _col(value))


def first_of(value: Column | str) -> Scan:
    """Earliest non-null value of the whole session, on every row."""
    return Scan("whole_first", _col(value))


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def shared(df: DataFrame, *by: str, parts: int = 0) -> DataFrame:
    """Shuffle ``df`` by the columns and keep it whole for several readers. With ``parts`` there are at least so many tasks,
    whatever their bytes.

    The other columns pass through a generator, so each reader needs all of them
    from the shuffle. The shuffles of all readers are then equal and Spark runs
    one of them; without this, column pruning makes each reader's shuffle
    different and everything above it is computed once per reader."""
    rest = [c for c in df.columns if c not in by]
    placed = df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by) if parts else df.repartition(*by)
    if not rest:
        return placed
    return placed.select(*by, F.inline(F.array(F.struct(*rest)))).select(*df.columns)


def scan(df: DataFrame, keys: list[str], order: list[str], block: Column, **scans: Scan) -> DataFrame:
    """Add one column per entry of ``scans``, computed along ``order`` per ``keys``."""
    blocked = shared(df.withColumn("_blk", block.cast("bigint")), *keys, "_blk")
    local_w = Window.partitionBy(*keys, "_blk").orderBy(*order)
    upto = local_w.rowsBetween(Window.unboundedPreceding, 0)
    # what comes later is looked for backwards: Spark computes a frame that ends unbounded anew for every row
    ahead = Window.partitionBy(*keys, "_blk").orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    earlier = local_w.rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*keys).orderBy("_blk")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.col("_blk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    position = F.struct(*[F.col(c) for c in order])

    local, summary, carried, final = [], [], [], {}
    for name, s in scans.items():
        l, c, boxed = f"_l_{name}", f"_c_{name}", F.struct(s.value.alias("v"))
        known = F.when(s.value.isNotNull(), boxed)
        at = F.when(s.value.isNotNull(), position)
        if s.kind == "prev":
            local.append(F.lag(boxed).over(local_w).alias(l))
            summary.append(F.max_by(boxed, position).alias(c))
            carried.append(F.lag(c).over(along).alias(c))
            value = F.coalesce(F.col(l), F.col(c))["v"]
            if s.default is not None:
                value = F.when(F.coalesce(F.col(l), F.col(c)).isNull(), F.lit(s.default)).otherwise(value)
        elif s.kind == "next":
            local.append(F.lead(boxed).over(local_w).alias(l))
            summary.append(F.min_by(boxed, position).alias(c))
            carried.append(F.lead(c).over(along).alias(c))
            value = F.coalesce(F.col(l), F.col(c))["v"]
            if s.default is not None:
                value = F.when(F.coalesce(F.col(l), F.col(c)).isNull(), F.lit(s.default)).otherwise(value)
        elif s.kind == "sum":
            local.append(F.sum(s.value).over(upto).alias(l))
            summary.append(F.sum(s.value).alias(c))
            carried.append(F.sum(c).over(before).alias(c))
            value = F.coalesce(F.col(l) + F.col(c), F.col(l), F.col(c))
        elif s.kind in ("max", "max_before"):
            local.append(F.max(s.value).over(upto if s.kind == "max" else earlier).alias(l))
            summary.append(F.max(s.value).alias(c))
            carried.append(F.max(c).over(before).alias(c))
            value = F.greatest(F.col(l), F.col(c))
        elif s.kind in ("ffill", "ffill_before"):
            frame = upto if s.kind == "ffill" else earlier
            local.append(F.last(known, ignorenulls=True).over(frame).alias(l))
            summary.append(F.max_by(boxed, at).alias(c))
            carried.append(F.last(c, ignorenulls=True).over(before).alias(c))
            value = F.coalesce(F.col(l), F.col(c))["v"]
        elif s.kind == "bfill_after":
            local.append(F.last(known, ignorenulls=True).over(ahead).alias(l))
            summary.append(F.min_by(boxed, at).alias(c))
            carried.append(F.last(c, ignorenulls=True).over(after).alias(c))
            value = F.coalesce(F.col(l), F.col(c))["v"]
        elif s.kind == "whole_first":
            summary.append(F.min_by(boxed, at).alias(c))
            carried.append(
                F.first(c, ignorenulls=True)
                .over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
                .alias(c)
            )
            value = F.col(c)["v"]
        else:
            fold = {"whole_sum": F.sum, "whole_max": F.max, "whole_min": F.min}[s.kind]
            summary.append(fold(s.value).alias(c))
            carried.append(fold(c).over(whole).alias(c))
            value = F.col(c)
        final[name] = value

    per_block = blocked.groupBy(*keys, "_blk").agg(*summary).select(*keys, "_blk", *carried)
    joined = blocked.select("*", *local).join(per_block, [*keys, "_blk"], "left")
    out = [F.col(c) for c in df.columns if c not in scans]
    return joined.select(*out, *[v.alias(n) for n, v in final.items()])


def islands(df: DataFrame, keys: list[str], order: list[str], block: Column, starts: Column, name: str = "island",
            **look: Scan) -> DataFrame:
    """Number runs of rows: ``starts`` says where a new run begins and may use
    the columns named in ``look``."""
    seen = scan(df, keys, order, block, **look) if look else df
    flagged = seen.withColumn("_start", F.coalesce(starts.cast("int"), F.lit(0)).cast("bigint"))
    return scan(flagged, keys, order, block, **{name: running_sum("_start")}).drop("_start")


def with_halo(df: DataFrame, position: str, before: int, after: int, width: int = BLOCK_ROWS) -> DataFrame:
    """Copy rows near a block edge into the neighbour block.

    ``position`` is a dense row number or a time. Adds ``_blk`` (window
    partition, together with the session key) and ``_own`` (false on copies;
    filter on it after the window)."""
    width = max(width, before, after, 1)
    home = F.floor(F.col(position) / F.lit(width)).cast("bigint")
    offset = F.col(position) - home * F.lit(width)
    targets = F.array_compact(F.array(
        home,
        F.when(offset >= F.lit(width - before), home + 1),
        F.when(offset < F.lit(after), home - 1),
    ))
    return (
        df.withColumn("_home", home)
        .withColumn("_blk", F.explode(targets))
        .withColumn("_own", F.col("_home") == F.col("_blk"))
        .drop("_home")
    )


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_own", "_blk")

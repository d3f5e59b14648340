"""Interval and as-of joins on an equi key made from time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import before_known, last_known, scan

BUCKET_MS = 30_000


def buckets(start: Column, end: Column, width: int) -> Column:
    """All buckets touched by the closed interval [start, end]."""
    lo, hi = F.floor(start / F.lit(width)), F.floor(F.greatest(start, end) / F.lit(width))
    return F.sequence(lo.cast("bigint"), hi.cast("bigint"))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[Column, Column],
               right_span: tuple[Column, Column], on: Column | None = None, how: str = "inner",
               width: int = BUCKET_MS) -> DataFrame:
    """Join rows whose closed time spans touch, plus any extra condition.

    Both sides are copied into the buckets they touch and joined on
    (keys, bucket), so a long session is spread over its buckets. A pair meets
    in every shared bucket but is kept only in the first one. Column names of
    the two sides must differ, except for the keys."""
    ls, le = left_span
    rs, re_ = right_span
    l = left.withColumn("_ls", ls).withColumn("_le", F.greatest(ls, le)).withColumn("_bkt", F.explode(buckets(ls, le, width)))
    r = right.withColumn("_rs", rs).withColumn("_re", F.greatest(rs, re_)).withColumn("_bkt", F.explode(buckets(rs, re_, width)))
    first_shared = F.floor(F.greatest(F.col("_ls"), F.col("_rs")) / F.lit(width))
    touch = (F.col("_ls") <= F.col("_re")) & (F.col("_rs") <= F.col("_le")) & (F.col("_bkt") == first_shared)
    if on is not None:
        touch = touch & on
    if how == "inner":
        return l.join(r, [*keys, "_bkt"]).filter(touch).drop("_ls", "_le", "_rs", "_re", "_bkt")
    if how not in ("left_semi", "left_anti"):
        raise ValueError("inner, left_semi or left_anti; build an outer join from inner plus left_anti")
    renamed = r
    for k in [*keys, "_bkt"]:
        renamed = renamed.withColumnRenamed(k, f"_r{k}")
    cond = touch
    for k in [*keys, "_bkt"]:
        cond = cond & (F.col(k) == F.col(f"_r{k}"))
    if how == "left_semi":
        return l.join(renamed, cond, how).drop("_ls", "_le", "_bkt")
    raise ValueError("use points_outside for a left_anti on points")


def points_outside(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str,
                   on: Column | None = None, width: int = BUCKET_MS) -> DataFrame:
    """Anti join: drop points inside any closed interval. A point lies in one
    bucket, so the anti join on (keys, bucket) is exact."""
    p = points.withColumn("_bkt", F.floor(F.col(at) / F.lit(width)).cast("bigint"))
    i = intervals.select(
        *[F.col(k).alias(f"_r{k}") for k in keys], F.col(start).alias("_rs"), F.col(end).alias("_re"),
        F.explode(buckets(F.col(start), F.col(end), width)).alias("_rbkt"))
    cond = (F.col("_bkt") == F.col("_rbkt")) & (F.col(at) >= F.col("_rs")) & (F.col(at) <= F.col("_re"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_r{k}"))
    if on is not None:
        cond = cond & on
    return p.join(i, cond, "left_anti").drop("_bkt")


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_at: list[str], right_at: list[str],
         take: list[str], block: Column, inclusive: bool = True, prefix: str = "") -> DataFrame:
    """Backward as-of: the last right row at or before each left row.

    Both sides are stacked and the right values carried forward by ``scan``;
    no per-key sort of a whole session and no pairwise comparison. ``block`` is
    written in terms of ``_at0``, the first ordering column."""
    n = len(left_at)
    at = [f"_at{i}" for i in range(n)]
    l = left.select("*", *[F.col(c).alias(a) for c, a in zip(left_at, at)], F.lit(1 if inclusive else 0).alias("_side"))
    payload = F.struct(*[F.col(c).alias(c) for c in take])
    r = right.select(*keys, *[F.col(c).alias(a) for c, a in zip(right_at, at)],
                     F.lit(0 if inclusive else 1).alias("_side"), payload.alias("_pay"))
    both = l.unionByName(r, allowMissingColumns=True)
    filled = scan(both, keys, [*at, "_side"], block, _got=last_known("_pay"))
    is_left = F.col("_side") == F.lit(1 if inclusive else 0)
    kept = filled.filter(is_left)
    return kept.select(*left.columns, *[F.col("_got")[c].alias(f"{prefix}{c}") for c in take])


__all__ = ["BUCKET_MS", "buckets", "range_join", "points_outside", "asof", "before_known"]

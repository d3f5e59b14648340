"""Exact order statistics by group without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running_sum, scan, whole_sum

# index rules, 0-based, for n values (n as column ``n``)
INDEX = {
    "floor": lambda q: F.floor(F.col("n") * F.lit(q)),
    "floor_capped": lambda q: F.least(F.floor(F.col("n") * F.lit(q)), F.col("n") - 1),
    "nearest": lambda q: F.bround(F.lit(q) * (F.col("n") - 1), 0),
}


def spread(value: Column) -> Column:
    """Order-preserving block number: fine near zero, coarse far out."""
    return F.signum(value) * F.floor(F.log2(F.abs(value) + 1) * 64)


def cumulative(df: DataFrame, keys: list[str], value: str, block: Column | None = None) -> DataFrame:
    """Histogram with ranks: one row per distinct value holding ``lo`` (rows
    below), ``hi`` (rows up to here) and ``n``. Counting first means that a hot
    group shuffles its distinct values, not its rows."""
    hist = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    blk = block if block is not None else spread(F.col(value).cast("double"))
    ranked = scan(hist, keys, [value], blk, hi=running_sum("_n"), n=whole_sum("_n"))
    return ranked.withColumn("lo", F.col("hi") - F.col("_n")).drop("_n")


def pick(df: DataFrame, keys: list[str], value: str, **wanted: Column) -> DataFrame:
    """One row per group with the value found at each 0-based index."""
    ranked = cumulative(df, keys, value)
    at = [
        F.max(F.when((F.col("lo") <= idx) & (idx < F.col("hi")), F.col(value))).alias(name)
        for name, idx in wanted.items()
    ]
    return ranked.groupBy(*keys).agg(*at, F.max("n").alias("n"))


def medians(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group (mean of the two middle values)."""
    n = F.col("n")
    both = pick(df, keys, value, _a=F.floor((n - 1) / 2), _b=F.floor(n / 2))
    return both.select(*keys, ((F.col("_a") + F.col("_b")) / 2).alias(name), "n")

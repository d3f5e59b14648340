"""Ranking, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V


def noisy_batches(tokens: DataFrame, keys: list[str], batch: str, word: str = "word", script_class: str = V.HANGUL, least: int = 4) -> DataFrame:
    """Most frequent word of each batch among words of the script; batches where
    it comes ``least`` times are to be dropped."""
    w = tokens.filter(F.col(word).rlike(script_class)).groupBy(*keys, batch, F.trim(word).alias("top_word")).agg(F.count(F.lit(1)).alias("n"))
    best = w.groupBy(*keys, batch).agg(F.max_by("top_word", F.struct("n", F.col("top_word").alias("w"))).alias("top_word"), F.max("n").alias("n"))
    return best.filter(F.col("n") >= least)


def drop_noisy_batches(tokens: DataFrame, keys: list[str], batch: str, **rule) -> DataFrame:
    return tokens.join(noisy_batches(tokens, keys, batch, **rule), [*keys, batch], "left_anti")


def rank_sequences(candidates: DataFrame, keys: list[str], alpha: float | None = None) -> DataFrame:
    """Best candidate by log probability over length, or over ((5 + n) / 6) ** alpha;
    the first one wins a tie."""
    n = F.col("length")
    penalty = n if alpha is None else F.pow((n + 5) / 6, F.lit(alpha))
    scored = candidates.withColumn("score", F.col("sum_logprob") / penalty)
    return scored.groupBy(*keys).agg(F.max_by("candidate", F.struct("score", (-F.col("candidate")).alias("c"))).alias("candidate"))


def worst_first(df: DataFrame, value: str, tie: str, n: int = 10) -> DataFrame:
    """Report of the ``n`` worst rows (a top-k, so no full sort)."""
    return df.orderBy(F.desc(value), tie).limit(n)


def era_union(committed: DataFrame, history: DataFrame, interim: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Earlier sessions, finalized lines without a newer interim one, interim."""
    shown = history.join(interim.select(*keys, line), [*keys, line], "left_anti")
    tag = lambda d, era, rank: d.withColumn("era", F.lit(era)).withColumn("part", F.lit(rank))
    return tag(committed, "past", 0).unionByName(tag(shown, "now", 1)).unionByName(tag(interim, "now", 2))


def content_words(text: str):
    """Words of two or more letters that are no stop words."""
    w = F.transform(X.words(text), X.edge_form)
    return F.array_distinct(F.filter(w, lambda x: (F.length(x) >= 2) & ~x.isin(V.STUB_STOPWORDS)))


def shared_content(df: DataFrame, left: str, right: str) -> DataFrame:
    """Content words of ``left`` that occur in ``right``."""
    r = F.transform(X.words(right), X.edge_form)
    return df.withColumn("shared", F.array_sort(F.array_intersect(content_words(left), r)))


def unexplained(all_bounds: DataFrame, *explained: DataFrame) -> DataFrame:
    """Boundaries in none of the other sets."""
    left = all_bounds
    for e in explained:
        left = left.join(e, all_bounds.columns, "left_anti")
    return left

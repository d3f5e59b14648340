"""Sample catalogues and row batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_samples(samples: DataFrame, languages: list[str] | None = None, categories: list[str] | None = None,
                   quick: Column | None = None) -> DataFrame:
    """Samples of the wanted languages and categories; ``quick`` marks the quick
    set. Plain filters, so they reach the scan."""
    if quick is not None:
        samples = samples.filter(quick)
    if languages:
        samples = samples.filter(F.col("language").isin(languages))
    if categories:
        samples = samples.filter(F.col("category").isin(categories))
    return samples


def tumble_rows(df: DataFrame, seq: str, n: int) -> DataFrame:
    """Fixed batches of ``n`` consecutive rows (``seq`` dense, from 1)."""
    return df.withColumn("batch", F.floor((F.col(seq) - 1) / n))


def flatten_words(results: DataFrame, keys: list[str]) -> DataFrame:
    """segments[] of words[] to one row per word, order kept."""
    s = results.select(*keys, F.posexplode("segments").alias("seg_no", "s"))
    w = s.select(*keys, F.col("seg_no").cast("bigint").alias("seg_no"), F.posexplode("s.words").alias("word_no", "w"))
    return w.select(*keys, "seg_no", F.col("word_no").cast("bigint").alias("word_no"), "w.*")

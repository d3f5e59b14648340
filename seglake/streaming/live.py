"""Native streams: sources and windows that need no custom state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def token_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """Tokens from files; a row of kind ``end`` closes a session."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def activity(events: DataFrame, key: str, at: str, gap: str = "10 minutes", lateness: str = "1 minute") -> DataFrame:
    """Stretches of activity; what lies between two is silence."""
    return events.withWatermark(at, lateness).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def upsert_sink(stream: DataFrame, path: str, checkpoint: str, keys: list[str], version: str):
    """Keep the latest version per key. Each micro-batch appends its own latest
    rows under its batch id; a replayed batch overwrites itself. Readers take
    ``latest`` of the folder."""

    def write(batch: DataFrame, number: int) -> None:
        cols = [c for c in batch.columns if c not in keys]
        batch.groupBy(*keys).agg(F.max_by(F.struct(*cols), version).alias("v")).select(*keys, "v.*").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def latest(spark: SparkSession, path: str, keys: list[str], version: str) -> DataFrame:
    df = spark.read.parquet(path).drop("batch")
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), version).alias("v")).select(*keys, "v.*")

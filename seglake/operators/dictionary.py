"""Word dictionaries: overlay, order of use, maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import prev, rows_block, scan


def overlay(base: DataFrame, user: DataFrame) -> DataFrame:
    """Union of two (wrong, correct) tables in which the user rows win; rows
    without either side are skipped."""
    both = base.select("wrong", "correct", F.lit(0).alias("_rank")).unionByName(
        user.select("wrong", "correct", F.lit(1).alias("_rank")))
    good = both.filter(F.col("wrong").isNotNull() & F.col("correct").isNotNull())
    return good.groupBy("wrong").agg(F.max_by("correct", "_rank").alias("correct"))


def longest_first(entries: DataFrame) -> DataFrame:
    """Order of use: longest key first."""
    return entries.withColumn("n", F.length("wrong")).orderBy(F.desc("n"), "wrong")


def apply_changes(base: DataFrame, user: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply put / delete changes (wrong, correct, op, at) to the user table.

    The latest change per key wins; base rows cannot be deleted. Returns the
    dictionary in force and the revision (number of effective changes: every
    put, and every delete that finds its key)."""
    latest = changes.groupBy("wrong").agg(F.max_by(F.struct("op", "correct"), "at").alias("c"))
    put = latest.filter("c.op = 'put'").select("wrong", "c.correct")
    kept = user.select("wrong", "correct").join(latest, "wrong", "left_anti")
    in_force = overlay(base, kept.unionByName(put))
    # a delete counts when the key is present just before it
    ordered = scan(changes, ["wrong"], ["at"], rows_block("at"), _before=prev("op"))
    seen = ordered.join(user.select("wrong", F.lit(True).alias("_had")), "wrong", "left")
    present = F.when(F.col("_before").isNull(), F.coalesce("_had", F.lit(False))).otherwise(F.col("_before") == "put")
    effective = seen.withColumn("_hit", (F.col("op") == "put") | present)
    revision = effective.agg(F.count_if("_hit").alias("revision"))
    return in_force, revision

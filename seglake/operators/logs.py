"""Summaries of log events. Every ordered step stays inside one file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.ordered import before_known, rows_block, scan
from ..functions.ranks import medians
from ..sources.logs import DROP_KINDS
from .joins import nearest, ordinal_join, tolerance_join
from .windows import cascades, cycles


def boundary_rates(boundaries: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of silence boundaries without new text, with a refresh, and with a
    lag of at least their own length."""
    s = scan(boundaries, keys, ["line_no"], rows_block("line_no"), _pe=before_known("last_end"))
    g = s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(F.col("last_end") <= F.col("_pe") + 1e-6, F.lit(False))).alias("zero_emission"),
        F.count_if(F.col("refreshes") > 0).alias("with_refresh"), F.count_if(F.coalesce(F.col("lag") >= F.col("dur"), F.lit(False))).alias("ordering_risk"))
    for n in ("zero_emission", "with_refresh", "ordering_risk"):
        g = g.withColumn(f"{n}_rate", F.round(F.col(n) / F.col("total"), 6))
    return g


def drop_summary(events: DataFrame, keys: list[str], near_lines: int = V.NEAR_LINES) -> DataFrame:
    """Drops per kind, near to or far from a speaker change, and broken files."""
    is_drop = F.col("kind").isin(DROP_KINDS)
    placed = nearest(events, keys, "line_no", F.col("kind") == "new_speaker", near_lines)
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    g = placed.groupBy(*keys).agg(
        F.count_if(is_drop).alias("drops"), F.count_if(is_drop & F.col("near")).alias("near_change"), F.count_if(is_drop & ~F.col("near")).alias("far_or_none"),
        *[n(k) for k in (*DROP_KINDS, "cross_batch", "gate_refresh", "stall", "new_speaker", "tensor_mismatch", "output")],
        (F.count_if(F.col("kind") == "trace_on") > 0).alias("trace_on"))
    mute = F.col("trace_on") & (F.col("output") == 0)
    reasons = F.array_compact(F.array(F.when(F.col("tensor_mismatch") > 0, "tensor_mismatch"), F.when(mute, "no_output")))
    return g.withColumn("broken", (F.col("tensor_mismatch") > 0) | mute).withColumn("reasons", F.array_join(reasons, ","))


def loss_summary(events: DataFrame, keys: list[str]) -> DataFrame:
    """Switch and loss counts per file, including cascades and stuck cycles."""
    c = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    k, cap = F.col("kind"), F.col("captures")
    g = events.groupBy(*keys).agg(
        c(k == "tensor_mismatch").alias("tensor_mismatches"), c(k == "other_error").alias("other_errors"),
        c((k == "switch_apply") & (cap["switch"] == "True")).alias("switch_true"), c((k == "switch_apply") & (cap["switch"] == "False")).alias("switch_false"),
        c(k == "marker").alias("markers"), c((k == "trim") & (cap["kept"].cast("double") < 1.0)).alias("low_keep_trims"),
        c((k == "tax_overlap") & (cap["overlap"].cast("double") >= 0.6 * cap["total"].cast("double"))).alias("high_overlap"),
        c(k == "cross_batch").alias("cross_batch"), c(k == "stall").alias("stalls"), c(k == "output").alias("outputs"),
        c((k == "end_silence") & (cap["branch"] == "long")).alias("long_silences"), c((k == "end_silence") & (cap["branch"] == "short")).alias("short_silences"),
        c((k == "long_reset") & (cap["before"] != "None")).alias("resets_discarded"), c(k == "deferred").alias("deferred"))
    ab = events.filter(k.isin("tensor_mismatch", "other_error")).select(*keys, "line_no", cap["a"].try_cast("bigint").alias("a"), cap["b"].try_cast("bigint").alias("b"))
    cas = cascades(ab, keys, "line_no").groupBy(*keys).agg(F.count(F.lit(1)).alias("cascades"))
    state = (
        F.when(k == "long_reset", "reset_long_silence").when(k == "new_speaker", "reset_new_speaker").when(k == "deferred", "deferred")
        .when(k == "first_timestamp", "first_timestamp").when((k == "switch_apply") & (cap["switch"] == "True"), "switch_true").when(k == "switch_apply", "switch_false"))
    st = events.select(*keys, "line_no", state.alias("kind")).filter("kind is not null")
    stuck = cycles(st, keys, "line_no").groupBy(*keys).agg(F.count_if("stuck").alias("stuck_cycles"))
    return g.join(cas, keys, "left").join(stuck, keys, "left").na.fill(0)


def totals(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Sums over files: counts only add, nothing is detected again."""
    return summary.agg(F.count(F.lit(1)).alias("files"), *[F.sum(c).alias(c) for c in summary.columns if c not in keys])


def delta_distribution(events: DataFrame, kind: str, value: str) -> DataFrame:
    v = events.filter(F.col(value).isNotNull())
    g = v.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"))
    return g.join(medians(v, [kind], value).drop("n"), kind)


def boundary_verdicts(boundaries: DataFrame, scans: DataFrame, resolves: DataFrame, keys: list[str], tol: int = 50) -> DataFrame:
    """What happened at each language boundary. ``boundaries``: no, before_lang,
    before_del, after_del (counts of lost words); ``scans``: line_no, boundary_t,
    prev_lang, removed; ``resolves``: r_line, r_t, restored, replaced. The i-th
    boundary belongs to the i-th scan; a resolve belongs to the scan when their
    times differ by less than ``tol``."""
    s = tolerance_join(scans, resolves.select(*keys, "r_line", "r_t"), keys, "line_no", "boundary_t", "r_line", "r_t", tol)
    s = s.join(resolves.select(*keys, "r_line", "restored", "replaced"), [*keys, "r_line"], "left")
    j = ordinal_join(boundaries, s, keys, "no", "line_no")
    status = (
        F.when(F.col("restored").isNull(), None).when((F.col("restored") == 0) & (F.col("replaced") == 0), "nothing")
        .when((F.col("restored") > 0) & (F.col("replaced") > 0), "mixed").when(F.col("restored") > 0, "restored").otherwise("replaced"))
    same = F.coalesce(F.col("prev_lang") == F.col("before_lang"), F.lit(False))
    lost = F.when(F.col("after_del") > 0, F.when(same & (F.col("removed") > 0), "retracted").when(same & (F.col("removed") == 0), "never_emitted").otherwise("other"))
    series = F.array_compact(F.array(F.when(F.col("before_del") > 0, "old_language_tail"), lost))
    return j.select(*keys, "no", F.when(F.size(series) == 0, "normal").otherwise(F.array_join(series, "+")).alias("series"), status.alias("reconcile_status"))

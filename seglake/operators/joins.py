"""Interval, as-of, tolerance and lookup joins.

Time joins use bucket equi keys (``range_join``), as-of joins carry values along
the time order (``asof``); nothing compares all pairs of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.entries import holding_entries
from ..functions import values as V
from ..functions.ordered import (first_of, last_known, next_known, row_no, rows_block, running_sum, scan,
                                 time_block)
from ..functions.ranges import asof, points_outside, range_join


# --- speakers on lines --------------------------------------------------------

def raw_speakers(lines: DataFrame, diar: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Best overlapping speaker per line (1-based; first interval wins a tie;
    1 without any overlap), and whether the line lies past the last interval."""
    d = diar.select(*keys, F.col("start_ms").alias("d_start"), F.col("end_ms").alias("d_end"), F.col("speaker").alias("d_speaker"))
    span = lines.select(*keys, line, "start_ms", "end_ms")
    hits = range_join(span, d, keys, (F.col("start_ms"), F.col("end_ms")), (F.col("d_start"), F.col("d_end")))
    overlap = F.least("end_ms", "d_end") - F.greatest("start_ms", "d_start")
    best = (
        hits.withColumn("_o", overlap).filter("_o > 0").groupBy(*keys, line)
        .agg(F.max_by(F.struct("d_speaker", (F.col("d_end") - F.col("d_start")).alias("len")),
                      F.struct("_o", (-F.col("d_start")).alias("s"), (-F.col("d_end")).alias("e"))).alias("_b"))
    )
    last = d.groupBy(*keys).agg(F.max_by("d_end", F.struct("d_start", "d_end")).alias("_last"))
    return (
        lines.join(best, [*keys, line], "left").join(last, keys, "left")
        .withColumn("raw_speaker", F.coalesce(F.col("_b.d_speaker") + 1, F.lit(1)))
        .withColumn("speaker_len", F.col("_b.len"))
        .withColumn("overflow", F.coalesce(F.col("start_ms") >= F.col("_last"), F.lit(False)))
        .drop("_b", "_last")
    )


def attribute_speakers(lines: DataFrame, diar: DataFrame, keys: list[str], line: str,
                       min_ms: int = V.MIN_SPEAKER_MS) -> DataFrame:
    """Speakers of lines. A winner from an interval shorter than ``min_ms`` is
    replaced by the speaker resolved before it. As a short winner always takes
    over the speaker before it, the fold is the last winner that was not short
    (or the very first winner of the session)."""
    raw = raw_speakers(lines, diar, keys, line)
    counted = ~F.col("overflow")
    short = F.coalesce(F.col("speaker_len") < min_ms, F.lit(False))
    seen = scan(raw, keys, [line], rows_block(line),
                _sure=last_known(F.when(counted & ~short, F.col("raw_speaker"))),
                _first=first_of(F.when(counted, F.col("raw_speaker"))))
    return seen.withColumn("speaker", F.when(counted, F.coalesce("_sure", "_first"))).drop("_sure", "_first", "speaker_len")


def attach_translations(lines: DataFrame, translations: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Concatenate, in order, the translations lying fully inside a line, up to
    the first one outside that follows a hit. ``translations`` has ``no``,
    ``t_start``, ``t_end``, ``t_text``; with ``no`` dense per session, the part
    before the first miss is the run of consecutive numbers."""
    inside = (F.col("start_ms") <= F.col("t_start")) & (F.col("t_end") <= F.col("end_ms"))
    pairs = range_join(lines.select(*keys, line, "start_ms", "end_ms"), translations.select(*keys, "no", "t_start", "t_end", "t_text"),
                       keys, (F.col("start_ms"), F.col("end_ms")), (F.col("t_start"), F.col("t_end")), on=inside)
    # empty translations inside the line neither add text nor end the run once text exists
    w = Window.partitionBy(*keys, line).orderBy("no")
    run = pairs.withColumn("_gap", F.col("no") - F.row_number().over(w))
    first = run.filter(F.col("t_text") != "").groupBy(*keys, line).agg(F.min_by("_gap", "no").alias("_g"))
    kept = run.join(first, [*keys, line]).filter("_gap = _g and t_text <> ''")
    text = kept.groupBy(*keys, line).agg(F.array_sort(F.collect_list(F.struct("no", "t_text"))).alias("_t"))
    text = text.select(*keys, line, F.array_join(F.transform("_t", lambda x: F.concat(x["t_text"], F.lit(" "))), "").alias("translation"))
    return lines.join(text, [*keys, line], "left").withColumn("translation", F.coalesce("translation", F.lit("")))


# --- lookups ------------------------------------------------------------------

def at(points: DataFrame, lines: DataFrame, keys: list[str], line: str, t: str = "t") -> DataFrame:
    """First line covering each point (closed interval), NULL when none does. Points meet lines as numbers only; the text is
    joined to the line that was found, so it is moved once per line and not once per point."""
    p = points.select(*keys, t).distinct()
    l = lines.select(*keys, line, "start_ms", "end_ms")
    hit = range_join(p, l, keys, (F.col(t), F.col(t)), (F.col("start_ms"), F.col("end_ms")))
    found = points.join(hit.groupBy(*keys, t).agg(F.min(line).alias(line)), [*keys, t], "left")
    told = lines.select(*keys, line, "speaker", "text").dropDuplicates([*keys, line])
    return found.join(told, [*keys, line], "left").select(
        *points.columns, line, "speaker", "text", F.coalesce(F.col("speaker") == -2, F.lit(False)).alias("in_silence"))


def between(ranges: DataFrame, lines: DataFrame, keys: list[str], line: str, rid: str) -> DataFrame:
    """Lines touching each range: count, speakers (> 0), joined text."""
    l = lines.select(*keys, line, F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end"), "speaker", "text")
    hit = range_join(ranges, l, keys, (F.col("from_ms"), F.col("to_ms")), (F.col("l_start"), F.col("l_end")))
    return hit.groupBy(*keys, rid).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("speaker") > 0, F.col("speaker").cast("string")))), ",").alias("speakers"),
        F.array_sort(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", F.struct(line, "text")))).alias("_t"),
    ).select(*keys, rid, "n_lines", "speakers", F.array_join(F.transform("_t", lambda x: x["text"]), " ").alias("text"))


def label_windows(df: DataFrame, windows: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Rows inside named windows (one row per window), the rest as control."""
    w = windows.select(*keys, "name", "w_start", "w_end")
    hit = range_join(df, w, keys, (F.col(t), F.col(t)), (F.col("w_start"), F.col("w_end")), width=3_600_000)
    inside = hit.select(*df.columns, "name")
    control = points_outside(df, w, keys, t, "w_start", "w_end", width=3_600_000)
    return inside.unionByName(control.withColumn("name", F.lit("control")))


def decision_check(decisions: DataFrame, probes: DataFrame, keys: list[str], order: str, block: Column,
                   tau_pct: int = 90) -> DataFrame:
    """Probability of the applied value in the last probe before each decision,
    and whether the probe disagreed (p <= 1 - tau)."""
    joined = asof(decisions, probes, keys, [order], [order], ["p"], block, inclusive=False, prefix="probe_")
    return joined.withColumn("disagrees", F.coalesce(F.col("probe_p") <= 100 - tau_pct, F.lit(False)))


def nearest(df: DataFrame, keys: list[str], order: str, is_anchor: Column, limit: int = V.NEAR_LINES) -> DataFrame:
    """Distance to the nearest anchor row and near / far_or_none."""
    at_anchor = F.when(is_anchor, F.col(order))
    s = scan(df, keys, [order], rows_block(order), _back=last_known(at_anchor), _fwd=next_known(at_anchor))
    dist = F.least(F.col(order) - F.col("_back"), F.col("_fwd") - F.col(order))
    return s.withColumn("distance", dist).withColumn(
        "near", F.coalesce(F.col("distance") <= limit, F.lit(False))).drop("_back", "_fwd")


def tolerance_join(left: DataFrame, right: DataFrame, keys: list[str], lid: str, lval: str, rid: str, rval: str,
                   tol: int) -> DataFrame:
    """First right row (by ``rid``) with |left - right| < tol, NULL when none. Both sides meet as distinct values per key, so a
    value that many rows share is compared once."""
    bucket = lambda c: F.floor(F.col(c) / tol)
    l = left.select(*keys, lval).distinct().withColumn("_b", bucket(lval))
    r = right.groupBy(*keys, rval).agg(F.min(rid).alias(rid))
    r = r.select(*keys, rid, rval, F.explode(F.array(*[bucket(rval) + d for d in (-1, 0, 1)])).alias("_b"))
    hit = l.join(r, [*keys, "_b"]).filter(F.abs(F.col(lval) - F.col(rval)) < tol)
    first = hit.groupBy(*keys, lval).agg(F.min(rid).alias(rid))
    return left.join(first, [*keys, lval], "left").select(*left.columns, rid)


def ordinal_join(left: DataFrame, right: DataFrame, keys: list[str], lorder: str, rorder: str) -> DataFrame:
    """i-th left row with the i-th right row of the same key."""
    l = scan(left, keys, [lorder], rows_block(lorder), ordinal=row_no())
    r = scan(right, keys, [rorder], rows_block(rorder), ordinal=row_no())
    return l.join(r, [*keys, "ordinal"], "left")


def cross_reference(logs: DataFrame, transcripts: DataFrame, keys: list[str]) -> DataFrame:
    """Files present on both sides, with a conclusion: storms in the transcript,
    drops in the log, both or none."""
    verdict = (
        F.when((F.col("storms") > 0) & (F.col("drops") > 0), "both").when(F.col("storms") > 0, "transcript_only")
        .when(F.col("drops") > 0, "log_only").otherwise("clean"))
    return logs.join(transcripts, keys, "inner").withColumn("conclusion", verdict)


def relevant_glossary(df: DataFrame, glossary: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Entries of which either side occurs in the text, ignoring case. A glossary of any size is taken in blocks of
    entries."""
    return holding_entries(df.select(key, F.lower(text).alias("_lower")), glossary, key, "_lower")


def apply_overrides(lines: DataFrame, overrides: DataFrame, keys: list[str], line: str) -> DataFrame:
    """A manual translation wins only while its source text is still the text."""
    o = overrides.select(*keys, line, F.col("source_text").alias("text"), F.col("translation").alias("_manual"), F.lit(True).alias("_has"))
    j = lines.join(o, [*keys, line, "text"], "left")
    shown = F.when(F.col("_has"), F.nullif(F.col("_manual"), F.lit(""))).otherwise(F.nullif(F.col("translation"), F.lit("")))
    return j.withColumn("translation", shown).select(*lines.columns)


def merge_views(history: DataFrame, interim: DataFrame, suppressed: DataFrame, keys: list[str], line: str, block: str) -> DataFrame:
    """Interim rows hide finalized rows with the same id; suppressed blocks go last."""
    kept = history.join(interim.select(*keys, line), [*keys, line], "left_anti")
    return kept.unionByName(interim).join(suppressed.select(*keys, block), [*keys, block], "left_anti")


def reemission_pairs(new: DataFrame, committed: DataFrame, keys: list[str], tol: int = V.REEMIT_TOL_MS) -> DataFrame:
    """Pairs of a new and a committed token starting within ``tol`` whose
    normalised texts are equal or one begins with the other."""
    n = new.select(*keys, F.col("seq").alias("new_seq"), F.col("start_ms").alias("n_start"), X.edge_form("word").alias("n_text")).filter("n_text <> ''")
    c = committed.select(*keys, F.col("seq").alias("old_seq"), F.col("start_ms").alias("c_start"), X.edge_form("word").alias("c_text")).filter("c_text <> ''")
    hit = range_join(n, c, keys, (F.col("n_start") - tol, F.col("n_start") + tol), (F.col("c_start"), F.col("c_start")),
                     on=F.startswith("n_text", "c_text") | F.startswith("c_text", "n_text"))
    return hit.select(*keys, "new_seq", "old_seq", F.when(F.col("n_text") == F.col("c_text"), "exact").otherwise("prefix").alias("kind"))


def drop_in_intervals(words: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Drop words that start inside a no-speech interval (closed)."""
    return points_outside(words, intervals, keys, "start_ms", "q_start", "q_end")


def restore_times(words: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Map times of audio with silence cut out back to the original clock. A word
    belongs to the chunk holding its middle; the shift is the silence before
    that chunk. Chunks are [start, end) on the original clock."""
    c = scan(chunks, keys, ["start_ms"], time_block("start_ms"), _upto=running_sum(F.col("end_ms") - F.col("start_ms")))
    c = c.select(*keys, (F.col("_upto") - (F.col("end_ms") - F.col("start_ms"))).alias("short_at"),
                 (F.col("start_ms") - (F.col("_upto") - (F.col("end_ms") - F.col("start_ms")))).alias("shift"))
    w = words.withColumn("mid2", F.col("start_ms") + F.col("end_ms")).withColumn("mid", F.floor(F.col("mid2") / 2))
    j = asof(w, c, keys, ["mid"], ["short_at"], ["shift"], time_block("_at0"))
    first = c.groupBy(*keys).agg(F.min_by("shift", "short_at").alias("_s0"))
    j = j.join(first, keys, "left").withColumn("shift", F.coalesce("shift", "_s0", F.lit(0)))
    return j.withColumn("start_ms", F.col("start_ms") + F.col("shift")).withColumn(
        "end_ms", F.col("end_ms") + F.col("shift")).select(*words.columns)


def missing_at_boundaries(ops: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Deleted or substituted reference words around language switches. ``ops``
    has ref_idx, op, word; ``bounds`` has boundary, at, lo, hi (word indexes,
    already clipped to their blocks)."""
    b = bounds.select(*keys, "boundary", "at", "lo", (F.col("hi") - 1).alias("_hi"))
    o = ops.filter(F.col("op").isin("del", "sub")).select(*keys, "ref_idx", "op", "word")
    hit = range_join(o, b, keys, (F.col("ref_idx"), F.col("ref_idx")), (F.col("lo"), F.col("_hi")), width=1024)
    return hit.select(*keys, "boundary", F.when(F.col("ref_idx") < F.col("at"), "before").otherwise("after").alias("side"),
                      "op", "ref_idx", "word")


def parity_errors(stored: DataFrame, parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Stored reference texts that differ from the parsed reference; runs
    without a stored reference are skipped."""
    j = stored.filter(F.col("reference").isNotNull()).join(parsed, keys)
    return j.filter(F.col("reference") != F.col("plain_text")).select(
        *stored.columns, F.length("reference").alias("stored_len"), F.length("plain_text").alias("parsed_len"))


def apply_cache(lines: DataFrame, cache: DataFrame, last: DataFrame, keys: list[str]) -> DataFrame:
    """Translation by (start in centiseconds, text); else the previous one by
    line id; else pending."""
    l = lines.withColumn("_cs", F.bround(F.col("start_ms").cast("decimal(20,1)") / 10, 0).cast("bigint"))
    c = cache.select(*keys, F.col("start_cs").alias("_cs"), "text", F.col("translation").alias("_hit"))
    p = last.select(*keys, F.col("line_id").alias("start_ms"), F.col("translation").alias("_prev"))
    j = l.join(c, [*keys, "_cs", "text"], "left").join(p, [*keys, "start_ms"], "left")
    return j.select(*lines.columns, F.coalesce("_hit", "_prev", F.lit("")).alias("translation"), F.col("_hit").isNull().alias("pending"))


def word_times(words: DataFrame, fragments: DataFrame, keys: list[str]) -> DataFrame:
    """Time of each word from the last fragment whose character offset is at or
    before the word's. ``words``: no (dense), word; ``fragments``: offset, pos."""
    w = scan(words, keys, ["no"], rows_block("no"), _upto=running_sum(F.length("word") + 1))
    w = w.withColumn("at_char", F.col("_upto") - F.length("word") - 1).withColumn("end_char", F.col("_upto") - 1).drop("_upto")
    block = F.floor(F.col("_at0") / 65536)
    s = asof(w, fragments, keys, ["at_char"], ["offset"], ["pos"], block, prefix="s_")
    e = asof(s, fragments, keys, ["end_char"], ["offset"], ["pos"], block, prefix="e_")
    return e.select(*keys, "no", "word", F.coalesce("s_pos", F.lit(0)).alias("start_pos"),
                    F.greatest(F.coalesce("e_pos", F.lit(0)), F.coalesce("s_pos", F.lit(0)) + 1).alias("end_pos"))



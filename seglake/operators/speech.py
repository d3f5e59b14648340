"""Streaks, gates and hysteresis on probability and event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..functions.folds import fold_sorted
from ..functions.ordered import (following, islands, last_known, own_rows, prev, row_no, rows_block, running_sum, scan, shared,
                                 with_halo)


def speech_events(frames: DataFrame, keys: list[str], prob: str, frame_ms: int, on: int = 50, margin: int = 15, min_silence_ms: int = 100,
                  pad_ms: int = 30) -> DataFrame:
    """Start and end events with hysteresis; probabilities in percent.

    Each frame at or over ``on`` opens an island. The island ends at its first
    low frame that comes ``min_silence_ms`` after its first low frame; a start
    is a high frame whose island before has ended (or the first one)."""
    f = frames.withColumn("_hi", F.col(prob) >= on).withColumn("_lo", F.col(prob) < on - margin)
    s = scan(f, keys, ["frame_no"], rows_block("frame_no"), _isl=running_sum(F.when(F.col("_hi"), 1).otherwise(0))).filter("_isl > 0")
    ik = [*keys, "_isl"]
    s = shared(s, *ik)
    first = s.groupBy(*ik).agg(F.min(F.when(F.col("_hi"), F.col("frame_no"))).alias("_h"), F.min(F.when(F.col("_lo"), F.col("frame_no"))).alias("_f"))
    wait = -(-min_silence_ms // frame_ms)
    fire = s.filter("_lo").join(first.select(*ik, "_f"), ik).filter(F.col("frame_no") - F.col("_f") >= wait)
    fire = fire.groupBy(*ik).agg(F.min("frame_no").alias("_e"))
    i = scan(first.join(fire, ik, "left"), keys, ["_isl"], rows_block("_isl"), _pe=prev(F.struct("_e")))
    ends = i.filter("_e is not null").select(*keys, F.col("_e").alias("frame_no"), F.lit("end").alias("event"),
                                             (F.col("_f") * frame_ms + pad_ms - frame_ms).alias("at_ms"))
    starts = i.filter("_pe is null or _pe._e is not null").select(
        *keys, F.col("_h").alias("frame_no"), F.lit("start").alias("event"), F.greatest(F.lit(0), F.col("_h") * frame_ms - pad_ms - frame_ms).alias("at_ms"))
    return ends.unionByName(starts)


def silences(events: DataFrame, keys: list[str], min_ms: int = 400) -> DataFrame:
    """From an end event to the next start; long ones become markers."""
    s = scan(events, keys, ["frame_no"], rows_block("frame_no"), _n=following("at_ms"))
    d = s.filter("event = 'end' and _n is not null")
    return d.select(*keys, F.col("at_ms").alias("start_ms"), F.col("_n").alias("end_ms"), (F.col("_n") - F.col("at_ms")).alias("duration_ms"),
                    (F.col("_n") - F.col("at_ms") > min_ms).alias("marker"))


def classify_silence(events: DataFrame, keys: list[str], order: str, dur: str) -> DataFrame:
    """long, short or none, and the clock base set by the last long silence."""
    branch = F.when(F.col(dur) >= V.LONG_SILENCE_MS, "long").when((F.col(dur) >= V.SHORT_SILENCE_MS) & F.col("auto_language"), "short").otherwise("none")
    e = events.withColumn("branch", branch)
    return scan(e, keys, [order], rows_block(order), base_ms=last_known(F.when(F.col("branch") == "long", F.col(dur) + F.col("offset_ms"))))


def script_triggers(tokens: DataFrame, keys: list[str], batch: str, order: str, n_words: int = 3, t_ms: int = 1000,
                    opposite: Column | None = None, neutral: Column | None = None) -> DataFrame:
    """Batches at whose end the opposite script has lasted ``n_words`` words or
    ``t_ms``. Neutral words neither count nor reset; the locked script resets."""
    opp = opposite if opposite is not None else X.opposite_script("word", "lang") & ~((F.col("lang") == "ko") & X.acronym_like("word"))
    neu = neutral if neutral is not None else (~X.has_hangul("word") & ~X.has_latin("word")) | (X.opposite_script("word", "lang") & (F.col("lang") == "ko") & X.acronym_like("word"))
    d = tokens.withColumn("_o", opp).withColumn("_r", ~opp & ~neu)
    s = scan(d, keys, [order], rows_block(order), _isl=running_sum(F.when(F.col("_r"), 1).otherwise(0)))
    ik = [*keys, "_isl"]
    s = scan(s, ik, [order], rows_block(order), _n=running_sum(F.when(F.col("_o"), 1).otherwise(0)),
             _to=last_known(F.when(F.col("_o"), F.col("end_ms"))))
    s = shared(s, *ik)
    first = s.filter("_o").groupBy(*ik).agg(F.min("start_ms").alias("_begin"))
    s = s.join(first, ik, "left")
    ends = s.groupBy(*keys, batch).agg(F.max_by(F.struct("_n", "_begin", "_to"), order).alias("e"))
    hit = (F.col("e._n") >= n_words) | ((F.col("e._n") > 0) & (F.col("e._to") - F.col("e._begin") >= t_ms))
    return ends.select(*keys, batch, F.coalesce(hit, F.lit(False)).alias("triggered"))


def sustained_alerts(probes: DataFrame, keys: list[str], order: str, tau: int = 97, min_len_ms: int = 2000, min_batches: int = 3,
                     min_ms: int = 800, cooldown_ms: int = 3000) -> DataFrame:
    """Seven ordered gates; blocked_by names the first that holds (NULL = fires).
    Columns: auto, locked, seglen_ms, p_ko, p_en, t_ms, switch_t (set on rows at
    which a switch happened), busy."""
    opp = F.when(F.col("locked") == "en", F.col("p_ko")).when(F.col("locked") == "ko", F.col("p_en"))
    pre = (
        F.when(~F.col("auto"), "g1").when(F.col("locked").isNull(), "g2").when(F.col("seglen_ms") < min_len_ms, "g3")
        .when(opp.isNull() | (opp < tau), "g4"))
    d = probes.withColumn("_pre", pre)
    # g1 and g2 leave the evidence alone; g3, g4 and another locked language restart it
    s = scan(d, keys, [order], rows_block(order), _clear=running_sum(F.when(F.col("_pre").isin("g3", "g4"), 1).otherwise(0)),
             _sw=last_known("switch_t"))
    ev = s.filter("_pre is null")
    ck = [*keys, "_clear"]
    ev = islands(ev, ck, [order], rows_block(order), F.col("_pl").isNull() | (F.col("_pl") != F.col("locked")), "_run", _pl=prev("locked"))
    rk = [*ck, "_run"]
    ev = shared(ev, *rk)
    first = ev.groupBy(*rk).agg(F.min("t_ms").alias("_t0"))
    ev = scan(ev, rk, [order], rows_block(order), _cnt=row_no()).join(first, rk)
    gate = (
        F.when((F.col("_cnt") < min_batches) | (F.col("t_ms") - F.col("_t0") < min_ms), "g5")
        .when(F.col("t_ms") - F.coalesce("_sw", F.lit(0)) < cooldown_ms, "g6").when(F.col("busy"), "g7"))
    done = ev.withColumn("blocked_by", gate).select(*probes.columns, "blocked_by")
    return done.unionByName(s.filter("_pre is not null").select(*probes.columns, F.col("_pre").alias("blocked_by")))


def stall_alerts(events: DataFrame, keys: list[str], order: str, limit_ms: int = V.STALL_MS) -> DataFrame:
    """Alerts when no output comes while the clock runs more than ``limit_ms``.
    Outputs and alerts both move the anchor; outputs cut the fold into stretches.
    ``events``: t_ms, emits."""
    s = scan(events, keys, [order], rows_block(order), _isl=running_sum(F.when(F.col("emits"), 1).otherwise(0)),
             _a=last_known(F.when(F.col("emits"), F.col("t_ms"))))
    quiet = s.filter(~F.col("emits")).select(*keys, "_isl", order, "t_ms", F.coalesce("_a", F.lit(0)).alias("_a"))
    names = ", ".join(f"{k} long" for k in keys)

    def step(st, row):
        anchor = st.setdefault("at", row["_a"])
        if row["t_ms"] - anchor > limit_ms:
            st["at"] = row["t_ms"]
            yield (*st["key"], row[order], row["t_ms"] - anchor)

    return fold_sorted(quiet, [*keys, "_isl"], [order], f"{names}, {order} long, stalled_ms long", lambda key: {"key": key[:-1]}, step)


def switch_overlap(tokens: DataFrame, keys: list[str], order: str, tail: int = 5) -> DataFrame:
    """Words of the first batch after a switch that repeat one of the ``tail``
    words before it. ``tokens``: batch, switched (true on the batch after a switch)."""
    h = with_halo(tokens.withColumn("_w", X.edge_form("word")), order, tail, 0)
    w = Window.partitionBy(*keys, "_blk").orderBy(order)
    h = h.withColumn("_tail", F.collect_list("_w").over(w.rowsBetween(-tail, -1)))
    own = own_rows(h)
    heads = own.groupBy(*keys, "batch").agg(F.min_by("_tail", order).alias("_t"), F.max("switched").alias("_s"))
    j = own.join(heads.filter("_s").drop("_s"), [*keys, "batch"]).filter("_w <> ''")
    return j.groupBy(*keys, "batch").agg(F.count_if(F.array_contains(F.col("_t"), F.col("_w"))).alias("overlap"), F.count(F.lit(1)).alias("n_words"))


def suppression_streaks(events: DataFrame, keys: list[str], order: str, n: int = 5) -> DataFrame:
    """Every n-th suppression in a row (emissions reset, punctuation-only ones do
    not count). ``events``: suppressed, punct_only."""
    s = scan(events, keys, [order], rows_block(order), _isl=running_sum(F.when(F.col("suppressed"), 0).otherwise(1)))
    counted = s.filter(F.col("suppressed") & ~F.col("punct_only"))
    c = scan(counted, [*keys, "_isl"], [order], rows_block(order), streak=row_no())
    return c.filter(F.col("streak") % n == 0).select(*keys, order, "streak")

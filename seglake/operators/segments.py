"""From tokens, silences and markers to finalized lines.

Input rows: keys, pos (dense arrival order), kind (text, silence, lang_switch),
start_ms, end_ms, text, lang. Segments: keys, seg_no, kind, start_ms, end_ms,
text, lang, punct, hard (a language switch closes it)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..functions.folds import fold_sorted
from ..functions.ordered import (before_known, following, islands, next_known, own_rows, prev, rows_block, running_sum,
                                 scan, shared, whole_max, with_halo)
from ..session import cut
from .sets import content_words


def segment(rows: DataFrame, keys: list[str], sep: str = " ") -> DataFrame:
    """Cut at silences, language switches and justified punctuation: at the end,
    before a silence, or a full stop that really ends a sentence."""
    h = with_halo(rows, "pos", 1, 1)
    w = Window.partitionBy(*keys, "_blk").orderBy("pos")
    h = h.withColumn("_nk", F.lead("kind").over(w)).withColumn("_nt", F.lead("text").over(w)).withColumn("_pk", F.lag("kind").over(w))
    next_text = F.when(F.col("_nk") == "text", F.col("_nt"))
    mark = X.ends_sentence_mark("text")
    stop = F.col("text").rlike(r"[.。]\s*$") & X.genuine_end("text", next_text)
    h = h.withColumn("_cut", (F.col("kind") == "text") & F.coalesce(mark & (F.col("_nk").isNull() | (F.col("_nk") == "silence") | stop), F.lit(False)))
    h = h.withColumn("_pc", F.lag("_cut").over(w))
    h = h.withColumn("_hard", (F.coalesce(F.col("_nk") == "lang_switch", F.lit(False))) & ~F.col("_cut"))
    starts = F.col("_pk").isNull() | (F.col("kind") != "text") | (F.col("_pk") != "text") | F.coalesce("_pc", F.lit(False))
    flat = own_rows(h.withColumn("_st", starts)).filter("kind <> 'lang_switch'")
    flat = scan(flat.withColumn("_n", F.when(F.col("_st"), 1).otherwise(0)), keys, ["pos"], rows_block("pos"), seg_no=running_sum("_n"))
    g = flat.groupBy(*keys, "seg_no").agg(
        F.first("kind").alias("kind"), F.min_by("start_ms", "pos").alias("start_ms"), F.max_by("end_ms", "pos").alias("end_ms"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("pos", "text")))).alias("_w"),
        F.min_by("lang", "pos").alias("lang"), F.max("_cut").alias("punct"), F.max_by("_hard", "pos").alias("hard"))
    text = F.when(F.col("kind") == "text", F.array_join(F.transform("_w", lambda x: x["text"]), sep))
    return g.select(*keys, "seg_no", "kind", "start_ms", "end_ms", text.alias("text"), "lang", "punct", "hard")


def grammar_gate(segments: DataFrame, keys: list[str], now: Column | None = None, flush: bool = False, speakers: bool = False,
                 hard_ms: int = V.SILENCE_HARD_MS, cap_ms: int = V.PENDING_CAP_MS) -> DataFrame:
    """Decide for each silence after an unfinished text whether it splits. Adds
    decision (split, merge, pending, NULL when not examined), path, pending and
    speaker_split; merged silences are removed; examined runs become one row."""
    s = segments if "speaker" in segments.columns else segments.withColumn("speaker", F.when(F.col("kind") == "silence", -2).otherwise(-1))
    blk = rows_block("seg_no")
    # the plan above would be copied by each of the scans below: write it once
    s = cut(s)
    around = F.struct("kind", "punct", "text", "lang", "hard", "speaker")
    s = scan(s, keys, ["seg_no"], blk, _pk=prev("kind"))
    run = (F.col("kind") != "silence") | (F.coalesce(F.col("_pk"), F.lit("")) != "silence")
    s = scan(s.withColumn("_st", F.when(run, 1).otherwise(0)), keys, ["seg_no"], blk, _run=running_sum("_st"),
             _prev=before_known(F.when(F.col("kind") == "text", F.struct(F.col("seg_no").alias("no"), around.alias("s")))))
    # a run of silences is examined when a text without final punctuation stands right before it
    s = shared(s, *keys, "_run")
    first = s.groupBy(*keys, "_run").agg(F.min("seg_no").alias("_first"))
    s = s.join(first, [*keys, "_run"])
    examined = (F.col("kind") == "silence") & F.coalesce((F.col("_prev.no") == F.col("_first") - 1) & ~F.col("_prev.s.punct"), F.lit(False))
    s = cut(s.withColumn("_ex", examined)).withColumn("_g", F.when(F.col("_ex"), F.col("_first")).otherwise(F.col("seg_no")))
    m = s.groupBy(*keys, "_g").agg(
        F.first("kind").alias("kind"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min_by("text", "seg_no").alias("text"),
        F.min_by("lang", "seg_no").alias("lang"), F.max("punct").alias("punct"), F.max("hard").alias("hard"), F.first("speaker").alias("speaker"),
        F.max("_ex").alias("_ex"), F.min_by("_prev", "seg_no").alias("_prev")).withColumnRenamed("_g", "seg_no")
    m = scan(m, keys, ["seg_no"], blk, _next=following(around))
    nxt = F.when(F.col("_next.kind") == "text", F.col("_next"))
    before = F.col("_prev.s")
    long = F.col("end_ms") - F.col("start_ms") >= hard_ms
    verdict = X.split_after_silence(before["text"], nxt["text"])
    open_next = nxt.isNull() | (F.lit(speakers) & F.coalesce(nxt["speaker"] == -1, F.lit(False)))
    expired = F.lit(flush) | (F.coalesce(now - F.col("end_ms") >= cap_ms, F.lit(False)) if now is not None else F.lit(False))
    differ = F.lit(speakers) & F.coalesce(nxt["speaker"] != before["speaker"], F.lit(False))
    path = (
        F.when(~F.col("_ex"), None).when(long & F.coalesce(verdict, F.lit(True)), "split_hard").when(open_next & expired, "split_cap")
        .when(open_next, "pending").when(F.col("hard") | before["hard"], "split_grammar").when(differ, "split_grammar")
        .when(~before["lang"].eqNullSafe(nxt["lang"]), "split_grammar").when(F.coalesce(verdict, F.lit(True)), "split_grammar").otherwise("merge"))
    m = m.withColumn("path", path).withColumn("decision", F.when(F.col("path").startswith("split"), "split").otherwise(F.col("path")))
    m = m.withColumn("speaker_split", F.coalesce(F.col("decision") == "split", F.lit(False)) & differ & F.coalesce(nxt["speaker"] != -1, F.lit(False)) & F.coalesce(before["speaker"] != -1, F.lit(False)))
    m = m.filter(~F.coalesce(F.col("decision") == "merge", F.lit(False)))
    m = scan(m, keys, ["seg_no"], blk, _nd=following("decision"))
    pending = F.coalesce(F.col("decision") == "pending", F.lit(False)) | ((F.col("kind") == "text") & F.coalesce(F.col("_nd") == "pending", F.lit(False)))
    return m.withColumn("pending", pending).drop("_ex", "_prev", "_next", "_nd")


def finalize_lines(segments: DataFrame, keys: list[str], sep: str = " ") -> DataFrame:
    """Merge neighbours of one speaker and name what closed each line: language
    switch, speaker change, punctuation, silence, in this order. All lines but
    the last are final, pending ones never."""
    s = segments
    for name in ("pending", "speaker_split"):
        if name not in s.columns:
            s = s.withColumn(name, F.lit(False))
    s = cut(s)
    starts = F.col("_p").isNull() | (F.col("_p.speaker") != F.col("speaker")) | F.col("_p.hard") | F.col("_p.punct")
    s = islands(s, keys, ["seg_no"], rows_block("seg_no"), starts, "line", _p=prev(F.struct("speaker", "hard", "punct")))
    g = s.groupBy(*keys, "line").agg(
        F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "seg_no").alias("end_ms"), F.first("speaker").alias("speaker"),
        F.array_sort(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", F.struct("seg_no", "text")))).alias("_t"),
        F.min_by("lang", "seg_no").alias("lang"), F.max_by("hard", "seg_no").alias("hard"), F.max_by("punct", "seg_no").alias("punct"),
        F.min_by("pending", "seg_no").alias("pending"), F.min_by("speaker_split", "seg_no").alias("speaker_split"))
    g = cut(g.withColumn("text", F.array_join(F.transform("_t", lambda x: x["text"]), sep)).drop("_t"))
    g = scan(g, keys, ["line"], rows_block("line"), _n=following(F.struct("speaker", "speaker_split")), _top=whole_max("line"))
    trigger = F.when(F.col("_n").isNotNull() & (F.col("speaker") != -2),
        F.when(F.col("hard"), "language_switch")
        .when(F.col("_n.speaker") == -2, F.when(F.col("pending"), None).when(F.col("_n.speaker_split"), "speaker_change")
              .when(X.ends_sentence_mark("text"), "punctuation").otherwise("silence"))
        .when(F.col("_n.speaker") != F.col("speaker"), "speaker_change").when(F.col("punct"), "punctuation").otherwise("speaker_change"))
    return g.withColumn("finalize_trigger", trigger).withColumn("finalized", (F.col("line") < F.col("_top")) & ~F.col("pending")).drop("_n", "_top", "speaker_split")


def finalize_grace(lines: DataFrame, keys: list[str], now: Column, flush: bool = False, grace_ms: int = V.FINALIZE_GRACE_MS) -> DataFrame:
    """While the last row is a fresh silence, the text before it is not final."""
    s = scan(cut(lines), keys, ["line"], rows_block("line"), _n=following(F.struct("line", "speaker", "start_ms", "pending")), _top=whole_max("line"))
    watched = F.coalesce((F.col("_n.line") == F.col("_top")) & (F.col("_n.speaker") == -2) & ~F.col("_n.pending") & (F.col("speaker") != -2) & (F.col("text") != ""), F.lit(False))
    ok = F.lit(flush) | (now - F.col("_n.start_ms") >= grace_ms)
    return s.withColumn("finalized", F.when(watched, ok).otherwise(F.col("finalized"))).withColumn(
        "finalize_trigger", F.when(watched, F.when(ok, F.when(X.ends_sentence_mark("text"), "punctuation").otherwise("silence")))
        .otherwise(F.col("finalize_trigger"))).drop("_n", "_top")


def reattach(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Move late tails in front of the silence they precede. Adds ``place`` (new
    dense order). A text row that is not late for the last silence clears the
    state, so the fold only sees the short stretches in between."""
    sil = F.when(F.col("kind") == "silence", F.col("start_ms"))
    late = lambda s: (F.col("start_ms") + V.TAIL_EPS_MS < s) & (s - F.col("start_ms") <= V.TAIL_LOOKBACK_MS)
    s = scan(rows, keys, ["pos"], rows_block("pos"), _sil=before_known(sil))
    s = s.withColumn("_clear", (F.col("kind") == "lang_switch") | ((F.col("kind") == "text") & ~F.coalesce(late(F.col("_sil")), F.lit(False))))
    s = scan(s, keys, ["pos"], rows_block("pos"), _isl=running_sum(F.when(F.col("_clear"), 1).otherwise(0)))
    names = ", ".join(f"{k} long" for k in keys)

    def start(key):
        return {"key": key[:-1], "trail": []}

    def step(st, row):
        pos, at, anchor = row["pos"], row["start_ms"], (row["pos"], 1)
        if row["kind"] == "silence":
            st["trail"].append((pos, at))
        elif row["kind"] == "text":
            k = len(st["trail"])
            while k and at + V.TAIL_EPS_MS < st["trail"][k - 1][1] <= at + V.TAIL_LOOKBACK_MS:
                k -= 1
            if k < len(st["trail"]):
                anchor, st["trail"] = (st["trail"][k][0], 0), st["trail"][k:]
            else:
                st["trail"] = []
        else:
            st["trail"] = []
        yield (*st["key"], pos, *anchor)

    src = s.select(*keys, "_isl", "pos", "kind", "start_ms")
    placed = fold_sorted(src, [*keys, "_isl"], ["pos"], f"{names}, pos long, anchor long, rank int", start, step)
    ranked = scan(placed, keys, ["anchor", "rank", "pos"], rows_block("anchor"), place=running_sum(F.lit(1).cast("bigint")))
    return rows.join(ranked.select(*keys, "pos", "place"), [*keys, "pos"])


def retract(rows: DataFrame, keys: list[str], keep_ms: int = 2500) -> DataFrame:
    """Tombstones at language switches. ``rows`` also has boundary_t, prev_lang
    and floor on switch rows (boundary_t NULL = no retraction). Adds ``zone``
    (NULL = kept): near or after the boundary, opposite script, same script close by."""
    marker = F.when(F.col("kind") != "text", F.struct("kind", "boundary_t", "prev_lang", "floor"))
    s = scan(rows, keys, ["pos"], rows_block("pos"), _m=next_known(marker), _span=running_sum(F.when(F.col("kind") != "text", 1).otherwise(0)))
    low = F.coalesce(F.col("_m.floor"), F.col("_m.boundary_t") - keep_ms - 1000)
    s = s.withColumn("_live", (F.col("kind") == "text") & F.coalesce((F.col("_m.kind") == "lang_switch") & F.col("_m.boundary_t").isNotNull(), F.lit(False))).withColumn("_low", low)
    s = cut(s)
    stops = s.filter("_live and start_ms < _low").groupBy(*keys, "_span").agg(F.max("pos").alias("_stop"))
    s = s.join(stops, [*keys, "_span"], "left")
    gap = F.col("_m.boundary_t") - F.col("start_ms")
    zone = F.when(F.col("_live") & (F.col("pos") > F.coalesce("_stop", F.lit(-1))) & (F.col("lang") == F.col("_m.prev_lang")),
        F.when(gap <= V.RETRACT_EPS_MS, "zone1").when(X.opposite_script("text", F.col("_m.prev_lang")), "zone2_opposite").when(gap <= V.SAME_SCRIPT_ZONE_MS, "zone2_samescript"))
    return s.withColumn("zone", zone).select(*rows.columns, "zone")


def collapse_stubs(lines: DataFrame, keys: list[str], order: str, max_words: int = 2) -> DataFrame:
    """Lines of one or two words closed by a language switch: dropped when a
    content word is in the line before, else merged back into it; never across
    speakers. Silence rows stay."""
    text = lines.filter((F.col("speaker") != -2) & (X.strip(F.coalesce("text", F.lit(""))) != ""))
    rest = lines.join(text.select(*keys, order), [*keys, order], "left_anti")
    t = scan(text, keys, [order], rows_block(order), _ps=prev("speaker"))
    stub = (F.col("finalize_trigger") == "language_switch") & (F.size(X.words("text")) <= max_words)
    t = t.withColumn("_stub", F.coalesce(stub & (F.col("_ps") == F.col("speaker")), F.lit(False)))
    t = scan(t, keys, [order], rows_block(order), _grp=running_sum(F.when(F.col("_stub"), 0).otherwise(1)))
    item = F.struct(F.col(order).alias("o"), F.col("text").alias("t"), F.col("end_ms").alias("e"), F.col("finalize_trigger").alias("g"), F.col("_stub").alias("s"), content_words("text").alias("c"))
    g = t.groupBy(*keys, "_grp").agg(F.array_sort(F.collect_list(item)).alias("_i"), F.min(order).alias(order))
    state = lambda tx, e, gr: F.struct(tx.alias("t"), e.alias("e"), gr.alias("g"))
    head = F.get("_i", F.lit(0))

    def step(acc, x):
        seen = F.transform(X.words(acc["t"]), X.edge_form)
        dup = F.exists(x["c"], lambda w: F.array_contains(seen, w))
        return F.when(~x["s"] | dup, acc).otherwise(state(F.concat(acc["t"], x["t"]), F.greatest(acc["e"], x["e"]), x["g"]))

    done = F.aggregate("_i", state(head["t"], head["e"], head["g"]), step)
    base = text.drop("text", "end_ms", "finalize_trigger").join(g.select(*keys, order, done.alias("_d")), [*keys, order])
    merged = base.select("*", F.col("_d.t").alias("text"), F.col("_d.e").alias("end_ms"), F.col("_d.g").alias("finalize_trigger")).drop("_d")
    return merged.select(*lines.columns).unionByName(rest.select(*lines.columns))


def group_sentences(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Lines to sentences: closed by a speaker change, a forced line, or a
    completed line ending in a full stop or question mark."""
    bare = X.strip("text")
    closes = F.col("forced") | (F.col("completed") & bare.rlike(r"[.?]$"))
    d = lines.withColumn("_c", closes).withColumn("_t", bare)
    s = islands(d, keys, [order], rows_block(order), F.col("_p").isNull() | F.col("_p._c") | (F.col("_p.speaker") != F.col("speaker")), "sentence",
                _p=prev(F.struct("_c", "speaker")))
    s = scan(s, keys, [order], rows_block(order), _ns=following("speaker"))
    g = s.groupBy(*keys, "sentence").agg(
        F.first("speaker").alias("speaker"), F.array_sort(F.collect_list(F.struct(order, "_t"))).alias("_w"),
        F.max_by("_c", order).alias("_closed"), F.max_by(F.coalesce(F.col("_ns") != F.col("speaker"), F.lit(False)), order).alias("_turn"), F.max_by("completed", order).alias("_done"))
    return g.select(*keys, "sentence", "speaker", F.concat(F.array_join(F.transform("_w", lambda x: x["_t"]), " "), F.lit(" ")).alias("text"),
                    (F.col("_closed") | F.col("_turn") | F.col("_done")).alias("completed"))



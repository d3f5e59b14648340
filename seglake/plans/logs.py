"""Log queries. Log lines in the servers' formats are made from the event table;
the SQL states the expected outcome from the events themselves."""

from pyspark.sql import functions as F

from ..operators import logs as L
from ..sources import logs as SL
from .registry import query

K = ["file_id"]


def lines(t):
    n, k, e = t.numbered_events(), F.col("k"), F.col("event_type")
    s = lambda c: c.cast("string")
    line = (
        F.when(e == "click", F.concat(F.lit("[EndSilence] dur="), s(k), F.lit(".0s branch="), F.when(k >= 80, "long").when(k >= 40, "short").otherwise("none"), F.lit(" det_lang=ko lang_before_reset=None")))
        .when((e == "view") & (k % 3 == 0), F.concat(F.lit("x [CrossBatchFilter] 반복 제거: w"), s(k % 7), F.lit(" (prev=w"), s(k % 7), F.lit(")")))
        .when((e == "view") & (k % 3 == 1), F.concat(F.lit("[LangSwitch] 토크나이저 적용: en (prev=ko, switch="), F.when(k % 2 == 0, "True").otherwise("False"), F.lit(", skip_trim=False)")))
        .when(e == "view", F.concat(F.lit("[QualityGate] avg_logprob -1.20 < -1.00 — suppressing: bad "), s(k)))
        .when((e == "error") & (k % 2 == 0), F.concat(F.lit("SimulStreaming processing error: The size of tensor a ("), s(F.col("n") * 4), F.lit(") must match the size of tensor b ("), s(k % 4), F.lit(") at non-singleton dimension 1")))
        .when(e == "error", F.concat(F.lit("SimulStreaming stall recovery: "), s(k), F.lit(".0s without output")))
        .when(e == "signup", F.concat(F.lit("[NewSpeaker] spk=0→"), s(k % 3), F.lit(" det_before=ko eager=True")))
        .when(k % 3 == 0, F.concat(F.lit("[SotLangProbe] t_abs="), s(F.col("n")), F.lit(".5 batch="), s(F.col("n")), F.lit(" locked="), F.when(k % 2 == 0, "en").otherwise("None"), F.lit(" p_ko=0."), F.lpad(s(k), 2, "0"), F.lit(" p_en=nan")))
        .when(k % 3 == 1, F.concat(F.lit("align_att_base:Output: hello "), s(k)))
        .otherwise(F.concat(F.lit("Silence of = "), s(k), F.lit(".5s lag="), s((k * 7) % 100), F.lit(".0s last_end = "), s(F.floor(F.col("n") / 4)), F.lit(".0"))))
    return n.select(F.col("user_id").alias("file_id"), F.col("n").alias("line_no"), line.alias("line"))


E = "e AS (SELECT user_id AS file_id, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS line_no, event_type AS y, k FROM evt)"


@query("src04a_silence_boundaries", f"""WITH {E}, c AS (SELECT *, sum(CASE WHEN y = 'view' AND k % 3 = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_no) AS s FROM e)
   SELECT file_id, line_no, k + 0.5 AS dur, (k * 7) % 100 * 1.0 AS lag, line_no // 4 * 1.0 AS last_end, CAST(s - lag(s, 1, 0) OVER (PARTITION BY file_id ORDER BY line_no) AS BIGINT) AS suppressed, 0 AS refreshes FROM c WHERE y = 'purchase' AND k % 3 = 2""")
def _(t):
    return SL.silence_boundaries(lines(t), K)


@query("src04b_switch_events", f"""WITH {E} SELECT file_id, line_no, CASE WHEN y = 'click' THEN 'end_silence' WHEN y = 'view' AND k % 3 = 0 THEN 'cross_batch' WHEN y = 'view' THEN 'switch_apply' WHEN y = 'error' AND k % 2 = 0 THEN 'tensor_mismatch' WHEN y = 'error' THEN 'stall' WHEN y = 'signup' THEN 'new_speaker' ELSE 'output' END AS kind,
   CASE WHEN y = 'click' THEN CASE WHEN k >= 80 THEN 'long' WHEN k >= 40 THEN 'short' ELSE 'none' END END AS branch, CASE WHEN y = 'error' AND k % 2 = 0 THEN line_no * 4 END AS a FROM e
   WHERE NOT (y = 'view' AND k % 3 = 2) AND NOT (y = 'purchase' AND k % 3 <> 1)""")
def _(t):
    ev = SL.log_events(lines(t), SL.SWITCH_CATALOG, K)
    return ev.select("file_id", "line_no", "kind", F.col("captures")["branch"].alias("branch"), F.col("captures")["a"].cast("bigint").alias("a"))


@query("src04c_drop_events", f"""WITH {E} SELECT file_id, line_no, CASE WHEN y = 'view' AND k % 3 = 0 THEN 'cross_batch' WHEN y = 'view' THEN 'gate_logprob' WHEN y = 'error' AND k % 2 = 0 THEN 'tensor_mismatch' WHEN y = 'error' THEN 'stall' WHEN y = 'signup' THEN 'new_speaker' ELSE 'output' END AS kind,
   CASE WHEN y = 'view' AND k % 3 = 2 THEN 'bad ' || k END AS txt FROM e WHERE y IN ('error', 'signup') OR (y = 'view' AND k % 3 <> 1) OR (y = 'purchase' AND k % 3 = 1)""")
def _(t):
    ev = SL.log_events(lines(t), SL.DROP_CATALOG, K)
    return ev.select("file_id", "line_no", "kind", F.col("captures")["text"].alias("txt"))


def boundary_lines(t):
    n, k, e = t.numbered_events(), F.col("k"), F.col("event_type")
    s = lambda c: c.cast("string")
    at = F.concat(s(F.floor(F.col("n") / 3)), F.lit(".25"))
    line = (
        F.when(e == "click", F.concat(F.lit("[RetractScan] boundary_t="), at, F.lit(" prev_lang="), F.when(k % 2 == 0, "ko").otherwise("en"), F.lit(" scanned=3 removed="), s(k % 3), F.lit(" stopped_by=silence")))
        .when(e == "view", F.concat(F.lit("[Reconcile] resolve reason=d1 boundary_t="), at, F.lit(" cut="), F.when(k % 2 == 0, "NA").otherwise("1.5"), F.lit(" covered=1 restored="), s(k % 2), F.lit(" replaced="), s(k % 3)))
        .when(e == "error", F.concat(F.lit("[Restore] 복원: 'w"), s(k), F.lit("' start=1.50 dstart="), F.when(k % 4 == 0, F.lit("NA")).otherwise(F.concat(s(k), F.lit(".5"))), F.lit(" boundary_t="), at, F.lit(" zone=zone1 gap_prev=0.1")))
        .when(e == "signup", F.concat(F.lit("[TimeDedup] action=drop text='a' start=2.00 dstart=0."), s(k), F.lit(" boundary_t="), at))
        .otherwise(F.concat(F.lit("[Replace] 늦은 대체(late): 'b' start=3.00 dstart=-0.50 boundary_t="), at, F.lit(" zone=zone2_opposite"))))
    return n.select(F.col("user_id").alias("file_id"), F.col("n").alias("line_no"), line.alias("line"))


@query("src04d_boundary_events", f"""WITH {E} SELECT file_id, line_no, CASE y WHEN 'click' THEN 'retract_scan' WHEN 'view' THEN 'resolve' WHEN 'error' THEN 'restore' WHEN 'signup' THEN 'dedup' ELSE 'replace_late' END AS kind,
   line_no // 3 + 0.25 AS boundary_t, CASE WHEN y = 'view' AND k % 2 = 1 THEN 1.5 END AS cut_at, CASE WHEN y = 'error' THEN 'w' || k WHEN y = 'signup' THEN 'a' WHEN y = 'purchase' THEN 'b' END AS txt FROM e""")
def _(t):
    ev = SL.log_events(boundary_lines(t), SL.BOUNDARY_CATALOG, K)
    c = F.col("captures")
    return ev.select("file_id", "line_no", "kind", c["boundary_t"].cast("double").alias("boundary_t"), c["cut"].try_cast("double").alias("cut_at"), SL.unquote(c["text"]).alias("txt"))


@query("src04e_probe_rows", f"""WITH {E}, p AS (SELECT *, CASE WHEN k % 3 = 0 THEN line_no END AS pl FROM e WHERE y = 'purchase' AND k % 3 <> 2),
   q AS (SELECT *, max(pl) OVER (PARTITION BY file_id ORDER BY line_no) AS lp FROM p)
   SELECT q.file_id, q.line_no, CASE WHEN q.k % 3 = 0 THEN 'probe' ELSE 'output' END AS kind, q.lp + 0.5 AS last_t, CASE WHEN r.k % 2 = 0 THEN 'en' END AS locked_now, CASE WHEN q.k % 3 = 0 AND q.k % 2 = 0 THEN q.k / 100.0 END AS p_opp, CASE WHEN q.k % 3 = 1 THEN 'hello ' || q.k END AS txt
   FROM q LEFT JOIN e r ON r.file_id = q.file_id AND r.line_no = q.lp""")
def _(t):
    return SL.probe_rows(lines(t), K).select("file_id", "line_no", "kind", "last_t", "locked_now", "p_opp", F.col("text").alias("txt"))


@query("agg15_drop_summary", f"""WITH {E}, a AS (SELECT file_id, line_no AS al FROM e WHERE y = 'signup'), d AS (SELECT * FROM e WHERE y = 'view' AND k % 3 = 2),
   n AS (SELECT d.file_id, d.line_no, coalesce(min(abs(al - line_no)) <= 5, false) AS near FROM d LEFT JOIN a USING (file_id) GROUP BY ALL), g AS (SELECT file_id, count(*) AS drops, count(CASE WHEN near THEN 1 END) AS near_change FROM n GROUP BY file_id),
   m AS (SELECT file_id, count(CASE WHEN y = 'error' AND k % 2 = 0 THEN 1 END) AS tm FROM e WHERE y IN ('error', 'signup') OR (y = 'view' AND k % 3 <> 1) OR (y = 'purchase' AND k % 3 = 1) GROUP BY file_id)
   SELECT m.file_id, coalesce(drops, 0) AS drops, coalesce(near_change, 0) AS near_change, coalesce(drops - near_change, 0) AS far_or_none, tm AS tensor_mismatch, tm > 0 AS broken, CASE WHEN tm > 0 THEN 'tensor_mismatch' ELSE '' END AS reasons FROM m LEFT JOIN g USING (file_id)""")
def _(t):
    d = L.drop_summary(SL.log_events(lines(t), SL.DROP_CATALOG, K), K, 5)
    return d.select("file_id", "drops", "near_change", "far_or_none", "tensor_mismatch", "broken", "reasons")


@query("agg16_boundary_rates", f"""WITH {E}, b AS (SELECT file_id, line_no, k + 0.5 AS dur, (k * 7) % 100 AS lg, line_no // 4 AS le, lag(line_no // 4) OVER (PARTITION BY file_id ORDER BY line_no) AS pe FROM e WHERE y = 'purchase' AND k % 3 = 2)
   SELECT file_id, count(*) AS total, count(CASE WHEN le <= pe THEN 1 END) AS zero_emission, 0 AS with_refresh, count(CASE WHEN lg >= dur THEN 1 END) AS ordering_risk, round(count(CASE WHEN le <= pe THEN 1 END) / count(*), 6) AS zero_emission_rate, 0.0 AS with_refresh_rate, round(count(CASE WHEN lg >= dur THEN 1 END) / count(*), 6) AS ordering_risk_rate FROM b GROUP BY file_id""")
def _(t):
    return L.boundary_rates(SL.silence_boundaries(lines(t), K), K)


LOSS = f"""{E} SELECT file_id, count(CASE WHEN y = 'error' AND k % 2 = 0 THEN 1 END) AS tensor_mismatches, count(CASE WHEN y = 'view' AND k % 3 = 1 AND k % 2 = 0 THEN 1 END) AS switch_true, count(CASE WHEN y = 'view' AND k % 3 = 1 AND k % 2 = 1 THEN 1 END) AS switch_false,
   count(CASE WHEN y = 'view' AND k % 3 = 0 THEN 1 END) AS cross_batch, count(CASE WHEN y = 'error' AND k % 2 = 1 THEN 1 END) AS stalls, count(CASE WHEN y = 'purchase' AND k % 3 = 1 THEN 1 END) AS outputs, count(CASE WHEN y = 'click' AND k >= 80 THEN 1 END) AS long_silences, count(CASE WHEN y = 'click' AND k >= 40 AND k < 80 THEN 1 END) AS short_silences FROM e GROUP BY file_id"""
LOSS_COLUMNS = ["tensor_mismatches", "switch_true", "switch_false", "cross_batch", "stalls", "outputs", "long_silences", "short_silences"]


@query("agg17_loss_summary", f"WITH {LOSS}")
def _(t):
    return L.loss_summary(SL.log_events(lines(t), SL.SWITCH_CATALOG, K), K).select("file_id", *LOSS_COLUMNS)


@query("agg17_loss_totals", f"WITH {LOSS.replace(' SELECT file_id, count', ', s AS (SELECT file_id, count', 1)}) SELECT count(*) AS files, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in LOSS_COLUMNS)} FROM s")
def _(t):
    return L.totals(L.loss_summary(SL.log_events(lines(t), SL.SWITCH_CATALOG, K), K), K).select("files", *LOSS_COLUMNS)


@query("agg20_delta_distribution", f"""WITH {E}, v AS (SELECT CASE y WHEN 'error' THEN 'restore' WHEN 'signup' THEN 'dedup' ELSE 'replace_late' END AS kind, CASE WHEN y = 'error' AND k % 4 <> 0 THEN k + 0.5 WHEN y = 'signup' THEN CAST('0.' || k AS DOUBLE) WHEN y = 'purchase' THEN -0.5 END AS d FROM e)
   SELECT kind, count(*) AS n, min(d) AS min, max(d) AS max, round(median(d), 6) AS median FROM v WHERE d IS NOT NULL GROUP BY kind""")
def _(t):
    ev = SL.log_events(boundary_lines(t), SL.BOUNDARY_CATALOG, K).filter(F.col("kind").isin("restore", "dedup", "replace_late"))
    return L.delta_distribution(ev.withColumn("d", F.col("captures")["dstart"].try_cast("double")), "kind", "d").withColumn("median", F.round("median", 6))


@query("agg21_boundary_verdicts", f"""WITH {E}, s AS (SELECT file_id, line_no, line_no // 3 * 1000 + 250 AS bt, CASE WHEN k % 2 = 0 THEN 'ko' ELSE 'en' END AS pl, k % 3 AS rm FROM e WHERE y = 'click'),
   v AS (SELECT file_id, line_no AS rl, line_no // 3 * 1000 + 250 AS rt, k % 2 AS re, k % 3 AS rp FROM e WHERE y = 'view'), m AS (SELECT s.file_id, s.line_no, min(rl) AS rl FROM s JOIN v ON s.file_id = v.file_id AND abs(bt - rt) < 50 GROUP BY ALL),
   x AS (SELECT s.*, v.re, v.rp, row_number() OVER (PARTITION BY s.file_id ORDER BY s.line_no) AS o FROM s LEFT JOIN m USING (file_id, line_no) LEFT JOIN v ON v.file_id = m.file_id AND v.rl = m.rl),
   b AS (SELECT file_id, line_no AS no, k % 2 AS bd, k % 3 AS ad, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS o FROM e WHERE y = 'signup')
   SELECT b.file_id, b.no, CASE WHEN bd = 0 AND ad = 0 THEN 'normal' ELSE concat_ws('+', CASE WHEN bd > 0 THEN 'old_language_tail' END, CASE WHEN ad > 0 THEN CASE WHEN pl = 'ko' AND rm > 0 THEN 'retracted' WHEN pl = 'ko' AND rm = 0 THEN 'never_emitted' ELSE 'other' END END) END AS series,
     CASE WHEN re IS NULL THEN NULL WHEN re = 0 AND rp = 0 THEN 'nothing' WHEN re > 0 AND rp > 0 THEN 'mixed' WHEN re > 0 THEN 'restored' ELSE 'replaced' END AS reconcile_status FROM b LEFT JOIN x USING (file_id, o)""")
def _(t):
    ev, c = SL.log_events(boundary_lines(t), SL.BOUNDARY_CATALOG, K), F.col("captures")
    ms = lambda x: F.round(x.cast("decimal(20,3)") * 1000, 0).cast("bigint")
    scans = ev.filter("kind = 'retract_scan'").select("file_id", "line_no", ms(c["boundary_t"]).alias("boundary_t"), c["prev_lang"].alias("prev_lang"), c["removed"].cast("bigint").alias("removed"))
    res = ev.filter("kind = 'resolve'").select("file_id", F.col("line_no").alias("r_line"), ms(c["boundary_t"]).alias("r_t"), c["restored"].cast("bigint").alias("restored"), c["replaced"].cast("bigint").alias("replaced"))
    b = t.numbered_events().filter("event_type = 'signup'").select(F.col("user_id").alias("file_id"), F.col("n").alias("no"), F.lit("ko").alias("before_lang"), (F.col("k") % 2).alias("before_del"), (F.col("k") % 3).alias("after_del"))
    return L.boundary_verdicts(b, scans, res, K)

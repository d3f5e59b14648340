"""Rollup queries."""

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import windows as W
from .registry import query
from .shared import with_silence

S = ["session_id"]
WER = "(subs + ins + dels) / ref_words"


def rows(t):
    """Evaluation rows with a latency; every third sample has none."""
    return t.bench.withColumn("latency_ms", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id") % 900)).withColumn(
        "wer", (F.col("subs") + F.col("ins") + F.col("dels")) / F.col("ref_words"))


BR = "br AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 900 END AS latency_ms FROM bench)"
SUMS = f"""count(*) AS n_samples, round(avg({WER}), 6) AS avg_wer, round(avg(proc_ms / duration_ms), 6) AS avg_rtf, round(sum(subs + ins + dels) / greatest(sum(ref_words), 1), 6) AS weighted_wer"""


@query("agg01_to_segments", """SELECT session_id, speaker, turn, arg_min(start_ms, seq) AS start_ms, arg_max(start_ms, seq) + 100 AS end_ms, string_agg(word, ' ' ORDER BY seq) AS "text", arg_min(lang, seq) AS lang FROM tok GROUP BY ALL""")
def _(t):
    return A.to_segments(t.tok.withColumn("end_ms", F.col("start_ms") + 100), ["session_id", "speaker", "turn"], "seq")


@query("agg03_wer_distribution", f"""WITH s AS (SELECT language, {WER} AS w, row_number() OVER (PARTITION BY language ORDER BY {WER}) - 1 AS i, count(*) OVER (PARTITION BY language) AS n FROM bench)
   SELECT language, max(CASE WHEN i = n // 2 THEN w END) AS median, max(CASE WHEN i = CAST(floor(n * 0.9) AS BIGINT) THEN w END) AS p90, max(CASE WHEN i = CAST(floor(n * 0.95) AS BIGINT) THEN w END) AS p95, max(n) AS n, count(CASE WHEN w = 0 THEN 1 END) AS n_zero FROM s GROUP BY language""")
def _(t):
    return A.wer_distribution(rows(t), ["language"])


ASCII = r"regexp_replace({0}, '[^\x00-\x7f]', '?', 'g')"


@query("agg03_char_error_rate", f"""WITH p AS (SELECT lang, {ASCII.format("upper(replace(text, 'ß', 'ss'))")} AS r, {ASCII.format("replace(upper(substring(replace(text, 'ß', 'ss'), 2)), ' EN', 'X')")} AS h FROM seg)
   SELECT lang, CAST(sum(levenshtein(r, h)) AS BIGINT) AS char_edits, CAST(sum(length(r)) AS BIGINT) AS ref_chars FROM p GROUP BY lang""")
def _(t):
    fold = lambda x: F.regexp_replace(x, r"[^\x00-\x7f]", "?")
    p = t.seg.withColumn("text", F.replace("text", F.lit("ß"), F.lit("ss"))).select("lang", fold(F.upper("text")).alias("r"), fold(F.replace(F.upper(F.substring("text", F.lit(2), F.length("text"))), F.lit(" EN"), F.lit("X"))).alias("h"))
    return A.char_errors(p, "r", "h").groupBy("lang").agg(F.sum("char_edits").alias("char_edits"), F.sum("ref_chars").alias("ref_chars"))


@query("agg04_bench_summary", f"""WITH {BR} SELECT {SUMS}, CAST(sum(duration_ms) AS BIGINT) AS audio_ms, CAST(sum(proc_ms) AS BIGINT) AS processing_ms, round(sum(proc_ms) / sum(duration_ms), 6) AS overall_rtf, round(avg(CASE WHEN latency_ms > 0 THEN latency_ms END), 6) AS avg_latency_ms FROM br""")
def _(t):
    return A.bench_summary(rows(t))


@query("agg05_bench_breakdown", f"""SELECT 'all' AS level, 'all' AS name, {SUMS} FROM bench UNION ALL SELECT 'language', language, {SUMS} FROM bench GROUP BY language UNION ALL SELECT 'category', category, {SUMS} FROM bench GROUP BY category""")
def _(t):
    return A.bench_breakdown(rows(t))


@query("agg06_session_metrics", """WITH c AS (SELECT user_id, k + 1 AS d, (k + 1) * 7 AS a, CASE WHEN event_type = 'view' THEN k ELSE 0 END AS s, row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM evt)
   SELECT user_id, count(*) AS n_calls, CAST(sum(d) AS BIGINT) AS processing_ms, CAST(sum(a) AS BIGINT) AS audio_ms, count(CASE WHEN s > 0 THEN 1 END) AS n_silences, CAST(sum(s) AS BIGINT) AS silence_ms,
     max(CASE WHEN i = least(CAST(floor(n * 0.95) AS BIGINT), n - 1) THEN d END) AS p95_ms, round(sum(d) / sum(a), 6) AS rtf, round(sum(d) / count(*), 6) AS avg_ms FROM c GROUP BY user_id""")
def _(t):
    k = F.col("k")
    c = t.evt.select("user_id", (k + 1).alias("duration_ms"), ((k + 1) * 7).alias("audio_ms"), F.when(F.col("event_type") == "view", k).otherwise(0).alias("silence_ms"))
    return A.session_metrics(c, ["user_id"])


@query("agg07_run_stats", f"""WITH r AS (SELECT language, category, CASE WHEN doc_id % 6 <> 0 THEN subs + ins END AS v FROM bench)
   SELECT language, category, min(v) AS min, max(v) AS max, count(v) AS n, median(v) AS median, round(CASE WHEN count(v) > 0 THEN coalesce(stddev_samp(v), 0.0) END, 6) AS stdev FROM r GROUP BY ALL""")
def _(t):
    return A.run_stats(t.bench.withColumn("v", F.when(F.col("doc_id") % 6 != 0, F.col("subs") + F.col("ins"))), ["language", "category"], "v")


@query("agg12_latin_recall", r"""WITH w AS (SELECT doc_id, regexp_extract_all(regexp_replace("text", '[^\x00-\x7f]', '_', 'g'), '\b[A-Za-z][A-Za-z''\-]+\b') AS r FROM documents)
   SELECT w.doc_id, len(r) AS n_latin, len(list_filter(r, lambda x: list_contains(string_split(p.hyp, ' '), lower(x)))) AS hits FROM w JOIN pair p USING (doc_id)""")
def _(t):
    p = t.pair.select("doc_id", "hyp").join(t.doc.select("doc_id", "text"), "doc_id")
    return A.latin_recall(p, "text", "hyp").select("doc_id", "n_latin", "hits")


@query("agg13_language_distribution", """SELECT source, CASE WHEN doc_id % 7 = 0 THEN 'unknown' ELSE lang END AS language, count(*) AS n_lines FROM documents GROUP BY ALL""")
def _(t):
    return A.language_distribution(t.doc.withColumn("lang", F.when(F.col("doc_id") % 7 != 0, F.col("lang"))), ["source"])


@query("agg14_type_token_ratio", """WITH tk AS (SELECT doc_id, list_transform(regexp_extract_all("text", '[A-Za-z'']+|[가-힣]+'), lambda x: lower(x)) AS w FROM documents)
   SELECT doc_id, len(w) AS n_words, CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) END AS ttr FROM tk""")
def _(t):
    return A.type_token_ratio(t.doc, "doc_id")


@query("agg14_repetition_summary")
def _(t):
    return A.repetition_summary(t.doc, W.repeat_runs(t.doc, "doc_id"), W.ttr_collapse(t.doc, "doc_id"), "doc_id")


LOCK = "CASE WHEN event_type = 'view' THEN 'ko' WHEN event_type = 'click' THEN 'en' END"


def probes(t):
    return t.evt.select("user_id", "event_id", F.expr(LOCK).alias("locked"), (F.col("k") / 100.0).alias("p_ko"), ((100 - F.col("k")) / 100.0).alias("p_en"), (F.col("value") / 100).alias("resid"))


@query("agg18_drift_stats", f"""WITH p AS (SELECT user_id, {LOCK} AS l, k / 100.0 AS p_ko, (100 - k) / 100.0 AS p_en, value / 100 AS resid FROM evt)
   SELECT user_id, count(*) AS probes, count(CASE WHEN l = 'ko' THEN 1 END) AS locked_ko, count(CASE WHEN l = 'en' THEN 1 END) AS locked_en, count(CASE WHEN l IS NULL THEN 1 END) AS locked_none,
     count(CASE WHEN (l = 'en' AND p_ko >= 0.9) OR (l = 'ko' AND p_en >= 0.9) THEN 1 END) AS mismatches, max(resid) AS max_resid, count(CASE WHEN resid >= 0.5 THEN 1 END) AS high_resid FROM p GROUP BY user_id""")
def _(t):
    return A.drift_stats(probes(t), ["user_id"])


@query("agg19_describe", """WITH s AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM evt)
   SELECT event_type, min(v) AS min, max(v) AS max, max(CASE WHEN i = round_even(0.25 * (n - 1), 0) THEN v END) AS q25, max(CASE WHEN i = round_even(0.75 * (n - 1), 0) THEN v END) AS q75,
     max(CASE WHEN i = round_even(0.9 * (n - 1), 0) THEN v END) AS q90, round(median(v), 6) AS median, max(n) AS n FROM s GROUP BY event_type""")
def _(t):
    return A.describe(t.evt, ["event_type"], "value").withColumn("median", F.round("median", 6))


@query("agg19_threshold_sweep", """SELECT tau, count(CASE WHEN event_type = 'signup' AND k / 100.0 >= tau THEN 1 END) AS target_hits, count(CASE WHEN event_type <> 'signup' AND k / 100.0 >= tau THEN 1 END) AS control_hits
   FROM evt, (SELECT unnest([0.5::DOUBLE, 0.7, 0.8, 0.9, 0.95, 0.97, 0.99, 0.995, 0.999]) AS tau) GROUP BY tau""")
def _(t):
    e = t.evt.select((F.col("k") / 100.0).alias("p"), (F.col("event_type") == "signup").alias("target"))
    return A.sweep(e, "p", "target", [0.5, 0.7, 0.8, 0.9, 0.95, 0.97, 0.99, 0.995, 0.999])


@query("agg22_timeline_counts", """SELECT session_id, count(DISTINCT CASE WHEN speaker > 0 THEN speaker END) AS n_speakers, CAST(sum(len(string_split("text", ' '))) AS BIGINT) AS committed_words,
     len(string_split(arg_max("text", seg_id), ' ')) AS buffer_words FROM seg GROUP BY session_id""")
def _(t):
    b = t.seg.groupBy("session_id").agg(F.max_by("text", "seg_id").alias("buffer"))
    return A.timeline_counts(with_silence(t), S, b)


@query("agg23_path_averages", f"""SELECT category, round(avg({WER}), 6) AS avg_wer, round(avg(CASE WHEN doc_id % 3 <> 0 THEN doc_id % 900 END), 6) AS avg_latency FROM bench GROUP BY category""")
def _(t):
    return A.path_averages(rows(t).withColumn("latency", F.when(F.col("doc_id") % 3 != 0, F.col("latency_ms"))), "category", ["wer", "latency"])


@query("agg25_scatter", """SELECT language, category, round(sum(subs + ins + dels) / greatest(sum(ref_words), 1) * 100, 4) AS wer_pct, round(sum(proc_ms) / sum(duration_ms), 6) AS rtf, count(*) AS n_samples FROM bench GROUP BY ALL""")
def _(t):
    return A.scatter(t.bench, ["language", "category"])


@query("agg27_compare_policies", """WITH r AS (SELECT *, 'p' || (doc_id % 2) AS policy, doc_id % 5 AS n_lines, doc_id % 900 AS latency_ms, doc_id % 11 <> 0 AS timing_valid FROM bench),
   m AS (SELECT policy, language, count(*) AS c FROM r GROUP BY ALL), x AS (SELECT policy, string_agg(language || '=' || c, ',' ORDER BY language) AS languages FROM m GROUP BY policy)
   SELECT policy, round(sum(subs + ins + dels) / greatest(sum(ref_words), 1), 6) AS wer, round(sum(proc_ms) / sum(duration_ms), 6) AS rtf, CAST(sum(n_lines) AS BIGINT) AS n_lines, round(avg(latency_ms), 6) AS avg_latency_ms, min(timing_valid) AS timing_valid, max(x.languages) AS languages
   FROM r JOIN x USING (policy) GROUP BY policy""")
def _(t):
    d = F.col("doc_id")
    r = t.bench.select("*", F.concat(F.lit("p"), (d % 2).cast("string")).alias("policy"), (d % 5).alias("n_lines"), (d % 900).alias("latency_ms"), (d % 11 != 0).alias("timing_valid"))
    mix = r.groupBy("policy", "language").agg(F.count(F.lit(1)).alias("n_lines"))
    c = A.compare_policies(r, mix, "policy")
    flat = F.array_join(F.transform(F.map_entries("languages"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return c.withColumn("languages", flat)


@query("agg28_lags", """SELECT user_id, greatest(round_even((max(ts_ms) - (max(ts_ms) - min(k) * 77)) / 1000.0, 1), 0) AS transcription_lag, greatest(round_even(((max(ts_ms) - min(k) * 77) - (max(ts_ms) - max(k) * 55)) / 1000.0, 1), 0) AS diarization_lag FROM evt GROUP BY user_id""")
def _(t):
    e = t.evt.groupBy("user_id").agg(F.max("ts_ms").alias("now_ms"), (F.max("ts_ms") - F.min("k") * 77).alias("text_end"), (F.max("ts_ms") - F.max("k") * 55).alias("speaker_end"))
    return A.lags(e, ["user_id"])



"""Feed and export queries."""

from pyspark.sql import functions as F

from ..operators import feed as FE
from ..operators import reports as RP
from ..sources import exports as EX
from ..sources.catalogs import flatten_words
from ..session import cut
from .registry import query
from .shared import with_silence

S = ["session_id"]
DELTA = """c AS (SELECT session_id, seq, list(line_id || '|' || line_text ORDER BY line_idx) AS ls FROM snap GROUP BY ALL), p AS (SELECT *, lag(ls) OVER (PARTITION BY session_id ORDER BY seq) AS pl FROM c),
   pr AS (SELECT *, CASE WHEN pl IS NULL THEN 0 ELSE coalesce(list_position(pl, ls[1]) - 1, len(pl)) END AS pruned FROM p), cm AS (SELECT *, CASE WHEN pl IS NULL THEN 0 ELSE coalesce(list_min(list_filter(range(1, len(ls) + 1), lambda i: ls[i] IS DISTINCT FROM pl[i + pruned])) - 1, len(ls)) END AS common FROM pr)"""


@query("str19_encode_deltas", f"WITH {DELTA} SELECT session_id, seq, CASE WHEN pl IS NULL THEN 'snapshot' ELSE 'diff' END AS type, len(ls) AS n_lines, pruned AS lines_pruned, len(ls) - common AS n_new FROM cm")
def _(t):
    return FE.encode_deltas(t.snap, S)[0]


@query("snk06_delta_lines", f"WITH {DELTA} SELECT s.session_id, s.seq, s.line_idx, s.line_id, s.line_text FROM snap s JOIN cm ON cm.session_id = s.session_id AND cm.seq = s.seq WHERE s.line_idx >= cm.common")
def _(t):
    return FE.encode_deltas(t.snap, S)[1]


@query("str20_decode_deltas", "SELECT session_id, line_idx, line_id, line_text, false AS desync FROM snap WHERE (session_id, seq) IN (SELECT (session_id, max(seq)) FROM snap GROUP BY session_id)")
def _(t):
    m, n = (cut(x) for x in FE.encode_deltas(cut(t.snap), S))
    return FE.decode_deltas(m, n, S, t.snap.groupBy(*S).agg(F.max("seq").alias("at")))


@query("str21_upsert_history", """WITH c AS (SELECT *, lag(line_text) OVER (PARTITION BY session_id, line_id ORDER BY seq) AS p FROM snap) SELECT session_id, line_id, arg_max(line_text, seq) AS line_text, count(CASE WHEN p IS NULL OR p <> line_text THEN 1 END) AS writes FROM c GROUP BY ALL""")
def _(t):
    return FE.upsert_history(t.snap, S, ["line_text"])


@query("str26_utterance_events", """WITH m AS (SELECT session_id, seg_id AS seq, seg_id // 2 AS nl, end_ms, CASE WHEN seg_id % 3 = 0 THEN '' ELSE "text" END AS b, start_ms + 4000 AS ss FROM seg), l AS (SELECT *, coalesce(lag(nl) OVER (PARTITION BY session_id ORDER BY seq), 0) AS s FROM m)
   SELECT session_id, seq, CASE WHEN nl > s THEN 'final' WHEN b <> '' THEN 'interim' END AS event, CASE WHEN nl > s THEN nl - s ELSE 0 END AS n_new, nl > 0 AND ss >= end_ms AS utterance_end FROM l""")
def _(t):
    m = t.seg.select("session_id", F.col("seg_id").alias("seq"), F.floor(F.col("seg_id") / 2).alias("n_lines"), F.col("end_ms").alias("last_end"),
                     F.when(F.col("seg_id") % 3 == 0, "").otherwise(F.col("text")).alias("buffer"), (F.col("start_ms") + 4000).alias("silence_start"))
    return FE.utterance_events(m, S)


@query("str28_freeze", """SELECT session_id, seg_id AS line_idx, speaker, CASE WHEN seg_id = max(seg_id) OVER (PARTITION BY session_id) THEN "text" || ' tail' ELSE "text" END AS line_text, true AS finalized FROM seg WHERE session_id % 3 <> 0 UNION ALL SELECT DISTINCT session_id, NULL, 1, 'tail', true FROM seg WHERE session_id % 3 = 0""")
def _(t):
    l = t.seg.filter("session_id % 3 <> 0").select("session_id", F.col("seg_id").alias("line_idx"), "speaker", F.col("text").alias("line_text"))
    return FE.freeze(l, t.seg.select("session_id", F.lit(" tail ").alias("tail")).distinct(), S)


@query("str31_commit_all_but_last", """WITH u AS (SELECT a.session_id, a.seq, a.turn, a.word, lead(a.word) OVER (PARTITION BY session_id, turn ORDER BY seq) AS nx FROM tok a)
   SELECT session_id, turn, string_agg(word, ' ' ORDER BY seq) AS committed FROM u GROUP BY ALL""")
def _(t):
    """Each turn arrives in three growing pieces; the last one flushes."""
    g = t.seg.withColumn("w", F.split("text", " "))
    u = g.select("session_id", F.col("seg_id").alias("turn"), F.explode(F.array(*[F.struct(F.lit(i).alias("seq"), F.array_join(F.slice("w", F.lit(1), F.ceil(F.size("w") * i / 3).cast("int")), " ").alias("text"), F.lit(i == 3).alias("flush")) for i in (1, 2, 3)])).alias("u"))
    c = FE.commit_all_but_last(u.select("session_id", "turn", "u.*"), ["session_id", "turn"])
    return c.groupBy("session_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "committed"))), lambda x: x["committed"]), " ").alias("committed"))


@query("str24_settle_retries", """SELECT user_id, k, CASE WHEN max(CASE WHEN event_type <> 'error' THEN event_id END) IS NOT NULL THEN 'r' || max(CASE WHEN event_type <> 'error' THEN event_id END) WHEN count(CASE WHEN event_type = 'error' THEN 1 END) >= 2 THEN '' END AS translation, count(CASE WHEN event_type = 'error' THEN 1 END) AS failures FROM evt GROUP BY ALL""")
def _(t):
    a = t.evt.select("user_id", "k", F.col("event_id").alias("at"), F.when(F.col("event_type") != "error", F.concat(F.lit("r"), F.col("event_id").cast("string"))).alias("result"))
    return FE.settle(a, ["user_id", "k"])


@query("str23_rederive", """SELECT session_id, frame_no, k < 10 OR (k % 3 < 2 AND row_number() OVER (PARTITION BY session_id ORDER BY frame_no DESC) <= 20) AS derive FROM frm""")
def _(t):
    l = t.frm.select("session_id", "frame_no", F.when(F.col("k") >= 10, "old").alias("translation"), (F.col("k") % 3).alias("revision"))
    return FE.rederive(l, S, "frame_no", 2).select("session_id", "frame_no", "derive")


def clock(col, mark):
    return f"printf('%02d:%02d:%02d{mark}%03d', {col} // 3600000, {col} // 60000 % 60, {col} // 1000 % 60, {col} % 1000)"


@query("snk01_subtitles_srt", f"""SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seg_id) AS cue, row_number() OVER (PARTITION BY session_id ORDER BY seg_id) || chr(10) || {clock('start_ms', ',')} || ' --> ' || {clock('end_ms', ',')} || chr(10) || "text" || chr(10) AS value FROM seg""")
def _(t):
    return EX.subtitles(with_silence(t), S, "seg_id", "srt")


@query("snk01_subtitles_vtt", f"""SELECT session_id, seg_id + 1 AS cue, CASE WHEN seg_id = 0 THEN 'WEBVTT' || chr(10) || chr(10) ELSE '' END || {clock('start_ms', '.')} || ' --> ' || {clock('end_ms', '.')} || chr(10) || "text" || chr(10) AS value FROM seg""")
def _(t):
    return EX.subtitles(with_silence(t), S, "seg_id", "vtt")


@query("snk02_transcript_tsv", """SELECT session_id, seg_id, start_ms || chr(9) || end_ms || chr(9) || "text" AS value FROM seg""")
def _(t):
    return EX.transcript(t.seg, S, "seg_id", "tsv")


@query("snk02_transcript_txt", """SELECT session_id, seg_id, trim("text") AS value FROM seg""")
def _(t):
    return EX.transcript(t.seg, S, "seg_id", "txt")


@query("snk02_transcript_json", """SELECT session_id, seg_id, '{"start_ms":' || start_ms || ',"end_ms":' || end_ms || ',"text":' || CAST(to_json("text") AS VARCHAR) || '}' AS value FROM seg""")
def _(t):
    return EX.transcript(t.seg, S, "seg_id", "json")


def _half_even(x, unit):
    """Rounds the fraction x (numerator, denominator) of milliseconds to ``unit`` milliseconds, halves to the even side, as seconds."""
    a, n = x
    n = f"({n} * {unit})"
    return f"(({a}) // {n} + CASE WHEN 2 * (({a}) % {n}) > {n} OR (2 * (({a}) % {n}) = {n} AND ({a}) // {n} % 2 = 1) THEN 1 ELSE 0 END) / {1000 // unit}.0"


def _words_sql(unit):
    at = lambda i: _half_even((f"start_ms * n + (end_ms - start_ms) * {i}", "n"), unit)
    return f"""ws AS (SELECT session_id, seg_id, start_ms, end_ms, speaker, "text", string_split("text", ' ') AS w, len(string_split("text", ' ')) AS n FROM seg),
     wx AS (SELECT *, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM ws), wt AS (SELECT session_id, seg_id, i, word, speaker, CAST({at('i')} AS DOUBLE) AS a, CAST({at('(i + 1)')} AS DOUBLE) AS b FROM wx)"""


J = "CAST(to_json({}) AS VARCHAR)"


@query("snk03_verbose_words", f"""WITH {_words_sql(10)}, g AS (SELECT session_id, seg_id, string_agg('{{"word":' || {J.format('word')} || ',"start":' || a || ',"end":' || b || '}}', ',' ORDER BY i) AS ws FROM wt GROUP BY ALL)
   SELECT s.session_id, s.seg_id, '{{"id":' || (row_number() OVER (PARTITION BY s.session_id ORDER BY s.seg_id) - 1) || ',"start":' || CAST({_half_even(('start_ms', '1'), 10)} AS DOUBLE) || ',"end":' || CAST({_half_even(('end_ms', '1'), 10)} AS DOUBLE)
     || ',"text":' || {J.format('"text"')} || ',"words":[' || ws || ']}}' AS value FROM seg s JOIN g USING (session_id, seg_id)""")
def _(t):
    return EX.verbose_json(t.seg, S, "seg_id")


@query("snk04_utterance_results", f"""WITH {_words_sql(1)}, g AS (SELECT session_id, seg_id, min(a) AS start, max(b) AS stop, string_agg('{{"word":' || {J.format('word')} || ',"start":' || a || ',"end":' || b || ',"confidence":0.0,"punctuated_word":' || {J.format('word')} || ',"speaker":' || greatest(speaker, 0) || '}}', ',' ORDER BY i) AS ws FROM wt GROUP BY ALL)
   SELECT s.session_id, s.seg_id, start, round(stop - start, 3) AS duration, '{{"alternatives":[{{"transcript":' || {J.format('trim("text")')} || ',"confidence":0.0,"words":[' || ws || ']}}]}}' AS channel FROM seg s JOIN g USING (session_id, seg_id)""")
def _(t):
    r = EX.utterance_results(t.seg, S, "seg_id")
    return r.select("session_id", "seg_id", "start", "duration", F.to_json("channel").alias("channel"))


@query("snk05_snapshot_lines", """SELECT session_id, seg_id, speaker, "text", start_ms / 1000 AS id, seg_id % 3 <> 2 AS finalized, seg_id % 3 <> 2 AS completed, lang AS detected_language, lang, printf('%d:%02d:%02d.%02d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms // 10 % 100) AS start,
   printf('%d:%02d:%02d.%02d', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms // 10 % 100) AS "end" FROM seg""")
def _(t):
    return EX.snapshot_lines(t.seg.withColumn("finalized", F.col("seg_id") % 3 != 2), S, "seg_id")


@query("snk07_labelled_text", """SELECT session_id, seg_id, '[speaker ' || speaker || '] ' || "text" || CASE WHEN seg_id % 2 = 0 THEN chr(10) || '    ↳ ' || upper(lang) ELSE '' END AS value FROM seg""")
def _(t):
    return EX.labelled_text(t.seg.withColumn("translation", F.when(F.col("seg_id") % 2 == 0, F.upper("lang"))), S, "seg_id")


@query("snk08_benchmark_report", """SELECT language, category, count(*) AS n_samples, round(avg((subs + ins + dels) / ref_words), 4) AS wer FROM bench GROUP BY ALL""")
def _(t):
    wer = (F.col("subs") + F.col("ins") + F.col("dels")) / F.col("ref_words")
    return t.bench.groupBy("language", "category").agg(F.count(F.lit(1)).alias("n_samples"), F.round(F.avg(wer), 4).alias("wer"))


REPORT = """sm AS (SELECT doc_id, language, category, (subs + ins + dels) / ref_words AS wer, proc_ms / duration_ms AS rtf, duration_ms, proc_ms, subs + ins + dels AS errors, ref_words FROM bench),
   gr AS (SELECT 'summary' AS section, 'all' AS name, * FROM sm UNION ALL SELECT 'language', language, * FROM sm UNION ALL SELECT 'category', category, * FROM sm)"""


@query("snk08_report_sections", f"""WITH {REPORT} SELECT section, name, count(*) AS n_samples, round(avg(wer), 4) AS avg_wer, round(sum(errors) / greatest(sum(ref_words), 1), 4) AS weighted_wer, round(avg(rtf), 3) AS avg_rtf,
   round(sum(proc_ms) / sum(duration_ms), 3) AS overall_rtf, round(sum(duration_ms) / 1000, 1) AS total_audio_s FROM gr GROUP BY ALL""")
def _(t):
    return RP.sections(t.bench)


@query("snk08_report_lines", f"""WITH {REPORT} SELECT 1 AS part, CAST(doc_id AS VARCHAR) AS name, '| ' || doc_id || ' | ' || language || ' | ' || category || ' | ' || round(100 * wer, 1) || ' % | ' || round(rtf, 2) || ' |' AS line FROM sm
   UNION ALL SELECT CASE section WHEN 'summary' THEN 0 WHEN 'language' THEN 2 ELSE 3 END, name, '| ' || name || ' | ' || count(*) || ' | ' || round(100 * avg(wer), 1) || ' % | ' || round(avg(rtf), 2) || ' |' FROM gr GROUP BY section, name""")
def _(t):
    return RP.lines(t.bench)


@query("src02_eval_reports", """SELECT language AS report, 'd' || doc_id || '.wav' AS file, row_number() OVER (PARTITION BY language ORDER BY doc_id) - 1 AS run, subs, ref_words, ref_words * 2 AS twice FROM bench""")
def _(t):
    """Report files written from the table, a language in files of a thousand documents each, and read again; the runs of a
    language are numbered through its files."""
    import uuid

    from ..functions.ordered import row_no, scan
    from ..session import checkpoint_folder
    from ..sources.texts import read_eval_reports
    folder = f"{checkpoint_folder(t.spark)}/reports-{uuid.uuid4().hex}"
    one = t.bench.withColumn("audio_file", F.concat(F.lit("/audio/d"), F.col("doc_id").cast("string"), F.lit(".wav"))).withColumn("part", F.floor(F.col("doc_id") / 1000))
    g = one.groupBy("language", "part").agg(F.array_sort(F.collect_list(F.struct("doc_id", "audio_file", "subs", "ref_words"))).alias("files"))
    files = F.transform("files", lambda f: F.struct(f["audio_file"].alias("audio_file"), f["subs"].alias("subs"), f["ref_words"].alias("ref_words")))
    sums = F.transform("files", lambda f: F.struct(f["audio_file"].alias("audio_file"), (f["ref_words"] * 2).alias("twice")))
    value = F.to_json(F.struct(files.alias("files"), sums.alias("file_summaries")))
    g.select(F.col("language").alias("name"), "part", value.alias("value")).repartition("name", "part").write.partitionBy("name", "part").text(folder)
    r = read_eval_reports(t.spark, folder)
    name = lambda n: F.regexp_extract("report", f"{n}=([^/]+)", 1)
    r = r.select(name("name").alias("report"), name("part").cast("bigint").alias("part"), "file", "run", "subs", "ref_words", F.col("summary.twice").alias("twice"))
    r = scan(r, ["report"], ["part", "run"], F.col("part"), no=row_no())
    return r.select("report", "file", (F.col("no") - 1).alias("run"), "subs", "ref_words", "twice")


@query("src03_run_transcripts", """SELECT 'clip' || session_id AS stem, CASE session_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS path, CAST(session_id % 2 + 1 AS VARCHAR) AS rep, row_number() OVER (PARTITION BY session_id ORDER BY seg_id) - 1 AS no, "text",
   CASE WHEN seg_id % 2 = 0 THEN 'silence' ELSE 'language_switch' END AS trigger FROM seg""")
def _(t):
    from ..sources.texts import parse_run_transcripts
    sid = F.col("session_id")
    line = F.concat(F.lit("1. "), F.col("text"), F.lit("  ⟨"), F.when(F.col("seg_id") % 2 == 0, "silence").otherwise("language_switch"), F.lit("⟩"))
    name = F.concat(F.lit("/runs/clip"), sid.cast("string"), F.lit("_"), F.when(sid % 3 == 0, "A").when(sid % 3 == 1, "B").otherwise("C"), F.lit("_R"), (sid % 2 + 1).cast("string"), F.lit(".txt"))
    return parse_run_transcripts(t.seg.select(name.alias("file"), F.col("seg_id").alias("line_no"), line.alias("line")))


@query("src07_live_events", """SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL""")
def _(t):
    """Files written from the table are streamed into an upsert sink and read back as the latest state."""
    import uuid

    from ..session import checkpoint_folder
    from ..streaming import live
    folder = f"{checkpoint_folder(t.spark)}/live-{uuid.uuid4().hex}"
    keys = ["user_id", "event_type"]
    t.read("events").select(*keys, "event_id", "value").write.parquet(f"{folder}/in")
    src = live.token_stream(t.spark, f"{folder}/in", t.spark.read.parquet(f"{folder}/in").schema)
    live.upsert_sink(src, f"{folder}/rows", f"{folder}/state", keys, "event_id").trigger(availableNow=True).start().awaitTermination()
    return live.latest(t.spark, f"{folder}/rows", keys, "event_id")


@query("src09_flatten_words", "SELECT session_id, turn AS seg_no, pos AS word_no, word, start_ms FROM tok")
def _(t):
    w = t.tok.groupBy("session_id", "turn").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "start_ms"))).alias("w"))
    w = w.withColumn("part", F.floor(F.col("turn") / 64))
    s = w.groupBy("session_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", F.transform("w", lambda x: F.struct(x["word"].alias("word"), x["start_ms"].alias("start_ms"))).alias("words")))).alias("segments"))
    return flatten_words(s, [*S, "part"]).select("session_id", (F.col("part") * 64 + F.col("seg_no")).alias("seg_no"), "word_no", "word", "start_ms")

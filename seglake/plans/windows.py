"""Window queries."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.ordered import time_block
from ..operators import windows as W
from .registry import query
from .shared import grown, with_silence

S = ["session_id"]


@query("win01_merge_runs", """WITH f AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER w THEN 0 ELSE 1 END AS st FROM diar WINDOW w AS (PARTITION BY session_id ORDER BY chunk)),
   g AS (SELECT *, sum(st) OVER (PARTITION BY session_id ORDER BY chunk) AS island FROM f)
   SELECT session_id, CAST(island AS BIGINT) AS island, arg_min(start_ms, chunk) AS start_ms, arg_max(end_ms, chunk) AS end_ms, min(speaker) AS speaker FROM g GROUP BY ALL""")
def _(t):
    return W.merge_runs(t.diar, S, "chunk")


@query("win02_frames_to_intervals", """WITH f AS (SELECT label AS session_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS frame_no, list_position(embedding, list_max(embedding)) - 1 AS speaker FROM embeddings),
   s AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER w THEN 0 ELSE 1 END AS st FROM f WINDOW w AS (PARTITION BY session_id ORDER BY frame_no)),
   g AS (SELECT session_id, frame_no, speaker, sum(st) OVER (PARTITION BY session_id ORDER BY frame_no) AS island FROM s),
   r AS (SELECT session_id, CAST(island AS BIGINT) AS island, min(speaker) AS speaker, min(frame_no) AS f0, max(frame_no) AS f1 FROM g GROUP BY ALL)
   SELECT session_id, island, speaker, f0 * 80 AS start_ms, coalesce(lead(f0) OVER (PARTITION BY session_id ORDER BY island), f1) * 80 AS end_ms FROM r""")
def _(t):
    from ..functions.ordered import row_no, rows_block, scan
    f = scan(t.emb, ["label"], ["vec_id"], rows_block("vec_id"), frame_no=row_no())
    return W.frames_to_intervals(f.select(F.col("label").alias("session_id"), "frame_no", F.col("embedding").alias("scores")), S, 80)


@query("win03_speaker_changes", "SELECT session_id, chunk, speaker, start_ms FROM diar QUALIFY lag(speaker) OVER (PARTITION BY session_id ORDER BY chunk) <> speaker")
def _(t):
    return W.speaker_changes(t.diar, S, "chunk").select("session_id", "chunk", "speaker", "start_ms")


@query("win04_speaker_change_count", """WITH l AS (SELECT session_id, seg_id, lag(speaker) OVER (PARTITION BY session_id ORDER BY seg_id) <> speaker AS c FROM seg)
   SELECT session_id, count(CASE WHEN c THEN 1 END) AS n_changes FROM l GROUP BY session_id""")
def _(t):
    return W.n_speaker_changes(with_silence(t), S, "seg_id")


@query("win06_max_char_run", """WITH c AS (SELECT doc_id, unnest(string_split("text", '')) ch, generate_subscripts(string_split("text", ''), 1) i FROM documents),
   f AS (SELECT *, CASE WHEN ch = lag(ch) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END st FROM c),
   g AS (SELECT doc_id, sum(st) OVER (PARTITION BY doc_id ORDER BY i) isl FROM f), n AS (SELECT doc_id, isl, count(*) k FROM g GROUP BY ALL)
   SELECT doc_id, max(k) AS longest FROM n GROUP BY doc_id""")
def _(t):
    return t.doc.select("doc_id", X.char_run("text").cast("bigint").alias("longest"))


@query("win07_bursts", """WITH c AS (SELECT session_id, frame_no, k FROM frm WHERE k >= 60), f AS (SELECT *, CASE WHEN frame_no - lag(frame_no) OVER (PARTITION BY session_id ORDER BY frame_no) <= 2 THEN 0 ELSE 1 END st FROM c),
   g AS (SELECT *, sum(st) OVER (PARTITION BY session_id ORDER BY frame_no) isl FROM f)
   SELECT session_id, CAST(isl AS BIGINT) AS island, min(frame_no) AS first_batch, max(frame_no) AS last_batch, max(k) AS max_value, median(k) AS median_value, count(*) AS n FROM g GROUP BY session_id, isl""")
def _(t):
    return W.bursts(t.frm.filter("k >= 60"), S, "frame_no", "k")


@query("win08_cascades", """WITH RECURSIVE ev AS (SELECT file_id, line_no, (k % 4) AS b, (line_no % 2 + k % 3) * 4 + line_no * 4 AS a, line_no AS i FROM (SELECT user_id AS file_id, k, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS line_no FROM evt)),
   r AS (SELECT file_id, i, a, b // 2 AS b, i AS s, CAST(NULL AS BIGINT) AS step FROM ev WHERE i = 1 UNION ALL
     SELECT e.file_id, e.i, e.a, e.b // 2, CASE WHEN e.b // 2 = r.b AND e.a > r.a AND (r.step IS NULL OR r.step = e.a - r.a) THEN r.s ELSE e.i END,
       CASE WHEN e.b // 2 = r.b AND e.a > r.a AND (r.step IS NULL OR r.step = e.a - r.a) THEN e.a - r.a END FROM r JOIN ev e ON e.file_id = r.file_id AND e.i = r.i + 1)
   SELECT file_id, max(i) AS end_line, count(*) AS length, max(step) AS step, min(b) AS b, min(a) AS a_first, max(a) AS a_last FROM r GROUP BY file_id, s HAVING count(*) >= 3""")
def _(t):
    e = t.numbered_events().select(F.col("user_id").alias("file_id"), F.col("n").alias("line_no"), F.floor((F.col("k") % 4) / 2).alias("b"),
                                   ((F.col("n") % 2 + F.col("k") % 3) * 4 + F.col("n") * 4).alias("a"))
    return W.cascades(e, ["file_id"], "line_no")


KIND = """CASE WHEN event_type = 'click' AND k >= 80 THEN 'reset_long_silence' WHEN event_type = 'signup' THEN 'reset_new_speaker' WHEN event_type = 'error' THEN 'deferred'
   WHEN event_type = 'view' AND k % 3 = 0 THEN 'first_timestamp' WHEN event_type = 'view' AND k % 3 = 1 THEN 'switch_true' WHEN event_type = 'view' THEN 'switch_false' END"""


def state_events(t):
    return t.numbered_events().select(F.col("user_id").alias("file_id"), F.col("n").alias("line_no"), F.expr(KIND).alias("kind")).filter("kind is not null")


@query("win09_cycles", f"""WITH e AS (SELECT user_id AS file_id, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS line_no, {KIND} AS kind FROM evt),
   s AS (SELECT *, sum(CASE WHEN kind LIKE 'reset%' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_no) AS cycle FROM e WHERE kind IS NOT NULL),
   g AS (SELECT file_id, CAST(cycle AS BIGINT) AS cycle, arg_min(kind, line_no) AS kd, min(line_no) AS f, max(line_no) AS l, count(CASE WHEN kind = 'deferred' THEN 1 END) AS deferred, count(CASE WHEN kind = 'first_timestamp' THEN 1 END) > 0 AS first_ts_set,
     count(CASE WHEN kind = 'switch_true' THEN 1 END) AS switch_true, count(CASE WHEN kind = 'switch_false' THEN 1 END) AS switch_false FROM s GROUP BY ALL),
   h AS (SELECT * FROM g UNION ALL SELECT file_id, 0, '', 1, f, 0, false, 0, 0 FROM g WHERE cycle = 1 AND file_id NOT IN (SELECT file_id FROM g WHERE cycle = 0))
   SELECT file_id, cycle, CASE WHEN cycle = 0 THEN 'initial' ELSE kd END AS reset_type, CASE WHEN cycle = 0 THEN 1 ELSE f END AS start_line,
     coalesce(lead(f) OVER (PARTITION BY file_id ORDER BY cycle), l) AS end_line, deferred, first_ts_set, switch_true, switch_false, deferred > 0 AND NOT first_ts_set AS stuck FROM h""")
def _(t):
    return W.cycles(state_events(t), ["file_id"], "line_no")


@query("win10_promote_stable", """WITH i AS (SELECT session_id, frame_no, CASE WHEN k < 10 THEN '' WHEN k < 70 THEN 'Same' ELSE 'other ' || (k % 3) END AS tx FROM frm),
   f AS (SELECT *, CASE WHEN tx = lag(tx) OVER w AND tx <> '' THEN 0 ELSE 1 END AS st FROM i WINDOW w AS (PARTITION BY session_id ORDER BY frame_no)),
   g AS (SELECT *, sum(st) OVER (PARTITION BY session_id ORDER BY frame_no) AS isl FROM f), n AS (SELECT *, row_number() OVER (PARTITION BY session_id, isl ORDER BY frame_no) AS rn FROM g),
   p AS (SELECT * FROM n WHERE rn = 4 AND tx <> ''), q AS (SELECT *, lag(lower(tx)) OVER (PARTITION BY session_id ORDER BY frame_no) AS pv FROM p)
   SELECT session_id, frame_no, tx FROM q WHERE pv IS NULL OR pv <> lower(tx)""")
def _(t):
    i = t.frm.select("session_id", "frame_no", F.when(F.col("k") < 10, "").when(F.col("k") < 70, "Same").otherwise(
        F.concat(F.lit("other "), (F.col("k") % 3).cast("string"))).alias("tx"))
    return W.promote_stable(i, S, "frame_no", "tx", 2)


GRAMS = """tl AS (SELECT e.session_id, e.turn, t.seq, t.word, row_number() OVER (PARTITION BY e.session_id, e.turn ORDER BY t.seq) AS p FROM (SELECT session_id, turn, max(seq) AS q FROM tok GROUP BY ALL) e
     JOIN (SELECT session_id, seq, lower(word) AS word FROM tok) t ON t.session_id = e.session_id AND t.seq > e.q - 40 AND t.seq <= e.q),
   gr AS (SELECT session_id, turn, p, 1 AS n, word AS g FROM tl UNION ALL SELECT session_id, turn, p, 2, word || chr(1) || lead(word) OVER (PARTITION BY session_id, turn ORDER BY p) FROM tl),
   fl AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY session_id, turn, n, g ORDER BY p) - n <= 5 THEN 0 ELSE 1 END AS st FROM gr WHERE g IS NOT NULL),
   cl AS (SELECT *, sum(st) OVER (PARTITION BY session_id, turn, n, g ORDER BY p) AS c FROM fl),
   cm AS (SELECT session_id, turn, n, g, c, count(*) AS m FROM cl GROUP BY ALL), cs AS (SELECT *, sum(m) OVER (PARTITION BY session_id, turn, n, g) AS tot FROM cm)"""


@query("win11_anchor_storms", f"""WITH {GRAMS}, hit AS (SELECT DISTINCT session_id, turn FROM cs WHERE m >= 3 AND m >= tot * 0.6)
   SELECT e.session_id, e.turn, h.turn IS NOT NULL AS storm FROM (SELECT DISTINCT session_id, turn FROM tok) e LEFT JOIN hit h USING (session_id, turn)""")
def _(t):
    k = t.tok.withColumn("word", F.lower("word"))
    return W.anchor_storms(k, S, "turn", "seq", least=3)


@query("win12_growing_loops", f"""WITH e AS (SELECT session_id, turn, max(seq) AS q FROM tok GROUP BY ALL), tl AS (SELECT e.session_id, e.turn, list(lower(t.word) ORDER BY t.seq) AS w FROM e JOIN tok t ON t.session_id = e.session_id AND t.seq > e.q - 80 AND t.seq <= e.q GROUP BY ALL)
   SELECT session_id, turn, {grown('w')} AS loop FROM tl""")
def _(t):
    return W.growing_loops(t.tok.withColumn("word", F.lower("word")), S, "turn", "seq")


@query("win13_repeat_runs")
def _(t):
    return W.repeat_runs(t.doc, "doc_id")


@query("win14_adjacent_duplicates")
def _(t):
    return W.adjacent_duplicates(t.doc, "doc_id")


TK = """tk AS (SELECT doc_id, list_transform(regexp_extract_all("text", '[A-Za-z'']+|[가-힣]+'), lambda x: lower(x)) AS w FROM documents)"""


@query("win14_doubled_grams", f"""WITH {TK}, u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM tk),
   e AS (SELECT doc_id, i, x = lead(x, 2) OVER w AS e2, x = lead(x, 3) OVER w AS e3, x = lead(x, 4) OVER w AS e4 FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
   m AS (SELECT doc_id, i, e2 AND lead(e2) OVER w AS h2, e3 AND lead(e3) OVER w AND lead(e3, 2) OVER w AS h3, e4 AND lead(e4) OVER w AND lead(e4, 2) OVER w AND lead(e4, 3) OVER w AS h4 FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY i))
   SELECT doc_id, 2 AS n, i - 1 AS start_word FROM m WHERE h2 UNION ALL SELECT doc_id, 3, i - 1 FROM m WHERE h3 UNION ALL SELECT doc_id, 4, i - 1 FROM m WHERE h4""")
def _(t):
    return W.doubled_grams(t.doc, "doc_id")


@query("win15_ttr_collapse", f"""WITH {TK}, p AS (SELECT doc_id, w, unnest(range(0, len(w) - 19, 10)) AS s FROM tk WHERE len(w) >= 20), q AS (SELECT doc_id, s, len(list_distinct(w[s + 1 : s + 20])) AS kd FROM p)
   SELECT doc_id, s AS start_word, s + 20 AS end_word, kd / 20.0 AS ttr FROM q WHERE kd <= 12""")
def _(t):
    return W.ttr_collapse(t.doc, "doc_id")


@query("win16_prune", """WITH l AS (SELECT *, start_ms + 100 AS e, (max(start_ms) OVER (PARTITION BY session_id)) + 100 - 20000 AS cut FROM tok)
   SELECT session_id, seq FROM (SELECT *, min(CASE WHEN e >= cut THEN seq END) OVER (PARTITION BY session_id) AS f FROM l) WHERE cut <= 0 OR seq >= f""")
def _(t):
    return W.prune(t.tok.withColumn("end_ms", F.col("start_ms") + 100), S, "seq", "end_ms", 20000).select("session_id", "seq")


@query("win17_last_rows", "SELECT user_id, event_id FROM evt QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5")
def _(t):
    return W.last_n(t.evt, ["user_id"], "event_id", 5).select("user_id", "event_id")


@query("win18_repair_times", """WITH RECURSIVE x AS (SELECT session_id, seq, start_ms - (seq % 7) * 300 AS a, start_ms - (seq % 7) * 300 + (seq % 5) * 200 AS b FROM tok),
   r AS (SELECT session_id, seq, greatest(10, a) AS start_ms, greatest(greatest(10, a), b) AS end_ms FROM x WHERE seq = 1 UNION ALL
     SELECT x.session_id, x.seq, greatest(r.end_ms + 10, x.a), greatest(greatest(r.end_ms + 10, x.a), x.b) FROM r JOIN x ON x.session_id = r.session_id AND x.seq = r.seq + 1)
   SELECT session_id, seq, start_ms, end_ms FROM r""")
def _(t):
    a = F.col("start_ms") - (F.col("seq") % 7) * 300
    x = t.tok.select("session_id", "seq", a.alias("start_ms"), (a + (F.col("seq") % 5) * 200).alias("end_ms"))
    return W.repair_times(x, S, "seq")


@query("win19_clamp_durations", """WITH x AS (SELECT session_id, turn, seq, CASE WHEN word LIKE '%.' THEN '.' ELSE word END AS word, start_ms AS a, start_ms + (seq * 53) % 900 AS b FROM tok),
   m AS (SELECT session_id, turn, 2 * least(median(b - a), 700) AS top FROM x WHERE b <> a GROUP BY ALL), j AS (SELECT x.*, m.top, lag(word) OVER (PARTITION BY session_id, turn ORDER BY seq) AS p FROM x LEFT JOIN m USING (session_id, turn))
   SELECT session_id, turn, seq, word, CASE WHEN p IS NOT NULL AND b - a > top AND word NOT IN ('.','。','!','！','?','？') AND p IN ('.','。','!','！','?','？') THEN b - top ELSE a END AS start_ms,
     CASE WHEN p IS NOT NULL AND b - a > top AND word IN ('.','。','!','！','?','？') THEN a + top ELSE b END AS end_ms FROM j""")
def _(t):
    x = t.tok.select("session_id", "turn", "seq", F.when(F.col("word").endswith("."), ".").otherwise(F.col("word")).alias("word"), "start_ms",
                     (F.col("start_ms") + (F.col("seq") * 53) % 900).alias("end_ms"))
    return W.clamp_durations(x, ["session_id", "turn"], "seq")


@query("win20_merge_punctuation", """WITH x AS (SELECT session_id, seq, CASE WHEN seq % 9 = 0 THEN ' (' WHEN seq % 11 = 0 THEN '.' WHEN seq % 13 = 0 THEN '”' ELSE ' ' || word END AS word FROM tok),
   f AS (SELECT *, CASE WHEN lag(word) OVER w IS NULL OR (word NOT IN ('.', '”') AND lag(word) OVER w <> ' (') THEN 1 ELSE 0 END AS st FROM x WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
   g AS (SELECT *, sum(st) OVER (PARTITION BY session_id ORDER BY seq) AS i FROM f)
   SELECT session_id, min(seq) AS seq, string_agg(word, '' ORDER BY seq) AS word FROM g GROUP BY session_id, i""")
def _(t):
    x = t.tok.select("session_id", "seq", F.when(F.col("seq") % 9 == 0, " (").when(F.col("seq") % 11 == 0, ".").when(F.col("seq") % 13 == 0, "”")
                     .otherwise(F.concat(F.lit(" "), "word")).alias("word"))
    return W.merge_punctuation(x, S, "seq")


@query("win21_context_suffix", """WITH x AS (SELECT session_id, seq, word, sum(length(word) + 1) OVER (PARTITION BY session_id ORDER BY seq DESC) - length(word) - 1 AS after FROM tok)
   SELECT session_id, string_agg(word, ' ' ORDER BY seq) AS prompt FROM x WHERE after < 200 GROUP BY session_id""")
def _(t):
    return W.context_suffix(t.tok, S, "seq")


@query("win22_block_numbers", """WITH v AS (SELECT *, line_id % 3 <> 1 OR seq > line_id + 1 AS vis FROM snap), d AS (SELECT *, seq - row_number() OVER (PARTITION BY session_id, line_id ORDER BY seq) AS run FROM v),
   b AS (SELECT session_id, line_id, run, min(seq) AS bs, arg_min(line_idx, seq) AS bi FROM d WHERE vis GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY bs, bi) AS block_no FROM b)
   SELECT d.session_id, d.seq, d.line_id, CASE WHEN d.seq >= n.bs THEN n.block_no END AS block_no FROM d LEFT JOIN n USING (session_id, line_id, run)""")
def _(t):
    return W.block_numbers(t.snap, S, (F.col("line_id") % 3 != 1) | (F.col("seq") > F.col("line_id") + 1)).select("session_id", "seq", "line_id", "block_no")


@query("win23_assign_speakers", """WITH f AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER w THEN 0 ELSE 1 END AS st FROM diar WINDOW w AS (PARTITION BY session_id ORDER BY chunk)),
   g AS (SELECT *, sum(st) OVER (PARTITION BY session_id ORDER BY chunk) AS isl FROM f), r AS (SELECT session_id, isl, arg_max(end_ms, chunk) AS e, min(speaker) AS sp FROM g GROUP BY ALL),
   m AS (SELECT session_id, start_ms AS ms, start_ms + 100 AS me FROM tok WHERE regexp_matches(word, '[.!?]$')),
   n AS (SELECT r.*, (SELECT min(ms) FROM m WHERE m.session_id = r.session_id AND m.ms > r.e) AS nx, (SELECT arg_max(me, ms) FROM m WHERE m.session_id = r.session_id AND m.ms <= r.e) AS pv FROM r),
   s AS (SELECT session_id, isl, sp, CASE WHEN nx IS NULL THEN e WHEN pv IS NULL OR e - pv > nx - e THEN nx ELSE pv END AS re FROM n)
   SELECT t.session_id, t.seq, coalesce((SELECT arg_min(sp, (re, isl)) FROM s WHERE s.session_id = t.session_id AND s.re >= t.start_ms + 100) + 1, -1) AS assigned FROM tok t""")
def _(t):
    k = t.tok.withColumn("end_ms", F.col("start_ms") + 100)
    return W.assign_speakers(k, t.diar, S, "seq").select("session_id", "seq", "assigned")


PACKED = """lw AS (SELECT session_id, seq, ' ' || word AS word, start_ms, start_ms + 100 AS end_ms, coalesce(start_ms - lag(start_ms) OVER w > 1500, true) AS begins, row_number() OVER w AS n FROM tok WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
   ly AS (SELECT session_id, seq, n, 'cue' AS place, CAST(42 - length(trim(word)) AS BIGINT) AS room, 1 AS free FROM lw WHERE n = 1
     UNION ALL SELECT session_id, seq, n, place, CASE WHEN place = 'on' THEN room - length(word) ELSE 42 - length(trim(word)) END, CASE place WHEN 'cue' THEN 1 WHEN 'line' THEN free - 1 ELSE free END FROM
       (SELECT w.session_id, w.seq, w.n, w.word, l.room, l.free, CASE WHEN w.begins THEN 'cue' WHEN length(w.word) <= l.room THEN 'on' WHEN l.free = 0 THEN 'cue' ELSE 'line' END AS place FROM ly l JOIN lw w ON w.session_id = l.session_id AND w.n = l.n + 1)),
   pc AS (SELECT ly.session_id, ly.seq, sum(CASE WHEN place = 'cue' THEN 1 ELSE 0 END) OVER (PARTITION BY ly.session_id ORDER BY ly.seq) AS cue, CASE place WHEN 'on' THEN word WHEN 'line' THEN chr(10) || trim(word) ELSE trim(word) END AS word,
     CASE place WHEN 'on' THEN ' <u>' || trim(word) || '</u>' WHEN 'line' THEN chr(10) || '<u>' || trim(word) || '</u>' ELSE '<u>' || trim(word) || '</u>' END AS lit, start_ms, end_ms FROM ly JOIN lw USING (session_id, seq))"""


def packed(t):
    k = t.tok.select("session_id", "turn", "seq", F.concat(F.lit(" "), "word").alias("word"), "start_ms", (F.col("start_ms") + 100).alias("end_ms"))
    return k, dict(width=42, lines=2, pause_ms=1500)


@query("win24_pack_subtitles", f"""WITH RECURSIVE {PACKED} SELECT session_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(word, '' ORDER BY seq) AS "text" FROM pc GROUP BY session_id, cue""")
def _(t):
    k, limits = packed(t)
    return W.pack_subtitles(k, S, "turn", "seq", **limits)


@query("win24_highlight_packed", f"""WITH RECURSIVE {PACKED}, nb AS (SELECT *, row_number() OVER w - 1 AS i, lag(end_ms) OVER w AS pe FROM pc WINDOW w AS (PARTITION BY session_id, cue ORDER BY seq))
   SELECT a.session_id, CAST(a.cue AS BIGINT) AS cue, a.i, a.start_ms, a.end_ms, string_agg(CASE WHEN b.seq = a.seq THEN b.lit ELSE b.word END, '' ORDER BY b.seq) AS "text" FROM nb a JOIN nb b ON b.session_id = a.session_id AND b.cue = a.cue GROUP BY ALL
   UNION ALL SELECT a.session_id, CAST(a.cue AS BIGINT), a.i, a.pe, a.start_ms, string_agg(b.word, '' ORDER BY b.seq) FROM nb a JOIN nb b ON b.session_id = a.session_id AND b.cue = a.cue WHERE a.pe <> a.start_ms GROUP BY ALL""")
def _(t):
    k, limits = packed(t)
    words = W.packed_words(k, S, "turn", "seq", **limits)
    return W.with_gaps(W.highlight_words(words, S, "cue", "at"), words, S, "cue", "at")


@query("win24_highlight_words", """SELECT a.session_id, a.turn AS cue, a.pos AS i, a.start_ms, a.start_ms + 100 AS end_ms,
     (SELECT string_agg(CASE WHEN b.seq = a.seq THEN ' <u>' || b.word || '</u>' ELSE ' ' || b.word END, '' ORDER BY b.seq) FROM tok b WHERE b.session_id = a.session_id AND b.turn = a.turn) AS "text" FROM tok a""")
def _(t):
    k = t.tok.select("session_id", F.col("turn").alias("cue"), "seq", F.concat(F.lit(" "), "word").alias("word"), "start_ms", (F.col("start_ms") + 100).alias("end_ms"))
    return W.highlight_words(k, S, "cue", "seq")


@query("win25_dedup_consecutive", """SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS p FROM evt) WHERE p IS DISTINCT FROM event_type""")
def _(t):
    return W.dedup_consecutive(t.evt, ["user_id"], ["ts_ms", "event_id"], time_block("ts_ms"), "event_type").select("user_id", "event_id", "event_type")


@query("win26_language_switches", """WITH b AS (SELECT session_id, seg_id, length(regexp_replace("text", '[^e-k]', '', 'g')) AS o, length(regexp_replace("text", '[^l-t]', '', 'g')) AS l FROM seg),
   g AS (SELECT session_id, seg_id, CASE WHEN o > l THEN 'other' WHEN l > o THEN 'latin' END AS lg FROM b), n AS (SELECT *, lead(lg) OVER (PARTITION BY session_id ORDER BY seg_id) AS nx FROM g)
   SELECT session_id, seg_id, lg AS before_lang, nx AS after_lang FROM n WHERE lg <> nx""")
def _(t):
    # two letter classes stand in for two scripts; the texts hold only one
    o, l = F.regexp_count("text", F.lit("[e-k]")), F.regexp_count("text", F.lit("[l-t]"))
    return W.language_switches(t.seg, S, "seg_id", F.when(o > l, "other").when(l > o, "latin"))


@query("win27_lead_time", """WITH w AS (SELECT user_id, 'w' || event_id AS name, ts_ms AS a, ts_ms + 7200000 AS b FROM evt WHERE event_type = 'signup'), p AS (SELECT user_id, ts_ms AS t FROM evt WHERE event_type = 'purchase' AND k >= 40), e AS (SELECT user_id, ts_ms AS t FROM evt WHERE event_type = 'view')
   SELECT w.user_id, w.name, w.a AS w_start, (SELECT min(t) FROM p WHERE p.user_id = w.user_id AND t BETWEEN a - 3600000 AND b) AS first_probe, (SELECT min(t) FROM e WHERE e.user_id = w.user_id AND t BETWEEN a AND b) AS first_emission,
     (SELECT min(t) FROM e WHERE e.user_id = w.user_id AND t BETWEEN a AND b) - (SELECT min(t) FROM p WHERE p.user_id = w.user_id AND t BETWEEN a - 3600000 AND b) AS lead_ms FROM w""")
def _(t):
    e = t.evt.withColumn("t", F.col("ts_ms"))
    w = e.filter("event_type = 'signup'").select("user_id", F.concat(F.lit("w"), F.col("event_id").cast("string")).alias("name"), F.col("t").alias("w_start"), (F.col("t") + 7200000).alias("w_end"))
    return W.lead_time(e.filter("event_type = 'purchase'").select("user_id", "t", F.col("k").alias("p")), e.filter("event_type = 'view'"), w, ["user_id"], 40, 3_600_000)

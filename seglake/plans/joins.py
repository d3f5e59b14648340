"""Join queries."""

from pyspark.sql import functions as F

from ..functions.ordered import time_block
from ..functions.ordered import rows_block
from ..operators import joins as J
from ..operators import vectors as VEC
from ..operators.overlap import trim_overlap
from .registry import query
from .shared import user_first, with_silence, DIC_SQL

SEG = ["session_id"]
RAW = """pr AS (SELECT s.session_id, s.seg_id, d.speaker, d.end_ms - d.start_ms AS len,
     row_number() OVER (PARTITION BY s.session_id, s.seg_id ORDER BY least(s.end_ms, d.end_ms) - greatest(s.start_ms, d.start_ms) DESC, d.start_ms, d.end_ms) AS rk
     FROM seg s JOIN diar d ON s.session_id = d.session_id AND least(s.end_ms, d.end_ms) - greatest(s.start_ms, d.start_ms) > 0),
   lastd AS (SELECT session_id, max_by(end_ms, start_ms) AS last_end FROM diar GROUP BY session_id),
   raw AS (SELECT s.session_id, s.seg_id, coalesce(p.speaker + 1, 1) AS raw_speaker, p.len, coalesce(s.start_ms >= l.last_end, false) AS overflow
     FROM seg s LEFT JOIN pr p ON p.session_id = s.session_id AND p.seg_id = s.seg_id AND p.rk = 1 LEFT JOIN lastd l ON l.session_id = s.session_id)"""


@query("jon01_speaker_overlap", f"WITH {RAW} SELECT session_id, seg_id, raw_speaker, overflow FROM raw")
def _(t):
    return J.raw_speakers(t.seg, t.diar, SEG, "seg_id").select("session_id", "seg_id", "raw_speaker", "overflow")


@query("jon01_attribute_speakers", f"""WITH {RAW}, c AS (SELECT *, max(CASE WHEN NOT overflow AND NOT coalesce(len < 2900, false) THEN seg_id END)
     OVER (PARTITION BY session_id ORDER BY seg_id) AS sure, min(CASE WHEN NOT overflow THEN seg_id END) OVER (PARTITION BY session_id) AS firstc FROM raw)
   SELECT c.session_id, c.seg_id, CASE WHEN NOT c.overflow THEN r.raw_speaker END AS speaker FROM c
   LEFT JOIN raw r ON r.session_id = c.session_id AND r.seg_id = coalesce(c.sure, c.firstc)""")
def _(t):
    return J.attribute_speakers(t.seg, t.diar, SEG, "seg_id", 2900).select("session_id", "seg_id", "speaker")


TRANS = """tr AS (SELECT session_id, seq AS no, start_ms + (seq % 4) * 60 AS t_start, start_ms + (seq % 4) * 60 + 90 AS t_end,
     CASE WHEN seq % 6 = 0 THEN '' ELSE word END AS t_text FROM tok)"""


@query("jon02_attach_translations", f"""WITH {TRANS}, hit AS (SELECT s.session_id, s.seg_id, t.no, t.t_text,
       t.no - row_number() OVER (PARTITION BY s.session_id, s.seg_id ORDER BY t.no) AS g
       FROM seg s JOIN tr t ON t.session_id = s.session_id AND s.start_ms <= t.t_start AND t.t_end <= s.end_ms),
     f AS (SELECT session_id, seg_id, arg_min(g, no) AS g FROM hit WHERE t_text <> '' GROUP BY ALL),
     c AS (SELECT h.session_id, h.seg_id, string_agg(t_text || ' ', '' ORDER BY no) AS tx FROM hit h JOIN f USING (session_id, seg_id, g) WHERE t_text <> '' GROUP BY ALL)
   SELECT s.session_id, s.seg_id, coalesce(c.tx, '') AS translation FROM seg s LEFT JOIN c USING (session_id, seg_id)""")
def _(t):
    k = t.tok
    tr = k.select("session_id", F.col("seq").alias("no"), (F.col("start_ms") + (F.col("seq") % 4) * 60).alias("t_start"),
                  (F.col("start_ms") + (F.col("seq") % 4) * 60 + 90).alias("t_end"),
                  F.when(F.col("seq") % 6 == 0, "").otherwise(F.col("word")).alias("t_text"))
    return J.attach_translations(t.seg, tr, SEG, "seg_id").select("session_id", "seg_id", "translation")


LINES = """lines AS (SELECT session_id, seg_id * 2 AS line, start_ms, end_ms, speaker, "text" FROM seg UNION ALL
     SELECT session_id, seg_id * 2 + 1, start_ms, end_ms, -2, NULL FROM sil)"""


def _lines(t):
    return with_silence(t).withColumn("line", F.when(F.col("speaker") == -2, F.col("seg_id") * 2 + 1).otherwise(F.col("seg_id") * 2))


@query("jon03_line_at", f"""WITH {LINES}, p AS (SELECT session_id, seq, start_ms + 150 AS t FROM tok),
     h AS (SELECT p.*, l.line, l.speaker, l."text", row_number() OVER (PARTITION BY p.session_id, p.seq ORDER BY l.line) AS rk
       FROM p LEFT JOIN lines l ON l.session_id = p.session_id AND p.t BETWEEN l.start_ms AND l.end_ms)
   SELECT session_id, seq, line, speaker, coalesce(speaker = -2, false) AS in_silence, "text" FROM h WHERE rk = 1""")
def _(t):
    p = t.tok.select("session_id", "seq", (F.col("start_ms") + 150).alias("t"))
    return J.at(p, _lines(t), SEG, "line").drop("t")


@query("jon04_lines_between", f"""WITH {LINES}, r AS (SELECT session_id, chunk, start_ms AS f, end_ms AS e FROM diar)
   SELECT r.session_id, r.chunk, count(*) AS n_lines,
     array_to_string(list_sort(list_distinct(list(CAST(CASE WHEN speaker > 0 THEN speaker END AS VARCHAR)))), ',') AS speakers,
     coalesce(string_agg(CASE WHEN coalesce("text", '') <> '' THEN "text" END, ' ' ORDER BY line), '') AS "text"
   FROM r JOIN lines l ON l.session_id = r.session_id AND l.end_ms >= r.f AND l.start_ms <= r.e GROUP BY ALL""")
def _(t):
    r = t.diar.select("session_id", "chunk", F.col("start_ms").alias("from_ms"), F.col("end_ms").alias("to_ms"))
    return J.between(r, _lines(t), SEG, "line", "chunk")


WIN = """wins AS (SELECT user_id, 'w' || (event_id % 7) AS name, ts_ms AS a, ts_ms + k * 60000 AS b FROM evt WHERE event_type = 'signup')"""


@query("jon05_label_windows", f"""WITH {WIN}, h AS (SELECT e.event_id, w.name FROM evt e JOIN wins w ON w.user_id = e.user_id AND e.ts_ms BETWEEN w.a AND w.b)
   SELECT event_id, name FROM h UNION ALL SELECT event_id, 'control' FROM evt WHERE event_id NOT IN (SELECT event_id FROM h)""")
def _(t):
    w = t.evt.filter("event_type = 'signup'").select("user_id", F.concat(F.lit("w"), (F.col("event_id") % 7).cast("string")).alias("name"),
                                                     F.col("ts_ms").alias("w_start"), (F.col("ts_ms") + F.col("k") * 60000).alias("w_end"))
    return J.label_windows(t.evt, w, ["user_id"], "ts_ms").select("event_id", "name")


@query("jon06_decision_check", """WITH d AS (SELECT * FROM evt WHERE event_type = 'signup'), p AS (SELECT user_id, ts_ms, event_id, k FROM evt WHERE event_type = 'purchase')
   SELECT d.event_id, p.k AS probe_p, coalesce(p.k <= 10, false) AS disagrees FROM d ASOF LEFT JOIN p ON d.user_id = p.user_id AND p.ts_ms < d.ts_ms""")
def _(t):
    d = t.evt.filter("event_type = 'signup'")
    p = t.evt.filter("event_type = 'purchase'").select("user_id", "ts_ms", F.col("k").alias("p"))
    return J.decision_check(d, p, ["user_id"], "ts_ms", time_block("_at0")).select("event_id", "probe_p", "disagrees")


@query("jon07_nearest_event", """WITH l AS (SELECT *, max(CASE WHEN line LIKE '[NewSpeaker]%' THEN line_no END) OVER (PARTITION BY file_id ORDER BY line_no) AS b,
     min(CASE WHEN line LIKE '[NewSpeaker]%' THEN line_no END) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS f FROM log)
   SELECT file_id, line_no, CASE WHEN b IS NULL THEN f - line_no WHEN f IS NULL THEN line_no - b ELSE least(line_no - b, f - line_no) END AS distance,
     coalesce(CASE WHEN b IS NULL THEN f - line_no WHEN f IS NULL THEN line_no - b ELSE least(line_no - b, f - line_no) END <= 5, false) AS near FROM l""")
def _(t):
    return J.nearest(t.log, ["file_id"], "line_no", F.col("line").startswith("[NewSpeaker]"), 5).select("file_id", "line_no", "distance", "near")


@query("jon08_tolerance_join", """WITH l AS (SELECT user_id, event_id, k * 10 AS v FROM evt WHERE event_type = 'click'), r AS (SELECT user_id, event_id AS rid, k * 10 + 30 AS w FROM evt WHERE event_type = 'view')
   SELECT l.user_id, l.event_id, min(r.rid) AS rid FROM l LEFT JOIN r ON l.user_id = r.user_id AND abs(v - w) < 50 GROUP BY ALL""")
def _(t):
    l = t.evt.filter("event_type = 'click'").select("user_id", "event_id", (F.col("k") * 10).alias("v"))
    r = t.evt.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("rid"), (F.col("k") * 10 + 30).alias("w"))
    return J.tolerance_join(l, r, ["user_id"], "event_id", "v", "rid", "w", 50).select("user_id", "event_id", "rid")


@query("jon09_ordinal_join", """WITH l AS (SELECT file_id, line_no AS a, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS ordinal FROM log WHERE line LIKE '[EndSilence]%'),
   r AS (SELECT file_id, line_no AS b, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS ordinal FROM log WHERE line LIKE '[Probe]%')
   SELECT l.file_id, l.ordinal, a, b FROM l LEFT JOIN r USING (file_id, ordinal)""")
def _(t):
    l = t.log.filter(F.col("line").startswith("[EndSilence]")).select("file_id", F.col("line_no").alias("a"))
    r = t.log.filter(F.col("line").startswith("[Probe]")).select("file_id", F.col("line_no").alias("b"))
    return J.ordinal_join(l, r, ["file_id"], "a", "b")


@query("jon10_cross_reference", """WITH l AS (SELECT user_id AS id, count(CASE WHEN event_type = 'view' AND k > 80 THEN 1 END) AS drops FROM evt GROUP BY user_id),
   d AS (SELECT conv_id AS id, count(CASE WHEN length("text") % 5 = 0 THEN 1 END) AS storms FROM conversations GROUP BY conv_id)
   SELECT id, drops, storms, CASE WHEN storms > 0 AND drops > 0 THEN 'both' WHEN storms > 0 THEN 'transcript_only' WHEN drops > 0 THEN 'log_only' ELSE 'clean' END AS conclusion
   FROM l JOIN d USING (id)""")
def _(t):
    l = t.evt.groupBy(F.col("user_id").alias("id")).agg(F.count_if((F.col("event_type") == "view") & (F.col("k") > 80)).alias("drops"))
    d = t.read("conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count_if(F.length("text") % 5 == 0).alias("storms"))
    return J.cross_reference(l, d, ["id"])


@query("jon11_relevant_glossary", f"""WITH {DIC_SQL}, sd AS MATERIALIZED (SELECT DISTINCT side FROM (SELECT lower(wrong) AS side FROM merged UNION ALL SELECT lower(correct) FROM merged) WHERE side <> ''), lt AS MATERIALIZED (SELECT doc_id, lower("text") AS x FROM documents),
   h AS MATERIALIZED (SELECT doc_id, side FROM lt JOIN sd ON contains(x, side)) SELECT doc_id, wrong AS origin, correct AS translation FROM h JOIN merged ON side = lower(wrong) UNION SELECT doc_id, wrong, correct FROM h JOIN merged ON side = lower(correct)""")
def _(t):
    g = user_first(t).select(F.col("wrong").alias("origin"), F.col("correct").alias("translation"))
    return J.relevant_glossary(t.doc.select("doc_id", "text"), g, "doc_id")


@query("jon12_apply_overrides", """SELECT session_id, seg_id, CASE WHEN seg_id % 3 <> 1 THEN 'm' || seg_id WHEN seg_id % 4 = 0 THEN NULL ELSE 's' || seg_id END AS translation FROM seg""")
def _(t):
    s = t.seg.select("session_id", "seg_id", "text", F.when(F.col("seg_id") % 4 == 0, "").otherwise(
        F.concat(F.lit("s"), F.col("seg_id").cast("string"))).alias("translation"))
    o = t.seg.select("session_id", "seg_id", F.when(F.col("seg_id") % 3 == 1, F.concat("text", F.lit("~"))).otherwise(F.col("text")).alias("source_text"),
                     F.concat(F.lit("m"), F.col("seg_id").cast("string")).alias("translation"))
    return J.apply_overrides(s, o, SEG, "seg_id").select("session_id", "seg_id", "translation")


@query("jon13_merge_views", """WITH h AS (SELECT session_id, seg_id, 'final' AS era FROM seg), i AS (SELECT session_id, seg_id, 'interim' AS era FROM seg WHERE seg_id % 3 = 1),
   m AS (SELECT * FROM h WHERE (session_id, seg_id) NOT IN (SELECT (session_id, seg_id) FROM i) UNION ALL SELECT * FROM i)
   SELECT * FROM m WHERE (session_id, seg_id) NOT IN (SELECT (session_id, seg_id) FROM seg WHERE speaker = 1 AND seg_id % 5 = 1)""")
def _(t):
    s = t.seg
    h = s.select("session_id", "seg_id", F.lit("final").alias("era"))
    i = s.filter("seg_id % 3 = 1").select("session_id", "seg_id", F.lit("interim").alias("era"))
    return J.merge_views(h, i, s.filter("speaker = 1 and seg_id % 5 = 1"), SEG, "seg_id", "seg_id")


EDGE = r"""lower(regexp_replace(word, '^[.,?!…~"''`“”‘’()\[\]{}<>:;·\-–—。、，！？ \t]+|[.,?!…~"''`“”‘’()\[\]{}<>:;·\-–—。、，！？ \t]+$', '', 'g'))"""


@query("jon14_reemission_pairs", f"""WITH n AS (SELECT session_id, seq, start_ms, {EDGE} AS x FROM tok WHERE seq % 2 = 0), c AS (SELECT session_id, seq, start_ms, {EDGE} AS x FROM tok WHERE seq % 2 = 1)
   SELECT n.session_id, n.seq AS new_seq, c.seq AS old_seq, CASE WHEN n.x = c.x THEN 'exact' ELSE 'prefix' END AS kind FROM n JOIN c ON n.session_id = c.session_id
   AND abs(n.start_ms - c.start_ms) <= 400 AND n.x <> '' AND c.x <> '' AND (starts_with(n.x, c.x) OR starts_with(c.x, n.x))""")
def _(t):
    k = t.tok
    return J.reemission_pairs(k.filter("seq % 2 = 0"), k.filter("seq % 2 = 1"), SEG)


UNIT = "u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), v AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x*x))) AS n FROM u)"
TOPK = f"""{UNIT}, s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.e, b.e) / (a.n * b.n), 6) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id),
   r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""


@query("jon15_similar_examples", f"WITH {TOPK} SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 3")
def _(t):
    e = t.emb.select("vec_id", "embedding")
    return VEC.similar_examples(e, e, 3)


@query("jon15_example_lines", f"""WITH {TOPK} SELECT query_id, string_agg('s' || vec_id || ' : t' || vec_id, chr(10) ORDER BY rank) AS examples
   FROM r WHERE rank <= 3 AND vec_id % 4 <> 3 GROUP BY query_id""")
def _(t):
    e = t.emb.select("vec_id", "embedding")
    vid = F.col("vec_id").cast("string")
    body = F.struct(F.concat(F.lit("s"), vid).alias("source"), F.when(F.col("vec_id") % 4 != 3, F.concat(F.lit("t"), vid)).alias("target"))
    payload = e.select("vec_id", F.when(F.col("vec_id") % 2 == 0, F.to_json(F.struct(body.alias("metadata")))).otherwise(F.to_json(body)).alias("payload"))
    return VEC.example_lines(VEC.similar_examples(e, e, 3), payload)


@query("jon16_trim_overlap", r"""WITH b AS (SELECT session_id, seg_id, "text", lag("text") OVER (PARTITION BY session_id ORDER BY seg_id) AS p FROM seg),
   j AS (SELECT session_id, seg_id, p, CASE WHEN p IS NULL THEN "text" ELSE array_to_string(string_split(p, ' ')[-(1 + seg_id % 5):], ' ') || ' ' || "text" END AS base FROM b),
   d AS (SELECT session_id, seg_id, base, lag(base) OVER (PARTITION BY session_id ORDER BY seg_id) AS said FROM j),
   n AS (SELECT *, replace(lower(regexp_replace(said, '[\s.,!?:()\[\]{}*"'']', '', 'g')), 'ß', 'ss') AS ltx FROM d),
   g AS (SELECT *, unnest(range(1, length(base) + 1)) AS i FROM n WHERE said IS NOT NULL),
   c AS (SELECT session_id, seg_id, i, ltx, substring(replace(lower(regexp_replace(base, '[\s.,!?:()\[\]{}*"'']', '', 'g')), 'ß', 'ss'), 1, length(regexp_replace(substring(base, 1, i), '[\s.,!?:()\[\]{}*"'']', '', 'g'))) AS pre
     FROM g WHERE i = length(base) OR regexp_matches(substring(base, i + 1, 1), '[\s.,!?:()\[\]{}*"'']')),
   best AS (SELECT session_id, seg_id, max(i) AS i FROM c WHERE length(pre) >= 3 AND suffix(ltx, pre) GROUP BY ALL)
   SELECT d.session_id, d.seg_id, CASE WHEN b.i IS NULL THEN base ELSE regexp_replace(regexp_replace(substring(base, b.i + 1), '^[.,!?:()\[\]{}*"'']+', ''), '^\s+', '') END AS "text"
   FROM d LEFT JOIN best b USING (session_id, seg_id)""")
def _(t):
    return trim_overlap(overlapping(t), SEG, "seg_id").select("session_id", "seg_id", "text")


def overlapping(t):
    """Lines that begin by repeating the last words of the line before."""
    from ..functions.ordered import prev, scan
    s = scan(t.seg.select("session_id", "seg_id", "text"), SEG, ["seg_id"], rows_block("seg_id"), p=prev("text"))
    w = F.split("p", " ")
    tail = F.array_join(F.slice(w, -F.least((1 + F.col("seg_id") % 5).cast("int"), F.size(w)), F.lit(5)), " ")
    return s.select("session_id", "seg_id", F.when(F.col("p").isNull(), F.col("text")).otherwise(F.concat(tail, F.lit(" "), F.col("text"))).alias("text"))


CHUNKS = "ch AS (SELECT session_id, start_ms, end_ms FROM seg), cu AS (SELECT *, sum(end_ms - start_ms) OVER (PARTITION BY session_id ORDER BY start_ms) - (end_ms - start_ms) AS s0 FROM ch)"


@query("jon17_restore_times", f"""WITH {CHUNKS}, w AS (SELECT session_id, seq, 310 * seq AS a, 310 * seq + 200 AS b FROM tok),
   p AS (SELECT w.*, (a + b) // 2 AS mid FROM w)
   SELECT p.session_id, p.seq, p.a + c.start_ms - CAST(c.s0 AS BIGINT) AS start_ms, p.b + c.start_ms - CAST(c.s0 AS BIGINT) AS end_ms FROM p ASOF JOIN cu c ON c.session_id = p.session_id AND c.s0 <= p.mid""")
def _(t):
    w = t.tok.select("session_id", "seq", (F.col("seq") * 310).alias("start_ms"), (F.col("seq") * 310 + 200).alias("end_ms"))
    return J.restore_times(w, t.seg.select("session_id", "start_ms", "end_ms"), SEG)


@query("jon18_missing_at_boundaries", """WITH ops AS (SELECT session_id, seq - 1 AS ref_idx, word, CASE WHEN seq % 5 = 0 THEN 'del' WHEN seq % 7 = 0 THEN 'sub' ELSE 'match' END AS op FROM tok),
   bl AS (SELECT session_id, turn, min(seq) - 1 AS lo, max(seq) AS hi FROM tok GROUP BY ALL),
   bd AS (SELECT session_id, turn AS boundary, lo AS pos_at, greatest(lo - 8, lag(lo) OVER (PARTITION BY session_id ORDER BY turn)) AS lo8, least(lo + 8, hi) AS hi8 FROM bl QUALIFY lag(lo) OVER (PARTITION BY session_id ORDER BY turn) IS NOT NULL)
   SELECT b.session_id, b.boundary, CASE WHEN ref_idx < pos_at THEN 'before' ELSE 'after' END AS side, op, ref_idx, word FROM bd b JOIN ops o ON o.session_id = b.session_id AND o.ref_idx >= lo8 AND o.ref_idx < hi8 WHERE op IN ('del', 'sub')""")
def _(t):
    ops = t.tok.select("session_id", (F.col("seq") - 1).alias("ref_idx"), "word",
                       F.when(F.col("seq") % 5 == 0, "del").when(F.col("seq") % 7 == 0, "sub").otherwise("match").alias("op"))
    from ..functions.ordered import prev, scan
    b = t.turns.select("session_id", "turn", F.col("seq0").alias("lo"), (F.col("seq0") + F.col("n")).alias("hi"))
    b = scan(b, SEG, ["turn"], rows_block("turn"), before=prev("lo")).filter("before is not null").select(
        "session_id", F.col("turn").alias("boundary"), F.col("lo").alias("at"), F.greatest(F.col("lo") - 8, "before").alias("lo"),
        F.least(F.col("lo") + 8, "hi").alias("hi"))
    return J.missing_at_boundaries(ops, b, SEG)


@query("jon21_parity_errors", """SELECT session_id, seg_id, length("text") - (CASE WHEN seg_id % 3 = 1 THEN 0 ELSE 1 END) AS stored_len, length("text") AS parsed_len FROM seg
   WHERE seg_id % 4 <> 3 AND seg_id % 3 <> 1 AND length("text") > 0""")
def _(t):
    stored = t.seg.select("session_id", "seg_id", F.when(F.col("seg_id") % 4 == 3, None).when(F.col("seg_id") % 3 == 1, F.col("text"))
                          .otherwise(F.substring("text", F.lit(2), F.length("text"))).alias("reference"))
    parsed = t.seg.select("session_id", "seg_id", F.col("text").alias("plain_text"))
    return J.parity_errors(stored, parsed, ["session_id", "seg_id"]).drop("reference")


@query("jon22_translation_cache", """SELECT session_id, seg_id, CASE WHEN seg_id % 2 = 0 THEN 'c' || seg_id WHEN seg_id % 3 = 0 THEN 'p' || seg_id ELSE '' END AS translation, seg_id % 2 <> 0 AS pending FROM seg""")
def _(t):
    s = t.seg.select("session_id", "seg_id", "start_ms", "text")
    tag = lambda x: F.concat(F.lit(x), F.col("seg_id").cast("string"))
    cache = s.filter("seg_id % 2 = 0").select("session_id", (F.col("start_ms") / 10).cast("bigint").alias("start_cs"), "text", tag("c").alias("translation"))
    last = s.filter("seg_id % 3 = 0").select("session_id", F.col("start_ms").alias("line_id"), tag("p").alias("translation"))
    return J.apply_cache(s, cache, last, SEG).select("session_id", "seg_id", "translation", "pending")


@query("jon23_drop_in_intervals", """SELECT session_id, seq FROM tok t WHERE NOT EXISTS (SELECT 1 FROM diar d WHERE d.session_id = t.session_id AND d.speaker = 1 AND t.start_ms BETWEEN d.start_ms AND d.end_ms)""")
def _(t):
    d = t.diar.filter("speaker = 1").select("session_id", F.col("start_ms").alias("q_start"), F.col("end_ms").alias("q_end"))
    return J.drop_in_intervals(t.tok, d, SEG).select("session_id", "seq")


@query("jon24_word_times", """WITH w AS (SELECT session_id, seq AS no, word, CAST(sum(length(word) + 1) OVER (PARTITION BY session_id ORDER BY seq) AS BIGINT) AS u FROM tok),
   f AS (SELECT session_id, (seq - 1) * 9 AS off, start_ms AS pos FROM tok WHERE seq > 2), x AS (SELECT *, u - length(word) - 1 AS a, u - 1 AS b FROM w),
   y AS (SELECT x.*, f.pos AS sp FROM x ASOF LEFT JOIN f ON f.session_id = x.session_id AND f.off <= x.a)
   SELECT y.session_id, no, word, coalesce(sp, 0) AS start_pos, greatest(coalesce(f.pos, 0), coalesce(sp, 0) + 1) AS end_pos FROM y ASOF LEFT JOIN f ON f.session_id = y.session_id AND f.off <= y.b""")
def _(t):
    w = t.tok.select("session_id", F.col("seq").alias("no"), "word")
    f = t.tok.filter("seq > 2").select("session_id", ((F.col("seq") - 1) * 9).alias("offset"), F.col("start_ms").alias("pos"))
    return J.word_times(w, f, SEG)



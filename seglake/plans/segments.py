"""Segmentation and streak queries, and the flagship timeline."""

from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.ordered import row_no, rows_block, scan
from ..operators import aggregates as A
from ..operators import filters as FI
from ..operators import segments as G
from ..operators import speech as P
from ..operators import windows as W
from ..session import cut
from .registry import query
from .shared import PHRASES, user_first

S = ["session_id"]


SWITCH = "seg_id % 4 = 2"


def rows(t, switch=SWITCH):
    """Arrival order of one session: switch markers, words, silences."""
    k = t.tok
    text = k.select("session_id", "turn", F.lit(1).alias("slot"), "seq", F.lit("text").alias("kind"), "start_ms", (F.col("start_ms") + 100).alias("end_ms"), F.col("word").alias("text"), "lang")
    sil = t.sil.select("session_id", F.col("seg_id").alias("turn"), F.lit(2).alias("slot"), F.lit(0).cast("bigint").alias("seq"), F.lit("silence").alias("kind"), "start_ms", "end_ms", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"))
    sw = t.seg.filter(switch).select("session_id", F.col("seg_id").alias("turn"), F.lit(0).alias("slot"), F.lit(0).cast("bigint").alias("seq"), F.lit("lang_switch").alias("kind"), "start_ms", F.col("start_ms").alias("end_ms"), F.lit("").alias("text"), "lang")
    every = cut(text.unionByName(sil).unionByName(sw))
    return scan(every, S, ["turn", "slot", "seq"], rows_block("turn", 1024), pos=row_no()).drop("slot")


def switched(t):
    """Switches to English where no silence comes before them, with boundaries before, at and after the first new word; words
    cut to a letter, so that they are said again, two of three after a blank."""
    r = rows(t, "seg_id % 4 = 0 AND seg_id > 0")
    sw = F.col("kind") == "lang_switch"
    bound = F.col("start_ms") + 300 * (F.floor(F.col("turn") / 4) % 3) - 300
    letter = F.concat(F.when(F.col("seq") % 3 == 0, "").otherwise(" "), F.substring("text", 1, 1))
    return r.withColumn("text", F.when(F.col("kind") == "text", letter).otherwise(F.col("text"))).withColumn("boundary_t", F.when(sw, bound)).withColumn(
        "prev_lang", F.when(sw, F.lit("ko"))).withColumn("floor", F.when(sw, bound - 4000)).withColumn("new_lang", F.when(sw, F.lit("en")))


ABBR = ", ".join(f"'{a}'" for a in V.ABBREVIATIONS_EN)
ROWS = f"""un AS (SELECT session_id, turn, 1 AS slot, seq, 'text' AS kind, start_ms, start_ms + 100 AS end_ms, word AS tx, lang FROM tok UNION ALL SELECT session_id, seg_id, 2, 0, 'silence', start_ms, end_ms, NULL, NULL FROM sil
     UNION ALL SELECT session_id, seg_id, 0, 0, 'lang_switch', start_ms, start_ms, '', lang FROM seg WHERE seg_id % 4 = 2),
   ro AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn, slot, seq) AS pos FROM un),
   nb AS (SELECT *, lead(kind) OVER w AS nk, lead(tx) OVER w AS nt, lag(kind) OVER w AS pk, regexp_replace(tx, '[.!?。！？]+$', '') AS bare FROM ro WINDOW w AS (PARTITION BY session_id ORDER BY pos)),
   ct AS (SELECT *, kind = 'text' AND regexp_matches(tx, '[.!?。！？]$') AND (nk IS NULL OR nk = 'silence' OR (regexp_matches(tx, '[.。]$') AND NOT regexp_matches(bare, '[0-9]$') AND bare <> ''
     AND NOT (replace(bare, '.', '') <> '' AND (length(replace(bare, '.', '')) = 1 OR (contains(bare, '.') AND replace(bare, '.', '') = upper(replace(bare, '.', '')) AND replace(bare, '.', '') <> lower(bare)) OR lower(replace(bare, '.', '')) IN ({ABBR}))) AND nk = 'text' AND regexp_matches(nt, '^\\p{{Lu}}'))) AS cut FROM nb),
   st AS (SELECT *, CASE WHEN pk IS NULL OR kind <> 'text' OR pk <> 'text' OR lag(cut) OVER w THEN 1 ELSE 0 END AS s FROM ct WINDOW w AS (PARTITION BY session_id ORDER BY pos)),
   sn AS (SELECT *, sum(s) OVER (PARTITION BY session_id ORDER BY pos) AS g FROM st WHERE kind <> 'lang_switch'),
   sg AS (SELECT session_id, CAST(g AS BIGINT) AS seg_no, min(kind) AS kind, min(start_ms) AS start_ms, max(end_ms) AS end_ms, CASE WHEN min(kind) = 'text' THEN string_agg(tx, ' ' ORDER BY pos) END AS tx, arg_min(lang, pos) AS lang, bool_or(cut) AS punct, arg_max(coalesce(nk = 'lang_switch', false) AND NOT cut, pos) AS hard FROM sn GROUP BY ALL)"""


@query("str04_segment", f'WITH {ROWS} SELECT session_id, seg_no, kind, start_ms, end_ms, tx AS "text", lang, punct, hard FROM sg')
def _(t):
    return G.segment(rows(t), S)


GATE = f"""{ROWS}, rn AS (SELECT *, CASE WHEN kind = 'silence' AND lag(kind) OVER w = 'silence' THEN 0 ELSE 1 END AS rs FROM sg WINDOW w AS (PARTITION BY session_id ORDER BY seg_no)),
   rg AS (SELECT *, sum(rs) OVER (PARTITION BY session_id ORDER BY seg_no) AS run FROM rn), fi AS (SELECT session_id, run, min(seg_no) AS f FROM rg GROUP BY ALL),
   pv AS (SELECT rg.*, fi.f, p.kind AS pkd, p.punct AS pp, p.tx AS ptx, p.lang AS pl, p.hard AS ph FROM rg JOIN fi USING (session_id, run) LEFT JOIN sg p ON p.session_id = rg.session_id AND p.seg_no = fi.f - 1),
   ex AS (SELECT *, kind = 'silence' AND coalesce(pkd = 'text' AND NOT pp, false) AS ex FROM pv),
   mg AS (SELECT session_id, CASE WHEN ex THEN f ELSE seg_no END AS seg_no, min(kind) AS kind, min(start_ms) AS start_ms, max(end_ms) AS end_ms, min(tx) AS tx, min(lang) AS lang, bool_or(punct) AS punct, bool_or(hard) AS hard, bool_or(ex) AS ex, min(ptx) AS ptx, min(pl) AS pl, bool_or(ph) AS ph FROM ex GROUP BY session_id, CASE WHEN ex THEN f ELSE seg_no END),
   nx AS (SELECT *, CASE WHEN lead(kind) OVER w = 'text' THEN lead(tx) OVER w END AS ntx, CASE WHEN lead(kind) OVER w = 'text' THEN lead(lang) OVER w END AS nl, max(end_ms) OVER (PARTITION BY session_id) AS now FROM mg WINDOW w AS (PARTITION BY session_id ORDER BY seg_no)),
   vd AS (SELECT *, CASE WHEN regexp_extract(regexp_replace(ptx, '[.!?。！？]+$', ''), '(\\S+)\\s*$', 1) = '' THEN true WHEN ntx IS NULL THEN NULL ELSE regexp_matches(ntx, '^\\p{{Lu}}') END AS vd FROM nx),
   pa AS (SELECT *, CASE WHEN NOT ex THEN NULL WHEN end_ms - start_ms >= 1200 AND coalesce(vd, true) THEN 'split_hard' WHEN ntx IS NULL AND now - end_ms >= 2000 THEN 'split_cap' WHEN ntx IS NULL THEN 'pending' WHEN hard OR ph THEN 'split_grammar' WHEN pl IS DISTINCT FROM nl THEN 'split_grammar' WHEN coalesce(vd, true) THEN 'split_grammar' ELSE 'merge' END AS path FROM vd)"""


def timed(t):
    s = G.segment(rows(t), S).withColumn("lang", F.when(F.col("lang").isNotNull(), F.lit("en")))
    from ..functions.ordered import whole_max
    return scan(s, S, ["seg_no"], rows_block("seg_no"), now=whole_max("end_ms"))


GATE1 = GATE.replace("arg_min(lang, pos) AS lang", "CASE WHEN arg_min(lang, pos) IS NOT NULL THEN 'en' END AS lang")


@query("str05_grammar_gate", f"WITH {GATE1} SELECT session_id, seg_no, kind, start_ms, end_ms, path FROM pa WHERE path IS DISTINCT FROM 'merge'")
def _(t):
    s = timed(t)
    return G.grammar_gate(s.drop("now"), S, F.lit(None).cast("bigint")).select("session_id", "seg_no", "kind", "start_ms", "end_ms", "path")


LINES = f"""{GATE1}, sp AS (SELECT *, CASE WHEN kind = 'silence' THEN -2 ELSE seg_no // 6 % 2 END AS speaker FROM sg), fl AS (SELECT *, CASE WHEN lag(speaker) OVER w IS NULL OR lag(speaker) OVER w <> speaker OR lag(hard) OVER w OR lag(punct) OVER w THEN 1 ELSE 0 END AS ls FROM sp WINDOW w AS (PARTITION BY session_id ORDER BY seg_no)),
   lg AS (SELECT *, sum(ls) OVER (PARTITION BY session_id ORDER BY seg_no) AS line FROM fl),
   li AS (SELECT session_id, CAST(line AS BIGINT) AS line, min(start_ms) AS start_ms, max(end_ms) AS end_ms, min(speaker) AS speaker, coalesce(string_agg(tx, ' ' ORDER BY seg_no), '') AS tx, arg_max(hard, seg_no) AS hard, arg_max(punct, seg_no) AS punct FROM lg GROUP BY ALL),
   ln AS (SELECT *, lead(speaker) OVER w AS ns, max(line) OVER (PARTITION BY session_id) AS top FROM li WINDOW w AS (PARTITION BY session_id ORDER BY line)),
   fz AS (SELECT session_id, line, start_ms, end_ms, speaker, tx, line < top AS finalized, CASE WHEN ns IS NULL OR speaker = -2 THEN NULL WHEN hard THEN 'language_switch' WHEN ns = -2 THEN CASE WHEN regexp_matches(tx, '[.!?。！？]$') THEN 'punctuation' ELSE 'silence' END WHEN ns <> speaker THEN 'speaker_change' WHEN punct THEN 'punctuation' ELSE 'speaker_change' END AS finalize_trigger FROM ln)"""


def spoken(t):
    return G.segment(rows(t), S).withColumn("speaker", F.when(F.col("kind") == "silence", -2).otherwise(F.floor(F.col("seg_no") / 6) % 2))


@query("str06_finalize_lines", f'WITH {LINES} SELECT session_id, line, start_ms, end_ms, speaker, tx AS "text", finalized, finalize_trigger FROM fz')
def _(t):
    return G.finalize_lines(spoken(t), S).select("session_id", "line", "start_ms", "end_ms", "speaker", "text", "finalized", "finalize_trigger")


@query("str07_finalize_grace", f"""WITH {LINES}, c AS (SELECT *, lead(speaker) OVER w AS ns, lead(line) OVER w AS nl, lead(start_ms) OVER w AS nst, max(line) OVER (PARTITION BY session_id) AS top FROM fz WHERE (session_id, line) NOT IN (SELECT (session_id, max(line)) FROM fz WHERE speaker <> -2 GROUP BY session_id HAVING max(line) = (SELECT max(line) FROM fz z WHERE z.session_id = fz.session_id)) WINDOW w AS (PARTITION BY session_id ORDER BY line))
   SELECT session_id, line, CASE WHEN nl = top AND ns = -2 AND speaker <> -2 AND tx <> '' THEN session_id % 2 = 0 ELSE finalized END AS finalized,
     CASE WHEN nl = top AND ns = -2 AND speaker <> -2 AND tx <> '' THEN CASE WHEN session_id % 2 = 0 THEN CASE WHEN regexp_matches(tx, '[.!?。！？]$') THEN 'punctuation' ELSE 'silence' END END ELSE finalize_trigger END AS finalize_trigger FROM c""")
def _(t):
    """Sessions seen while their last row is a silence: odd ones just after it began."""
    from ..functions.ordered import whole_max
    lines = cut(G.finalize_lines(spoken(t), S))
    lines = scan(lines, S, ["line"], rows_block("line"), top=whole_max("line"))
    lines = cut(lines.filter(~((F.col("line") == F.col("top")) & (F.col("speaker") != -2))))
    lines = scan(lines, S, ["line"], rows_block("line"), last_start=whole_max("start_ms"))
    now = F.col("last_start") + F.when(F.col("session_id") % 2 == 0, 2500).otherwise(500)
    return G.finalize_grace(lines, S, now).select("session_id", "line", "finalized", "finalize_trigger")


@query("str08_reattach_tails")
def _(t):
    late = (F.col("kind") == "text") & (F.col("seq") % 7 == 1)
    r = rows(t).withColumn("start_ms", F.when(late, F.col("start_ms") - 900).otherwise(F.col("start_ms")))
    return G.reattach(r, S).select("session_id", "pos", "place")


ZONES = ROWS.replace("seg_id % 4 = 2", "seg_id % 4 = 0 AND seg_id > 0") + """, m AS (SELECT session_id, turn, seq, kind, start_ms, end_ms, lang, pos, CASE WHEN kind = 'text' THEN CASE WHEN seq % 3 = 0 THEN '' ELSE ' ' END || tx[1] ELSE tx END AS tx,
     CASE WHEN kind = 'lang_switch' THEN start_ms + 300 * (turn // 4 % 3) - 300 END AS bt FROM ro),
   n AS (SELECT *, min(CASE WHEN kind <> 'text' THEN pos END) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS np FROM m),
   j AS (SELECT n.session_id, n.pos, n.start_ms, n.end_ms, n.tx, n.lang, n.kind, n.bt, x.pos AS xp, x.kind AS xk, x.bt AS xb, x.start_ms AS xs FROM n LEFT JOIN n x ON x.session_id = n.session_id AND x.pos = n.np),
   k AS (SELECT *, max(CASE WHEN kind = 'text' AND start_ms < xb - 4000 THEN pos END) OVER (PARTITION BY session_id, xp) AS sp FROM j),
   zn AS (SELECT *, CASE WHEN kind = 'text' AND xk = 'lang_switch' AND pos > coalesce(sp, -1) AND lang = 'ko' THEN CASE WHEN start_ms >= xb - 50 THEN 'zone1' WHEN regexp_matches(tx, '[A-Za-z]') THEN 'zone2_opposite' WHEN start_ms >= xb - 1200 THEN 'zone2_samescript' END END AS zone FROM k)"""


@query("str09_retract", f"WITH {ZONES} SELECT session_id, pos, zone FROM zn WHERE zone IS NOT NULL")
def _(t):
    return G.retract(switched(t), S).filter("zone is not null").select("session_id", "pos", "zone")


STUB = """sb AS (SELECT session_id, seg_id, start_ms, end_ms, seg_id // 3 % 2 AS speaker, CASE WHEN seg_id % 2 = 1 THEN ' ' || string_split("text", ' ')[1] ELSE ' ' || "text" END AS tx, CASE WHEN seg_id % 2 = 1 THEN 'language_switch' ELSE 'punctuation' END AS tg FROM seg),
   ps AS (SELECT *, lag(speaker) OVER w AS pv, lag(tx) OVER w AS px, lead(speaker) OVER w AS nv, lead(tx) OVER w AS nx, lead(tg) OVER w AS ng, lead(end_ms) OVER w AS ne FROM sb WINDOW w AS (PARTITION BY session_id ORDER BY seg_id))"""


def stub_lines(t):
    first = F.get(F.split("text", " "), F.lit(0))
    return t.seg.select("session_id", "seg_id", "start_ms", "end_ms", (F.floor(F.col("seg_id") / 3) % 2).cast("int").alias("speaker"),
                        F.concat(F.lit(" "), F.when(F.col("seg_id") % 2 == 1, first).otherwise(F.col("text"))).alias("text"),
                        F.when(F.col("seg_id") % 2 == 1, "language_switch").otherwise("punctuation").alias("finalize_trigger"))


DEDUP = r"""lower(regexp_replace({0}, '^[.,?!…~"''`“”‘’()\[\]{{}}<>:;·\-–—。、，！？ \t]+|[.,?!…~"''`“”‘’()\[\]{{}}<>:;·\-–—。、，！？ \t]+$', '', 'g'))"""
from .sets import STOPS  # noqa: E402

DUP = "length(@w) >= 2 AND @w NOT IN (" + STOPS + ") AND list_contains(list_transform(string_split(trim(@p), ' '), lambda q: " + DEDUP.format("q") + "), @w)"


@query("str12_collapse_stubs", f"""WITH {STUB}, d AS (SELECT *, tg = 'language_switch' AND pv IS NOT NULL AND pv = speaker AS st, ng = 'language_switch' AND nv = speaker AS ns, {DEDUP.format('nx')} AS nw, CASE WHEN ng = 'language_switch' AND nv = speaker THEN {DUP.replace('@w', DEDUP.format('nx')).replace('@p', 'tx')} END AS nd FROM ps)
   SELECT session_id, seg_id, CASE WHEN ns AND NOT nd THEN tx || nx ELSE tx END AS "text", CASE WHEN ns AND NOT nd THEN greatest(end_ms, ne) ELSE end_ms END AS end_ms, CASE WHEN ns AND NOT nd THEN 'language_switch' ELSE tg END AS finalize_trigger FROM d WHERE NOT st""")
def _(t):
    return G.collapse_stubs(stub_lines(t), S, "seg_id").select("session_id", "seg_id", "text", "end_ms", "finalize_trigger")


@query("str33_group_sentences", """WITH l AS (SELECT session_id, seg_id, seg_id // 2 % 2 AS sp, trim("text") AS tx, seg_id % 5 <> 4 AS done, seg_id % 7 = 3 AS forced FROM seg), c AS (SELECT *, forced OR (done AND regexp_matches(tx, '[.?]$')) AS cl FROM l),
   f AS (SELECT *, CASE WHEN lag(cl) OVER w IS NULL OR lag(cl) OVER w OR lag(sp) OVER w <> sp THEN 1 ELSE 0 END AS st, lead(sp) OVER w AS ns FROM c WINDOW w AS (PARTITION BY session_id ORDER BY seg_id)), g AS (SELECT *, sum(st) OVER (PARTITION BY session_id ORDER BY seg_id) AS sn FROM f)
   SELECT session_id, CAST(sn AS BIGINT) AS sentence, min(sp) AS speaker, string_agg(tx, ' ' ORDER BY seg_id) || ' ' AS "text", arg_max(cl OR coalesce(ns <> sp, false) OR done, seg_id) AS completed FROM g GROUP BY session_id, sn""")
def _(t):
    l = t.seg.select("session_id", "seg_id", (F.floor(F.col("seg_id") / 2) % 2).alias("speaker"), "text", (F.col("seg_id") % 5 != 4).alias("completed"), (F.col("seg_id") % 7 == 3).alias("forced"))
    return G.group_sentences(l, S, "seg_id")


HYST = """fr AS (SELECT session_id, frame_no, k >= 50 AS hi, k < 35 AS lo FROM frm), isl AS (SELECT *, sum(CASE WHEN hi THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY frame_no) AS i FROM fr),
   ff AS (SELECT session_id, i, min(CASE WHEN hi THEN frame_no END) AS h, min(CASE WHEN lo THEN frame_no END) AS f FROM isl WHERE i > 0 GROUP BY ALL), ee AS (SELECT a.session_id, a.i, min(a.frame_no) AS e FROM isl a JOIN ff b USING (session_id, i) WHERE a.lo AND a.frame_no - b.f >= 2 GROUP BY ALL),
   ii AS (SELECT ff.*, ee.e, lag(ee.e) OVER w AS pe, row_number() OVER w AS rn FROM ff LEFT JOIN ee USING (session_id, i) WINDOW w AS (PARTITION BY session_id ORDER BY i)),
   ev AS (SELECT session_id, e AS frame_no, 'end' AS event, f * 32 + 30 - 32 AS at_ms FROM ii WHERE e IS NOT NULL UNION ALL SELECT session_id, h, 'start', greatest(0, h * 32 - 62) FROM ii WHERE rn = 1 OR pe IS NOT NULL)"""


@query("str02_speech_events", f"WITH {HYST} SELECT * FROM ev")
def _(t):
    return P.speech_events(t.frm, S, "k", 32, min_silence_ms=64)


@query("str03_silences", f"""WITH {HYST}, n AS (SELECT *, lead(at_ms) OVER (PARTITION BY session_id ORDER BY frame_no) AS nx FROM ev) SELECT session_id, at_ms AS start_ms, nx AS end_ms, nx - at_ms AS duration_ms, nx - at_ms > 100 AS marker FROM n WHERE event = 'end' AND nx IS NOT NULL""")
def _(t):
    return P.silences(P.speech_events(t.frm, S, "k", 32, min_silence_ms=64), S, 100)


@query("str30_classify_silence", """WITH e AS (SELECT session_id, frame_no, k * 30 AS d FROM frm), b AS (SELECT *, CASE WHEN d >= 2000 THEN 'long' WHEN d >= 500 AND frame_no % 3 <> 0 THEN 'short' ELSE 'none' END AS branch FROM e)
   SELECT session_id, frame_no, branch, (SELECT arg_max(x.d + x.frame_no * 32, x.frame_no) FROM b x WHERE x.session_id = b.session_id AND x.frame_no <= b.frame_no AND x.branch = 'long') AS base_ms FROM b""")
def _(t):
    e = t.frm.select("session_id", "frame_no", (F.col("k") * 30).alias("d"), (F.col("frame_no") % 3 != 0).alias("auto_language"), (F.col("frame_no") * 32).alias("offset_ms"))
    return P.classify_silence(e, S, "frame_no", "d").select("session_id", "frame_no", "branch", "base_ms")


@query("str15_script_triggers", """WITH b AS (SELECT session_id, seq, (seq - 1) // 4 AS batch, start_ms, regexp_matches(word, '[à-ÿ]') AS o, NOT regexp_matches(word, '[a-z]') AS ne FROM tok), r AS (SELECT *, sum(CASE WHEN NOT o AND NOT ne THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS i FROM b),
   c AS (SELECT *, sum(CASE WHEN o THEN 1 ELSE 0 END) OVER w AS n, max(CASE WHEN o THEN start_ms + 100 END) OVER w AS te, min(CASE WHEN o THEN start_ms END) OVER (PARTITION BY session_id, i) AS tb FROM r WINDOW w AS (PARTITION BY session_id, i ORDER BY seq)),
   e AS (SELECT session_id, batch, arg_max(n, seq) AS n, arg_max(CASE WHEN n > 0 THEN te - tb ELSE 0 END, seq) AS d FROM c GROUP BY ALL) SELECT session_id, batch, n >= 3 OR d >= 1000 AS triggered FROM e""")
def _(t):
    k = t.tok.withColumn("batch", F.floor((F.col("seq") - 1) / 4)).withColumn("end_ms", F.col("start_ms") + 100)
    o = F.col("word").rlike("[à-ÿ]")
    return P.script_triggers(k, S, "batch", "seq", opposite=o, neutral=~o & ~F.col("word").rlike("[a-z]"))


ALERT = """pb AS (SELECT session_id, frame_no, frame_no % 50 <> 0 AS au, CASE WHEN frame_no % 31 = 0 THEN NULL WHEN frame_no // 20 % 2 = 0 THEN 'en' ELSE 'ko' END AS lk, 1000 + (frame_no % 9) * 500 AS sl, k AS pk, k AS pe, frame_no * 400 AS tm, CASE WHEN frame_no % 40 = 0 THEN frame_no * 400 END AS sw, frame_no % 13 = 0 AS bz FROM frm),
   pr AS (SELECT *, CASE WHEN NOT au THEN 'g1' WHEN lk IS NULL THEN 'g2' WHEN sl < 2000 THEN 'g3' WHEN pk < 20 THEN 'g4' END AS pre, max(sw) OVER (PARTITION BY session_id ORDER BY frame_no) AS ls FROM pb),
   cl AS (SELECT *, sum(CASE WHEN pre IN ('g3', 'g4') THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY frame_no) AS c FROM pr), e1 AS (SELECT *, CASE WHEN lk = lag(lk) OVER (PARTITION BY session_id, c ORDER BY frame_no) THEN 0 ELSE 1 END AS st FROM cl WHERE pre IS NULL),
   e2 AS (SELECT *, sum(st) OVER (PARTITION BY session_id, c ORDER BY frame_no) AS rn FROM e1), e3 AS (SELECT *, row_number() OVER w AS cn, tm - min(tm) OVER (PARTITION BY session_id, c, rn) AS du FROM e2 WINDOW w AS (PARTITION BY session_id, c, rn ORDER BY frame_no)),
   al AS (SELECT session_id, frame_no, CASE WHEN cn < 3 OR du < 800 THEN 'g5' WHEN tm - coalesce(ls, 0) < 3000 THEN 'g6' WHEN bz THEN 'g7' END AS blocked_by FROM e3 UNION ALL SELECT session_id, frame_no, pre FROM pr WHERE pre IS NOT NULL)"""


def alerts(t):
    n = F.col("frame_no")
    p = t.frm.select("session_id", "frame_no", (n % 50 != 0).alias("auto"), F.when(n % 31 == 0, None).when(F.floor(n / 20) % 2 == 0, "en").otherwise("ko").alias("locked"), (1000 + (n % 9) * 500).alias("seglen_ms"),
                     F.col("k").alias("p_ko"), F.col("k").alias("p_en"), (n * 400).alias("t_ms"), F.when(n % 40 == 0, n * 400).alias("switch_t"), (n % 13 == 0).alias("busy"))
    return P.sustained_alerts(p, S, "frame_no", tau=20)


@query("str17_sustained_alerts", f"WITH {ALERT} SELECT * FROM al")
def _(t):
    return alerts(t).select("session_id", "frame_no", "blocked_by")


@query("agg26_gate_stats", f"WITH {ALERT} SELECT session_id, coalesce(blocked_by, 'fired') AS gate, count(*) AS n FROM al GROUP BY ALL")
def _(t):
    return A.gate_stats(alerts(t), S)


@query("str18_stall_alerts", """WITH RECURSIVE ev AS (SELECT session_id, frame_no, frame_no * 900 AS tm, k >= 95 AS em FROM frm), r AS (SELECT session_id, frame_no, CASE WHEN em OR tm > 10000 THEN tm ELSE 0 END AS a, NOT em AND tm > 10000 AS fired, tm AS late FROM ev WHERE frame_no = 1
   UNION ALL SELECT e.session_id, e.frame_no, CASE WHEN e.em OR e.tm - r.a > 10000 THEN e.tm ELSE r.a END, NOT e.em AND e.tm - r.a > 10000, e.tm - r.a FROM r JOIN ev e ON e.session_id = r.session_id AND e.frame_no = r.frame_no + 1) SELECT session_id, frame_no, late AS stalled_ms FROM r WHERE fired""")
def _(t):
    e = t.frm.select("session_id", "frame_no", (F.col("frame_no") * 900).alias("t_ms"), (F.col("k") >= 95).alias("emits"))
    return P.stall_alerts(e, S, "frame_no")


@query("str29_switch_overlap", f"""WITH x AS (SELECT session_id, seq, turn AS batch, {DEDUP.format('word')} AS w FROM tok), h AS (SELECT session_id, batch, min(seq) AS s FROM x GROUP BY ALL)
   SELECT h.session_id, h.batch, count(CASE WHEN EXISTS (SELECT 1 FROM x p WHERE p.session_id = h.session_id AND p.seq < h.s AND p.seq >= h.s - 5 AND p.w = x.w) THEN 1 END) AS overlap, count(*) AS n_words FROM h JOIN x ON x.session_id = h.session_id AND x.batch = h.batch WHERE x.w <> '' AND h.batch > 0 GROUP BY ALL""")
def _(t):
    k = t.tok.withColumn("batch", F.col("turn")).withColumn("switched", F.col("turn") > 0)
    return P.switch_overlap(k, S, "seq")


@query("str32_suppression_streaks", """WITH e AS (SELECT session_id, frame_no, k < 70 AS su, k % 4 = 0 AS po FROM frm), i AS (SELECT *, sum(CASE WHEN su THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY frame_no) AS g FROM e),
   c AS (SELECT session_id, frame_no, row_number() OVER (PARTITION BY session_id, g ORDER BY frame_no) AS streak FROM i WHERE su AND NOT po) SELECT * FROM c WHERE streak % 3 = 0""")
def _(t):
    e = t.frm.select("session_id", "frame_no", (F.col("k") < 70).alias("suppressed"), (F.col("k") % 4 == 0).alias("punct_only"))
    return P.suppression_streaks(e, S, "frame_no", 3)


@query("flagship_session_timeline")
def _(t):
    """Tokens, segments, cleaning, and the rollup per session."""
    lines = G.finalize_lines(spoken(t), S).withColumn("key", F.concat_ws(":", "session_id", "line"))
    lines = cut(lines)
    clean = FI.clean_segments(lines, PHRASES, user_first(t), whole_words=True, silence=F.col("speaker") == -2)
    clean = cut(clean)
    counts = A.timeline_counts(clean.withColumn("speaker", F.when(F.col("speaker") >= 0, F.col("speaker") + 1).otherwise(F.col("speaker"))), S)
    changes = W.n_speaker_changes(clean, S, "line")
    span = clean.groupBy(*S).agg(F.count(F.lit(1)).alias("n_lines"), F.max("end_ms").alias("end_ms"))
    return counts.join(changes, S).join(span, S)

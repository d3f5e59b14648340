"""Scoring queries: whole texts of documents and whole turns."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import scoring as SC
from ..operators import sets as O
from .registry import query

K = ["doc_id"]


def accented(word):
    """KO / EN rule on the given texts: accented letters stand in for Hangul."""
    other, latin = word.rlike("[à-ÿ]"), word.rlike("[a-z]")
    return F.when(other & ~latin, "KO").when(other, "KO").when(latin, "EN").otherwise("NEU")


SENTENCE, BLOCK = "\x01", "\x02"


def sentence_pairs(t):
    """Texts against a damaged copy, with the words of each sentence (``n``), whether it is the last of its block and whether a
    line of the copy ends there. Paragraph lines are speaker blocks with sentences inside them; a line of the copy takes two.

    The borders are marked in the text before its words are taken, so it is read once."""
    text = F.lower(F.translate("text", SENTENCE + BLOCK, "||"))
    text = F.translate(F.regexp_replace(text, r"(?<=[.!?])[ \t\x0B\f\r]+", f" {SENTENCE} "), "\n", BLOCK)
    text = F.regexp_replace(F.regexp_replace(text, rf"[^\p{{L}}\p{{M}}\p{{N}}_\s\-'{SENTENCE}{BLOCK}]", " "), r"\s+", " ")
    d = X.hold(t.doc.where(F.col("text").isNotNull()).select("doc_id", text.alias("_m")), r=F.trim(F.regexp_replace(F.translate("_m", SENTENCE + BLOCK, "  "), " +", " ")))

    def size(s):
        s = F.btrim(s, F.lit(" " + BLOCK))
        return F.when(s == "", 0).otherwise(F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1)

    def block(p):  # its last sentence keeps the mark
        last = lambda s: F.endswith(s, F.lit(BLOCK))
        return F.transform(F.split(F.concat(p, F.lit(BLOCK)), SENTENCE), lambda s, k: F.struct(size(s).alias("n"), last(s).alias("last"), (last(s) | (k % 2 == 1)).alias("ends")))

    s = F.flatten(F.transform(F.split("_m", BLOCK), block))
    d = X.hold(d.select("doc_id", "r", damaged(F.split("r", " ")).alias("h"), s.alias("s")), n=F.transform("s", lambda x: x["n"]))
    return d.select("doc_id", "r", "h", "s", "n", SC.upto("n").alias("upto"))


def damaged(words):
    """Every seventh word dropped, others replaced."""
    return F.array_join(F.filter(F.transform(words, lambda x, i: F.when(i % 11 == 3, F.lit("x")).otherwise(x)), lambda x, i: i % 7 != 6), " ")


def inner(t):
    """Sentence pairs with the boundaries in the text (``speaker`` or ``sentence``) and, moved to its word counts, in the copy."""
    p = sentence_pairs(t)
    p = X.hold(p, z=F.filter(F.arrays_zip("s", "upto"), lambda x: (x["upto"] > 0) & (x["upto"] < F.element_at("upto", -1))))
    bounds = lambda keep: F.transform(F.filter("z", keep), lambda x: x["upto"])
    own = lambda x: x["s"]["n"] > 0
    moved = F.array_distinct(F.transform(bounds(lambda x: x["s"]["ends"]), lambda b: b - F.floor(b / 7)))
    return p.select("doc_id", "r", "h", bounds(own).alias("all"), bounds(lambda x: own(x) & x["s"]["last"]).alias("speaker"),
                    bounds(lambda x: own(x) & ~x["s"]["last"]).alias("sentence"), moved.alias("heard"))


@query("aln01_align_words")
def _(t):
    return SC.align(t.pair, "doc_id", "ref", "hyp", words=False)


@query("agg02_wer")
def _(t):
    return SC.wer(t.pair, "doc_id", "ref", "hyp")


@query("agg02_corpus_wer")
def _(t):
    s = SC.wer(t.pair, "doc_id", "ref", "hyp").join(t.pair.select("doc_id", "lang"), "doc_id")
    return SC.corpus_wer(s, ["lang"])


@query("agg08_language_mismatch")
def _(t):
    return SC.pair_mismatch(t.pair, K, "ref", "hyp", accented)


@query("win05_insertion_runs")
def _(t):
    return SC.pair_mismatch(t.pair, K, "hyp", "ref", accented).select("doc_id", "max_ins_run", "ins_runs_ge3")


# Turns against a damaged copy: short pairs, whose whole edit table SQL can build. The SQL numbers the turns.
TURNS = ["session_id", "turn"]
NUMBERED = """pk AS (SELECT session_id, turn, row_number() OVER (ORDER BY session_id, turn) AS pair_id FROM (SELECT DISTINCT session_id, turn FROM tok)),
   pw AS (SELECT pair_id, seq, word, start_ms, row_number() OVER (PARTITION BY pair_id ORDER BY seq) - 1 AS i FROM tok JOIN pk USING (session_id, turn))"""
HEARD = """hx AS (SELECT pair_id, i * 2 AS o, CASE WHEN i % 11 = 3 THEN 'x' ELSE word END AS word FROM pw WHERE i % 7 <> 6 UNION ALL SELECT pair_id, i * 2 + 1, CASE WHEN i % 2 = 0 THEN 'y' ELSE 'é' END FROM pw WHERE i % 13 IN (5, 6, 7))"""
EDITS = """rf AS (SELECT pair_id, i + 1 AS i, word FROM pw),
   hy AS (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY o) AS j, word FROM hx),
   nm AS (SELECT pair_id, n, coalesce(m, 0) AS m FROM (SELECT pair_id, count(*) AS n FROM rf GROUP BY 1) LEFT JOIN (SELECT pair_id, count(*) AS m FROM hy GROUP BY 1) USING (pair_id)),
   dp AS (SELECT pair_id, CAST(0 AS BIGINT) AS i, j, j AS d FROM (SELECT pair_id, unnest(range(0, m + 1)) AS j FROM nm)
     UNION ALL SELECT pair_id, i, j, j + min(c - j) OVER (PARTITION BY pair_id ORDER BY j) AS d FROM (SELECT q.pair_id, q.i + 1 AS i, q.j, least(q.d + 1, coalesce(q.diag + CASE WHEN r.word = h.word THEN 0 ELSE 1 END, 1000000)) AS c
       FROM (SELECT dp.pair_id, dp.i, dp.j, dp.d, lag(dp.d) OVER (PARTITION BY dp.pair_id ORDER BY dp.j) AS diag FROM dp) q JOIN nm ON nm.pair_id = q.pair_id AND q.i < nm.n JOIN rf r ON r.pair_id = q.pair_id AND r.i = q.i + 1 LEFT JOIN hy h ON h.pair_id = q.pair_id AND h.j = q.j)),
   ce AS (SELECT c.pair_id, c.i, c.j, CASE WHEN c.i = 0 THEN 'ins' WHEN c.j > 0 AND r.word = h.word THEN 'match' WHEN c.j > 0 AND c.d = g.d + 1 THEN 'sub' WHEN c.d = u.d + 1 THEN 'del' ELSE 'ins' END AS op, r.word AS rw, h.word AS hw
     FROM dp c LEFT JOIN dp g ON g.pair_id = c.pair_id AND g.i = c.i - 1 AND g.j = c.j - 1 LEFT JOIN dp u ON u.pair_id = c.pair_id AND u.i = c.i - 1 AND u.j = c.j LEFT JOIN rf r ON r.pair_id = c.pair_id AND r.i = c.i LEFT JOIN hy h ON h.pair_id = c.pair_id AND h.j = c.j WHERE c.i + c.j > 0),
   pt AS (SELECT pair_id, n AS i, m AS j, 0 AS k FROM nm UNION ALL SELECT pt.pair_id, pt.i - CASE WHEN ce.op = 'ins' THEN 0 ELSE 1 END, pt.j - CASE WHEN ce.op = 'del' THEN 0 ELSE 1 END, k + 1 FROM pt JOIN ce ON ce.pair_id = pt.pair_id AND ce.i = pt.i AND ce.j = pt.j),
   al AS (SELECT pt.pair_id, count(*) OVER (PARTITION BY pt.pair_id) - pt.k - 1 AS op_no, ce.op, CASE WHEN ce.op <> 'ins' THEN pt.i - 1 END AS ref_idx, CASE WHEN ce.op <> 'del' THEN pt.j - 1 END AS hyp_idx, pt.i AS ref_pos, pt.j AS hyp_pos,
     CASE WHEN ce.op <> 'ins' THEN ce.rw END AS ref_word, CASE WHEN ce.op <> 'del' THEN ce.hw END AS hyp_word FROM pt JOIN ce ON ce.pair_id = pt.pair_id AND ce.i = pt.i AND ce.j = pt.j)"""
TURN_PAIRS = f"{NUMBERED}, {HEARD}, {EDITS}"
SCRIPT = "CASE WHEN {0} IS NULL THEN NULL WHEN regexp_matches({0}, '[à-ÿ]') THEN 'KO' WHEN regexp_matches({0}, '[a-z]') THEN 'EN' ELSE 'NEU' END"
MISMATCH = f"""{TURN_PAIRS}, sc AS (SELECT *, {SCRIPT.format('ref_word')} AS rs, {SCRIPT.format('hyp_word')} AS hs FROM al),
   ir AS (SELECT pair_id, count(*) AS n FROM (SELECT pair_id, op_no - row_number() OVER (PARTITION BY pair_id ORDER BY op_no) AS g FROM al WHERE op = 'ins') GROUP BY pair_id, g),
   im AS (SELECT pair_id, max(n) AS max_ins_run, count(CASE WHEN n >= 3 THEN 1 END) AS ins_runs_ge3 FROM ir GROUP BY pair_id),
   mm AS (SELECT pair_id, count(CASE WHEN rs = 'KO' THEN 1 END) AS ko_ref_words, count(CASE WHEN rs = 'KO' AND op = 'match' THEN 1 END) AS ko_ok, count(CASE WHEN rs = 'KO' AND op = 'del' THEN 1 END) AS ko_del, count(CASE WHEN rs = 'KO' AND op = 'sub' AND hs = 'EN' THEN 1 END) AS ko_to_en,
     count(CASE WHEN rs = 'KO' AND op = 'sub' AND hs <> 'EN' THEN 1 END) AS ko_to_ko, count(CASE WHEN rs = 'EN' THEN 1 END) AS en_ref_words, count(CASE WHEN rs = 'EN' AND op = 'match' THEN 1 END) AS en_ok, count(CASE WHEN rs = 'EN' AND op = 'del' THEN 1 END) AS en_del,
     count(CASE WHEN rs = 'EN' AND op = 'sub' AND hs = 'KO' THEN 1 END) AS en_to_ko, count(CASE WHEN rs = 'EN' AND op = 'sub' AND hs <> 'KO' THEN 1 END) AS en_to_en, count(CASE WHEN op = 'ins' AND hs = 'KO' THEN 1 END) AS ins_ko, count(CASE WHEN op = 'ins' AND hs = 'EN' THEN 1 END) AS ins_en,
     count(CASE WHEN op = 'ins' AND hs NOT IN ('KO', 'EN') THEN 1 END) AS ins_neu, count(ref_word) AS ref_words FROM sc GROUP BY pair_id)"""


def turn_pairs(t):
    g = t.tok.groupBy(*TURNS).agg(F.array_sort(F.collect_list(F.struct("seq", "word"))).alias("w"))
    g = g.select(*TURNS, F.transform("w", lambda x: x["word"]).alias("r"))

    def heard(w, i):
        own = F.when(i % 7 != 6, F.array(F.when(i % 11 == 3, F.lit("x")).otherwise(w))).otherwise(F.array().cast("array<string>"))
        more = F.when((i % 13).isin(5, 6, 7), F.array(F.when(i % 2 == 0, F.lit("y")).otherwise(F.lit("é")))).otherwise(F.array().cast("array<string>"))
        return F.concat(own, more)

    return g.select(*TURNS, "r", F.flatten(F.transform("r", heard)).alias("h"))


def turn_ops(t):
    return SC.align(turn_pairs(t), TURNS, "r", "h")


@query("aln01_align_turns", f"WITH RECURSIVE {TURN_PAIRS} SELECT pk.session_id, pk.turn, al.* EXCLUDE (pair_id) FROM al JOIN pk USING (pair_id)")
def _(t):
    return turn_ops(t)


@query("aln01_align_turns_sql", f"WITH RECURSIVE {TURN_PAIRS} SELECT pk.session_id, pk.turn, al.* EXCLUDE (pair_id) FROM al JOIN pk USING (pair_id)")
def _(t):
    """The same operations from a lateral join in SQL."""
    from ..functions import tables
    tables.register(t.spark)
    return t.spark.sql("SELECT p.session_id, p.turn, o.* FROM {pairs} p, LATERAL align_words(p.r, p.h) o", pairs=turn_pairs(t))


WER = """er AS (SELECT nm.pair_id, count(CASE WHEN op = 'sub' THEN 1 END) AS substitutions, count(CASE WHEN op = 'ins' THEN 1 END) AS insertions, count(CASE WHEN op = 'del' THEN 1 END) AS deletions, any_value(n) AS ref_words, any_value(m) AS hyp_words FROM nm LEFT JOIN al USING (pair_id) GROUP BY nm.pair_id)"""


@query("agg02_turn_wer", f"WITH RECURSIVE {TURN_PAIRS}, {WER} SELECT pk.session_id, pk.turn, er.* EXCLUDE (pair_id), (substitutions + insertions + deletions) / ref_words AS wer FROM er JOIN pk USING (pair_id)")
def _(t):
    return SC.wer(turn_pairs(t), TURNS, "r", "h")


@query("agg02_session_wer", f"""WITH RECURSIVE {TURN_PAIRS}, {WER} SELECT session_id, CAST(sum(substitutions + insertions + deletions) AS BIGINT) AS errors, CAST(sum(ref_words) AS BIGINT) AS ref_words,
   sum(substitutions + insertions + deletions) / sum(ref_words) AS wer FROM er JOIN pk USING (pair_id) GROUP BY ALL""")
def _(t):
    s = SC.wer(turn_pairs(t), TURNS, "r", "h")
    return SC.corpus_wer(s, ["session_id"])


@query("agg08_turn_mismatch", f"""WITH RECURSIVE {MISMATCH} SELECT pk.session_id, pk.turn, mm.* EXCLUDE (pair_id), coalesce(max_ins_run, 0) AS max_ins_run, coalesce(ins_runs_ge3, 0) AS ins_runs_ge3, CASE WHEN ko_ref_words > 0 THEN ko_to_en / ko_ref_words END AS lmr_ko,
   CASE WHEN en_ref_words > 0 THEN en_to_ko / en_ref_words END AS lmr_en, coalesce((ko_to_en + en_to_ko) / nullif(ref_words, 0), 0) AS lmr_wer_pp FROM mm JOIN pk USING (pair_id) LEFT JOIN im USING (pair_id)""")
def _(t):
    return SC.pair_mismatch(turn_pairs(t), TURNS, "r", "h", accented)


@query("win05_turn_insertion_runs", f"""WITH RECURSIVE {MISMATCH} SELECT session_id, turn, coalesce(max_ins_run, 0) AS max_ins_run, coalesce(ins_runs_ge3, 0) AS ins_runs_ge3 FROM mm JOIN pk USING (pair_id) LEFT JOIN im USING (pair_id)""")
def _(t):
    return SC.pair_mismatch(turn_pairs(t), TURNS, "r", "h", accented).select(*TURNS, "max_ins_run", "ins_runs_ge3")


# Sentences of a turn end at words with a full stop, question or exclamation mark; every fourth place also changes the speaker.
BOUNDS = f"""{TURN_PAIRS}, rb AS (SELECT pair_id, rf.i AS bound, CASE WHEN rf.i % 4 = 0 THEN 'speaker' ELSE 'sentence' END AS kind FROM rf JOIN nm USING (pair_id) WHERE regexp_matches(word, '[.!?]$') AND rf.i < n),
   hb AS (SELECT pair_id, hy.j AS bound FROM hy JOIN nm USING (pair_id) WHERE (regexp_matches(word, '[.!?]$') AND hy.j % 3 <> 0 OR hy.j % 11 = 5) AND hy.j < m),
   pj AS (SELECT hb.pair_id, projected, row_number() OVER (PARTITION BY hb.pair_id ORDER BY hb.bound) AS k FROM hb JOIN (SELECT pair_id, hyp_pos, max(ref_pos) AS projected FROM al GROUP BY ALL) p ON p.pair_id = hb.pair_id AND p.hyp_pos = hb.bound),
   fr AS (SELECT pair_id, kind, list(bound ORDER BY bound) AS free FROM (SELECT pair_id, 'all' AS kind, bound FROM rb UNION ALL SELECT pair_id, kind, bound FROM rb) GROUP BY ALL),
   gr AS (SELECT pair_id, kind, free, CAST(0 AS BIGINT) AS k, false AS hit FROM fr UNION ALL SELECT pair_id, kind, CASE WHEN q IS NULL THEN free ELSE free[:q - 1] || free[q + 1:] END, k, q IS NOT NULL FROM
     (SELECT g.pair_id, g.kind, g.free, p.k, list_min(list_filter(range(1, len(g.free) + 1), lambda i: abs(g.free[i] - p.projected) <= 1)) AS q FROM gr g JOIN pj p ON p.pair_id = g.pair_id AND p.k = g.k + 1)),
   ct AS (SELECT nm.pair_id, (SELECT count(*) FROM pj WHERE pj.pair_id = nm.pair_id) AS nh, (SELECT count(*) FROM rb WHERE rb.pair_id = nm.pair_id) AS nr, (SELECT count(*) FROM rb WHERE rb.pair_id = nm.pair_id AND kind = 'speaker') AS np,
     (SELECT count(*) FROM gr WHERE gr.pair_id = nm.pair_id AND hit AND kind = 'all') AS ma, (SELECT count(*) FROM gr WHERE gr.pair_id = nm.pair_id AND hit AND kind = 'speaker') AS ms, (SELECT count(*) FROM gr WHERE gr.pair_id = nm.pair_id AND hit AND kind = 'sentence') AS me,
     (SELECT count(DISTINCT k) FROM gr WHERE gr.pair_id = nm.pair_id AND hit AND kind <> 'all') AS mb FROM nm)"""


def _rates(m: str, r: str, h: str, name: str) -> str:
    p, q = f"(CASE WHEN {h} > 0 THEN {m} / ({h}) ELSE 0.0 END)", f"(CASE WHEN {r} > 0 THEN {m} / ({r}) ELSE 0.0 END)"
    f1 = f"CASE WHEN {p} + {q} > 0 THEN 2 * {p} * {q} / ({p} + {q}) ELSE 0.0 END"
    return ", ".join(f"CASE WHEN ({r}) = 0 AND ({h}) = 0 THEN 1.0 ELSE {x} END AS {name}_{n}" for x, n in ((p, "precision"), (q, "recall"), (f1, "f1")))


def turn_bounds(t):
    """Pairs of turns with the boundaries in both texts."""
    ends = lambda x: x.rlike("[.!?]$")

    def places(column, keep):
        at = F.transform(column, lambda x, i: F.when(keep(x, i + 1) & (i + 1 < F.size(column)), (i + 1).cast("bigint")))
        return F.filter(at, lambda b: b.isNotNull())

    p = turn_pairs(t).withColumn("all", places("r", lambda x, b: ends(x))).withColumn("heard", places("h", lambda x, b: (ends(x) & (b % 3 != 0)) | (b % 11 == 5)))
    return p.withColumn("speaker", F.filter("all", lambda b: b % 4 == 0)).withColumn("sentence", F.filter("all", lambda b: b % 4 != 0))


@query("agg10_turn_segmentation_f1", f"""WITH RECURSIVE {BOUNDS} SELECT session_id, turn, {_rates('ma', 'nr', 'nh', 'boundary')}, CAST(ma AS INTEGER) AS matched, CAST(nr AS INTEGER) AS n_ref, CAST(nh AS INTEGER) AS n_hyp FROM ct JOIN pk USING (pair_id)""")
def _(t):
    return SC.segmentation_f1(turn_bounds(t), TURNS, "r", "h", "all", "heard")


@query("agg11_turn_speaker_sentence_f1", f"""WITH RECURSIVE {BOUNDS}, al2 AS (SELECT *, nh - mb AS loose FROM ct), rt AS (SELECT pair_id, {_rates('ms', 'np', 'ms + loose', 'speaker')}, {_rates('me', 'nr - np', 'me + loose', 'sentence')}, nr - np AS ns, np, loose FROM al2)
   SELECT session_id, turn, speaker_precision, speaker_recall, speaker_f1, CASE WHEN ns > 0 THEN sentence_precision END AS sentence_precision, CASE WHEN ns > 0 THEN sentence_recall END AS sentence_recall, CASE WHEN ns > 0 THEN sentence_f1 END AS sentence_f1,
     CAST(ns AS INTEGER) AS n_sentence, CAST(np AS INTEGER) AS n_speaker, CAST(loose AS INTEGER) AS unexplained FROM rt JOIN pk USING (pair_id)""")
def _(t):
    return SC.speaker_sentence_f1(turn_bounds(t), TURNS, "r", "h", "speaker", "sentence", "heard")


@query("agg09_turn_flip_events", f"""WITH RECURSIVE {TURN_PAIRS}, rs AS (SELECT pair_id, i, word, coalesce(sum(CASE WHEN regexp_matches(word, '[.!?]$') THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM rf),
   ow AS (SELECT al.pair_id, s.sentence, {SCRIPT.format('al.ref_word')} AS rx, {SCRIPT.format('al.hyp_word')} AS hx, al.ref_word FROM al JOIN rs s ON s.pair_id = al.pair_id AND s.i = al.ref_pos),
   ev AS (SELECT pair_id, sentence, count(CASE WHEN rx = 'KO' THEN 1 END) AS rk, count(CASE WHEN rx = 'EN' THEN 1 END) AS re, count(CASE WHEN hx = 'KO' THEN 1 END) AS hk, count(CASE WHEN hx = 'EN' THEN 1 END) AS he, count(ref_word) AS ref_words FROM ow GROUP BY ALL),
   dm AS (SELECT *, CASE WHEN rk > re THEN 'KO' WHEN re > rk THEN 'EN' END AS ref_script, CASE WHEN hk > he THEN 'KO' WHEN he > hk THEN 'EN' END AS hyp_script FROM ev)
   SELECT session_id, turn, CAST(sentence AS BIGINT) AS sentence, ref_script, hyp_script, ref_words FROM dm JOIN pk USING (pair_id) WHERE ref_script <> hyp_script""")
def _(t):
    pairs = turn_pairs(t)
    ends = F.filter(F.transform("r", lambda x, i: F.when(x.rlike("[.!?]$"), (i + 1).cast("bigint"))), lambda p: p.isNotNull())
    marks = F.array_union(F.concat(F.array(F.lit(0).cast("bigint")), ends), F.array(F.size("r").cast("bigint")))
    pairs = X.hold(pairs, m=marks)
    sizes = F.transform(F.sequence(F.lit(1), F.size("m") - 1), lambda k: F.get("m", k) - F.get("m", k - 1))
    return SC.flip_events(pairs.withColumn("sizes", sizes), TURNS, "r", "h", "sizes", accented)


@query("agg09_flip_events")
def _(t):
    p = sentence_pairs(t).withColumn("sizes", F.filter("n", lambda n: n > 0))
    return SC.flip_events(p, K, "r", "h", "sizes", accented).withColumn("sentence", (F.col("sentence") + 1).cast("int"))


@query("agg10_segmentation_f1")
def _(t):
    return SC.segmentation_f1(inner(t), K, "r", "h", "all", "heard")


@query("agg11_speaker_sentence_f1")
def _(t):
    return SC.speaker_sentence_f1(inner(t), K, "r", "h", "speaker", "sentence", "heard")


@query("set03_unexplained_boundaries", """WITH a AS (SELECT session_id, seg_id AS bound FROM seg), s AS (SELECT session_id, seg_id AS bound FROM seg WHERE speaker = 1), e AS (SELECT session_id, seg_id AS bound FROM seg WHERE length("text") % 3 = 0)
   SELECT * FROM a EXCEPT SELECT * FROM s EXCEPT SELECT * FROM e""")
def _(t):
    k = ["session_id", F.col("seg_id").alias("bound")]
    return O.unexplained(t.seg.select(*k), t.seg.filter("speaker = 1").select(*k), t.seg.filter("length(text) % 3 = 0").select(*k))


BARE_WORD = r"trim(regexp_replace(regexp_replace(lower(word), '[^\p{L}\p{M}\p{N}_\s\-'']', ' ', 'g'), '\s+', ' ', 'g'))"
TIMED = f"""{NUMBERED}, tw AS (SELECT pair_id, seq, {BARE_WORD} AS x, start_ms FROM pw),
   rl AS (SELECT pair_id, list(x ORDER BY seq) AS rx, list(start_ms ORDER BY seq) AS rs, count(*) AS n_ref, count(CASE WHEN seq % 6 <> 5 THEN 1 END) AS n_pred FROM tw GROUP BY pair_id),
   pd AS (SELECT pair_id, x, s, row_number() OVER (PARTITION BY pair_id ORDER BY seq) AS k FROM (SELECT pair_id, seq, CASE WHEN seq % 9 = 4 THEN 'zz' ELSE x END AS x, start_ms + (seq % 5) * 40 AS s FROM tw WHERE seq % 6 <> 5) WHERE x <> ''),
   gm AS (SELECT pair_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS done, CAST(NULL AS DOUBLE) AS d FROM rl
     UNION ALL SELECT pair_id, k, coalesce(hit, done), abs(s - rs[hit]) / 1000 FROM (SELECT g.pair_id, p.k, g.done, p.s, r.rs, list_min(list_filter(range(g.done + 1, least(g.done + 3, len(r.rx)) + 1), lambda i: r.rx[i] = p.x)) AS hit
       FROM gm g JOIN pd p ON p.pair_id = g.pair_id AND p.k = g.k + 1 JOIN rl r ON r.pair_id = g.pair_id))"""


@query("jon19_timestamp_accuracy", f"""WITH RECURSIVE {TIMED} SELECT session_id, turn, CAST(any_value(n_ref) AS INTEGER) AS n_ref, CAST(any_value(n_pred) AS INTEGER) AS n_pred, CAST(count(d) AS INTEGER) AS n_matched,
   round(avg(d), 6) AS mae_start, round(max(d), 6) AS max_delta_start, round(median(d), 6) AS median_delta_start FROM rl JOIN pk USING (pair_id) JOIN gm USING (pair_id) GROUP BY session_id, turn""")
def _(t):
    g = t.tok.groupBy(*TURNS).agg(F.array_sort(F.collect_list(F.struct("seq", X.scoring_form("word").alias("word"), "start_ms"))).alias("w"))
    ref = F.transform("w", lambda x: F.struct(x["word"].alias("word"), (x["start_ms"] / 1000).alias("start")))
    pred = F.transform(F.filter("w", lambda x: x["seq"] % 6 != 5), lambda x: F.struct(
        F.when(x["seq"] % 9 == 4, F.lit("zz")).otherwise(x["word"]).alias("word"), ((x["start_ms"] + (x["seq"] % 5) * 40) / 1000).alias("start")))
    d = SC.timestamp_accuracy(g.select(*TURNS, ref.alias("ref"), pred.alias("pred")), TURNS)
    return d.select(*TURNS, "n_ref", "n_pred", "n_matched", *[F.round(c, 6).alias(c) for c in ("mae_start", "max_delta_start", "median_delta_start")])


# Turns whose every tenth word of four letters or more is heard in two pieces, every other time across lines; one of 13 is misheard.
PIECES = """pc AS (SELECT pair_id, i, seq, word, seq % 5 = 0 AND length(word) >= 4 AS sp FROM pw),
   hq AS (SELECT pair_id, i * 2 AS o, 0 AS line, CASE WHEN sp THEN word[1:2] WHEN i % 13 = 7 THEN 'x' ELSE word END AS word FROM pc UNION ALL SELECT pair_id, i * 2 + 1, CASE WHEN seq % 10 = 0 THEN 1 ELSE 0 END, word[3:] FROM pc WHERE sp),
   hx AS (SELECT pair_id, o, word, sum(line) OVER (PARTITION BY pair_id ORDER BY o) AS line FROM hq),
   ls AS (SELECT pair_id, row_number() OVER w - 1 AS hyp_idx, line <> lag(line) OVER w AS begins FROM hx WINDOW w AS (PARTITION BY pair_id ORDER BY o))"""


@query("agg24_midword_splits", f"""WITH RECURSIVE {NUMBERED}, {PIECES}, {EDITS}, ru AS (SELECT *, count(CASE WHEN op = 'match' THEN 1 END) OVER (PARTITION BY pair_id ORDER BY op_no) AS run FROM al),
   sp AS (SELECT ru.*, coalesce(begins, false) AND ru.hyp_idx > min(ru.hyp_idx) OVER (PARTITION BY ru.pair_id, run) AS inner_start FROM ru LEFT JOIN ls USING (pair_id, hyp_idx) WHERE op <> 'match')
   SELECT session_id, turn, max(ref_word) AS ref_word, min(hyp_idx) AS hyp_idx, count(hyp_word) AS pieces FROM sp JOIN pk USING (pair_id) GROUP BY session_id, turn, run
   HAVING count(ref_word) = 1 AND count(hyp_word) >= 2 AND bool_or(inner_start) AND string_agg(hyp_word, '' ORDER BY op_no) = max(ref_word)""")
def _(t):
    g = t.tok.groupBy(*TURNS).agg(F.array_sort(F.collect_list(F.struct("seq", "word"))).alias("w"))

    def heard(x, i):
        piece = lambda word, begins: F.struct(word.alias("word"), begins.alias("begins"))
        split = F.array(piece(F.substring(x["word"], 1, 2), F.lit(False)), piece(F.substr(x["word"], F.lit(3)), x["seq"] % 10 == 0))
        return F.when((x["seq"] % 5 == 0) & (F.length(x["word"]) >= 4), split).otherwise(F.array(piece(F.when(i % 13 == 7, "x").otherwise(x["word"]), F.lit(False))))

    g = g.select(*TURNS, F.transform("w", lambda x: x["word"]).alias("r"), F.flatten(F.transform("w", heard)).alias("p"))
    ops = SC.align(g.select(*TURNS, "r", F.transform("p", lambda x: x["word"]).alias("h")), TURNS, "r", "h")
    starts = g.select(*TURNS, F.posexplode("p").alias("hyp_idx", "x")).where("x.begins").select(*TURNS, F.col("hyp_idx").cast("long").alias("hyp_idx"))
    return SC.midword_splits(ops, starts, TURNS)

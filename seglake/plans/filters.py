"""Filter queries."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import filters as O
from .registry import query
from .shared import DIC_SQL, PHRASES, user_first, with_silence

SILENT = "SELECT session_id, seg_id, start_ms, end_ms, NULL::VARCHAR AS \"text\", -2 AS speaker, NULL::VARCHAR AS lang FROM sil"
LINES = f"lines AS (SELECT * FROM seg UNION ALL {SILENT})"
MARKS = "[.!?。！？]"


@query("flt01_visible_tokens", "SELECT session_id, seq, word FROM tok WHERE NOT (word LIKE '%,')")
def _(t):
    return O.visible(t.tok.withColumn("retracted", F.col("word").endswith(","))).select("session_id", "seq", "word")


@query("flt02_line_visibility", f"""WITH {LINES} SELECT session_id,
   count(CASE WHEN coalesce("text", '') <> '' OR speaker = -2 THEN 1 END) AS renderable,
   count(CASE WHEN coalesce("text", '') <> '' AND speaker <> -2 THEN 1 END) AS visible FROM lines GROUP BY session_id""")
def _(t):
    lines = with_silence(t)
    r = O.renderable(lines).groupBy("session_id").agg(F.count(F.lit(1)).alias("renderable"))
    v = O.visible_lines(lines).groupBy("session_id").agg(F.count(F.lit(1)).alias("visible"))
    return r.join(v, "session_id")


ANNOT = V.ANNOTATION.replace("'", "''")
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
S1 = STRIP.format(f"regexp_replace(\"text\", '{ANNOT}', '', 'g')")


@query("flt03_strip_annotations", f'SELECT doc_id, {S1} AS "text" FROM documents')
def _(t):
    return O.strip_annotations(t.doc.select("doc_id", "text"))


@query("flt04_drop_script", f"""SELECT doc_id, NOT regexp_matches("text", '[ßœç]|{V.CJK_KANA}') AS kept FROM documents""")
def _(t):
    kept, rejected = O.drop_script(t.doc.select("doc_id", "text"), f"[ßœç]|{V.CJK_KANA}")
    return kept.select("doc_id", F.lit(True).alias("kept")).unionByName(rejected.select("doc_id", F.lit(False).alias("kept")))


def _phrases_sql(x):
    for p in sorted(PHRASES, key=len, reverse=True):
        x = f"replace({x}, '{p}', '')"
    return STRIP.format(f"regexp_replace({x}, '\\s+', ' ', 'g')")


@query("flt05_remove_phrases", f'SELECT doc_id, {_phrases_sql(chr(34) + "text" + chr(34))} AS "text" FROM documents')
def _(t):
    return O.remove_phrases(t.doc.select("doc_id", "text"), PHRASES)


def _tidy_sql(x):
    x = STRIP.format(f"regexp_replace({x}, '\\s+', ' ', 'g')")
    x = STRIP.format(f"regexp_replace({x}, '(?:\\s*\\.\\s*){{2,}}', '. ', 'g')")
    return STRIP.format(f"regexp_replace({x}, '^[.\\s]+', '')")


@query("flt06_collapse_punctuation", f"""SELECT * FROM (SELECT doc_id, {_tidy_sql('"text"')} AS "text" FROM documents)
   WHERE NOT regexp_matches("text", '^[ .!?。！？]*$')""")
def _(t):
    return O.collapse_punct(t.doc.select("doc_id", "text"))


PIECES = r"""(?:[A-Za-z'']+|[가-힣]+)|[^A-Za-z''가-힣]+"""


def _dict_sql(src, key="doc_id"):
    return f"""pieces AS (SELECT {key}, unnest(regexp_extract_all("text", '{PIECES}')) piece,
      generate_subscripts(regexp_extract_all("text", '{PIECES}'), 1) pos FROM {src}),
      swapped AS (SELECT p.{key}, string_agg(coalesce(m.correct, p.piece), '' ORDER BY pos) AS "text"
      FROM pieces p LEFT JOIN merged m ON m.wrong = p.piece GROUP BY p.{key})"""


@query("flt07_dictionary_words", f"""WITH {DIC_SQL}, {_dict_sql('documents')}
   SELECT d.doc_id, coalesce(s."text", d."text") AS "text" FROM documents d LEFT JOIN swapped s USING (doc_id)""")
def _(t):
    return O.apply_dictionary(t.doc.select("doc_id", "text"), user_first(t), whole_words=True)


@query("flt07_dictionary_substrings")
def _(t):
    return O.apply_dictionary(t.doc.select("doc_id", "text"), user_first(t))


CLEAN = f"""a AS (SELECT doc_id, {S1} AS "text" FROM documents WHERE coalesce("text", '') <> ''),
   b AS (SELECT * FROM a WHERE NOT regexp_matches("text", '{V.CJK_KANA}')),
   c AS (SELECT doc_id, {_tidy_sql(_phrases_sql(chr(34) + "text" + chr(34)))} AS "text" FROM b),
   d AS (SELECT * FROM c WHERE NOT regexp_matches("text", '^[ .!?。！？]*$'))"""


@query("flt08_clean_segments", f"""WITH {DIC_SQL}, {CLEAN}, {_dict_sql('d')}
   SELECT doc_id, "text" FROM swapped UNION ALL SELECT doc_id, "text" FROM documents WHERE coalesce("text", '') = ''""")
def _(t):
    return O.clean_segments(t.doc.select("doc_id", "text"), PHRASES, user_first(t), whole_words=True)


@query("flt08_clean_raw", f"""WITH {DIC_SQL}, r AS (SELECT * FROM (SELECT doc_id, {_phrases_sql(chr(34) + "text" + chr(34))} AS "text"
   FROM documents) WHERE "text" <> '' AND "text" <> '?' AND NOT regexp_full_match("text", '\\.+')), {_dict_sql('r')}
   SELECT doc_id, "text" FROM swapped""")
def _(t):
    return O.clean_raw(t.doc.select("doc_id", "text"), PHRASES, user_first(t), whole_words=True)


PROB = "((length(word) * 37 + seq * 13) % 100) / 100.0"


def scored_tokens(t):
    return t.tok.withColumn("probability", ((F.length("word") * 37 + F.col("seq") * 13) % 100) / 100.0)


@query("flt09_filter_words", f"""SELECT session_id, turn,
   coalesce(string_agg(CASE WHEN {PROB} > 0.2 THEN ' ' || word END, '' ORDER BY seq), string_agg(' ' || word, '' ORDER BY seq)) AS "text",
   count(CASE WHEN {PROB} > 0.2 THEN 1 END) AS n_words FROM tok GROUP BY session_id, turn""")
def _(t):
    w = scored_tokens(t).withColumn("word", F.concat(F.lit(" "), "word"))
    w = w.withColumn("probability", ((F.length(F.trim("word")) * 37 + F.col("seq") * 13) % 100) / 100.0)
    return O.filter_words(w, ["session_id", "turn"], 0.2)


@query("flt10_drop_no_speech", """SELECT event_id, start_ms, end_ms FROM (SELECT event_id, ts_ms AS start_ms, ts_ms + (k - 5) * 10 AS end_ms,
   k / 100.0 AS p, -value / 20.0 AS lp FROM evt) WHERE NOT (p > 0.6 AND NOT (lp > -1.0)) AND start_ms < end_ms""")
def _(t):
    e = t.evt.select("event_id", F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + (F.col("k") - 5) * 10).alias("end_ms"),
                     (F.col("k") / 100.0).alias("no_speech_prob"), (-F.col("value") / 20.0).alias("avg_logprob"))
    return O.drop_no_speech(e).select("event_id", "start_ms", "end_ms")


@query("flt11_quality_gate")
def _(t):
    d = t.doc.select("doc_id", "text", (-(F.col("doc_id") % 13) / 10.0).alias("avg_logprob"))
    return O.quality_gate(d).select("doc_id", "failed_rule")


@query("flt12_clear_empty", """SELECT session_id, seg_id, CASE WHEN start_ms + 100 = end_ms OR trim("text") = '' THEN '' ELSE "text" END AS "text" FROM seg""")
def _(t):
    s = t.seg.withColumn("end_ms", F.col("end_ms") - 100)
    return O.clear_empty(s).select("session_id", "seg_id", "text")


@query("flt13_terminal_punctuation", f"""SELECT session_id, seg_id, CASE WHEN seg_id < max(seg_id) OVER (PARTITION BY session_id)
   AND seg_id % 3 <> 2 AND NOT regexp_matches("text", '{MARKS}$') AND "text" <> '' THEN "text" || '.' ELSE "text" END AS "text" FROM seg""")
def _(t):
    s = t.seg.withColumn("finalized", F.col("seg_id") % 3 != 2)
    return O.terminal_punct(s, ["session_id"], "seg_id").select("session_id", "seg_id", "text")


@query("flt14_timing_errors", """WITH j AS (SELECT session_id, seg_id, start_ms - (seg_id % 3) * 9000 AS s,
   end_ms - (seg_id % 5) * 9000 AS e FROM seg), l AS (SELECT *, lag(s) OVER (PARTITION BY session_id ORDER BY seg_id) b FROM j)
   SELECT session_id, seg_id, 'negative_start' AS rule FROM l WHERE s < 0 UNION ALL
   SELECT session_id, seg_id, 'negative_end' FROM l WHERE e < 0 UNION ALL
   SELECT session_id, seg_id, 'end_before_start' FROM l WHERE e < s UNION ALL
   SELECT session_id, seg_id, 'non_monotonic' FROM l WHERE s < b""")
def _(t):
    j = t.seg.withColumn("start_ms", F.col("start_ms") - (F.col("seg_id") % 3) * 9000).withColumn(
        "end_ms", F.col("end_ms") - (F.col("seg_id") % 5) * 9000)
    return O.timing_errors(j, ["session_id"], "seg_id")


@query("flt15_drop_marker_rows", "SELECT session_id, seq, word FROM tok WHERE NOT regexp_matches(word, '(?i)THE|^un')")
def _(t):
    return O.drop_marker_rows(t.tok, "the|^un").select("session_id", "seq", "word")


@query("flt16_strip_leading_punctuation", """WITH s AS (SELECT session_id, seq, (seq - 1) // 5 AS batch,
     CASE WHEN seq % 5 = 1 AND seq % 3 = 0 THEN '.' WHEN seq % 17 = 0 THEN '-' ELSE word END AS word FROM tok),
   m AS (SELECT *, word IN ('.', '!', '?', '。', '！', '？') AS mark, word IN ('-', '–', '—') AS dash FROM s),
   n AS (SELECT *, min(CASE WHEN NOT mark THEN seq END) OVER (PARTITION BY session_id, batch) AS first_plain,
     (SELECT max_by(x.word, x.seq) FROM m x WHERE x.session_id = m.session_id AND x.batch < m.batch AND NOT x.dash AND x.word <> '') AS tail FROM m)
   SELECT session_id, seq, word FROM n WHERE NOT dash AND NOT (mark AND seq < coalesce(first_plain, 9223372036854775807)
     AND coalesce(regexp_matches(tail, '[.!?。！？]$'), false))""")
def _(t):
    s = t.tok.select("session_id", "seq", F.floor((F.col("seq") - 1) / 5).alias("batch"),
                     F.when((F.col("seq") % 5 == 1) & (F.col("seq") % 3 == 0), ".").when(F.col("seq") % 17 == 0, "-")
                     .otherwise(F.col("word")).alias("word"))
    return O.strip_leading_punct(s, ["session_id"], "batch", "seq").select("session_id", "seq", "word")


@query("flt17_compatible_samples", """WITH caps AS (SELECT 'b' || (label % 4) AS backend,
     CASE WHEN label % 4 = 0 THEN NULL WHEN label % 4 = 1 THEN ['en', 'fr'] WHEN label % 4 = 2 THEN ['de'] ELSE ['es', 'en'] END AS languages
     FROM (SELECT DISTINCT label % 4 AS label FROM embeddings))
   SELECT b.doc_id, c.backend FROM bench b JOIN caps c ON c.languages IS NULL OR list_contains(c.languages, b.language)""")
def _(t):
    b = F.col("label") % 4
    caps = t.emb.select(b.alias("label")).distinct().select(
        F.concat(F.lit("b"), F.col("label").cast("string")).alias("backend"),
        F.when(F.col("label") == 1, F.array(F.lit("en"), F.lit("fr"))).when(F.col("label") == 2, F.array(F.lit("de")))
        .when(F.col("label") == 3, F.array(F.lit("es"), F.lit("en"))).alias("languages"))
    return O.compatible(t.bench, caps).select("doc_id", "backend")


ANOMALY = f"""sw AS (SELECT session_id, turn, seq, word, {PROB} AS p, 40 + (seq * 97) % 2400 AS dur FROM tok),
   r AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn ORDER BY seq) AS rk FROM sw
     WHERE NOT regexp_matches(word, '^["''“¿(\\[{{\\-.。,，!！?？:：”)\\]}}、]$')),
   a AS (SELECT session_id, turn, CAST(sum(CASE WHEN p < 0.15 THEN 1000 ELSE 0 END + CASE WHEN dur < 133 THEN (133 - dur) * 15 ELSE 0 END
     + CASE WHEN dur > 2000 THEN dur - 2000 ELSE 0 END) AS BIGINT) AS score, count(*) AS n FROM r WHERE rk <= 8 GROUP BY ALL)"""


def anomalies(t):
    w = scored_tokens(t).withColumn("end_ms", F.col("start_ms") + 40 + (F.col("seq") * 97) % 2400)
    return O.flag_anomalies(w, ["session_id"], "turn", "seq")


@query("flt18_segment_anomalies", f"""WITH {ANOMALY} SELECT session_id, turn, score, n,
   (score >= 3000 OR score + 10 >= n * 1000) AS anomalous FROM a""")
def _(t):
    return anomalies(t)


@query("flt18_drop_anomalous", f"""WITH {ANOMALY}, f AS (SELECT s.*, coalesce(a.score >= 1000, false) AS bad FROM seg s
     LEFT JOIN a ON a.session_id = s.session_id AND a.turn = s.seg_id),
   l AS (SELECT *, lag(end_ms) OVER w AS pe, lead(start_ms) OVER w AS ns, lead(bad) OVER w AS nb FROM f WINDOW w AS (PARTITION BY session_id ORDER BY seg_id))
   SELECT session_id, seg_id FROM l WHERE NOT (bad AND (pe IS NULL OR start_ms - pe > 600 OR start_ms < 600) AND (ns IS NULL OR ns - end_ms > 600 OR nb))""")
def _(t):
    a = anomalies(t).select("session_id", F.col("turn").alias("seg_id"), (F.col("score") >= 1000).alias("bad"))
    s = t.seg.join(a, ["session_id", "seg_id"], "left").withColumn("anomalous", F.coalesce("bad", F.lit(False)))
    return O.drop_anomalous(s, ["session_id"], "seg_id", 600).select("session_id", "seg_id")


@query("flt19_script_predicates", """WITH l AS (SELECT session_id, seq, word, lang, regexp_replace(word, '[^A-Za-z]', '', 'g') AS letters FROM tok)
   SELECT session_id, seq, (length(letters) > 0 AND (length(letters) <= 2 OR (length(letters) <= 6 AND letters = upper(letters)))) AS is_acronym,
   (lang = 'ko' AND regexp_matches(word, '[A-Za-z]')) AS is_opposite_script FROM l""")
def _(t):
    return t.tok.select("session_id", "seq", X.acronym_like("word").alias("is_acronym"),
                        X.opposite_script("word", "lang").alias("is_opposite_script"))


INFER = "CASE WHEN length(regexp_replace({0}, '[^A-Za-z]', '', 'g')) >= 4 THEN 'en' END"
SANI = r"""first AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN "text" ELSE lang END AS s, CASE WHEN contains("text", chr(10)) THEN coalesce(list_filter(list_transform(
     string_split("text", chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')[1], '') ELSE "text" END AS f FROM documents),
   cut AS (SELECT *, CASE WHEN length(f) > 500 THEN regexp_replace(substring(f, 1, 500), '\s+$', '') ELSE f END AS r FROM first)"""


@query("flt20_sanitize_translations", f"""WITH {SANI} SELECT doc_id, CASE WHEN coalesce(({INFER.format("s")}) = ({INFER.format("r")}), false) THEN '' ELSE r END AS result FROM cut""")
def _(t):
    d = t.doc.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.col("lang")).alias("source"), F.col("text").alias("result"))
    return O.sanitize_translations(d, "source", "result").select("doc_id", "result")


@query("flt20_source_language", f"""SELECT doc_id, coalesce({INFER.format('"text"')}, lang) AS source_language FROM documents""")
def _(t):
    return t.doc.select("doc_id", O.resolve_source_language(F.col("text"), F.col("lang")).alias("source_language"))


@query("flt21_trim_interim", """SELECT session_id, seg_id, CASE WHEN starts_with("text", c) AND c <> '' THEN
     regexp_replace(substring("text", length(c) + 1), '^\\s+', '') ELSE "text" END AS buffer
   FROM (SELECT *, substring("text", 1, seg_id * 9) || CASE WHEN seg_id % 2 = 1 THEN '' ELSE '~' END AS c FROM seg)""")
def _(t):
    s = t.seg.select("session_id", "seg_id", F.col("text").alias("buffer"),
                     F.concat(F.substring("text", F.lit(1), (F.col("seg_id") * 9).cast("int")),
                              F.when(F.col("seg_id") % 2 == 1, "").otherwise("~")).alias("committed"))
    return O.trim_interim(s, "buffer", "committed").select("session_id", "seg_id", "buffer")

"""Ranking, top-k and set queries, dictionary scans and sample catalogues."""

from pyspark.sql import functions as F

from ..operators import dictionary as D
from ..operators import sets as O
from ..operators.vectors import similar_examples
from ..operators.windows import repeat_runs
from ..session import cut
from ..sources import catalogs as C
from .registry import query
from .shared import DIC_SQL, user_first
from .joins import EDGE, TOPK

S = ["session_id"]


@query("src05_load_dictionary", f"WITH {DIC_SQL} SELECT wrong, correct FROM merged")
def _(t):
    return user_first(t)


@query("set02_overlay_union", "SELECT wrong, max_by(correct, CASE src WHEN 'base' THEN 1 ELSE 0 END) AS correct FROM dic GROUP BY wrong")
def _(t):
    d = t.dict_entries
    return D.overlay(d.filter("src = 'user'"), d.filter("src = 'base'"))


@query("src06_select_samples", """SELECT doc_id, language, category FROM bench WHERE language IN ('en', 'fr') AND category IN ('c1', 'c2') AND duration_ms <= 60000""")
def _(t):
    return C.select_samples(t.bench, ["en", "fr"], ["c1", "c2"], quick=F.col("duration_ms") <= 60000).select("doc_id", "language", "category")


@query("src08_tumble_rows", "SELECT session_id, (frame_no - 1) // 8 AS batch, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM frm GROUP BY ALL")
def _(t):
    return C.tumble_rows(t.frm, "frame_no", 8).groupBy("session_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


@query("snk09_dictionary_changes", f"""WITH ch AS (SELECT 'w' || (k % 60) AS wrong, 'c' || event_id AS correct, CASE WHEN event_type IN ('purchase', 'error') THEN 'delete' ELSE 'put' END AS op, event_id AS at_no FROM evt),
   ba AS (SELECT DISTINCT 'w' || (doc_id % 20) AS wrong, 'base' AS correct FROM documents), us AS (SELECT DISTINCT 'w' || (doc_id % 80 + 10) AS wrong, 'user' AS correct FROM documents),
   la AS (SELECT wrong, arg_max(op, at_no) AS op, arg_max(correct, at_no) AS correct FROM ch GROUP BY wrong),
   uu AS (SELECT wrong, correct FROM la WHERE op = 'put' UNION ALL SELECT wrong, correct FROM us WHERE wrong NOT IN (SELECT wrong FROM la)),
   sq AS (SELECT *, lag(op) OVER (PARTITION BY wrong ORDER BY at_no) AS pv FROM ch),
   rv AS (SELECT count(*) AS revision FROM sq WHERE op = 'put' OR pv = 'put' OR (pv IS NULL AND wrong IN (SELECT wrong FROM us)))
   SELECT wrong, correct, (SELECT revision FROM rv) AS revision FROM (SELECT * FROM uu UNION ALL SELECT * FROM ba WHERE wrong NOT IN (SELECT wrong FROM uu))""")
def _(t):
    e = t.evt
    ch = e.select(F.concat(F.lit("w"), (F.col("k") % 60).cast("string")).alias("wrong"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("correct"),
                  F.when(F.col("event_type").isin("purchase", "error"), "delete").otherwise("put").alias("op"), F.col("event_id").alias("at"))
    d = t.read("documents")
    base = d.select(F.concat(F.lit("w"), (F.col("doc_id") % 20).cast("string")).alias("wrong"), F.lit("base").alias("correct")).distinct()
    user = d.select(F.concat(F.lit("w"), (F.col("doc_id") % 80 + 10).cast("string")).alias("wrong"), F.lit("user").alias("correct")).distinct()
    force, revision = D.apply_changes(base, user, ch)
    return force.withColumn("revision", F.lit(revision.first()[0]))


@query("top01_longest_first", f"WITH {DIC_SQL} SELECT wrong, correct, length(wrong) AS n FROM merged ORDER BY n DESC, wrong")
def _(t):
    return D.longest_first(user_first(t))


@query("top02_top_k", f"WITH {TOPK} SELECT query_id, vec_id, rank FROM r WHERE rank <= 5")
def _(t):
    e = t.emb.select("vec_id", "embedding")
    return similar_examples(e, e, 5).select("query_id", "vec_id", "rank")


@query("top03_noisy_batches", """WITH b AS (SELECT session_id, (seq - 1) // 12 AS batch, trim(word) AS w, count(*) AS n FROM tok WHERE regexp_matches(word, '[a-z]') GROUP BY ALL), bad AS (SELECT DISTINCT session_id, batch FROM b WHERE n >= 2)
   SELECT session_id, seq FROM tok t WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.session_id = t.session_id AND bad.batch = (t.seq - 1) // 12)""")
def _(t):
    k = t.tok.withColumn("batch", F.floor((F.col("seq") - 1) / 12))
    return O.drop_noisy_batches(k, S, "batch", script_class="[a-z]", least=2).select("session_id", "seq")


@query("top04_worst_first", "SELECT doc_id, (subs + ins + dels) / ref_words AS wer FROM bench ORDER BY wer DESC, doc_id LIMIT 10")
def _(t):
    b = t.bench.select("doc_id", ((F.col("subs") + F.col("ins") + F.col("dels")) / F.col("ref_words")).alias("wer"))
    return O.worst_first(b, "wer", "doc_id")


@query("top05_rank_sequences", "SELECT user_id, arg_max(event_id, (-value / (k + 1), -event_id)) AS candidate FROM evt GROUP BY user_id")
def _(t):
    e = t.evt.select("user_id", F.col("event_id").alias("candidate"), (-F.col("value")).alias("sum_logprob"), (F.col("k") + 1).alias("length"))
    return O.rank_sequences(e, ["user_id"])


@query("top06_runs_in_order")
def _(t):
    # a sort reads its input twice, for the bounds of its ranges and for the rows
    return cut(repeat_runs(t.doc, "doc_id")).orderBy("doc_id", "start_word")


@query("set01_era_union", """SELECT session_id, seg_id, 'past' AS era, 0 AS part FROM seg WHERE speaker = 0 UNION ALL SELECT session_id, seg_id, 'now', 1 FROM seg WHERE speaker = 1 AND seg_id % 4 <> 1 UNION ALL SELECT session_id, seg_id, 'now', 2 FROM seg WHERE seg_id % 4 = 1""")
def _(t):
    s = t.seg.select("session_id", "seg_id", "speaker")
    return O.era_union(s.filter("speaker = 0"), s.filter("speaker = 1"), s.filter("seg_id % 4 = 1"), S, "seg_id").drop("speaker")


STOPS = "'the','a','an','and','or','of','to','in','on','at','for','with','from','by','is','are','was','were','be','been','i','we','you','it','he','she','they','this','that','these','those','my','our','your','their','its','his','her','as','so','but','if','then','u','s','t'"


@query("set04_shared_content", f"""WITH x AS (SELECT session_id, turn, {EDGE} AS w FROM tok), l AS (SELECT DISTINCT session_id, turn, w FROM x WHERE length(w) >= 2 AND w NOT IN ({STOPS})),
   m AS (SELECT session_id, max(turn) AS mt FROM tok GROUP BY session_id), h AS (SELECT l.session_id, l.turn, l.w FROM l WHERE EXISTS (SELECT 1 FROM x WHERE x.session_id = l.session_id AND x.turn = l.turn - 1 AND x.w = l.w))
   SELECT s.session_id, s.seg_id, coalesce(string_agg(h.w, ' ' ORDER BY h.w), '') AS shared FROM seg s LEFT JOIN h ON h.session_id = s.session_id AND h.turn = s.seg_id GROUP BY ALL""")
def _(t):
    from ..functions.ordered import prev, rows_block, scan
    s = scan(t.seg.select("session_id", "seg_id", "text"), S, ["seg_id"], rows_block("seg_id"), before=prev("text", ""))
    return O.shared_content(s, "text", "before").select("session_id", "seg_id", F.array_join("shared", " ").alias("shared"))


@query("set05_key_intersection", "SELECT user_id AS id FROM evt INTERSECT SELECT conv_id FROM conversations")
def _(t):
    return t.evt.select(F.col("user_id").alias("id")).intersect(t.read("conversations").select(F.col("conv_id").alias("id")))


@query("set06_distinct_labels", "SELECT DISTINCT language, category FROM bench")
def _(t):
    return t.bench.select("language", "category").distinct()

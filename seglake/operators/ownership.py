"""Who owns a stretch of time when words are emitted again after a switch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..functions.ordered import last_known, rows_block, scan
from .joins import reemission_pairs


def own_dedup(new: DataFrame, committed: DataFrame, keys: list[str], batch: str, tol: int = V.REEMIT_TOL_MS) -> DataFrame:
    """Verdicts on words emitted again: keys, batch, side, seq, action, start_ms.

    ``new`` has seq, start_ms, word, the batch, and the batch's window: floor_ms and limit_ms. A batch that begins after its
    limit is new audio and is left alone; committed words count from the floor to the end of the batch. A batch that reaches
    past the matched committed words supersedes them, with the punctuation that directly follows them, and its first word
    inherits the earliest start among them. Any other batch loses its exact repeats (drop)."""
    bk = [*keys, batch]
    reach = new.groupBy(*bk).agg(F.max("start_ms").alias("b_max"), F.min("start_ms").alias("b_min"), F.min_by("seq", F.struct("start_ms", "seq")).alias("first_seq"),
                                 F.min("floor_ms").alias("floor_ms"), F.min("limit_ms").alias("limit_ms")).filter("b_min <= limit_ms")
    inside = F.col("c_start").between(F.col("floor_ms") - tol, F.col("b_max") + tol)
    at = scan(committed.select(*keys, "seq", "start_ms", (X.edge_form("word") == "").alias("_mark")), keys, ["seq"], rows_block("seq"),
              _word=last_known(F.when(~F.col("_mark"), F.col("seq"))))
    at = at.select(*keys, F.col("seq").alias("old_seq"), F.col("start_ms").alias("c_start"), "_mark", "_word")
    pairs = reemission_pairs(new, committed, keys, tol).join(new.select(*bk, F.col("seq").alias("new_seq")), [*keys, "new_seq"])
    live = pairs.join(at.filter("not _mark").drop("_mark", "_word"), [*keys, "old_seq"]).join(reach, bk).filter(inside)
    top = live.groupBy(*bk).agg(F.max("c_start").alias("c_max"))
    judged = live.join(top, bk).withColumn("extends", F.col("b_max") > F.col("c_max") + tol)
    words = judged.filter("extends").select(*bk, "old_seq", "c_start", "floor_ms", "b_max", "b_min", "first_seq").distinct()
    marks = at.filter("_mark").select(*keys, F.col("_word").alias("old_seq"), F.col("old_seq").alias("_seq"), F.col("c_start").alias("_at"))
    marks = words.drop("c_start").join(marks, [*keys, "old_seq"]).withColumn("old_seq", F.col("_seq")).withColumn("c_start", F.col("_at")).filter(inside)
    gone = words.unionByName(marks.select(*words.columns))
    heirs = gone.groupBy(*bk, "first_seq", "b_min").agg(F.min("c_start").alias("start_ms")).filter("start_ms < b_min")
    none = F.lit(None).cast("bigint").alias("start_ms")
    return gone.select(*bk, F.lit("committed").alias("side"), F.col("old_seq").alias("seq"), F.lit("supersede").alias("action"), none).unionByName(
        heirs.select(*bk, F.lit("new").alias("side"), F.col("first_seq").alias("seq"), F.lit("inherit_id").alias("action"), "start_ms")).unionByName(
        judged.filter("not extends and kind = 'exact'").select(*bk, F.lit("new").alias("side"), F.col("new_seq").alias("seq"), F.lit("drop").alias("action"), none).distinct())


def _long_cut(limit_ms: int) -> Column:
    """A buffer over the limit is cut at the last commit, without one in its middle."""
    middle = F.col("offset_ms") + F.floor(F.col("length_ms") / 2)
    return F.when(F.col("length_ms") > limit_ms, F.coalesce("last_commit_ms", middle))


def trim_points(sentences: DataFrame, buffers: DataFrame, keys: list[str], limit_ms: int = 15_000) -> DataFrame:
    """Where to cut a buffer longer than ``limit_ms``: at the end of the second-last committed sentence, else at the last
    commit, else in the middle. Shorter buffers are not cut. ``sentences``: sent_no (dense), end_ms; ``buffers``: step,
    n_sentences, last_commit_ms, offset_ms, length_ms."""
    s = sentences.select(*keys, (F.col("sent_no") + 1).alias("n_sentences"), F.col("end_ms").alias("_cut"))
    j = buffers.join(s, [*keys, "n_sentences"], "left")
    sentence = F.when((F.col("length_ms") > limit_ms) & (F.col("n_sentences") >= 2) & F.col("last_commit_ms").isNotNull(), F.col("_cut"))
    return j.withColumn("cut_ms", F.coalesce(sentence, _long_cut(limit_ms))).drop("_cut")


def trim_segment_ends(ends: DataFrame, buffers: DataFrame, keys: list[str], limit_ms: int = 30_000) -> DataFrame:
    """Cut at the latest segment end, but for the last segment's, that lies within what is committed; else as a long buffer.
    ``ends``: step, end_no, end_ms; ``buffers``: step, last_commit_ms, offset_ms, length_ms."""
    last = ends.groupBy(*keys, "step").agg(F.max("end_no").alias("_last"))
    inner = ends.join(last, [*keys, "step"]).filter(F.col("end_no") < F.col("_last")).join(buffers.select(*keys, "step", "last_commit_ms"), [*keys, "step"])
    cut = inner.filter(F.col("end_ms") <= F.col("last_commit_ms")).groupBy(*keys, "step").agg(F.max("end_ms").alias("_cut"))
    return buffers.join(cut, [*keys, "step"], "left").withColumn("cut_ms", F.coalesce("_cut", _long_cut(limit_ms))).drop("_cut")


def starved(buffers: DataFrame, limit_ms: int = 15_000) -> DataFrame:
    """Buffers to be thrown away: nothing committed in this step, longer than the limit, and no output for as long.
    ``buffers``: n_committed, length_ms, end_ms, last_output_ms."""
    quiet = F.col("end_ms") - F.coalesce("last_output_ms", F.lit(0))
    return buffers.withColumn("reset", (F.col("n_committed") == 0) & (F.col("length_ms") > limit_ms) & (quiet > limit_ms))


def with_scores(df: DataFrame, fn, schema: str) -> DataFrame:
    """User scoring of a table in Arrow batches (an iterator of record batches in
    and out), giving token rows."""
    return df.mapInArrow(fn, schema)


def translate_table(df: DataFrame, fn, source: str, lang: str, out: str = "translation", slots: int | None = None) -> DataFrame:
    """User translation with the guards around it: direction from the script,
    cleaned result, echoes emptied, one retry for empty results. ``fn`` is a
    pandas UDF of (text, language); ``slots`` bounds the calls at once."""
    from .filters import resolve_source_language, sanitize_translations
    src = df.repartition(slots) if slots else df
    ready = src.withColumn("_lang", resolve_source_language(F.col(source), F.col(lang)))
    first = sanitize_translations(X.hold(ready, **{out: fn(F.col(source), F.col("_lang"))}), source, out)
    again = first.filter(F.col(out) == "").drop(out)
    retried = sanitize_translations(X.hold(again, **{out: fn(F.col(source), F.col("_lang"))}), source, out)
    return first.filter(F.col(out) != "").unionByName(retried).drop("_lang")

"""Sinks. Every export is a table of text rows with a session and a position, so
that long sessions are written by many tasks; ``write_rows`` keeps the order by
range partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.ordered import row_no, rows_block, scan


def spoken(lines: DataFrame) -> DataFrame:
    return lines.filter((F.col("speaker") != -2) & (F.coalesce("text", F.lit("")) != ""))


def subtitles(lines: DataFrame, keys: list[str], order: str, fmt: str = "srt") -> DataFrame:
    """One cue per spoken line: number, times, text."""
    mark = "," if fmt == "srt" else "."
    s = scan(spoken(lines), keys, [order], rows_block(order), cue=row_no())
    times = F.concat(X.clock("start_ms", mark), F.lit(" --> "), X.clock("end_ms", mark))
    parts = ([F.col("cue").cast("string")] if fmt == "srt" else []) + [times, F.col("text"), F.lit("")]
    body = F.concat_ws("\n", *parts)
    if fmt == "vtt":
        body = F.when(F.col("cue") == 1, F.concat(F.lit("WEBVTT\n\n"), body)).otherwise(body)
    return s.select(*keys, "cue", body.alias("value"))


def transcript(lines: DataFrame, keys: list[str], order: str, fmt: str) -> DataFrame:
    """tsv (integer ms, tabs to spaces), txt or json rows."""
    t = F.trim("text")
    value = {
        "tsv": F.concat_ws("\t", F.col("start_ms").cast("string"), F.col("end_ms").cast("string"), F.replace(t, F.lit("\t"), F.lit(" "))),
        "txt": t,
        "json": F.to_json(F.struct("start_ms", "end_ms", "text")),
    }[fmt]
    return spoken(lines).select(*keys, order, value.alias("value"))


def timed_words(lines: DataFrame, keys: list[str], order: str, digits: int) -> DataFrame:
    """Words with times spread evenly over their line, rounded half to even."""
    s = spoken(lines).withColumn("_w", X.words("text"))
    n, span = F.size("_w"), (F.col("end_ms") - F.col("start_ms")).cast("decimal(20,0)")
    x = s.select(*keys, order, "speaker", "start_ms", span.alias("_s"), n.alias("_n"), F.posexplode("_w").alias("i", "word"))
    at = lambda i: F.bround((F.col("start_ms") + F.col("_s") * i / F.col("_n")) / 1000, digits).cast("double")
    return x.select(*keys, order, F.col("i").cast("bigint").alias("i"), "word", "speaker", at(F.col("i")).alias("start"), at(F.col("i") + 1).alias("end"))


def verbose_json(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Segment rows with 2-decimal times and their words."""
    w = timed_words(lines, keys, order, 2).groupBy(*keys, order).agg(F.array_sort(F.collect_list(F.struct("i", "word", "start", "end"))).alias("words"))
    sec = lambda c: F.bround(F.col(c).cast("decimal(20,0)") / 1000, 2).cast("double")
    s = scan(spoken(lines), keys, [order], rows_block(order), _no=row_no())
    return s.join(w, [*keys, order]).select(*keys, order, F.to_json(F.struct(
        (F.col("_no") - 1).alias("id"), sec("start_ms").alias("start"), sec("end_ms").alias("end"), "text", F.transform("words", lambda x: x.dropFields("i")).alias("words"))).alias("value"))


def utterance_results(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Nested result per line: transcript and words with 3-decimal times."""
    g = timed_words(lines, keys, order, 3).groupBy(*keys, order).agg(
        F.array_sort(F.collect_list(F.struct("i", "word", "start", "end"))).alias("w"), F.min("start").alias("start"), F.max("end").alias("stop"), F.max("speaker").alias("speaker"))
    t = spoken(lines).select(*keys, order, F.trim("text").alias("transcript"))
    words = F.transform("w", lambda x: F.struct(x["word"].alias("word"), x["start"].alias("start"), x["end"].alias("end"), F.lit(0.0).alias("confidence"),
                                                x["word"].alias("punctuated_word"), F.greatest(F.col("speaker"), F.lit(0)).alias("speaker")))
    return g.join(t, [*keys, order]).select(*keys, order, "start", F.round(F.col("stop") - F.col("start"), 3).alias("duration"),
        F.struct(F.array(F.struct("transcript", F.lit(0.0).alias("confidence"), words.alias("words"))).alias("alternatives")).alias("channel"))


def snapshot_lines(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Line payloads of a full snapshot with the alias fields; speaker -1 is 1."""
    from ..operators.filters import renderable
    sp = F.when(F.col("speaker") == -1, 1).otherwise(F.col("speaker"))
    return renderable(lines).select(*keys, order, sp.alias("speaker"), "text", (F.col("start_ms") / 1000).alias("id"), X.short_clock("start_ms").alias("start"),
        X.short_clock("end_ms").alias("end"), "finalized", F.col("finalized").alias("completed"), F.col("lang").alias("detected_language"), "lang")


def labelled_text(lines: DataFrame, keys: list[str], order: str, label: str = "speaker") -> DataFrame:
    """``[speaker n] text`` rows, the translation on a second line."""
    head = F.concat(F.lit(f"[{label} "), F.col("speaker").cast("string"), F.lit("] "), F.col("text"))
    value = F.when(F.coalesce("translation", F.lit("")) != "", F.concat(head, F.lit("\n    ↳ "), F.col("translation"))).otherwise(head)
    return lines.filter(F.coalesce("text", F.lit("")) != "").select(*keys, order, value.alias("value"))


def write_rows(rows: DataFrame, keys: list[str], order: str, path: str) -> None:
    """Ordered text files, one folder per session."""
    rows.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order).select(*keys, "value").write.partitionBy(*keys).mode("overwrite").text(path)


EXPORTS = {"srt": lambda l, k, o: subtitles(l, k, o, "srt"), "vtt": lambda l, k, o: subtitles(l, k, o, "vtt"),
           **{f: (lambda l, k, o, f=f: transcript(l, k, o, f)) for f in ("tsv", "txt", "json")}, "verbose_json": verbose_json}


def export(lines: DataFrame, keys: list[str], order: str, fmt: str, path: str) -> None:
    """Write by format name."""
    write_rows(EXPORTS[fmt](lines, keys, order), keys, {"srt": "cue", "vtt": "cue"}.get(fmt, order), path)



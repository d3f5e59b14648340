"""Scans of reference scripts, run transcripts and evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.ordered import last_known, prev, row_no, rows_block, running_sum, scan, whole_sum

HEADER = r"^\[(spk\d+)\]\s*$"
TOLD = r"^\d+\.\s+(.*?)\s+⟨([^⟩]+)⟩\s*$"
TXT_NAME = r"(.+?)_([ABC])_R(\d+)\.txt$"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, line numbers from 1. Files are read in splits: a line's number is its place within
    its split and the number of lines in the splits before, so one large file is many tasks."""
    raw = spark.read.option("lineSep", "\n").text(path)
    d = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_row"),
                   F.regexp_replace("value", r"\r$", "").alias("line"))
    return scan(d, ["file"], ["_split", "_row"], F.col("_split"), line_no=row_no()).select("file", "line_no", "line")


def parse_scripts(lines: DataFrame) -> DataFrame:
    """(file, line_no, line) to (file, block, speaker, sent, sentence). A header opens a block; blank lines part sentences;
    bracketed remarks go; lines before the first header of a file with headers go; without headers there is one block."""
    head, bare = F.col("line").rlike(HEADER), F.trim(F.regexp_replace("line", r"\s+", " ")) == ""
    at, keys = rows_block("line_no"), ["file"]
    d = lines.select("file", "line_no", "line", head.alias("_head"), bare.alias("_blank"))
    s = scan(d, keys, ["line_no"], at, _no=running_sum(F.when(F.col("_head"), 1).otherwise(0)), _all=whole_sum(F.when(F.col("_head"), 1).otherwise(0)),
             speaker=last_known(F.when(F.col("_head"), F.regexp_extract("line", HEADER, 1))))
    s = s.filter("NOT _head AND NOT _blank AND (_no > 0 OR _all = 0)").withColumn("block", F.greatest(F.col("_no") - 1, F.lit(0)))
    s = scan(s, keys, ["line_no"], at, _p=prev(F.struct("block", "line_no")))
    new = (F.col("_p.block") == F.col("block")) & (F.col("_p.line_no") < F.col("line_no") - 1)
    s = scan(s.withColumn("_new", F.coalesce(new, F.lit(False))), keys, ["line_no"], at, _gaps=running_sum(F.when(F.col("_new"), 1).otherwise(0)),
             _before=last_known(F.when(F.col("_p").isNull() | (F.col("_p.block") != F.col("block")), F.struct(F.col("line_no").alias("n")))))
    base = s.filter(F.col("_before.n") == F.col("line_no")).select("file", "block", F.col("_gaps").alias("_base"))
    s = s.join(base, ["file", "block"])
    g = s.groupBy("file", "block", (F.col("_gaps") - F.col("_base")).alias("sent")).agg(F.first("speaker").alias("speaker"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    text = F.array_join(F.transform("x", lambda x: x["line"]), "\n")
    clean = X.strip(F.regexp_replace(F.regexp_replace(text, r"\([^)]*\)", " "), r"\s+", " "))
    return g.select("file", "block", "speaker", "sent", clean.alias("sentence")).filter("sentence <> ''")


def read_reference_scripts(spark: SparkSession, path: str) -> DataFrame:
    return parse_scripts(numbered_lines(spark, path))


def plain_texts(scripts: DataFrame) -> DataFrame:
    g = scripts.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "sent", "sentence"))).alias("s"))
    return g.select("file", F.array_join(F.transform("s", lambda x: x["sentence"]), " ").alias("plain_text"))


def parse_run_transcripts(lines: DataFrame) -> DataFrame:
    """(file, line_no, line) to (stem, path, rep, no, text, trigger): numbered lines with their trigger."""
    base = X.base_name("file")
    told = lines.filter(F.col("line").rlike(TOLD)).select("file", "line_no", F.trim(F.regexp_extract("line", TOLD, 1)).alias("text"), F.regexp_extract("line", TOLD, 2).alias("trigger"))
    s = scan(told, ["file"], ["line_no"], rows_block("line_no"), no=row_no())
    name = [F.regexp_extract(base, TXT_NAME, i).alias(n) for i, n in ((1, "stem"), (2, "path"), (3, "rep"))]
    return s.select(*name, (F.col("no") - 1).alias("no"), "text", "trigger")


def read_run_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return parse_run_transcripts(numbered_lines(spark, path))


def read_eval_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row per run of a file in a report, in order, with the file's summary
    (by base name) when the report has one."""
    r = spark.read.json(path, multiLine=True).withColumn("report", F.input_file_name())
    runs = r.select("report", F.posexplode("files").alias("run", "f")).select("report", F.col("run").cast("bigint").alias("run"), X.base_name("f.audio_file").alias("file"), "f.*")
    if "file_summaries" not in r.columns:
        return runs
    s = r.select("report", F.explode("file_summaries").alias("s")).select("report", X.base_name("s.audio_file").alias("file"), F.col("s").alias("summary"))
    return runs.join(s, ["report", "file"], "left")

"""Row filters and text cleaning on token and line tables."""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import values as V
from ..functions.entries import replaced
from ..functions.ordered import before_known, following, prev, rows_block, scan, shared, whole_max


def visible(tokens: DataFrame) -> DataFrame:
    """Hide tombstones."""
    return tokens.filter(~F.col("retracted"))


def renderable(lines: DataFrame) -> DataFrame:
    """Lines with text, and silence."""
    return lines.filter((F.coalesce("text", F.lit("")) != "") | (F.col("speaker") == -2))


def visible_lines(lines: DataFrame) -> DataFrame:
    """Lines with text that are not silence."""
    return lines.filter((F.coalesce("text", F.lit("")) != "") & (F.col("speaker") != -2))


def strip_annotations(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, X.strip(F.regexp_replace(text, V.ANNOTATION, "")))


def drop_script(df: DataFrame, script_class: str = V.CJK_KANA, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) by a character class that must not occur."""
    hit = F.coalesce(F.col(text).rlike(script_class), F.lit(False))
    return df.filter(~hit), df.filter(hit)


def without_phrases(x: Column, phrases: Iterable[str]) -> Column:
    """Remove phrases one after the other, longest first."""
    for p in sorted(phrases, key=len, reverse=True):
        x = F.replace(x, F.lit(p), F.lit(""))
    return X.strip(F.regexp_replace(x, r"\s+", " "))


def remove_phrases(df: DataFrame, phrases: Iterable[str], text: str = "text") -> DataFrame:
    return df.withColumn(text, without_phrases(F.col(text), phrases))


def tidy_dots(x: Column) -> Column:
    one = X.strip(F.regexp_replace(x, r"\s*\.[\s.]*\.\s*", ". "))
    return X.strip(F.regexp_replace(one, r"^[.\s]+", ""))


def punctuation_only(x: Column) -> Column:
    return x.rlike(r"^[ " + "".join(V.PUNCTUATION) + "]*$")


def collapse_punct(df: DataFrame, text: str = "text") -> DataFrame:
    """Collapse repeated dots, strip leading dots, drop punctuation-only rows."""
    tidy = df.withColumn(text, tidy_dots(X.strip(F.regexp_replace(text, r"\s+", " "))))
    return tidy.filter(~punctuation_only(F.col(text)))


# --- dictionary ---------------------------------------------------------------

def apply_dictionary(df: DataFrame, entries: DataFrame, text: str = "text", whole_words: bool = False) -> DataFrame:
    """One left-to-right pass, longest entry first, replaced text is not looked at again. Entries (wrong, correct) without a
    side are skipped; of equal keys the greatest value counts. A dictionary of any size is taken in blocks."""
    return replaced(df, entries, text, whole_words)


def clean_segments(lines: DataFrame, phrases: Iterable[str], entries: DataFrame, text: str = "text",
                   script_class: str = V.CJK_KANA, whole_words: bool = False, silence: Column | None = None) -> DataFrame:
    """The whole cleaning job. Silence and empty rows pass through unchanged;
    rows left without words are dropped. Always run on the raw rows, so that
    repeated runs agree."""
    passing = silence if silence is not None else F.lit(False)
    passing = passing | (F.coalesce(text, F.lit("")) == "")
    speech = lines.filter(~passing)
    kept, _ = drop_script(strip_annotations(speech, text), script_class, text)
    tidy = collapse_punct(remove_phrases(kept, phrases, text), text)
    return apply_dictionary(tidy, entries, text, whole_words).unionByName(lines.filter(passing))


def clean_raw(rows: DataFrame, phrases: Iterable[str], entries: DataFrame, text: str = "text",
              whole_words: bool = False) -> DataFrame:
    """Older, shorter variant: phrases, whitespace, bare dots, dictionary."""
    done = remove_phrases(rows, phrases, text)
    kept = done.filter((F.col(text) != "") & (F.col(text) != "?") & ~F.col(text).rlike(r"^\.+$"))
    return apply_dictionary(kept, entries, text, whole_words)


# --- confidence and quality ---------------------------------------------------

def filter_words(words: DataFrame, keys: list[str], threshold: float = 0.2) -> DataFrame:
    """Rebuild each segment from words above ``threshold``; a segment that keeps
    no word keeps its text."""
    ok = F.col("probability") > threshold
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda w: w["word"]), "")
    g = words.groupBy(*keys).agg(
        F.collect_list(F.when(ok, F.struct("seq", "word"))).alias("k"), F.collect_list(F.struct("seq", "word")).alias("a"))
    return g.select(*keys, F.when(F.size("k") > 0, joined("k")).otherwise(joined("a")).alias("text"),
                    F.size("k").cast("bigint").alias("n_words"))


def drop_no_speech(df: DataFrame, no_speech: float = 0.6, log_prob: float = -1.0) -> DataFrame:
    """Skip rows without speech unless the decoder was confident; cut start >= end."""
    skip = (F.col("no_speech_prob") > no_speech) & ~(F.col("avg_logprob") > log_prob)
    return df.filter(~skip & (F.col("start_ms") < F.col("end_ms")))


@F.pandas_udf(T.DoubleType())
def compression_ratio(texts: pd.Series) -> pd.Series:
    def one(t: str) -> float:
        raw = t.encode("utf-8")
        return len(raw) / len(zlib.compress(raw))
    return texts.map(one)


def quality_gate(df: DataFrame, log_prob: float = -1.0, ratio: float = 2.4, text: str = "text") -> DataFrame:
    """Name of the failed rule per row, NULL when the row passes."""
    bare = X.strip(text)
    rule = (
        F.when(F.col("avg_logprob") < log_prob, "avg_logprob")
        .when((bare != "") & (F.col("_cr") > ratio), "compression_ratio")
    )
    return df.withColumn("_cr", compression_ratio(F.coalesce(bare, F.lit("")))).withColumn("failed_rule", rule).drop("_cr")


def clear_empty(lines: DataFrame) -> DataFrame:
    empty = (F.col("start_ms") == F.col("end_ms")) | (X.strip("text") == "")
    return lines.withColumn("text", F.when(empty, "").otherwise(F.col("text")))


def terminal_punct(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Full stop after finalized text rows except the last row of a session."""
    s = scan(lines, keys, [order], rows_block(order), _last=whole_max(order))
    bare = F.regexp_replace("text", r"\s+$", "")
    add = ((F.col(order) < F.col("_last")) & F.col("finalized") & (F.col("speaker") != -2) & (bare != "")
           & ~bare.rlike(X.PUNCT_CLASS + "$"))
    return s.withColumn("text", F.when(add, F.concat(bare, F.lit("."))).otherwise(F.col("text"))).drop("_last")


def timing_errors(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per broken timing rule."""
    s = scan(lines, keys, [order], rows_block(order), _before=prev("start_ms"))
    rules = F.array_compact(F.array(
        F.when(F.col("start_ms") < 0, "negative_start"), F.when(F.col("end_ms") < 0, "negative_end"),
        F.when(F.col("end_ms") < F.col("start_ms"), "end_before_start"),
        F.when(F.col("start_ms") < F.col("_before"), "non_monotonic")))
    return s.select(*keys, order, F.explode(rules).alias("rule"))


# --- streaming-batch filters --------------------------------------------------

def drop_marker_rows(tokens: DataFrame, pattern: str = V.FOREIGN_MARKER, word: str = "word") -> DataFrame:
    return tokens.filter(~F.col(word).rlike("(?i)" + pattern))


def strip_leading_punct(tokens: DataFrame, keys: list[str], batch: str, order: str, word: str = "word") -> DataFrame:
    """Drop marks that open a batch when the batch before ended with one; drop
    dash-only rows everywhere."""
    norm = F.trim(F.col(word))
    mark = norm.isin(V.PUNCTUATION)
    dash = norm.isin("-", "–", "—")
    real = F.when((norm != "") & ~dash, norm)
    s = scan(tokens.withColumn("_real", real).withColumn("_mark", mark), keys, [order], rows_block(order),
             _seen=before_known(F.when(F.col("_real").isNotNull(), F.struct(F.col(batch).alias("b"), F.col("_real").alias("w")))),
             _open=before_known(F.when(~F.col("_mark"), F.col(batch))))
    # last real word of an earlier batch: the word before the batch's first row
    s = shared(s, *keys, batch)
    first = s.groupBy(*keys, batch).agg(F.min_by("_seen.w", order).alias("_tail"))
    s = s.join(first, [*keys, batch], "left")
    leading = F.col("_mark") & (F.col("_open").isNull() | (F.col("_open") != F.col(batch)))
    drop = leading & F.coalesce(F.col("_tail").rlike(X.PUNCT_CLASS + "$"), F.lit(False))
    return s.filter(~drop & ~F.trim(F.col(word)).isin("-", "–", "—")).select(*tokens.columns)


# --- capability and anomaly ---------------------------------------------------

def compatible(samples: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Pairs of sample and backend whose language the backend supports; a NULL
    language list means all. Listed backends join on the language; the backends
    that take everything (a handful of configuration rows) are exploded onto
    each sample, which is exactly the output."""
    listed = capabilities.filter(F.col("languages").isNotNull()).select("backend", F.explode("languages").alias("_language"))
    spoken = samples.select(F.col("language").alias("_language"), F.lit(1).alias("_one")).distinct()
    open_to_all = capabilities.filter(F.col("languages").isNull()).select("backend", F.lit(1).alias("_one")).join(spoken, "_one").drop("_one")
    allowed = listed.unionByName(open_to_all)
    return samples.join(allowed, F.col("language").eqNullSafe(F.col("_language"))).drop("_language")


def word_anomaly(probability: Column, duration_ms: Column) -> Column:
    """Score of one word: unsure, too short, too long (integer thousandths)."""
    return (
        F.when(probability < 0.15, 1000).otherwise(0)
        + F.when(duration_ms < 133, (133 - duration_ms) * 15).otherwise(0)
        + F.when(duration_ms > 2000, duration_ms - 2000).otherwise(0)
    ).cast("bigint")


def flag_anomalies(words: DataFrame, keys: list[str], segment: str, order: str) -> DataFrame:
    """Per segment: score of its first eight words that are not punctuation, and
    the anomaly flag."""
    plain = words.filter(~F.col("word").rlike(r"^[\"'“¿(\[{\-.。,，!！?？:：”)\]}、]$"))
    numbered = plain.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, segment).orderBy(order)))
    scored = numbered.filter("_rank <= 8").groupBy(*keys, segment).agg(
        F.sum(word_anomaly(F.col("probability"), F.col("end_ms") - F.col("start_ms"))).alias("score"),
        F.count(F.lit(1)).alias("n"))
    return scored.select(
        *keys, segment, "score", "n",
        ((F.col("score") >= 3000) | (F.col("score") + 10 >= F.col("n") * 1000)).alias("anomalous"))


def drop_anomalous(segments: DataFrame, keys: list[str], order: str, threshold_ms: int = 2000) -> DataFrame:
    """Drop an anomalous segment that stands between silences. ``segments`` has
    ``anomalous``; the first and last segment count as bordered."""
    s = scan(segments, keys, [order], rows_block(order), _end=prev("end_ms"), _next=following(F.struct("start_ms", "anomalous")))
    before = F.col("_end").isNull() | (F.col("start_ms") - F.col("_end") > threshold_ms) | (F.col("start_ms") < threshold_ms)
    after = F.col("_next").isNull() | (F.col("_next.start_ms") - F.col("end_ms") > threshold_ms) | F.col("_next.anomalous")
    return s.filter(~(F.col("anomalous") & before & after)).drop("_end", "_next")


# --- generated text -----------------------------------------------------------

def infer_script(x: Column) -> Column:
    """ko or en by characters; NULL when too few or too mixed."""
    ko, en = F.regexp_count(x, F.lit(V.HANGUL)), F.regexp_count(x, F.lit(V.LATIN))
    total = ko + en
    return (
        F.when((en == 0) & (ko >= 1), "ko").when((ko == 0) & (en >= 4), "en")
        .when((total < 6) | (ko == en), None)
        .when(F.greatest(ko, en) * 100 < total * 60, None)
        .when(ko > en, "ko").otherwise("en")
    )


def resolve_source_language(content: Column, detected: Column) -> Column:
    return F.coalesce(infer_script(content), detected)


def sanitize(result: Column, limit: int = 500) -> Column:
    lines = F.filter(F.transform(F.split(result, "\n"), X.strip), lambda s: s != "")
    first = F.when(F.instr(result, "\n") > 0, F.coalesce(F.get(lines, F.lit(0)), F.lit(""))).otherwise(result)
    return F.when(F.length(first) > limit, F.regexp_replace(F.substring(first, 1, limit), r"\s+$", "")).otherwise(first)


def sanitize_translations(df: DataFrame, source: str, result: str, limit: int = 500) -> DataFrame:
    """First non-blank line, hard length limit, and an empty result when it is an
    echo of the source script."""
    clean = df.withColumn(result, sanitize(F.col(result), limit))
    echo = F.coalesce(infer_script(F.col(source)) == infer_script(F.col(result)), F.lit(False))
    return clean.withColumn(result, F.when(echo, "").otherwise(F.col(result)))


def trim_interim(df: DataFrame, buffer: str, committed: str) -> DataFrame:
    """Take just-committed text off the front of the interim buffer."""
    hit = F.startswith(F.col(buffer), F.col(committed)) & (F.col(committed) != "")
    rest = F.regexp_replace(F.substring(F.col(buffer), F.length(committed) + 1, F.length(buffer)), r"^\s+", "")
    return df.withColumn(buffer, F.when(hit, rest).otherwise(F.col(buffer)))



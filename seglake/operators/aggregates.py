"""Rollups over tokens, lines, calls and evaluation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.ranks import medians, pick


def to_segments(tokens: DataFrame, keys: list[str], order: str, sep: str = " ") -> DataFrame:
    """Tokens to one line per key: ordered text, first start, last end, language
    of the first token."""
    g = tokens.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(order, "word"))).alias("_w"), F.min_by("start_ms", order).alias("start_ms"),
        F.max_by("end_ms", order).alias("end_ms"), F.min_by("lang", order).alias("lang"))
    return g.select(*keys, "start_ms", "end_ms", F.array_join(F.transform("_w", lambda x: x["word"]), sep).alias("text"), "lang")


def wer_distribution(scores: DataFrame, keys: list[str], value: str = "wer") -> DataFrame:
    """Median, 90th and 95th value at index int(n * q), and the number of zeros."""
    n = F.col("n")
    at = pick(scores, keys, value, median=F.floor(n / 2), p90=F.floor(n * 0.9), p95=F.floor(n * 0.95))
    zeros = scores.groupBy(*keys).agg(F.count_if(F.col(value) == 0).alias("n_zero"))
    return at.join(zeros, keys)


def char_errors(pairs: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Character edits and reference length per pair (corpus rate = sum / sum)."""
    return pairs.withColumn("char_edits", F.levenshtein(ref, hyp).cast("bigint")).withColumn("ref_chars", F.length(ref).cast("bigint"))


def ratio(a: Column, b: Column) -> Column:
    """Whole numbers divided as SQL engines with binary division do: by zero they give NaN or an infinity, not an error."""
    by_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a == 0, float("nan"))
    return F.when(b == 0, by_zero).otherwise(a / b)


def summary_columns() -> list[Column]:
    errors = F.col("subs") + F.col("ins") + F.col("dels")
    wer, rtf = errors / F.col("ref_words"), ratio(F.col("proc_ms"), F.col("duration_ms"))
    return [
        F.count(F.lit(1)).alias("n_samples"), F.sum("duration_ms").alias("audio_ms"), F.sum("proc_ms").alias("processing_ms"),
        F.round(F.avg(wer), 6).alias("avg_wer"), F.round(F.sum(errors) / F.greatest(F.sum("ref_words"), F.lit(1)), 6).alias("weighted_wer"),
        F.round(F.avg(rtf), 6).alias("avg_rtf"),
        F.round(F.when(F.sum("duration_ms") > 0, F.sum("proc_ms") / F.sum("duration_ms")).otherwise(0.0), 6).alias("overall_rtf"),
        F.round(F.coalesce(F.avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))), F.lit(0.0)), 6).alias("avg_latency_ms"),
    ]


def bench_summary(bench: DataFrame) -> DataFrame:
    return bench.agg(*summary_columns())


def bench_breakdown(bench: DataFrame) -> DataFrame:
    """Whole set, by language and by category in one pass."""
    g = bench.groupingSets([[], ["language"], ["category"]], "language", "category")
    return g.agg(F.grouping_id().alias("_g"), *summary_columns()).select(
        F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "language").otherwise("category").alias("level"),
        F.coalesce("language", "category", F.lit("all")).alias("name"), "n_samples", "avg_wer", "avg_rtf", "weighted_wer")


def session_metrics(calls: DataFrame, keys: list[str], duration: str = "duration_ms", audio: str = "audio_ms") -> DataFrame:
    """Real-time factor, mean and 95th call latency (index min(int(.95 n), n-1)),
    silence totals."""
    n = F.col("n")
    p95 = pick(calls, keys, duration, p95_ms=F.least(F.floor(n * 0.95), n - 1)).drop("n")
    g = calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_calls"), F.sum(duration).alias("processing_ms"), F.sum(audio).alias("audio_ms"),
        F.count_if(F.col("silence_ms") > 0).alias("n_silences"), F.sum("silence_ms").alias("silence_ms"))
    return g.join(p95, keys).withColumn("rtf", F.round(F.when(F.col("audio_ms") > 0, F.col("processing_ms") / F.col("audio_ms")).otherwise(0.0), 6)) \
        .withColumn("avg_ms", F.round(F.col("processing_ms") / F.col("n_calls"), 6))


def run_stats(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, min, max, sample deviation (0 for one run) over runs that have a
    value; NULL when none has."""
    g = runs.groupBy(*keys).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"),
        F.when(F.count(value) > 0, F.coalesce(F.stddev_samp(value), F.lit(0.0))).alias("stdev"))
    return g.join(medians(runs, keys, value).drop("n"), keys, "left").withColumn("stdev", F.round("stdev", 6))


def latin_recall(pairs: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Share of Latin reference words found in the hypothesis' word set."""
    words = F.regexp_extract_all(F.col(ref), F.lit(r"(?U)\b[A-Za-z][A-Za-z'\-]+\b"), 0)
    held = X.hold(pairs, _latin=F.transform(words, F.lower), _got=X.scoring_words(hyp))
    hits = F.size(F.filter("_latin", lambda w: F.array_contains("_got", w)))
    return held.withColumn("n_latin", F.size("_latin")).withColumn("hits", hits).withColumn(
        "ratio", F.when(F.col("n_latin") > 0, F.col("hits") / F.col("n_latin")).otherwise(0.0)).drop("_latin", "_got")


def language_distribution(lines: DataFrame, keys: list[str], lang: str = "lang") -> DataFrame:
    return lines.groupBy(*keys, F.coalesce(F.nullif(F.col(lang), F.lit("")), F.lit("unknown")).alias("language")).agg(F.count(F.lit(1)).alias("n_lines"))


def type_token_ratio(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    w = X.tokens(text)
    n = F.size(w)
    return docs.select(key, n.alias("n_words"), F.when(n > 0, F.size(F.array_distinct(w)) / n).alias("ttr"))


def repetition_summary(docs: DataFrame, runs: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Words, type-token ratio, storms, longest repeat, repeated share, collapsed
    windows, from the run and window tables."""
    r = runs.groupBy(key).agg(F.count(F.lit(1)).alias("storms"), F.max("repeats").alias("max_repeats"),
                              F.sum(F.col("end_word") - F.col("start_word")).alias("repeated_words"))
    c = windows.groupBy(key).agg(F.count(F.lit(1)).alias("collapsed_windows"))
    j = type_token_ratio(docs, key).join(r, key, "left").join(c, key, "left").na.fill(0, ["storms", "max_repeats", "repeated_words", "collapsed_windows"])
    return j.withColumn("repeated_ratio", F.when(F.col("n_words") > 0, F.col("repeated_words") / F.col("n_words")))


def drift_stats(probes: DataFrame, keys: list[str], mismatch: float = 0.9, high: float = 0.5) -> DataFrame:
    """Counts per lock state, candidates for a mismatch, residual extremes."""
    return probes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("probes"), F.count_if(F.col("locked") == "ko").alias("locked_ko"),
        F.count_if(F.col("locked") == "en").alias("locked_en"), F.count_if(F.col("locked").isNull()).alias("locked_none"),
        F.count_if(((F.col("locked") == "en") & (F.col("p_ko") >= mismatch)) | ((F.col("locked") == "ko") & (F.col("p_en") >= mismatch))).alias("mismatches"),
        F.max("resid").alias("max_resid"), F.count_if(F.col("resid") >= high).alias("high_resid"))


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Nearest-rank description: index round(q (n - 1)), half to even."""
    n = F.col("n")
    at = lambda q: F.bround(F.lit(q) * (n - 1), 0).cast("bigint")
    d = pick(df, keys, value, min=F.lit(0), q25=at(0.25), q75=at(0.75), q90=at(0.9), max=n - 1)
    return d.join(medians(df, keys, value).drop("n"), keys)


def sweep(df: DataFrame, value: str, target: str, taus: list[float]) -> DataFrame:
    """Detections per threshold in the target and the control rows. One pass;
    the thresholds are a fixed short list."""
    counts = [F.count_if(F.col(target) & (F.col(value) >= t)).alias(f"t{i}") for i, t in enumerate(taus)]
    counts += [F.count_if(~F.col(target) & (F.col(value) >= t)).alias(f"c{i}") for i, t in enumerate(taus)]
    rows = F.array(*[F.struct(F.lit(t).alias("tau"), F.col(f"t{i}").alias("target_hits"), F.col(f"c{i}").alias("control_hits")) for i, t in enumerate(taus)])
    return df.agg(*counts).select(F.inline(rows))


def timeline_counts(lines: DataFrame, keys: list[str], buffers: DataFrame | None = None) -> DataFrame:
    """Distinct speakers (> 0), committed words, words still in the buffer."""
    n = F.when(F.col("speaker") != -2, F.size(X.words(F.coalesce("text", F.lit(""))))).otherwise(0)
    kinds = lines.filter("speaker > 0").select(*keys, "speaker").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_speakers"))
    g = lines.groupBy(*keys).agg(F.sum(n).alias("committed_words")).join(kinds, keys, "left")
    if buffers is not None:
        g = g.join(buffers.select(*keys, F.size(X.words("buffer")).alias("buffer_words")), keys, "left")
    return g.na.fill(0)


def path_averages(runs: DataFrame, path: str, metrics: list[str]) -> DataFrame:
    return runs.groupBy(path).agg(*[F.round(F.avg(m), 6).alias(f"avg_{m}") for m in metrics])


def scatter(bench: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted error in percent and true real-time factor per configuration."""
    errors = F.sum(F.col("subs") + F.col("ins") + F.col("dels"))
    return bench.groupBy(*keys).agg(
        F.round(errors / F.greatest(F.sum("ref_words"), F.lit(1)) * 100, 4).alias("wer_pct"),
        F.round(F.sum("proc_ms") / F.sum("duration_ms"), 6).alias("rtf"), F.count(F.lit(1)).alias("n_samples"))


def gate_stats(trace: DataFrame, keys: list[str], blocked: str = "blocked_by") -> DataFrame:
    """Fires and blocks per gate."""
    return trace.groupBy(*keys, F.coalesce(blocked, F.lit("fired")).alias("gate")).agg(F.count(F.lit(1)).alias("n"))


def compare_policies(runs: DataFrame, mix: DataFrame, policy: str) -> DataFrame:
    """One row per policy; ``mix`` holds its line counts per language."""
    errors = F.sum(F.col("subs") + F.col("ins") + F.col("dels"))
    g = runs.groupBy(policy).agg(
        F.round(errors / F.greatest(F.sum("ref_words"), F.lit(1)), 6).alias("wer"), F.round(F.sum("proc_ms") / F.sum("duration_ms"), 6).alias("rtf"),
        F.sum("n_lines").alias("n_lines"), F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"), F.min("timing_valid").alias("timing_valid"))
    m = mix.groupBy(policy).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n_lines")))).alias("languages"))
    return g.join(m, policy, "left")


def lags(state: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds the text is behind the clock and the speakers are behind the text."""
    tenth = lambda ms: F.greatest(F.bround(ms.cast("decimal(20,1)") / 1000, 1), F.lit(0)).cast("double")
    g = state.groupBy(*keys).agg(F.max("now_ms").alias("n"), F.max("text_end").alias("t"), F.max("speaker_end").alias("s"))
    return g.select(*keys, F.when(F.col("t") > 0, tenth(F.col("n") - F.col("t"))).otherwise(0.0).alias("transcription_lag"),
                    tenth(F.col("t") - F.col("s")).alias("diarization_lag"))



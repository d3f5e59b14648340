"""Column expressions shared by the operators (one definition each)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import values as V

PUNCT_CLASS = "[" + "".join(V.PUNCTUATION) + "]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hold(df: DataFrame, **columns: Column) -> DataFrame:
    """Add computed columns behind a generator. Lambdas over them then read the
    value; plain projections would be merged and computed again per element."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def strip(x: Column | str) -> Column:
    """Both ends, any whitespace."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def words(x: Column | str) -> Column:
    """Whitespace words; no empty strings."""
    return F.filter(F.split(_c(x), r"\s+"), lambda w: w != "")


def scoring_form(x: Column | str) -> Column:
    """Lower case, keep letters, digits, underscore, space, hyphen, apostrophe."""
    kept = F.regexp_replace(F.lower(_c(x)), r"[^\p{L}\p{M}\p{N}_\s\-']", " ")
    return strip(F.regexp_replace(kept, r"\s+", " "))


def scoring_words(x: Column | str) -> Column:
    return F.filter(F.split(scoring_form(x), " "), lambda w: w != "")


def upper_form(x: Column | str) -> Column:
    """Upper case with punctuation deleted, not spaced."""
    kept = F.regexp_replace(F.upper(_c(x)), r"[^\p{L}\p{M}\p{N}_\s]", "")
    return strip(F.regexp_replace(kept, r"\s+", " "))


def edge_form(x: Column | str) -> Column:
    """Strip edge punctuation, lower case."""
    cls = "[" + "".join("\\" + ch if ch in "[]\\-^\"'.(){}?!" else ch for ch in V.EDGE_PUNCTUATION) + "]"
    return F.lower(F.regexp_replace(_c(x), f"^{cls}+|{cls}+$", ""))


def tokens(x: Column | str) -> Column:
    """Lower-case Latin or Hangul words in order."""
    return F.transform(F.regexp_extract_all(_c(x), F.lit(V.WORD_TOKEN), 0), lambda w: F.lower(w))


def ends_sentence_mark(x: Column | str) -> Column:
    return _c(x).rlike(PUNCT_CLASS + r"\s*$")


def has_hangul(x: Column | str) -> Column:
    return _c(x).rlike(V.HANGUL)


def has_latin(x: Column | str) -> Column:
    return _c(x).rlike(V.LATIN)


def script(x: Column | str) -> Column:
    """KO, EN, MIX or NEU."""
    return (
        F.when(has_hangul(x) & has_latin(x), "MIX").when(has_hangul(x), "KO").when(has_latin(x), "EN").otherwise("NEU")
    )


def majority_language(x: Column | str) -> Column:
    ko, en = F.regexp_count(_c(x), F.lit(V.HANGUL)), F.regexp_count(_c(x), F.lit(V.LATIN))
    return F.when(ko > en, "ko").when(en > ko, "en")


def opposite_script(x: Column | str, lang: Column | str) -> Column:
    lang = _c(lang)
    return (
        F.when(lang == "ko", has_latin(x) & ~has_hangul(x))
        .when(lang == "en", has_hangul(x) & ~has_latin(x))
        .otherwise(F.lit(False))
    )


def acronym_like(x: Column | str) -> Column:
    letters = F.regexp_replace(_c(x), "[^A-Za-z]", "")
    n = F.length(letters)
    return (n > 0) & ((n <= 2) | ((n <= 6) & (letters == F.upper(letters))))


def effective_length(x: Column | str) -> Column:
    """Characters, a Hangul syllable counting 2.8."""
    return F.length(_c(x)) + F.lit(1.8) * F.regexp_count(_c(x), F.lit(V.HANGUL))


def last_word(x: Column | str) -> Column:
    bare = F.regexp_replace(strip(x), PUNCT_CLASS + "+$", "")
    return F.regexp_extract(bare, r"(\S+)\s*$", 1)


def _ends_with(word: Column, suffixes: list[str]) -> Column:
    return word.rlike("(" + "|".join(suffixes) + ")$")


def final_ending(word: Column) -> Column:
    return has_hangul(word) & ~_ends_with(word, V.NON_ENDINGS_KO) & _ends_with(word, V.ENDINGS_KO)


def abbreviation(word: Column) -> Column:
    core = F.regexp_replace(word, r"\.", "")
    initials = word.contains(".") & (core == F.upper(core)) & (core != F.lower(core))
    return (core != "") & ((F.length(core) == 1) | initials | F.lower(core).isin(V.ABBREVIATIONS_EN))


def _opens_upper(nxt: Column) -> Column:
    return strip(nxt).rlike(r"^\p{Lu}")


def genuine_end(closing: Column | str, nxt: Column | str) -> Column:
    """Is the full stop closing ``closing`` a real sentence end, given the text
    after it (NULL when none arrived)?"""
    word = last_word(closing)
    digit = F.regexp_replace(_c(closing), r"\s+$", "").rlike(r"\p{Nd}" + PUNCT_CLASS + "*$")
    return (
        F.when(digit, False)
        .when(word == "", False)
        .when(has_hangul(word), final_ending(word))
        .when(abbreviation(word), False)
        .otherwise(F.coalesce(_opens_upper(_c(nxt)), F.lit(False)))
    )


def split_after_silence(closing: Column | str, nxt: Column | str) -> Column:
    """Three states: true, false, NULL (cannot tell before the next word)."""
    word = last_word(closing)
    nxt = _c(nxt)
    return (
        F.when(word == "", F.lit(True))
        .when(has_hangul(word), final_ending(word))
        .when(nxt.isNull() | (strip(nxt) == ""), F.lit(None).cast("boolean"))
        .otherwise(_opens_upper(nxt))
    )


def clock(ms: Column | str, decimal: str) -> Column:
    """HH:MM:SS plus milliseconds after ``decimal``."""
    v = _c(ms).cast("bigint")
    return F.concat(
        F.lpad(F.floor(v / 3_600_000).cast("string"), 2, "0"), F.lit(":"),
        F.lpad((F.floor(v / 60_000) % 60).cast("string"), 2, "0"), F.lit(":"),
        F.lpad((F.floor(v / 1000) % 60).cast("string"), 2, "0"), F.lit(decimal),
        F.lpad((v % 1000).cast("string"), 3, "0"),
    )


def short_clock(ms: Column | str) -> Column:
    """H:MM:SS.cc with half-even centiseconds."""
    cs = F.bround(_c(ms).cast("decimal(20,1)") / 10, 0).cast("bigint")
    return F.concat(
        F.floor(cs / 360_000).cast("string"), F.lit(":"),
        F.lpad((F.floor(cs / 6000) % 60).cast("string"), 2, "0"), F.lit(":"),
        F.lpad((F.floor(cs / 100) % 60).cast("string"), 2, "0"), F.lit("."),
        F.lpad((cs % 100).cast("string"), 2, "0"),
    )


def parse_clock_ms(x: Column | str) -> Column:
    """H:MM:SS.cc, MM:SS or plain seconds to milliseconds."""
    parts = F.transform(F.split(_c(x), ":"), lambda p: p.cast("decimal(18,3)"))
    seconds = F.aggregate(parts, F.lit(0).cast("decimal(28,3)"),
                          lambda acc, p: (acc * 60 + p).cast("decimal(28,3)"))
    return F.round(seconds * 1000, 0).cast("bigint")


def wall_clock(session_start: Column, ms: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(F.unix_millis(session_start) + _c(ms)), "HH:mm:ss")


def char_run(x: Column | str) -> Column:
    """Longest run of one character."""
    zero = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))
    def step(acc, ch):
        run = F.when(ch == acc["last"], acc["run"] + 1).otherwise(1)
        return F.struct(ch.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))
    chars = F.filter(F.split(_c(x), ""), lambda c: c != "")
    return F.aggregate(chars, zero, step, lambda acc: acc["best"])


def base_name(x: Column | str) -> Column:
    return F.element_at(F.split(F.regexp_replace(_c(x), r"\\", "/"), "/"), -1)


def dynamic_keep(buffer_end: Column, last_emit: Column) -> Column:
    """Audio kept at a switch, in ms: at least 2500, at most 5000."""
    keep = buffer_end - last_emit + 300
    return F.when(keep.isNull(), 2500).otherwise(F.greatest(F.least(keep, F.lit(5000)), F.lit(2500)))

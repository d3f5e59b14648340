"""Inputs used by several query files."""

from pyspark.sql import functions as F

from ..operators.dictionary import overlay

PHRASES = ["the of", "der die", "et la", "que", "ing"]

DIC_SQL = """merged AS (SELECT wrong, max_by(correct, CASE src WHEN 'user' THEN 1 ELSE 0 END) AS correct FROM dic GROUP BY wrong)"""


def user_first(t):
    d = t.dict_entries
    return overlay(d.filter("src = 'base'"), d.filter("src = 'user'"))


def with_silence(t):
    quiet = t.sil.select("session_id", "seg_id", "start_ms", "end_ms", F.lit(None).cast("string").alias("text"),
                         F.lit(-2).alias("speaker"), F.lit(None).cast("string").alias("lang"))
    return t.seg.unionByName(quiet)


def grown(w: str) -> str:
    """SQL: the words of list ``w`` show a growing restart loop."""
    ahead = f"coalesce(list_min(list_filter(range(0, len({w}) - p[k] + 1), lambda d: {w}[p[k - 1] + d] <> {w}[p[k] + d])), len({w}) - p[k] + 1)"
    common = f"list_transform(range(1, len(p) + 1), lambda k: CASE WHEN k = 1 OR p[k] - p[k - 1] < 6 THEN -1 WHEN {ahead} >= 0.7 * (p[k] - p[k - 1]) THEN {ahead} ELSE -1 END)"
    more = f"list_transform([{common}], lambda c: len(list_filter(range(2, len(c) + 1), lambda k: c[k - 1] >= 0 AND c[k] > c[k - 1])) > 0)[1]"
    return any_gram(w, more)


def any_gram(w: str, test: str) -> str:
    """SQL: ``test`` holds for the places ``p`` of some 1- or 2-gram of list ``w`` (n is its length)."""
    def of(n: int, grams: str) -> str:
        at = "list_filter(range(1, len(g) + 1), lambda i: g[i] = x)"
        return f"list_transform([{grams}], lambda g: len(list_filter(list_distinct(g), lambda x: list_transform([{at}], lambda p: {test.replace('@n', str(n))})[1])) > 0)[1]"

    return f"({of(1, w)} OR {of(2, f'list_transform(range(1, len({w})), lambda i: {w}[i] || chr(1) || {w}[i + 1])')})"


def stormy(w: str, least: int = 4) -> str:
    """SQL: most places of some gram of ``w`` stand close together."""
    heads = "list_filter(range(1, len(p) + 1), lambda k: k = 1 OR p[k] - p[k - 1] - @n > 5) || [len(p) + 1]"
    largest = f"list_transform([{heads}], lambda b: list_max(list_transform(range(1, len(b)), lambda j: b[j + 1] - b[j])))[1]"
    return any_gram(w, f"{largest} >= {least} AND {largest} >= 0.6 * len(p)")

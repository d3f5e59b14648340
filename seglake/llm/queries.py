"""Registered queries of the corpus operators, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, hard_negatives, langid, license_scan, main_text, mtree, simhash, spelling, substring_dedup, token_counts, token_files, url_filter
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(table(spark, folder, "documents", "doc_id", "text")))


@query
def op2_bpe_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))


@query
def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages", "page_id", "url")
    return url_filter.judge(pages, url_filter.SITES + url_filter.PATTERNS).drop("url", "n_candidates")


@query
def op4_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.extract(table(spark, folder, "pages", "page_id", "url", "html")).drop("html")


@query
def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return token_files.read(token_files.write(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2), ids=False)


@query
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    told = langid.identify(docs.select("doc_id", "text"), model)
    return told.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return token_counts.with_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


@query
def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    found = decontaminate.find(docs, table(spark, folder, "benchmark", "item_id", "text"))
    return decontaminate.digest(found)


@query
def op9_topk_mtree(spark: SparkSession, folder: str) -> DataFrame:
    rows = mtree.integers(table(spark, folder, "embeddings", "vec_id", "embedding"))
    return mtree.top_k(rows, rows.where("vec_id % 20 = 0"))


@query
def op10_simhash_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents", "doc_id", "text"))


@query
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents", "doc_id", "text"))


@query
def op12_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(table(spark, folder, "documents", "doc_id", "text")))


@query
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.usable(table(spark, folder, "embeddings", "vec_id", "embedding", "label"), label=label)
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def _url_sql() -> str:
    """The same verdicts in DuckDB: every rule as a regular expression over host and path."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    sites = sorted(url_filter.SITES, key=lambda r: (-len(r.name), r.action != url_filter.BLOCK))
    hit = lambda r: f"regexp_matches(u, {text(r.pattern)}, 's')"
    rule = " ".join(f"WHEN {hit(r)} THEN {text(r.name)}" for r in sites)
    verdict = " ".join(f"WHEN {hit(r)} THEN {text(r.action)}" for r in sites)
    others = sorted(url_filter.PATTERNS, key=lambda r: (-len(r.name), r.action != url_filter.BLOCK))
    pattern = " ".join(f"WHEN {hit(r)} THEN {text(r.name)}" for r in others)
    return f"""WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
      h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
      s AS (SELECT *, host || path AS u FROM h), j AS (SELECT *, CASE {rule} END AS rule, CASE {pattern} END AS fits FROM s)
      SELECT page_id, host, path, rule, CASE {verdict} WHEN fits IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, CASE WHEN rule IS NULL THEN fits END AS pattern FROM j"""


ORACLES["op3_url_filter"] = _url_sql()
ORACLES["op8_decontaminate"] = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  iw AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM (SELECT *, least(10, len(w)) AS n FROM i WHERE len(w) > 0))),
  dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
  h AS (SELECT doc_id, n, p, item FROM dw JOIN iw USING (n, k)), c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
  t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""
ORACLES["op9_topk_mtree"] = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS r FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.r, c.r) AS BIGINT) AS score FROM (SELECT vec_id, min(r) AS r FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id) q JOIN v c ON c.vec_id <> q.vec_id AND len(q.r) = len(c.r)),
  k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20"""
ORACLES["op12_substring_dedup"] = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
  m AS (SELECT k, min(doc_id) AS least FROM s GROUP BY k), g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM s JOIN m USING (k) WHERE least < doc_id),
  t AS (SELECT doc_id, list(q) AS gone FROM g GROUP BY doc_id)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
    sha256(array_to_string(list_filter(w, lambda x, i: NOT coalesce(list_contains(gone, i), false)), ' ')) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""
ORACLES["op13_hard_negatives"] = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS r FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.r, c.r) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(a.r) = len(c.r)),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
  n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
  SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

"""Registry of queries with their checking SQL.

A query is a function of ``Tables``. The SQL is written for DuckDB over the raw
tables; ``with_views`` prepends the derived views it uses, stated independently
of the Spark code."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VIEWS = {
    "tok": r"""
      tokw AS (SELECT conv_id session_id, turn, role,
              unnest(regexp_split_to_array(trim("text"), '\s+')) word,
              generate_subscripts(regexp_split_to_array(trim("text"), '\s+'), 1) - 1 pos FROM conversations),
      tokb AS (SELECT session_id, turn, pos, word,
              CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END speaker,
              CASE WHEN turn % 2 = 0 THEN 'en' ELSE 'ko' END lang,
              row_number() OVER (PARTITION BY session_id ORDER BY turn, pos) seq FROM tokw),
      tok AS (SELECT session_id, turn, pos, word, speaker, lang, seq,
              CAST(400*(seq-1) + sum(CASE WHEN pos = 0 THEN 500*(turn % 4) ELSE 0 END)
                OVER (PARTITION BY session_id ORDER BY seq) AS BIGINT) AS start_ms FROM tokb)""",
    "seg": r"""
      seg AS (SELECT session_id, turn seg_id, min(start_ms) start_ms, max(start_ms)+100 end_ms,
              string_agg(word, ' ' ORDER BY seq) "text", min(speaker) speaker, min(lang) lang
              FROM tok GROUP BY session_id, turn)""",
    "sil": r"""
      sil AS (SELECT * FROM (SELECT session_id, seg_id, end_ms start_ms,
              lead(start_ms) OVER (PARTITION BY session_id ORDER BY seg_id) end_ms FROM seg) q
              WHERE end_ms - start_ms > 400)""",
    "diar": r"""
      diar AS (SELECT session_id, chunk, start_ms, end_ms, (chunk*5 + chunk // 2) % 3 speaker FROM
              (SELECT session_id, (seq-1) // 7 chunk, min(start_ms) start_ms, max(start_ms)+300 end_ms
               FROM tok GROUP BY session_id, (seq-1) // 7) q)""",
    "evt": r"""
      evt AS (SELECT event_id, user_id, epoch_us(ts) // 1000 ts_ms, event_type, value,
              CAST(json_extract_string(props, '$.k') AS BIGINT) k FROM events)""",
    "frm": r"""
      frm AS (SELECT user_id session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) frame_no, k
              FROM evt)""",
    "log": r"""
      log AS (SELECT user_id file_id, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) line_no,
              CASE event_type
              WHEN 'click' THEN concat('[EndSilence] dur=', k, ' branch=',
                   CASE WHEN k >= 80 THEN 'long' WHEN k >= 40 THEN 'short' ELSE 'none' END)
              WHEN 'view' THEN concat('[CrossBatchFilter] drop=w', k % 7)
              WHEN 'error' THEN concat('[Stall] ', k, 's without output')
              WHEN 'signup' THEN concat('[NewSpeaker] spk=', k % 3)
              ELSE concat('[Probe] batch=', event_id, ' p_ko=', k, ' p_en=', 100 - k) END line FROM evt)""",
    "pair": r"""
      nrm AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(trim(regexp_replace(lower("text"),
              '[^\p{L}\p{M}\p{N}_\s\-'']', ' ', 'g')), '\s+'), lambda x: x <> '') r FROM documents),
      pair AS (SELECT doc_id, lang, array_to_string(r, ' ') "ref", array_to_string(
              [CASE WHEN (i-1) % 11 = 3 THEN 'x' ELSE r[i] END FOR i IN range(1, len(r)+1) IF (i-1) % 7 <> 6], ' ') hyp
              FROM nrm)""",
    "bench": r"""
      bench AS (SELECT doc_id, lang AS language, concat('c', CAST(doc_id % 4 AS VARCHAR)) category,
              n_chars*66 duration_ms, n_chars*(5 + doc_id % 20) proc_ms,
              doc_id % 5 subs, doc_id % 3 ins, doc_id % 4 dels, greatest(n_chars // 6, 1) ref_words FROM documents)""",
    "snap": r"""
      snap AS (SELECT a.session_id, a.seg_id seq, b.seg_id - greatest(a.seg_id - 4, 0) line_idx, b.seg_id line_id,
              CASE WHEN a.seg_id = b.seg_id THEN regexp_replace(b.text, '\s*\S+$', '') ELSE b.text END line_text
              FROM seg a JOIN seg b ON a.session_id = b.session_id AND b.seg_id BETWEEN a.seg_id - 4 AND a.seg_id)""",
    "dic": r"""
      dic AS (SELECT word wrong, upper(word) correct, 'base' src FROM (SELECT DISTINCT
              lower(unnest(regexp_extract_all("text", '[A-Za-z'']+|[가-힣]+'))) word FROM benchmark)
              UNION ALL SELECT word, reverse(word), 'user' FROM (SELECT DISTINCT
              lower(unnest(regexp_extract_all("text", '[A-Za-z'']+|[가-힣]+'))) word FROM conversations))""",
}
NEEDS = {"tok": [], "seg": ["tok"], "sil": ["seg"], "diar": ["tok"], "evt": [], "frm": ["evt"], "log": ["evt"],
         "pair": [], "bench": [], "snap": ["seg"], "dic": []}


def with_views(sql: str) -> str:
    """Prepend the views named in ``sql`` (in dependency order)."""
    order: list[str] = []

    def add(name: str) -> None:
        for parent in NEEDS[name]:
            add(parent)
        if name not in order:
            order.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            add(name)
    if not order:
        return sql
    body = sql.strip()
    views = ",".join(VIEWS[n] for n in order)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {views}, {body[5:]}"
    return f"WITH {views} {body}"


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register

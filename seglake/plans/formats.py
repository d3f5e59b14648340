"""Every log format once: example lines filled from the event table, and what a scan must give for them."""

from pyspark.sql import functions as F

from ..operators import logs as L
from ..sources import logs as SL
from .logs import E, K
from .registry import query

#: (line, kind, captures); {n} is the number of the line in its file.
SWITCH = [
    ("[TraceTokens] DEBUG 레벨 로깅 활성화", "trace_on", {}), ("align: Output: text {n}", "output", {}),
    ("SimulStreaming processing error: The size of tensor a ({n}) must match the size of tensor b (4) at non-singleton dimension 2", "tensor_mismatch", {"a": "{n}", "b": "4", "dim": "2"}),
    ("SimulStreaming processing error: no memory {n}", "other_error", {"message": "no memory {n}"}),
    ("[LangSwitch] 토크나이저 적용: en (prev=ko, switch=True, skip_trim=False)", "switch_apply", {"lang": "en", "prev": "ko", "switch": "True", "skip_trim": "False"}),
    ("[LangSwitch] 문장 경계 마커 방출 @ {n}.5s (lang=ko)", "marker", {"t": "{n}.5", "lang": "ko"}),
    ("[LangSwitch] 전환 전 오디오 {n}.0s 절단 (유지 0.5s)", "trim", {"removed": "{n}.0", "kept": "0.5"}),
    ("[SwitchTaxMeasure] 전환 직후 배치 2/{n} 단어가 직전 tail과 겹침 (tail=[a, b])", "tax_overlap", {"overlap": "2", "total": "{n}", "tail": "[a, b]"}),
    ("[SwitchTaxMeasure] 전환 직후 배치 겹침 없음 (tail=[c{n}])", "tax_clean", {"tail": "[c{n}]"}),
    ("[CrossBatchFilter] 반복 제거: w{n} (prev=w)", "cross_batch", {"word": "w{n}", "prev": "w"}),
    ("[BatchRepeatFilter] 배치 내 반복 네 ×{n} — 배치 드롭+리셋", "batch_repeat", {"word": "네", "count": "{n}"}),
    ("[HallucinationFilter] 환각 루프 임계치 초과 — context 리셋 (count={n})", "hallucination_reset", {"count": "{n}"}),
    ("SimulStreaming stall recovery: {n}.2s without output", "stall", {"secs": "{n}.2"}),
    ("[ForeignLang] '(speaking in foreign language)' 감지", "foreign_detect", {}),
    ("[EndSilence] dur={n}.0s branch=long det_lang=ko lang_before_reset=None", "end_silence", {"dur": "{n}.0", "branch": "long", "det_lang": "ko", "before": "None"}),
    ("[EndSilence] long-silence 리셋 직전(폐기 예정): det_lang=ko→None lang_before_reset=en→None", "long_reset", {"det_lang": "ko", "before": "en"}),
    ("[NewSpeaker] spk={n}→1 det_before=ko eager=True", "new_speaker", {"old": "{n}", "new": "1", "det_before": "ko", "eager": "True"}),
    ("[NewSpeaker] spk={n} det_after=en (eager_applied=False)", "new_speaker_after", {"spk": "{n}", "det_after": "en", "eager_applied": "False"}),
    ("[LangDetectDeferred] 감지 보류: first_timestamp=None, eager_lang_detect=False (segments_len={n}.1s)", "deferred", {"seglen": "{n}.1"}),
    ("[FirstTimestamp] 최초 설정: {n}.0s (segments_len=1.5s)", "first_timestamp", {"t": "{n}.0", "seglen": "1.5"}),
    ("nothing of note {n}", None, {}),
]
DROP = [
    SWITCH[0], SWITCH[1], ("SimulStreaming processing error: whatever {n}", "tensor_mismatch", {}),
    ("[ScriptMismatchFilter] lang=ko 반대스크립트 반복 세그먼트 드롭: so so {n}", "script_mismatch", {"lang": "ko", "text": "so so {n}"}),
    SWITCH[13], ("[ForeignLang] 드롭 텍스트: text {n}", "foreign_dropped", {"text": "text {n}"}), SWITCH[10], SWITCH[11], SWITCH[9],
    ("[QualityGate] avg_logprob -1.{n} < -1.0 — suppressing: bad {n}", "gate_logprob", {"value": "-1.{n}", "limit": "-1.0", "text": "bad {n}"}),
    ("[QualityGate] compression_ratio 3.{n} > 2.4 — suppressing: bad bad", "gate_ratio", {"value": "3.{n}", "limit": "2.4", "text": "bad bad"}),
    ("[QualityGate] {n} consecutive suppressions — refresh_segment", "gate_refresh", {"count": "{n}"}), SWITCH[12], SWITCH[16], SWITCH[17], SWITCH[20],
]
BOUNDARY = [
    SWITCH[0],
    ("[RetractScan] boundary_t={n}.5 prev_lang=ko scanned=4 removed=2 stopped_by=silence", "retract_scan", {"boundary_t": "{n}.5", "prev_lang": "ko", "scanned": "4", "removed": "2", "stopped_by": "silence"}),
    ("[Retract] 철회: 'w {n}' start={n}.0 prev_lang=ko", "retract", {"text": "'w {n}'", "start": "{n}.0", "prev_lang": "ko"}),
    ("[LangSwitch] 문장 경계 마커 방출 @ {n}.5s (lang=en)", "marker", {"boundary_t": "{n}.5", "lang": "en"}),
    ("[NewSpeaker] spk={n} det_after=en (eager_applied=True) keep_secs=1.5 kept_segments_len=2.5s global_time_offset=-3.5", "new_speaker_after",
     {"spk": "{n}", "det_after": "en", "eager_applied": "True", "keep_secs": "1.5", "kept": "2.5", "offset": "-3.5"}),
    ("[Reconcile] arm boundary_t={n}.5 prev_lang=ko new_lang=en floor=-1.5 tombstones=3", "arm", {"boundary_t": "{n}.5", "prev_lang": "ko", "new_lang": "en", "floor": "-1.5", "tombstones": "3"}),
    ("[Reconcile] resolve reason=d1 boundary_t={n}.5 cut=NA covered=1 restored=2 replaced=3", "resolve", {"reason": "d1", "boundary_t": "{n}.5", "cut": "NA", "covered": "1", "restored": "2", "replaced": "3"}),
    ("[Restore] 복원: 'a b' start=-1.0 dstart=NA boundary_t={n}.5 zone=zone1", "restore", {"text": "'a b'", "start": "-1.0", "dstart": "NA", "boundary_t": "{n}.5", "zone": "zone1"}),
    ("[Replace] 늦은 대체(late): 'b' start=3.0 dstart=-0.5 boundary_t={n}.5 zone=zone2", "replace_late", {"text": "'b'", "start": "3.0", "dstart": "-0.5", "boundary_t": "{n}.5", "zone": "zone2"}),
    ("[Replace] 대체: 'c' start=3.0 dstart=0.5 boundary_t={n}.5 zone=zone1", "replace", {"text": "'c'", "start": "3.0", "dstart": "0.5", "boundary_t": "{n}.5", "zone": "zone1"}),
    ("[TimeDedup] action=drop new_text='d' start=2.0 dstart=0.25 boundary_t={n}.5", "dedup", {"action": "drop", "text": "'d'", "start": "2.0", "dstart": "0.25", "boundary_t": "{n}.5"}),
    ("[LangSwitch] dynamic keep={n}.0s (buffer_end=9.5 last_emit_end=None)", "dynamic_keep", {"keep": "{n}.0", "buffer_end": "9.5", "last_emit_end": "None"}), SWITCH[20],
]


def _lines(t, examples: list):
    """Line n of a file is example n, and so on around."""
    n = F.col("n")
    texts = F.array(*[F.lit(line) for line, _, _ in examples])
    line = F.replace(F.get(texts, (n % len(examples)).cast("int")), F.lit("{n}"), n.cast("string"))
    return t.numbered_events().select(F.col("user_id").alias("file_id"), n.alias("line_no"), line.alias("line"))


def _kinds(examples: list) -> str:
    """SQL: table x with the kind of every line. Files divisible by three have no output."""
    kinds = " ".join(f"WHEN {i} THEN '{k}'" for i, (_, k, _) in enumerate(examples) if k)
    return f"{E}, y AS (SELECT file_id, line_no, CASE line_no % {len(examples)} {kinds} END AS kind FROM e), x AS (SELECT * FROM y WHERE kind IS NOT NULL AND NOT (kind = 'output' AND file_id % 3 = 0))"


def _events(t, catalog: list, examples: list):
    return SL.log_events(_lines(t, examples), catalog, K).filter("NOT (kind = 'output' AND file_id % 3 = 0)")


def _all(name: str, catalog: list, examples: list) -> None:
    assert {k for k, _, _ in catalog} == {k for _, k, _ in examples if k}, name
    quoted = lambda x: "'" + x.replace("'", "''").replace("{n}", "' || line_no || '") + "'"
    shown = [";".join(f"{k}={v}" for k, v in sorted(c.items())) for _, _, c in examples]
    kinds = " ".join(f"WHEN {i} THEN '{k}'" for i, (_, k, _) in enumerate(examples) if k)
    captures = " ".join(f"WHEN {i} THEN {quoted(x)}" for i, x in enumerate(shown))
    sql = f"""WITH {E}, x AS (SELECT file_id, line_no, CASE line_no % {len(examples)} {kinds} END AS kind, CASE line_no % {len(examples)} {captures} END AS captures FROM e) SELECT * FROM x WHERE kind IS NOT NULL"""

    @query(name, sql)
    def _(t):
        entries = F.transform(F.map_entries("captures"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
        return SL.log_events(_lines(t, examples), catalog, K).select("file_id", "line_no", "kind", F.array_join(F.array_sort(entries), ";").alias("captures"))


_all("src04b_all_formats", SL.SWITCH_CATALOG, SWITCH)
_all("src04c_all_formats", SL.DROP_CATALOG, DROP)
_all("src04d_all_formats", SL.BOUNDARY_CATALOG, BOUNDARY)

DROPPED = ", ".join(f"'{k}'" for k in SL.DROP_KINDS)
OTHERS = ["cross_batch", "gate_refresh", "stall", "new_speaker", "tensor_mismatch", "output"]


@query("agg15_drop_summary_all_formats", f"""WITH {_kinds(DROP)}, a AS (SELECT file_id, line_no AS al FROM x WHERE kind = 'new_speaker'), n AS (SELECT x.file_id, x.line_no, coalesce(min(abs(al - line_no)) <= 5, false) AS near FROM x LEFT JOIN a USING (file_id) WHERE kind IN ({DROPPED}) GROUP BY ALL),
   g AS (SELECT x.file_id, count(near) AS drops, count(CASE WHEN near THEN 1 END) AS near_change, count(CASE WHEN NOT near THEN 1 END) AS far_or_none, {', '.join(f"count(CASE WHEN kind = '{k}' THEN 1 END) AS {k}" for k in SL.DROP_KINDS + OTHERS)},
     count(CASE WHEN kind = 'trace_on' THEN 1 END) > 0 AS trace_on FROM x LEFT JOIN n USING (file_id, line_no) GROUP BY x.file_id)
   SELECT *, tensor_mismatch > 0 OR (trace_on AND "output" = 0) AS broken, concat_ws(',', CASE WHEN tensor_mismatch > 0 THEN 'tensor_mismatch' END, CASE WHEN trace_on AND "output" = 0 THEN 'no_output' END) AS reasons FROM g""")
def _(t):
    return L.drop_summary(_events(t, SL.DROP_CATALOG, DROP), K, 5)


#: Column and condition on a line; cascades and stuck cycles are checked by win08 and win09.
COUNTED = {"tensor_mismatches": "kind = 'tensor_mismatch'", "other_errors": "kind = 'other_error'", "switch_true": "kind = 'switch_apply'", "switch_false": "false", "markers": "kind = 'marker'", "low_keep_trims": "kind = 'trim'",
           "high_overlap": "kind = 'tax_overlap' AND line_no <= 3", "cross_batch": "kind = 'cross_batch'", "stalls": "kind = 'stall'", "outputs": "kind = 'output'", "long_silences": "kind = 'end_silence'", "short_silences": "false",
           "resets_discarded": "kind = 'long_reset'", "deferred": "kind = 'deferred'"}


@query("agg17_loss_summary_all_formats", f"WITH {_kinds(SWITCH)} SELECT file_id, {', '.join(f'count(CASE WHEN {c} THEN 1 END) AS {n}' for n, c in COUNTED.items())} FROM x GROUP BY file_id")
def _(t):
    return L.loss_summary(_events(t, SL.SWITCH_CATALOG, SWITCH), K).select("file_id", *COUNTED)

"""Server log scans: text lines to typed events, in parallel over files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import last_known, prev, rows_block, running_sum, scan
from .texts import numbered_lines

# Line formats. (kind, pattern, names of the captures)
TRACE_ON = ("trace_on", r"\[TraceTokens\] DEBUG 레벨 로깅 활성화", [])
OUTPUT = ("output", r"\bOutput: ", [])
SWITCH_CATALOG = [
    TRACE_ON, OUTPUT,
    ("tensor_mismatch", r"SimulStreaming processing error:.*size of tensor a \((\d+)\) must match the size of tensor b \((\d+)\) at non-singleton dimension (\d+)", ["a", "b", "dim"]),
    ("other_error", r"SimulStreaming processing error:\s*(.+)$", ["message"]),
    ("switch_apply", r"\[LangSwitch\] 토크나이저 적용: (\S+) \(prev=(\S+), switch=(True|False), skip_trim=(True|False)\)", ["lang", "prev", "switch", "skip_trim"]),
    ("marker", r"\[LangSwitch\] 문장 경계 마커 방출 @ ([\d.]+)s \(lang=(\S+)\)", ["t", "lang"]),
    ("trim", r"\[LangSwitch\] 전환 전 오디오 ([\d.]+)s 절단 \(유지 ([\d.]+)s\)", ["removed", "kept"]),
    ("tax_overlap", r"\[SwitchTaxMeasure\] 전환 직후 배치 (\d+)/(\d+) 단어가 직전 tail과 겹침 \(tail=(\[.*\])\)", ["overlap", "total", "tail"]),
    ("tax_clean", r"\[SwitchTaxMeasure\] 전환 직후 배치 겹침 없음 \(tail=(\[.*\])\)", ["tail"]),
    ("cross_batch", r"\[CrossBatchFilter\] 반복 제거: (.+) \(prev=(.+)\)\s*$", ["word", "prev"]),
    ("batch_repeat", r"\[BatchRepeatFilter\] 배치 내 반복 (.+) ×(\d+) — 배치 드롭\+리셋", ["word", "count"]),
    ("hallucination_reset", r"\[HallucinationFilter\] 환각 루프 임계치 초과 — context 리셋 \(count=(\d+)\)", ["count"]),
    ("stall", r"SimulStreaming stall recovery: ([\d.]+)s without output", ["secs"]),
    ("foreign_detect", r"\[ForeignLang\] '\(speaking in foreign language\)' 감지", []),
    ("end_silence", r"\[EndSilence\] dur=([\d.]+)s branch=(long|short|none) det_lang=(\S+) lang_before_reset=(\S+)", ["dur", "branch", "det_lang", "before"]),
    ("long_reset", r"\[EndSilence\] long-silence 리셋 직전\(폐기 예정\): det_lang=(\S+)→None lang_before_reset=(\S+)→None", ["det_lang", "before"]),
    ("new_speaker", r"\[NewSpeaker\] spk=(\S+)→(\S+) det_before=(\S+) eager=(\S+)", ["old", "new", "det_before", "eager"]),
    ("new_speaker_after", r"\[NewSpeaker\] spk=(\S+) det_after=(\S+) \(eager_applied=(\S+)\)", ["spk", "det_after", "eager_applied"]),
    ("deferred", r"\[LangDetectDeferred\] 감지 보류: first_timestamp=None, eager_lang_detect=False \(segments_len=([\d.]+)s\)", ["seglen"]),
    ("first_timestamp", r"\[FirstTimestamp\] 최초 설정: ([\d.]+)s \(segments_len=([\d.]+)s\)", ["t", "seglen"]),
]
DROP_CATALOG = [
    TRACE_ON, OUTPUT,
    ("tensor_mismatch", r"SimulStreaming processing error:", []),
    ("script_mismatch", r"\[ScriptMismatchFilter\] lang=(\S+) 반대스크립트 반복 세그먼트 드롭: (.*)$", ["lang", "text"]),
    ("foreign_detect", r"\[ForeignLang\] '\(speaking in foreign language\)' 감지", []),
    ("foreign_dropped", r"\[ForeignLang\] 드롭 텍스트: (.*)$", ["text"]),
    ("batch_repeat", r"\[BatchRepeatFilter\] 배치 내 반복 (.+) ×(\d+) — 배치 드롭\+리셋", ["word", "count"]),
    ("hallucination_reset", r"\[HallucinationFilter\] 환각 루프 임계치 초과 — context 리셋 \(count=(\d+)\)", ["count"]),
    ("cross_batch", r"\[CrossBatchFilter\] 반복 제거: (.+) \(prev=(.+)\)\s*$", ["word", "prev"]),
    ("gate_logprob", r"\[QualityGate\] avg_logprob ([\-\d.]+) < ([\-\d.]+) — suppressing: (.*)$", ["value", "limit", "text"]),
    ("gate_ratio", r"\[QualityGate\] compression_ratio ([\d.]+) > ([\d.]+) — suppressing: (.*)$", ["value", "limit", "text"]),
    ("gate_refresh", r"\[QualityGate\] (\d+) consecutive suppressions — refresh_segment", ["count"]),
    ("stall", r"SimulStreaming stall recovery: ([\d.]+)s without output", ["secs"]),
    ("new_speaker", r"\[NewSpeaker\] spk=(\S+)→(\S+) det_before=(\S+) eager=(\S+)", ["old", "new", "det_before", "eager"]),
    ("new_speaker_after", r"\[NewSpeaker\] spk=(\S+) det_after=(\S+) \(eager_applied=(\S+)\)", ["spk", "det_after", "eager_applied"]),
]
DROP_KINDS = ["script_mismatch", "foreign_detect", "foreign_dropped", "batch_repeat", "hallucination_reset", "gate_logprob", "gate_ratio"]
BOUNDARY_CATALOG = [
    TRACE_ON,
    ("retract_scan", r"\[RetractScan\] boundary_t=([\d.]+) prev_lang=(\S+) scanned=(\d+) removed=(\d+) stopped_by=(\S+)", ["boundary_t", "prev_lang", "scanned", "removed", "stopped_by"]),
    ("retract", r"\[Retract\] 철회: (.+) start=([\d.]+) prev_lang=(\S+)", ["text", "start", "prev_lang"]),
    ("marker", r"\[LangSwitch\] 문장 경계 마커 방출 @ ([\d.]+)s \(lang=(\S+)\)", ["boundary_t", "lang"]),
    ("new_speaker_after", r"\[NewSpeaker\] spk=(\S+) det_after=(\S+) \(eager_applied=(\S+)\) keep_secs=([\d.]+) kept_segments_len=([\d.]+)s global_time_offset=([\-\d.]+)",
     ["spk", "det_after", "eager_applied", "keep_secs", "kept", "offset"]),
    ("arm", r"\[Reconcile\] arm boundary_t=([\d.]+) prev_lang=(\S+) new_lang=(\S+) floor=([\-\d.]+) tombstones=(\d+)", ["boundary_t", "prev_lang", "new_lang", "floor", "tombstones"]),
    ("resolve", r"\[Reconcile\] resolve reason=(\S+) boundary_t=([\d.]+) cut=(\S+) covered=(\d+) restored=(\d+) replaced=(\d+)", ["reason", "boundary_t", "cut", "covered", "restored", "replaced"]),
    ("restore", r"\[Restore\] 복원: (.+) start=([\-\d.]+) dstart=(\S+) boundary_t=([\d.]+) zone=(\S+)", ["text", "start", "dstart", "boundary_t", "zone"]),
    ("replace_late", r"\[Replace\] 늦은 대체\(late\): (.+) start=([\-\d.]+) dstart=(\S+) boundary_t=([\d.]+) zone=(\S+)", ["text", "start", "dstart", "boundary_t", "zone"]),
    ("replace", r"\[Replace\] 대체: (.+) start=([\-\d.]+) dstart=(\S+) boundary_t=([\d.]+) zone=(\S+)", ["text", "start", "dstart", "boundary_t", "zone"]),
    ("dedup", r"\[TimeDedup\] action=(\w+) (?:text|new_text)=(.+?) start=([\-\d.]+) dstart=([\-\d.]+) boundary_t=([\d.]+)", ["action", "text", "start", "dstart", "boundary_t"]),
    ("dynamic_keep", r"\[LangSwitch\] dynamic keep=([\d.]+)s \(buffer_end=([\-\d.]+) last_emit_end=(\S+)\)", ["keep", "buffer_end", "last_emit_end"]),
]
LOG_NAME = r"server_(.+?)_([ABC])_R(\d+)_\d+_\d+\.log$"
PROBE_FIELDS = ["t_abs", "seglen", "p_ko", "p_en", "p_abs_ko", "p_abs_en", "resid", "H_lang", "p_translate", "p_transcribe", "p_nospeech"]


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) over a folder; a large file is read by many tasks."""
    return numbered_lines(spark, path)


def log_key(file: Column, pattern: str = LOG_NAME) -> list[Column]:
    """(stem, path, rep) from a file name; empty strings when it does not fit."""
    base = F.element_at(F.split(F.regexp_replace(file, r"\\", "/"), "/"), -1)
    return [F.regexp_extract(base, pattern, i).alias(n) for i, n in ((1, "stem"), (2, "path"), (3, "rep"))]


def unquote(x: Column) -> Column:
    t = F.trim(x)
    return F.when(t.rlike("""^'.*'$|^".*"$"""), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)



def log_events(logs: DataFrame, catalog: list[tuple], keys: list[str]) -> DataFrame:
    """First matching format per line: kind and a map of its captures."""
    line, hit = F.col("line"), None
    for kind, pattern, names in catalog:
        pairs = [x for i, n in enumerate(names, 1) for x in (F.lit(n), F.trim(F.regexp_extract(line, pattern, i)))]
        got = F.struct(F.lit(kind).alias("kind"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("captures"))
        hit = F.when(line.rlike(pattern), got) if hit is None else hit.when(line.rlike(pattern), got)
    return logs.select(*keys, "line_no", F.inline(F.array(hit))).filter("kind is not null")


def silence_boundaries(logs: DataFrame, keys: list[str]) -> DataFrame:
    """Finished silences with the suppressions and refreshes seen since the
    boundary before."""
    line = F.col("line")
    refresh = line.rlike(r"\[QualityGate\].*consecutive suppressions.*refresh_segment")
    suppress = ~refresh & line.rlike(r"\[QualityGate\].*suppressing:\s*(.*)$")
    done = ~refresh & ~suppress & line.rlike(r"Silence of = ([\d.]+)s")
    num = lambda p: F.nullif(F.regexp_extract(line, p, 1), F.lit("")).cast("double")
    d = logs.withColumn("_kind", F.when(refresh, "r").when(suppress, "s").when(done, "b")).filter("_kind is not null")
    d = d.select(*keys, "line_no", "_kind", num(r"Silence of = ([\d.]+)s").alias("dur"), num(r"lag=([\d.]+)s").alias("lag"), num(r"last_end = ([\d.]+)").alias("last_end"))
    c = lambda k: running_sum(F.when(F.col("_kind") == k, 1).otherwise(0))
    s = scan(d, keys, ["line_no"], rows_block("line_no"), _s=c("s"), _r=c("r"))
    b = s.filter("_kind = 'b'")
    b = scan(b, keys, ["line_no"], rows_block("line_no"), _ps=prev("_s", 0), _pr=prev("_r", 0))
    return b.select(*keys, "line_no", "dur", "lag", "last_end", (F.col("_s") - F.col("_ps")).alias("suppressed"), (F.col("_r") - F.col("_pr")).alias("refreshes"))


def probe_rows(logs: DataFrame, keys: list[str]) -> DataFrame:
    """Probe lines and output lines in order; an output line carries the time
    and lock state of the last probe before it."""
    line = F.col("line")
    body = F.regexp_extract(line, r"\[SotLangProbe\] (.+)$", 1)
    kv = F.map_from_entries(F.transform(F.regexp_extract_all(body, F.lit(r"(\w+=-?[\w.+-]+)"), 1), lambda x: F.struct(
        F.regexp_extract(x, r"^(\w+)=", 1).alias("k"), F.regexp_extract(x, r"=(.*)$", 1).alias("v"))))
    kind = F.when(body != "", "probe").when(F.trim(F.regexp_extract(line, r"Output:\s*(.*)$", 1)) != "", "output")
    d = logs.select(*keys, "line_no", kind.alias("kind"), F.when(body != "", kv).alias("kv"), F.trim(F.regexp_extract(line, r"Output:\s*(.*)$", 1)).alias("text")).filter("kind is not null")
    locked = F.nullif(F.col("kv")["locked"], F.lit("None"))
    d = d.select(*keys, "line_no", "kind", F.when(F.col("kind") == "output", F.col("text")).alias("text"), F.col("kv")["batch"].try_cast("bigint").alias("batch"),
                 locked.alias("locked"), *[F.col("kv")[f].try_cast("double").alias(f) for f in ("t_abs", "p_ko", "p_en", "resid")])
    s = scan(d, keys, ["line_no"], rows_block("line_no"), last_t=last_known("t_abs"),
             _lock=last_known(F.when(F.col("kind") == "probe", F.struct(F.col("locked").alias("x")))))
    opp = F.when(F.col("kind") == "probe", F.when(F.col("locked") == "en", F.col("p_ko")).when(F.col("locked") == "ko", F.col("p_en")))
    return s.withColumn("locked_now", F.col("_lock.x")).withColumn("p_opp", opp).drop("_lock")

"""Evaluation rows without audio: their real-time factor is 0 / 0, which is no error."""

import math

import pytest

from seglake.operators import aggregates as A
from seglake.operators import reports as RP

BENCH = "doc_id long, language string, category string, duration_ms long, proc_ms long, subs long, ins long, dels long, ref_words long, latency_ms long"


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "en", "c1", 1000, 500, 1, 0, 0, 2, 7), (2, "fr", "c1", 0, 0, 1, 0, 0, 1, 0), (3, "fr", "c0", 200, 50, 0, 0, 0, 1, 9)], BENCH)


def test_summary_of_samples_without_audio(bench):
    got = A.bench_summary(bench).first()
    assert math.isnan(got["avg_rtf"])
    assert (got["n_samples"], got["audio_ms"], got["avg_wer"], got["overall_rtf"], got["avg_latency_ms"]) == (3, 1200, 0.5, 0.458333, 8.0)


def test_breakdown_of_samples_without_audio(bench):
    got = {(r["level"], r["name"]): (r["n_samples"], r["avg_rtf"]) for r in A.bench_breakdown(bench).collect()}
    assert {k for k, (_, rtf) in got.items() if math.isnan(rtf)} == {("all", "all"), ("language", "fr"), ("category", "c1")}
    assert got[("language", "en")] == (1, 0.5) and got[("category", "c0")] == (1, 0.25) and got[("language", "fr")][0] == 2


def test_lines_of_samples_without_audio(bench):
    got = {(r["part"], r["name"]): r["line"] for r in RP.lines(bench).collect()}
    assert got[(1, "2")] == "| 2 | fr | c1 | 100.0 % | -nan |" and got[(1, "3")] == "| 3 | fr | c0 | 0.0 % | 0.25 |"
    assert got[(0, "all")] == "| all | 3 | 50.0 % | -nan |" and got[(2, "en")] == "| en | 1 | 50.0 % | 0.5 |"


def test_sections_without_audio(bench):
    got = {(r["section"], r["name"]): r for r in RP.sections(bench.where("doc_id <> 3")).collect()}
    assert math.isnan(got[("language", "fr")]["overall_rtf"]) and math.isnan(got[("language", "fr")]["avg_rtf"])
    assert got[("language", "fr")]["total_audio_s"] == 0 and got[("summary", "all")]["overall_rtf"] == 0.5
    assert math.isnan(got[("summary", "all")]["avg_rtf"]) and got[("language", "en")]["avg_rtf"] == 0.5

"""Runs of many texts at once against text by text."""

import random

import numpy as np

from seglake.functions import repeats as RP
from seglake.operators import windows as W
from seglake.plans import catalog

FOUND = (4, 1, 3, 3, 0.5)


def texts(seed=4):
    r = random.Random(seed)
    said = [" ".join(r.choice("abcd"[:k]) for _ in range(n)) for k in (1, 2, 4) for n in (1, 2, 5, 30, 90) for _ in range(6)]
    return [(i, t) for i, t in enumerate([None, "", *said, "a a a", "a a a"])]


def test_texts_side_by_side(spark, monkeypatch):
    monkeypatch.setattr(W, "SPAN_WORDS", 100)
    rows = texts()
    got = sorted(tuple(x) for x in W.repeat_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), "doc_id").collect())
    assert got == sorted((i, *x) for i, t in rows for x in RP.runs((t or "").split(), *FOUND))
    assert len(got) > 50


def test_no_run_over_the_end_of_a_text():
    assert RP.runs_of_texts(np.array([0, 0, 0, 0]), np.array([2, 0, 2]), *FOUND).tolist() == []
    assert RP.runs_of_texts(np.array([0, 0, 0, 0]), np.array([1, 3]), *FOUND).tolist() == [[1, 1, 4, 3]]


def test_sort_reads_runs_once(spark):
    """The sort looks at its input twice; the search is done before, into a table."""
    plan = catalog.QUERIES["top06_runs_in_order"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" in plan and "Arrow" not in plan and "Python" not in plan

"""Alignment of many and of long pairs: whole numbers as rows of the cost table, one pass for all scores."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seglake.operators import scoring as SC


def plain_path(r, h):
    """The whole cost table, and the way back through it."""
    n, m = len(r), len(h)
    d = [[max(i, j) if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = min(d[i - 1][j - 1] + (r[i - 1] != h[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    out, i, j = [], n, m
    while i or j:
        if i and j and r[i - 1] == h[j - 1]:
            step = SC.MATCH
        elif i and j and d[i][j] == d[i - 1][j - 1] + 1:
            step = SC.SUB
        elif i and d[i][j] == d[i - 1][j] + 1:
            step = SC.DEL
        else:
            step = SC.INS
        out.append(step)
        i, j = i - (step != SC.INS), j - (step != SC.DEL)
    return out[::-1]


@pytest.mark.parametrize("cells, strip, bits", [(1 << 28, 256, 1 << 28), (0, 3, 1), (0, 1, 1 << 28)])
def test_path_is_that_of_the_whole_table(monkeypatch, cells, strip, bits):
    monkeypatch.setattr(SC, "CELLS", cells)
    monkeypatch.setattr(SC, "STRIP", strip)
    monkeypatch.setattr(SC, "MASK_BITS", bits)
    rnd = random.Random(5)
    for _ in range(300):
        kinds = rnd.choice([1, 2, 5, 30])
        r = [rnd.randrange(kinds) for _ in range(rnd.randint(0, 25))]
        h = [w for w in r if rnd.random() > 0.2] if rnd.random() < 0.5 else [rnd.randrange(kinds) for _ in range(rnd.randint(0, 25))]
        assert SC.edit_path(np.array(r, dtype=np.int64), np.array(h, dtype=np.int64)).tolist() == plain_path(r, h)


def test_pairs_without_words_and_long_pairs_in_one_table(spark):
    r = [f"w{i}" for i in range(400)]
    h = [w for i, w in enumerate(r) if i % 97 != 5]
    pairs = spark.createDataFrame([(1, r, h), (2, None, ["a"]), (3, None, None), (4, ["a"], ["b"])], "id long, r array<string>, h array<string>")
    for cells in (1, 1 << 28):
        counts = {x[0]: tuple(x)[1:] for x in SC.edit_counts(pairs, "id", "r", "h", cells).collect()}
        assert counts == {1: (0, 0, 400 - len(h), 400, len(h)), 2: (0, 1, 0, 0, 1), 3: (0, 0, 0, 0, 0), 4: (1, 0, 0, 1, 1)}
        ops = SC.align(pairs, "id", "r", "h", cells)
        rows = [tuple(x) for x in ops.filter("id = 1").orderBy("op_no").select("op_no", "op", "ref_idx", "hyp_word").collect()]
        assert [x[0] for x in rows] == list(range(400)) and [x[3] for x in rows if x[3]] == h


def test_scores_of_an_alignment_read_it_once(spark):
    pairs = spark.createDataFrame([(1, ["a", "b"], ["a", "x", "y", "z", "b", "q"]), (2, ["a"], ["a"])], "id long, r array<string>, h array<string>")
    kind = lambda w: F.when(w.isNotNull(), "EN")
    scores = SC.language_mismatch(SC.align(pairs, "id", "r", "h"), ["id"], kind)
    got = {x["id"]: (x["max_ins_run"], x["ins_runs_ge3"]) for x in scores.collect()}
    assert got == {1: (3, 1), 2: (0, 0)}
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") <= 5  # whole pairs, pieces, and for the places of pieces their cuts (twice) and counts


def test_frames_hold_many_pairs():
    ones = ({"k": i, "op_no": np.arange(2), "op": SC.NAMES[[0, 1]]} for i in range(5))
    assert [(f["k"].tolist(), len(f)) for f in SC._framed(ones)] == [([0, 0, 1, 1, 2, 2, 3, 3, 4, 4], 10)]


def test_pairs_side_by_side_equal_each_alone(monkeypatch):
    rnd = random.Random(9)
    for width, size in ((2048, 48 << 20), (8, 1 << 14)):
        monkeypatch.setattr(SC, "GROUP_WIDTH", width)
        monkeypatch.setattr(SC, "GROUP_BYTES", size)
        for kinds, top in ((1, 5), (2, 70), (5, 140), (30, 200)):
            pairs = [[np.array([rnd.randrange(kinds) for _ in range(rnd.randint(0, top))], dtype=np.int64) for _ in range(2)] for _ in range(40)]
            assert [p.tolist() for p in SC.edit_paths(pairs)] == [plain_path(r.tolist(), h.tolist()) for r, h in pairs]


def test_a_batch_is_aligned_in_slices_of_words(spark, monkeypatch):
    monkeypatch.setattr(SC, "SLICE_WORDS", 7)
    rows = [(i, ["a", "b", None, "c"][:i % 5], ["a", "x", None][:i % 4]) for i in range(20)]
    pairs = spark.createDataFrame(rows, "id long, r array<string>, h array<string>").repartition(1)
    got = {x["id"]: tuple(x)[1:] for x in SC.edit_counts(pairs, "id", "r", "h").collect()}
    for i, r, h in rows:
        n = np.bincount(plain_path(r, h), minlength=4)
        assert got[i] == (n[SC.SUB], n[SC.INS], n[SC.DEL], len(r), len(h))


def test_small_pairs_are_dealt_to_every_slot(spark):
    whole, _ = SC._parts(spark.createDataFrame([(1, ["a"], ["b"])], "id long, r array<string>, h array<string>"), ["id"], "r", "h", SC.CELLS)
    assert whole.rdd.getNumPartitions() >= SC.PARTS_PER_SLOT * spark.sparkContext.defaultParallelism

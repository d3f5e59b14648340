"""Block folds against the plain fold, with guesses that are often wrong."""

import random

import pytest

from seglake.functions.speculative import fold_blocks
from seglake.operators.overlap import KeptRow, cut_repeat, trim_kept_overlap
from seglake.streaming import folds as FO


def never_forgets():
    """A fold for which every guess but the first is wrong; local, so that it travels by value."""

    class Total(FO.Fold):
        columns = "n long, total long"

        def start(self, key):
            return {**super().start(key), "total": 0}

        def step(self, s, row):
            s["total"] += row["v"]
            if s["total"] % 3:
                yield (*s["key"], row["n"], s["total"])

        def finish(self, s):
            yield (*s["key"], -1, s["total"])

    return Total()


def plain(fold, sessions):
    out = []
    for key, rows in sessions.items():
        state = fold.start((key,))
        for row in rows:
            out += list(fold.step(state, row))
        out += list(fold.finish(state))
    return sorted(out, key=str)


def batches(seed, sizes, alphabet):
    r = random.Random(seed)
    return {k: [{"batch": i, "text": " ".join(r.choice(alphabet) for _ in range(r.randrange(0, 7)))} for i in range(n)] for k, n in sizes.items()}


@pytest.mark.parametrize("width,warm", [(4, 0), (7, 3), (1000, 10)])
def test_a_sum_is_right_after_many_rounds(spark, width, warm):
    sessions = {k: [{"n": 3 * i + (i > 9) * 40, "v": (i * k) % 5 + 1} for i in range(n)] for k, n in {1: 40, 2: 1, 3: 17}.items()}
    df = spark.createDataFrame([(k, x["n"], x["v"]) for k, rows in sessions.items() for x in rows], "session long, n long, v long")
    got = sorted((tuple(x) for x in fold_blocks(df, ["session"], ["n"], "n", never_forgets(), warm, width * 3).collect()), key=str)
    assert got == plain(never_forgets(), sessions)


def test_repeat_gate_in_blocks(spark):
    sessions = batches(3, {1: 120, 2: 9, 5: 0}, ["a", "b", "c d e", "fff", ""])
    df = spark.createDataFrame([(k, x["batch"], x["text"]) for k, rows in sessions.items() for x in rows], "session long, batch long, text string")
    got = sorted((tuple(x) for x in fold_blocks(df, ["session"], ["batch"], "batch", FO.RepeatGate(), 4, 16).collect()), key=str)
    assert got == plain(FO.RepeatGate(), sessions) and len({x[2] for x in got}) > 1


def test_commits_in_blocks(spark):
    r = random.Random(6)
    said = [(f"w{r.randrange(5)}", 150 * i) for i in range(200)]
    rows = []
    for seq in range(90):
        lo = max(0, 2 * seq - r.randrange(6))
        rows.append({"seq": seq, "words": [{"text": w if r.random() < 0.95 else "x", "start": at, "end": at + 100} for w, at in said[lo:lo + 8]]})
    df = spark.createDataFrame([(7, x["seq"], [tuple(w.values()) for w in x["words"]]) for x in rows], "session long, seq long, words array<struct<text:string,start:long,end:long>>")
    got = sorted((tuple(x) for x in fold_blocks(df, ["session"], ["seq"], "seq", FO.CommitAgreed(), 2, 10).collect()), key=str)
    assert got == plain(FO.CommitAgreed(), {7: rows}) and len(got) > 60


def test_kept_rows_in_blocks(spark):
    r = random.Random(2)
    lines, said = [], ""
    for i in range(80):
        again = said if r.random() < 0.3 else " ".join(said.split()[-r.randrange(1, 4):])
        text = again if r.random() < 0.4 else f"{again} " + " ".join(f"word{r.randrange(9)}" for _ in range(3))
        lines.append((1, i, text.strip()))
        said = text
    want, last = [], None
    for _, i, text in lines:
        rest = text if last is None else cut_repeat(text, last)
        if rest:
            want.append((1, i, rest))
            last = rest
    df = spark.createDataFrame(lines, "session_id long, seq long, text string")
    assert sorted(tuple(x) for x in trim_kept_overlap(df, width=16).collect()) == want and len(want) < 80


def test_no_rows(spark):
    df = spark.createDataFrame([], "session_id long, seq long, text string")
    assert fold_blocks(df, ["session_id"], ["seq"], "seq", KeptRow()).count() == 0

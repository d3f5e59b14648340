"""What a task holds at once does not grow with the rows of a batch."""

import numpy as np
import pandas as pd

from seglake.operators import scoring as SC
from seglake.operators import vectors as VEC


def test_tables_of_rows_and_pivots_are_bounded(spark, monkeypatch):
    batches = [pd.DataFrame({"query_id": range(1000), "v": list(np.ones((1000, 2)))})]
    parts = list(VEC._slices(batches, np.ones((4096, 2))))
    assert max(len(p) for p in parts) * 4096 <= VEC.TABLE_NUMBERS and sum(len(p) for p in parts) == 1000
    rnd = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rnd.normal(size=8)]) for i in range(300)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(VEC, "TABLE_NUMBERS", 100)
    monkeypatch.setattr(VEC, "ROUTED_ROWS", 7)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in VEC.similar_examples(e, e, 3).collect()}
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(v @ v.T, 6)
    np.fill_diagonal(s, -np.inf)
    best = np.lexsort((np.broadcast_to(np.arange(300), s.shape), -s), axis=1)[:, :3]
    assert got == {(i, k + 1): int(best[i, k]) for i in range(300) for k in range(3)}


def test_timed_pairs_in_slices(spark, monkeypatch):
    monkeypatch.setattr(SC, "SLICE_ROWS", 2)
    kind = "array<struct<word: string, start: double>>"
    pairs = [(i, [("a", 1.0 + i), ("b", 2.0)], [("a", 1.0), ("b", 2.0), ("c", 3.0)]) for i in range(5)]
    df = spark.createDataFrame([*pairs, (9, [], [])], f"id long, pred {kind}, ref {kind}")
    got = {r["id"]: (r["n_ref"], r["n_pred"], r["n_matched"], r["mae_start"], r["max_delta_start"]) for r in SC.timestamp_accuracy(df, ["id"]).collect()}
    assert got == {**{i: (3, 2, 2, i / 2, float(i)) for i in range(5)}, 9: (0, 0, 0, None, None)}

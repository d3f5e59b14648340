"""What the search for similar vectors shuffles follows the number of its blocks, not that of its pieces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seglake.operators import vectors as VEC


@pytest.mark.parametrize("numbers", [1 << 23, 400])
def test_queries_travel_once_to_a_block(spark, monkeypatch, numbers):
    monkeypatch.setattr(VEC, "PIECE_ROWS", 8)
    monkeypatch.setattr(VEC, "BLOCK_NUMBERS", numbers, raising=False)
    monkeypatch.setattr(VEC, "FINDS", 50, raising=False)
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(600, 16))
    x[40:60] = x[7]  # ties
    e = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    q = e.select(F.col("vec_id").alias("query_id"), VEC.unit("embedding").alias("v"))
    own = VEC.Cells(e.select("vec_id", VEC.unit("embedding").alias("v")))
    sent = own.others(q.withColumn("reach", F.lit(2.0)), 4).count()
    blocks = 600 * 16 // 400 if numbers == 400 else 8
    assert own.pieces.sum() > 60 and sent <= 600 * (blocks + 1)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in VEC.similar_examples(e, e, 4).collect()}
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -np.inf)
    best = np.lexsort((np.broadcast_to(np.arange(600), s.shape), -s), axis=1)[:, :4]
    assert got == {(i, k + 1): (int(best[i, k]), pytest.approx(s[i, best[i, k]], abs=1e-9)) for i in range(600) for k in range(4)}

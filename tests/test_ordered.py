"""Block helpers agree with plain windows for every block width."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seglake.functions import ordered as O
from seglake.functions.ranges import asof, points_outside, range_join
from seglake.functions.ranks import medians, pick


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(3)
    # one session holds most rows
    out = [(1 if r.random() < 0.8 else r.randrange(2, 5), r.randrange(0, 400), i, r.choice([None, 1, 2, 3, 5])) for i in range(300)]
    return spark.createDataFrame(out, "k long, t long, id long, v long").cache()


@pytest.mark.parametrize("width", [3, 50, 10_000])
def test_scan(data, width):
    w = Window.partitionBy("k").orderBy("t", "id")
    got = O.scan(data, ["k"], ["t", "id"], O.time_block("t", width), a=O.prev("v"), b=O.following("v"), c=O.running_sum("v"), d=O.running_max("v"),
                 e=O.last_known("v"), f=O.before_known("v"), g=O.next_known("v"), h=O.row_no(), i=O.whole_sum("v"), j=O.first_of("v"))
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    want = data.select("*", F.lag("v").over(w), F.lead("v").over(w), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)),
                       F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
                       F.last("v", True).over(before), F.first("v", True).over(after), F.row_number().over(w).cast("long"),
                       F.sum("v").over(Window.partitionBy("k")), F.first("v", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_halo(data):
    w0 = Window.partitionBy("k").orderBy("n")
    d = data.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")))
    h = O.with_halo(d, "n", 2, 1, 4)
    w = Window.partitionBy("k", "_blk").orderBy("n")
    got = O.own_rows(h.withColumn("x", F.lag("id", 2).over(w)).withColumn("y", F.lead("id").over(w))).select("id", "x", "y")
    want = d.select("id", F.lag("id", 2).over(w0), F.lead("id").over(w0))
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_joins(spark, data):
    iv = spark.createDataFrame([(1, 10, 60, 0), (1, 50, 200, 1), (2, 0, 400, 2), (3, 100, 100, 3)], "k long, a long, b long, no long")
    got = {(r.id, r.no) for r in range_join(data, iv, ["k"], (F.col("t"), F.col("t")), (F.col("a"), F.col("b")), width=25).collect()}
    src, ivs = data.collect(), iv.collect()
    assert got == {(d.id, i.no) for d in src for i in ivs if d.k == i.k and i.a <= d.t <= i.b}
    out = {r.id for r in points_outside(data, iv, ["k"], "t", "a", "b", width=25).collect()}
    assert out == {d.id for d in src} - {x for x, _ in got}
    near = {r.id: r.no for r in asof(data, iv, ["k"], ["t"], ["a"], ["no"], F.floor(F.col("_at0") / 30)).collect()}
    for d in src:
        c = [i for i in ivs if i.k == d.k and i.a <= d.t]
        assert near[d.id] == (max(c, key=lambda i: i.a).no if c else None)


def test_ranks(data):
    n = F.col("n")
    got = {r.k: r for r in pick(data, ["k"], "t", mid=F.floor(n / 2), top=n - 1).collect()}
    med = {r.k: r.median for r in medians(data, ["k"], "t").collect()}
    for k in {r.k for r in data.collect()}:
        v = sorted(r.t for r in data.collect() if r.k == k)
        assert (got[k].mid, got[k].top, got[k].n) == (v[len(v) // 2], v[-1], len(v))
        assert med[k] == (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2


def test_one_shuffle_is_shared(data):
    s = O.scan(data, ["k"], ["t", "id"], O.time_block("t"), a=O.prev("v"))
    s.collect()
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_looking_ahead_is_linear(data):
    """Spark computes a frame from a later row to the end anew for every row, so no window of a scan may have one."""
    got = O.scan(data, ["k"], ["t", "id"], O.time_block("t", 50), g=O.next_known("v"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "1, unboundedfollowing" not in plan.lower()

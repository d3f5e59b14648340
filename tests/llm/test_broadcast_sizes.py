"""Tables that an explode makes larger than Spark's estimate are not sent to the driver."""

import pytest

pytest.importorskip("seglake.llm")

from seglake.llm import simhash  # noqa: E402


def test_variants_of_fingerprints_are_never_broadcast(spark):
    fps = simhash.written(spark.createDataFrame([(0,), (0b1111,), (0b11111 << 20,), (-1,)], "fp long"), "fps")
    found = simhash.links(fps)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {tuple(r) for r in found.collect()} == {(0, 0b1111)}


def test_pipeline_stage_links_without_broadcast(spark, monkeypatch):
    plans = []
    whole = simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), whole(df, name))[1])
    docs = whole(spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (3, "f g h")], "doc_id long, text string"), "docs")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 3]
    (joined,) = [plan for name, plan in plans if name == "links"]
    assert "SortMergeJoin" in joined and "BroadcastHashJoin" not in joined

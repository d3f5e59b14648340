"""Lines at points: the text of a line does not travel once per point."""

import random

from seglake.operators import joins as J


def test_long_line_with_many_points(spark):
    rnd = random.Random(3)
    long = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(100_000))
    lines = spark.createDataFrame([("s", 0, 0, 1000, 1, long), ("s", 1, 900, 2000, -2, None)], "k string, line long, start_ms long, end_ms long, speaker int, text string")
    points = spark.createDataFrame([("s", i, 4 * i) for i in range(600)], "k string, no long, t long")
    found = J.at(points, lines, ["k"], "line")
    got = {r["no"]: r for r in found.collect()}
    assert len(got) == 600 and got[0]["text"] == long
    assert (got[250]["line"], got[251]["line"], got[251]["in_silence"], got[501]["line"], got[501]["in_silence"]) == (0, 1, True, None, False)
    # what is kept per point is a number; the whole line was kept there before
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan and "struct" not in plan

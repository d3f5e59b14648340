"""Scores are counted where pairs are aligned: no row per operation is shuffled, and texts are read once."""

import random

from pyspark.sql import functions as F

from seglake.operators import scoring as SC
from seglake.plans import catalog
from seglake.plans import scoring as PS

KIND = lambda w: F.when(w.startswith("k"), "KO").when(w.startswith("e"), "EN").otherwise("NEU")


def odd_pairs(spark, text):
    rnd = random.Random(3)
    word = lambda: rnd.choice(["k1", "k2", "e1", "e2", "n", "é"])
    rows = [(None, ["k1"], ["e1"]), (1, [], []), (2, None, ["k1", "e1", "e1", "n"]), (3, ["e1"], None), (4, None, None)]
    rows += [(i, r, [x if rnd.random() < 0.6 else word() for x in r for _ in range(rnd.choice([0, 1, 1, 1, 4]))]) for i in range(5, 60) for r in [[word() for _ in range(rnd.randint(0, 30))]]]
    r = [f"k{i}" for i in range(100)]
    rows.append((99, r, [x for i, x in enumerate(r) if i % 20]))
    if text:
        rows = [(k, *(None if x is None else " ".join(x) for x in ws)) for k, *ws in rows]
    return spark.createDataFrame(rows, "id long, r string, h string" if text else "id long, r array<string>, h array<string>")


def test_mismatch_equals_that_of_the_table_of_operations(spark):
    want = sorted(SC.language_mismatch(SC.align(odd_pairs(spark, False), "id", "r", "h"), ["id"], KIND).collect(), key=str)
    for text in (False, True):
        for cells in (20, SC.CELLS):
            got = SC.pair_mismatch(odd_pairs(spark, text), "id", "r", "h", KIND, cells)
            assert sorted(got.select(list(want[0].asDict())).collect(), key=str) == want


def test_boundaries_and_flips_equal_those_of_the_operations(spark):
    pairs = odd_pairs(spark, False).where("id IS NOT NULL AND r IS NOT NULL AND h IS NOT NULL").withColumn("b", F.filter(F.sequence(F.lit(1), F.lit(40), F.lit(3)), lambda x: x < F.size("h")))
    pairs = pairs.withColumn("sizes", F.when(F.size("r") > 3, F.array(F.lit(3), F.size("r") - 3)).otherwise(F.array(F.size("r")))).localCheckpoint()
    ops = {}
    for x in SC.align(pairs, "id", "r", "h").orderBy("id", "op_no").collect():
        ops.setdefault(x["id"], []).append(x)
    for cells in (20, SC.CELLS):
        got = {x["id"]: x["projected"] for x in SC.project(pairs, "id", "r", "h", "b", [], cells).collect()}
        flips = {(x["id"], x["sentence"]): (x["ref_script"], x["hyp_script"], x["ref_words"]) for x in SC.flip_events(pairs, "id", "r", "h", "sizes", KIND, cells).collect()}
        for p in pairs.collect():
            own = ops.get(p["id"], [])
            assert got[p["id"]] == [max(x["ref_pos"] for x in own if x["hyp_pos"] == b) for b in p["b"]]
            at = 0
            for k, n in enumerate(p["sizes"]):
                mine = [x for x in own if at < x["ref_pos"] <= at + n]
                kinds = [[sum((x[c] or "").startswith(s) for x in mine) for s in "ke"] for c in ("ref_word", "hyp_word")]
                sides = ["KO" if a > b else "EN" if b > a else None for a, b in kinds]
                want = (*sides, sum(x["ref_word"] is not None for x in mine)) if None not in sides and sides[0] != sides[1] else None
                assert flips.get((p["id"], k)) == want
                at += n


def test_sentences_are_those_of_each_block_alone(spark):
    texts = ["One. Two!  three\n\nFour? five.\t Six. ... \nseven", "", "\n", "a.\x01 b. \x02c\n d. e. f. ", "ΣΑΣ. ΟΔΟΣ\nΑΣ", ". ! x"]
    class Given:
        doc = spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id long, text string")
    got = {x["doc_id"]: x for x in PS.sentence_pairs(Given).collect()}
    assert sorted(got) == list(range(len(texts)))
    b = Given.doc.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block", "p"))
    s = b.select("doc_id", "block", F.posexplode(F.split("p", r"(?<=[.!?])\s+")).alias("sent", "s")).withColumn("w", PS.X.scoring_words("s"))
    want = {}
    for x in s.orderBy("doc_id", "block", "sent").collect():
        want.setdefault(x["doc_id"], []).append(x)
    for k, own in want.items():
        last = {x["block"]: x["sent"] for x in own}
        assert got[k]["r"].split() == [w for x in own for w in x["w"]]
        assert [tuple(x) for x in got[k]["s"]] == [(len(x["w"]), x["sent"] == last[x["block"]], x["sent"] % 2 == 1 or x["sent"] == last[x["block"]]) for x in own]
        assert got[k]["upto"][-1] == sum(len(x["w"]) for x in own)


def test_no_operation_is_shuffled(spark):
    for name in ("agg08_language_mismatch", "agg09_flip_events", "agg10_segmentation_f1", "agg11_speaker_sentence_f1", "agg08_turn_mismatch"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "op_no" not in plan and "ref_word#" not in plan
    assert "ref_word#" not in catalog.QUERIES["aln01_align_words"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()

"""Rules on small hand-made inputs and against direct restatements."""

import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from seglake.functions import entries as EN
from seglake.functions import repeats as RP
from seglake.functions import text as X
from seglake.operators import filters as FI
from seglake.operators import joins as J
from seglake.operators import normalize as N
from seglake.operators import scoring as SC
from seglake.operators import segments as G
from seglake.operators import windows as W
from seglake.operators.feed import decode_deltas, encode_deltas
from seglake.operators.overlap import cut_repeat
from seglake.operators.vectors import similar_examples
from seglake.plans import scoring as PS
from seglake.sources import logs as SL
from seglake.sources import texts as ST
from seglake.streaming import folds as FO
from seglake.streaming import reconcile as RC


def test_sentence_rules(spark):
    cases = [("That is 3.", "The", False), ("Hello Dr.", "The", False), ("at home.", "The", True), ("at home.", "the", False), ("감사합니다.", None, True),
             ("그런데.", None, False), ("U.S.", "The", False), ("at home.", None, False)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert [r.got for r in df.select(X.genuine_end("a", "b").alias("got")).collect()] == [c[2] for c in cases]
    cases = [("well and", "The", True), ("well and", "then", False), ("well and", None, None), ("", None, True), ("했습니다", None, True), ("하는데", None, False)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert [r.got for r in df.select(X.split_after_silence("a", "b").alias("got")).collect()] == [c[2] for c in cases]


def test_cleaning(spark):
    df = spark.createDataFrame([(1, "(laughs) hi . . there.."), (2, ". ."), (3, "日本"), (4, None), (5, "[Music play 가나 (speaking in x 다")], "id long, text string")
    entries = spark.createDataFrame([("hi", "HI"), ("6", "제6"), ("there", "h")], "wrong string, correct string")
    got = {r.id: r.text for r in FI.clean_segments(df, [], entries).collect()}
    assert got == {1: "HI. h.", 4: None, 5: "가나 다"}


def test_dictionary_against_brute_force(spark):
    r = random.Random(5)
    docs = [(i, "".join(r.choice("abcd ") for _ in range(r.randrange(0, 60)))) for i in range(60)] + [(1, None), (2, "ab"), (2, "ab")]
    entries = [("ab", "x"), ("abc", "ba"), ("b", "bb"), ("cd ", ""), ("dd", "abc"), ("b", "aa"), ("c", None), (None, "z"), ("", "y")]
    entries += [(f"long{i:05d}", "n") for i in range(25_000)]
    d, e = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(entries, "wrong string, correct string")
    table = {"ab": "x", "abc": "ba", "b": "bb", "cd ": "", "dd": "abc"}

    def parts(t):
        out, i = "", 0
        while i < len(t):
            n = next((n for n in (3, 2, 1) if t[i:i + n] in table and len(t[i:i + n]) == n), 0)
            out, i = out + (table[t[i:i + n]] if n else t[i]), i + max(n, 1)
        return out

    got = sorted(((x.id, x.text) for x in FI.apply_dictionary(d, e).collect()), key=str)
    assert got == sorted(((i, None if t is None else parts(t)) for i, t in docs), key=str)
    got = sorted(((x.id, x.text) for x in FI.apply_dictionary(d, e, whole_words=True).collect()), key=str)
    assert got == sorted(((i, None if t is None else " ".join(table.get(w, w) for w in t.split(" "))) for i, t in docs), key=str)


def test_dictionary_in_blocks(spark):
    """Keys of different blocks at one place: the longest wins, and what is replaced is not looked at again."""
    r = random.Random(9)
    keys = {"".join(r.choice("abc") for _ in range(r.randrange(1, 6))) for _ in range(60)}
    table = {k: r.choice(["", "x", k + "a", "abc"]) for k in keys}
    docs = [(i, "".join(r.choice("abcd ") for _ in range(r.randrange(0, 80)))) for i in range(50)] + [(99, None)]
    d, e = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(sorted(table.items()), "wrong string, correct string")
    for whole in (False, True):
        one = sorted(map(tuple, EN.replaced(d, e, "text", whole).collect()), key=str)
        assert sorted(map(tuple, EN.replaced(d, e, "text", whole, limit=400).collect()), key=str) == one and len(EN.blocks(e, "wrong", "correct", limit=400)) > 2
    sides = e.select(F.col("wrong").alias("side"))
    held = {(i, k) for i, t in docs if t for k in table if k in t}
    assert {tuple(x) for x in EN.holding(d, sides, "id", "text", limit=300).collect()} == held


def test_glossary_against_brute_force(spark):
    docs = [(1, "The Cat sat."), (2, None), (3, ""), (4, "concatenate"), (1, "dog")]
    words = [("cat", "chat"), ("dog", "chien"), ("x", "SAT"), ("", "the"), ("none", "nul")]
    got = J.relevant_glossary(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(words, "origin string, translation string"), "id")
    want = {(i, o, w) for i, t in docs if t for o, w in words if any(s and s.lower() in t.lower() for s in (o, w))}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def run_fold(fold, rows):
    state, out = fold.start((1,)), []
    for row in rows:
        out += list(fold.step(state, row))
    return [r[1:] for r in out + list(fold.finish(state))]


def test_repeat_filter_rules(spark):
    fold = lambda *batches: run_fold(FO.RepeatFilter(), [{"batch": i, "words": list(b)} for i, b in enumerate(batches)])
    assert fold(["a", "a", "b"], ["b", "c"]) == [(0, "a"), (0, "b"), (1, "c")]
    assert fold(["end."], [".", "!", "next"]) == [(0, "end."), (1, "next")] and fold(["end"], [".", "next"]) == [(0, "end"), (1, "."), (1, "next")]
    assert fold(["-", "a", "–", "a", "---- b"]) == [(0, "a"), (0, "---- b")]
    stretched = ["aaaa"] * 5
    assert fold(["a", *stretched, "a"]) == [(0, "a"), (0, "a")]  # five in a row: the next word counts as new
    assert fold(["a", *stretched[:4], "a"]) == [(0, "a")]
    assert fold(["a", *stretched], ["a"]) == [(0, "a")]  # but what the batch has emitted is remembered at its end
    assert fold(["a"], stretched, ["a"]) == [(0, "a"), (2, "a")]
    assert fold(["e\u0301"], ["é"]) == [(0, "é")]
    rows = [("s", 0, ["a", "b"]), ("s", 1, ["x", "x", "x", "x"]), ("s", 2, ["b"]), ("t", 0, ["b"])]
    df = spark.createDataFrame(rows, "session string, batch long, words array<string>")
    assert sorted(map(tuple, FO.repeat_filter(df, ["session"], "[a-z]").collect())) == [("s", 0, "a"), ("s", 0, "b"), ("s", 2, "b"), ("t", 0, "b")]


def test_filler_streak_rules(spark):
    rows = [(1, "so, so. so!", "ko"), (2, "so so", "ko"), (3, "so", "ko"), (4, "so", "ko"), (5, "...", "ko"), (6, "가", "ko"), (7, "so", "ko"), (8, "so so so so so", "en"), (9, None, "ko")]
    df = spark.createDataFrame([("s", *r) for r in rows], "session string, batch long, text string, lang string")
    got = {r.batch: r.dropped for r in FO.filler_streak(df, ["session"]).collect()}
    assert got == {n: n == 3 for n in range(1, 10)}


def test_repetition_windows():
    assert RP.clustered("thank you very thank you so thank you much thank you".split())
    assert not RP.clustered("a b c d e f g".split()) and not RP.clustered([]) and not RP.clustered(["a"])
    far = [w for i in range(5) for w in ["name", *[f"w{i}{j}" for j in range(8)]]]
    assert not RP.clustered(far)
    words = []
    for n in (7, 8, 9, 10):
        words += [f"w{i}" for i in range(n)]
    assert RP.regrows(words) and not RP.regrows([f"w{i}" for i in range(30)]) and not RP.regrows([f"w{i}" for i in range(8)] * 4)
    r = random.Random(8)
    for _ in range(300):
        words = [r.choice("abc") for _ in range(r.randrange(0, 40))]
        codes = RP.numbered(words)
        for lag in (1, 3, 7):
            if lag < len(words):
                want = [next((k for k in range(len(words)) if i + lag + k >= len(words) or words[i + k] != words[i + lag + k])) for i in range(len(words) - lag)]
                assert RP.common_ahead(codes, lag).tolist() == want


def test_commit_by_agreement_and_by_probability():
    word = lambda text, at, p=0.5: {"text": text, "start": at, "end": at + 100, "p": p}
    rows = [{"seq": 0, "words": [word("a", 0), word("b", 200)]}, {"seq": 1, "words": [word("a", 0), word("b", 200), word("c", 400)]}, {"seq": 2, "words": [word("c", 400), word("d", 600)]}]
    assert run_fold(FO.CommitAgreed(), rows) == [(1, "a", 0), (1, "b", 200), (2, "c", 400), (-1, "d", 600)]
    sure = [{"seq": 0, "offset_ms": 1000, "words": [word("a", 0, 0.99), word("b", 200)]}]
    assert run_fold(FO.CommitAgreed(0.95), sure) == [(0, "a", 1000), (-1, "b", 1200)]


def test_subtitles_fill_lines(spark):
    words = [(1, 0, i, w, 100 * i, 100 * i + 90) for i, w in enumerate([" aaa", " bbb", " ccc", " ddd", " eee"])] + [(1, 1, 5, " fff", 9000, 9100)]
    df = spark.createDataFrame(words, "session long, seg long, seq long, word string, start_ms long, end_ms long")
    got = [(r.start_ms, r.end_ms, r.text) for r in W.pack_subtitles(df, ["session"], "seg", "seq", width=8, lines=2).orderBy("start_ms").collect()]
    assert got == [(0, 390, "aaa bbb\nccc ddd"), (400, 490, "eee"), (9000, 9100, "fff")]
    got = [r.text for r in W.pack_subtitles(df, ["session"], "seg", "seq", per_line=2).orderBy("start_ms").collect()]
    assert got == ["aaa bbb", "ccc ddd", "eee", "fff"]


def test_reconcile_cut():
    stone = lambda at, text: {"pos": at, "start": at, "end": at + 100, "text": text}
    stones = [stone(0, " one"), stone(400, " two"), stone(800, " thr"), stone(900, "ee"), stone(2000, " four")]
    assert RC.cut_place(stones, None, []) == 5 and RC.cut_place(stones, 2400, []) == 4
    assert RC.cut_place(stones, 1400, []) == 2  # not inside a word
    assert RC.cut_place(stones, 2400, [(1000, "ee"), (500, "two")]) == 1 and RC.cut_place(stones, 9000, []) == 5


def test_normalised_english(spark):
    df = spark.createDataFrame([("Café COSTS $five … %x 5% $3 1,000 Mr. X didn't <b> (uh) straße",)], "text string")
    assert N.normalize_corpus(df, mode="english").first().text == "cafe costs five x 5% $3 1000 mister x did not strasse"


def test_edit_path_is_cheapest_and_ordered():
    r = random.Random(1)
    for _ in range(150):
        a = np.array([r.randrange(4) for _ in range(r.randrange(0, 9))], dtype=np.int64)
        b = np.array([r.randrange(4) for _ in range(r.randrange(0, 9))], dtype=np.int64)
        d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = d[i - 1][j - 1] if a[i - 1] == b[j - 1] else 1 + min(d[i - 1][j - 1], d[i - 1][j], d[i][j - 1])
        i, j, want = len(a), len(b), []
        while i or j:
            if i and j and a[i - 1] == b[j - 1]:
                want.append(SC.MATCH); i -= 1; j -= 1
            elif i and j and d[i][j] == d[i - 1][j - 1] + 1:
                want.append(SC.SUB); i -= 1; j -= 1
            elif i and d[i][j] == d[i - 1][j] + 1:
                want.append(SC.DEL); i -= 1
            else:
                want.append(SC.INS); j -= 1
        old, SC.STRIP = SC.STRIP, 3
        try:
            assert SC.edit_path(a, b).tolist() == want[::-1]
        finally:
            SC.STRIP = old


def test_scores(spark):
    pairs = spark.createDataFrame([(1, ["a", "b", "c"], ["a", "x", "c", "d"]), (2, [], ["a", "b"]), (3, ["가", "b"], ["b", "b"])], "id long, r array<string>, h array<string>")
    ops = SC.align(pairs, "id", "r", "h")
    w = {r.id: r for r in SC.wer(pairs, "id", "r", "h").collect()}
    assert (w[1].substitutions, w[1].insertions, w[1].deletions, round(w[1].wer, 4)) == (1, 1, 0, 0.6667)
    assert w[2].wer == 2.0 and w[2].insertions == 2
    m = {r.id: r for r in SC.language_mismatch(ops, ["id"]).collect()}
    assert m[3].ko_to_en == 1 and m[3].lmr_ko == 1.0 and m[1].lmr_ko is None
    for r in m.values():
        assert r.ko_ok + r.ko_to_ko + r.ko_to_en + r.ko_del == r.ko_ref_words
    assert SC.greedy([3, 4, 9], [4, 5], 1) == [0, 1]


def test_delta_round_trip(spark):
    r = random.Random(7)
    snaps, lines = [], [(0, "a")]
    for seq in range(12):
        for i, (lid, text) in enumerate(lines):
            snaps.append((1, seq, i, lid, text))
        if r.random() < 0.5 and len(lines) > 2:
            lines = lines[r.randrange(1, 2):]
        lines = [*lines[:-1], (lines[-1][0], lines[-1][1] + "x"), (seq + 1, "n")]
    df = spark.createDataFrame(snaps, "session_id long, seq long, line_idx long, line_id long, line_text string").cache()
    m, n = (spark.createDataFrame(x.collect(), x.schema) for x in encode_deltas(df, ["session_id"]))
    for at in (0, 5, 11):
        last = spark.createDataFrame([(1, at)], "session_id long, at long")
        got = sorted((r.line_idx, r.line_id, r.line_text) for r in decode_deltas(m, n, ["session_id"], last).collect())
        assert got == sorted((s[2], s[3], s[4]) for s in snaps if s[1] == at)


def test_reattach_matches_list_inserts(spark):
    r = random.Random(11)
    rows, t = [], 5000
    for pos in range(1, 200):
        kind = r.choice(["text", "text", "silence", "silence", "lang_switch"])
        t += r.randrange(0, 400)
        rows.append((1, pos, kind, t - (r.choice([0, 300, 900, 2500]) if kind == "text" else 0)))
    order: list[tuple] = []
    for row in rows:
        i = len(order)
        if row[2] == "text":
            while i and order[i - 1][2] == "silence" and row[3] + 50 < order[i - 1][3] and order[i - 1][3] - row[3] <= 1500:
                i -= 1
        order.insert(i, row)
    df = spark.createDataFrame(rows, "session_id long, pos long, kind string, start_ms long")
    got = [r.pos for r in G.reattach(df, ["session_id"]).orderBy("place").collect()]
    assert got == [o[1] for o in order]


def test_cascades_against_fold(spark):
    r = random.Random(2)
    ev = [(1, i, 4 * i * r.choice([1, 1, 1, 2]), r.choice([4, 4, 4, 5])) for i in range(1, 300)]
    runs, run, step = [], [ev[0]], None
    for x in ev[1:]:
        d = x[2] - run[-1][2]
        if x[3] == run[-1][3] and d > 0 and step in (None, d):
            step = d
            run.append(x)
        else:
            runs.append(run)
            run, step = [x], None
    runs.append(run)
    want = sorted((q[-1][1], len(q)) for q in runs if len(q) >= 3)
    got = sorted((x.end_line, x.length) for x in W.cascades(spark.createDataFrame(ev, "f long, n long, a long, b long"), ["f"], "n").collect())
    assert got == want


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(90, 8))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): r.vec_id for r in similar_examples(df, df, 3).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    for i in range(90):
        best = sorted((-s[i, j], j) for j in range(90) if j != i)[:3]
        assert [got[(i, k + 1)] for k in range(3)] == [j for _, j in best]


def test_overlap_and_loops():
    assert cut_repeat("the end. And more", "this is the end") == "And more"
    assert cut_repeat("nothing new", "this is the end") == "nothing new"
    assert cut_repeat("Xl the end more", "al the end", head=1) == "more"
    assert cut_repeat("the end. (And more", "this is the end") == "(And more"
    assert RP.runs("a b a b a b".split(), 4, 1, 3, 3, 0.5) == [(2, 0, 6, 3, "a b")]
    assert RP.runs("x a y a z z a q q q q a".split(), 1, 1, 3, 3, 0.5) == [(1, 1, 7, 3, "a"), (1, 7, 11, 4, "q")]
    assert RP.runs("a a a b a a a a a a a a".split(), 1, 1, 3, 0, 0.5) == [(1, 4, 12, 8, "a")] and RP.runs([], 4, 1, 3, 3, 0.5) == []


def test_log_lines(spark):
    lines = [(1, 1, "[NewSpeaker] spk=0→1 det_before=ko eager=True"), (1, 2, "[Restore] 복원: 'x' start=1.50 dstart=NA boundary_t=2.00 zone=zone1 gap_prev=0.1"),
             (1, 3, "SimulStreaming processing error: The size of tensor a (8) must match the size of tensor b (4) at non-singleton dimension 1"), (1, 4, "other")]
    df = spark.createDataFrame(lines, "file_id long, line_no long, line string")
    got = {r.line_no: r for r in SL.log_events(df, SL.SWITCH_CATALOG, ["file_id"]).collect()}
    assert set(got) == {1, 3} and got[3].captures["a"] == "8" and got[1].captures["new"] == "1"
    b = SL.log_events(df, SL.BOUNDARY_CATALOG, ["file_id"]).select(SL.unquote(F.col("captures")["text"]).alias("t"), F.col("captures")["dstart"].try_cast("double").alias("d")).first()
    assert (b.t, b.d) == ("x", None)


def test_scripts_and_reports(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.txt").write_text("[spk1]\nHello (laughs) there.\n\nNext one.\n[spk2]\nHi.\n[spk1]\nBack.\n", encoding="utf-8")
    (tmp_path / "s" / "b.txt").write_text("Old one.\n\nOld two.\n", encoding="utf-8")
    got = sorted((r.file[-5:], r.block, r.speaker, r.sentence) for r in ST.read_reference_scripts(spark, str(tmp_path / "s")).collect())
    assert got == [("a.txt", 0, "spk1", "Hello there."), ("a.txt", 0, "spk1", "Next one."), ("a.txt", 1, "spk2", "Hi."), ("a.txt", 2, "spk1", "Back."),
                   ("b.txt", 0, None, "Old one."), ("b.txt", 0, None, "Old two.")]
    (tmp_path / "r.json").write_text('{"files":[{"audio_file":"d\\\\x.wav","wer":0.1},{"audio_file":"x.wav","wer":0.2}],"file_summaries":[{"audio_file":"/p/x.wav","runs":2}]}')
    rep = ST.read_eval_reports(spark, str(tmp_path / "r.json")).orderBy("run").collect()
    assert [(r.run, r.file, r.summary.runs) for r in rep] == [(0, "x.wav", 2), (1, "x.wav", 2)]
    (tmp_path / "clip_A_R2.txt").write_text("[x]\n1. one here  ⟨silence⟩\n2. two  ⟨language_switch⟩\n", encoding="utf-8")
    run = sorted(tuple(r) for r in ST.read_run_transcripts(spark, str(tmp_path / "clip_A_R2.txt")).collect())
    assert run == [("clip", "A", "2", 0, "one here", "silence"), ("clip", "A", "2", 1, "two", "language_switch")]


def test_line_numbers_of_split_files(spark, tmp_path):
    texts = {"a.log": [f"line {i} " + "x" * (i % 23) for i in range(400)], "b.log": ["", "é", ""], "c.log": ["one"]}
    for name, lines in texts.items():
        (tmp_path / name).write_bytes(("\r\n" if name == "b.log" else "\n").join(lines).encode() + (b"\n" if name != "c.log" else b""))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 512)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        df = SL.read_logs(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = sorted((r.file.rsplit("/", 1)[1], r.line_no, r.line) for r in df.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted((name, i, line) for name, lines in texts.items() for i, line in enumerate(lines, 1))


def test_queries_meet_few_pieces_of_clustered_vectors(spark, monkeypatch):
    from seglake.operators import vectors as VEC
    monkeypatch.setattr(VEC, "PIECE_ROWS", 16)
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 32))
    rows = [(i, (centres[i % 40] + 0.02 * r.normal(size=32)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = df.filter("vec_id % 20 = 0")
    own = VEC.Cells(df.select("vec_id", VEC.unit("embedding").alias("v")))
    q = queries.select(F.col("vec_id").alias("query_id"), VEC.unit("embedding").alias("v"))
    near = VEC._scored(own.held(), own.first(q), 3, True).groupBy("query_id").agg(F.sqrt(2.0 - 2.0 * (F.min("score") - 1e-6)).alias("reach"))
    assert own.first(q).count() == 100 and own.others(q.join(near, "query_id"), 4).count() <= 0.05 * 100 * own.pieces.sum()
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    for row in VEC.similar_examples(queries, df, 3).collect():
        s = np.round(x @ x[row.query_id], 6)
        s[row.query_id] = -2
        assert sorted(range(2000), key=lambda i: (-s[i], i))[row["rank"] - 1] == row.vec_id


@pytest.mark.parametrize("files", [1, 3])
def test_stream_equals_table(spark, tmp_path, files):
    rows = [(s, i // 10, i, 300 * i, "word " * (i % 9 + 1)) for s in ("a", "b") for i in range(30)]
    schema = "session_id string, line long, seq long, t_ms long, text string"
    table = sorted(map(tuple, FO.debounce(spark.createDataFrame(rows, schema), ["session_id"]).collect()))
    for n in range(files):
        part = [r for r in rows if n * 30 // files <= r[2] < (n + 1) * 30 // files]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    FO.ready_for_state(spark)
    q = FO.on_stream(src, ["session_id"], ["seq"], FO.Debounce()).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == table


def stream_of(spark, folder, parts, schema, fold, order, **options):
    """The parts arrive as files, one per micro-batch; a last one in a session of its own moves the watermark on."""
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / "in" / f"p{n}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).option("recursiveFileLookup", True).parquet(str(folder / "in"))
    src = src.withColumn("at", F.timestamp_millis("start_ms")).withWatermark("at", "0 seconds")
    FO.ready_for_state(spark)
    out = FO.on_stream(src, ["session"], order, fold, at="at", **options)
    out.writeStream.format("parquet").option("checkpointLocation", str(folder / "c")).outputMode("append").trigger(availableNow=True).start(str(folder / "out")).awaitTermination(180)
    return sorted(tuple(r) for r in spark.read.parquet(str(folder / "out")).collect() if r.session != "last")


@pytest.mark.parametrize("files", [1, 2, 7])
def test_stall_timer_equals_table(spark, tmp_path, files):
    times = [0, 400, 900, 4000, 4100, 9500, 9600, 9700, 20_000, 20_100]
    rows = [(s, at + shift, at + shift) for s, shift in (("a", 100), ("b", 1100)) for at in times]
    schema = "session string, t_ms long, start_ms long"
    table = sorted(map(tuple, FO.on_table(spark.createDataFrame(rows, schema), ["session"], ["t_ms"], FO.StallWatch(1000)).collect()))
    rows = sorted(rows, key=lambda r: r[1])
    parts = [rows[n * len(rows) // files:(n + 1) * len(rows) // files] for n in range(files)] + [[("last", 21_900, 21_900)]]
    got = stream_of(spark, tmp_path, parts, schema, FO.StallWatch(1000), ["t_ms"])
    assert len(table) > 10 and sorted(r for r in got if r in table) == table
    assert [r for r in got if r not in table] == [("a", 21_200, 1000)]  # after the last output only the timer can tell


def test_deadline_and_expiry_without_rows(spark, tmp_path):
    schema = "session string, pos long, kind string, start_ms long, end_ms long, text string, lang string, zone long, boundary_t long, new_lang string"
    rows = [("a", 1, "text", 1000, 1100, " alt", "ko", 1, None, None), ("a", 2, "lang_switch", 1500, 1500, "", "ko", None, 1500, "en")]
    parts = [rows, [("last", 1, "text", 60_000, 60_100, " x", "ko", None, None, None)]]
    assert stream_of(spark, tmp_path / "deadline", parts, schema, RC.Reconcile(), ["pos"]) == [("a", 1, "restored", "d3")]
    schema = "session string, seq long, start_ms long, words array<struct<text: string, start: long, end: long>>"
    parts = [[("a", 0, 1000, [("one", 0, 100), ("two", 200, 300)])], [("last", 0, 90_000, [])]]
    assert stream_of(spark, tmp_path / "flush", parts, schema, FO.CommitAgreed(), ["seq"], keep_ms=30_000) == [("a", -1, "one", 0), ("a", -1, "two", 200)]


def test_turns_of_long_sessions_stay_apart(spark):
    """Turn 100000 of session 1 is not turn 0 of session 2."""
    turns = {(1, 5): 3, (1, 99_999): 2, (1, 100_000): 4, (1, 200_003): 1, (2, 0): 5, (3, 3): 2}
    rows = [(s, k, i, f"w{i}") for (s, k), n in turns.items() for i in range(n)]
    t = SimpleNamespace(tok=spark.createDataFrame(rows, "session_id long, turn long, seq long, word string"))
    got = PS.turn_pairs(t).collect()
    assert sorted((r.session_id, r.turn, len(r.r)) for r in got) == sorted((*k, n) for k, n in turns.items())
    words = {}
    for r in SC.align(PS.turn_pairs(t), PS.TURNS, "r", "h").collect():
        if r.ref_word is not None:
            words.setdefault((r.session_id, r.turn), []).append((r.op_no, r.ref_word))
    assert all([w for _, w in sorted(ws)] == [f"w{i}" for i in range(len(ws))] for ws in words.values()) and len(words) == len(turns)


def test_long_pairs_are_cut_where_all_paths_pass(spark):
    r = np.random.default_rng(5)
    pairs = []
    for i in range(-3, 40):
        a = r.integers(0, int(r.choice([2, 60, 400])), int(r.integers(0, 250))).tolist()
        b = [int(r.integers(0, 9)) if r.random() < 0.03 else w for w in a if r.random() > 0.02]
        pairs.append((i, [str(w) for w in a], [str(w) for w in (b[20:] + b[:20] if i % 7 == 0 else b)]))
    df = spark.createDataFrame(pairs, "id long, r array<string>, h array<string>")
    one = sorted(map(tuple, SC.align(df, "id", "r", "h").collect()), key=lambda x: x[:2])
    assert sorted(map(tuple, SC.align(df, "id", "r", "h", cells=30).collect()), key=lambda x: x[:2]) == one
    assert sorted(SC.edit_counts(df, "id", "r", "h", cells=30).collect()) == sorted(SC.edit_counts(df, "id", "r", "h").collect())
    assert sum(len(SC.sure_cuts(*SC.numbered(a, b))) for _, a, b in pairs) > 50


def test_alignment_from_sql(spark):
    from seglake.functions import tables
    tables.register(spark)
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["a", "x", "c", "d"]), (2, None, ["q"]), (3, [], [])], "id long, r array<string>, h array<string>")
    got = spark.sql("SELECT id, o.op, o.ref_idx, o.hyp_idx, o.ref_word, o.hyp_word FROM {p} p, LATERAL align_words(p.r, p.h) o ORDER BY id, op_no", p=df).collect()
    assert [tuple(x) for x in got] == [(1, "match", 0, 0, "a", "a"), (1, "sub", 1, 1, "b", "x"), (1, "match", 2, 2, "c", "c"), (1, "ins", None, 3, None, "d"), (2, "ins", None, 0, None, "q")]


def test_split_words(spark):
    ops = [(-1, i, op, h if w != "del" else None, r, x) for i, (op, h, r, x, w) in enumerate([
        ("match", 0, "a", "a", ""), ("sub", 1, "hello", "he", ""), ("ins", 2, None, "llo", ""), ("match", 3, "b", "b", ""),
        ("sub", 4, "w" * 5000, "w" * 4000, ""), ("ins", 5, None, "w" * 1000, ""), ("match", 6, "c", "c", ""), ("sub", 7, "upon", "up", ""), ("ins", 8, None, "in", ""), ("match", 9, "d", "d", ""),
        ("sub", 10, "into", "in", ""), ("ins", 11, None, "to", "")])]
    df = spark.createDataFrame(ops, "s long, op_no long, op string, hyp_idx long, ref_word string, hyp_word string")
    starts = spark.createDataFrame([(-1, 2), (-1, 5), (-1, 8), (-1, 10)], "s long, hyp_idx long")
    got = sorted((r.hyp_idx, len(r.ref_word), r.pieces) for r in SC.midword_splits(df, starts, ["s"]).collect())
    assert got == [(1, 5, 2), (4, 5000, 2)]

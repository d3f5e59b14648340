"""Spelling variants, substring dedup and hard negatives against brute-force versions, on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from helpers import SAMPLE, lowered
from seglake.llm import decontaminate, hard_negatives, langid, main_text, mtree, spelling, substring_dedup

# --- spelling -------------------------------------------------------------------


def brute_variants(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    holes, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1:]
            holes[i, shorter].add(w)
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, n, form.get(w), root(w), len(near[w]), words.get(form.get(w))) for w, n in words.items())


def variants(df):
    return sorted(tuple(r[c] for c in ("word", "n", "form", "root", "n_near", "form_n")) for r in spelling.variants(df).collect())


def test_variants_of_the_sample(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SAMPLE}/documents.parquet").to_pylist()]
    got = variants(spark.read.parquet(f"{SAMPLE}/documents.parquet"))
    assert got == brute_variants(rows) and sum(1 for x in got if x[2]) > 50 and any(x[3] not in (x[0], x[2]) for x in got)


def test_variants_on_awkward_rows(spark):
    r = random.Random(4)
    base = ["receive", "straße", "élèves", "aaaaaa", "ABCDEF", "Über×mut", "w" * 3000]
    rows = [(None, "receive recieve receive"), (None, None), (3, ""), (3, "receive"), (3, "receive"), (4, "12 . --"), (5, "receive " * 9 + "a" * 5000)]
    for i in range(200):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            at = r.randrange(len(w))
            w[at:at + r.randrange(2)] = r.choice(["", "e", "É", "x"])
        rows.append((i, " ".join(["".join(w)] * r.randrange(1, 6))))
    df = spark.createDataFrame([(*x, "mine", 1) for x in rows], "doc_id long, text string, word string, n int")
    assert variants(df) == brute_variants(rows)
    assert spelling.variants(df.where("1 = 0")).count() == 0


def test_neighbourhoods_hold_every_edit():
    r = np.random.default_rng(1)
    for length in (1, 2, 5, 9):
        word = r.integers(0, spelling.SYMBOLS, length).astype(np.uint64)
        edits = {tuple(word)} | {tuple(np.delete(word, i)) for i in range(length)}
        for s in range(spelling.SYMBOLS):
            edits |= {tuple(np.insert(word, i, s)) for i in range(length + 1)} | {(*word[:i], s, *word[i + 1:]) for i in range(length)}
        want = {int(spelling.keys(np.array([e], dtype=np.uint64).reshape(1, len(e)))[0]) for e in edits}
        assert set(spelling.neighbourhoods(word[None])[0].tolist()) == want


# --- substring dedup --------------------------------------------------------------


def brute_repeats(rows):
    words = [[w for w in re.split("[\x20\x09-\x0d]+", text or "") if w] for _, text in rows]
    place = lambda doc_id: float("inf") if doc_id is None else doc_id
    least = {}
    for (doc_id, _), w in zip(rows, words):
        for i in range(len(w) - 12):
            least[tuple(w[i:i + 13])] = min(place(doc_id), least.get(tuple(w[i:i + 13]), float("inf")))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = {i + k for i in range(len(w) - 12) if least[tuple(w[i:i + 13])] < place(doc_id) for k in range(13)}
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def repeats(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(df).collect()), key=str)


@pytest.mark.parametrize("parts", [1, 5])
def test_repeats_against_brute_force(spark, parts):
    r = random.Random(parts)
    passage = [f"p{i}" for i in range(60)]
    rows = [(None, " ".join(passage)), (None, " ".join(passage)), (3, None), (3, ""), (4, " \n\x0b"), (9, "few words"), (2, "a " * 400), (1, "a " * 40), (1, "a " * 40), (7, " ".join(passage[:12]))]
    for i in range(10, 60):
        w = [r.choice("abcdefgh") for _ in range(r.randrange(0, 40))]
        lo = r.randrange(50)
        w[r.randrange(len(w) + 1):0] = passage[lo:lo + r.randrange(5, 30)]
        rows.append((r.choice([i, i, 10]), r.choice([" ", "\t", " \n"]).join(w)))
    df = spark.createDataFrame([(*x, "mine", 5) for x in rows], "doc_id long, text string, kept string, block long").repartition(parts)
    want = brute_repeats(rows)
    assert repeats(df) == want and sum(x[2] for x in want) > 300
    assert substring_dedup.remove_repeats(df.where("1 = 0")).count() == 0


def test_every_long_match_holds_a_common_anchor():
    covered = set(substring_dedup.COVER.tolist())
    for shift in range(substring_dedup.PERIOD):
        assert any((d + shift) % substring_dedup.PERIOD in covered for d in covered)
    assert substring_dedup.PERIOD - 1 + substring_dedup.ANCHOR <= substring_dedup.WINDOW


def test_digest_of_what_is_kept(spark):
    df = spark.createDataFrame([(1, "é x\x0cy"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.kept_sha256 for r in substring_dedup.digest(substring_dedup.remove_repeats(df)).collect()}
    assert got == {1: hashlib.sha256("é x y".encode()).hexdigest(), 2: hashlib.sha256(b"").hexdigest()}


# --- hard negatives ---------------------------------------------------------------


def brute_negatives(rows, every):
    own = {}
    for vec_id, label, x in rows:
        if vec_id is None or label is None or x is None or any(e is None or not np.isfinite(e) for e in x):
            continue
        v = [int(np.floor(256 * e)) for e in x]
        own[vec_id] = min(own.get(vec_id, (label, v)), (label, v))
    out = []
    for a, (label, v) in own.items():
        if a % every:
            continue
        score = {b: sum(p * q for p, q in zip(v, w)) for b, (_, w) in own.items() if b != a and len(w) == len(v)}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if own[b][0] == label][:5]:
            fits = [b for b in order if own[b][0] != label and 80 * score[p] <= 100 * score[b] <= 100 * score[p]][:5]
            out += [(a, p, i + 1, b, score[p], score[b]) for i, b in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("numbers", [1 << 20, 90])
def test_negatives_against_brute_force(spark, numbers):
    r = random.Random(3)
    vector = lambda n=9: [r.choice([-0.5, 0.25, 0.5, 1.0, 1.25]) + 0.3 for _ in range(n)]
    rows = [(i, r.randrange(3), vector()) for i in range(120)] + [(200 + i, 1, [1.0] * 9) for i in range(12)] + [(300 + i, i % 2, [1.0] * 9) for i in range(8)]
    rows += [(400, None, vector()), (401, 1, None), (402, 1, [None] * 9), (403, 1, [float("nan")] * 9), (404, 1, [float("inf")] * 9), (None, 1, vector()), (410, 1, []), (420, 2, []),
             (430, 0, vector(4)), (440, 1, vector(4)), (450, 0, vector(4)), (10, 0, [1.0] * 9), (10, 0, [1.0] * 9), (20, 2, vector())]
    df = spark.createDataFrame([(*x, "mine") for x in rows], "vec_id long, label int, embedding array<double>, block string")
    got = sorted(tuple(x) for x in hard_negatives.mine(hard_negatives.usable(df), F.col("vec_id") % 10 == 0, numbers=numbers).collect())
    want = brute_negatives(rows, 10)
    assert got == want and len(want) > 100
    assert hard_negatives.mine(hard_negatives.usable(df.where("1 = 0")), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(hard_negatives.usable(df), F.col("vec_id") < -5).count() == 0


def test_bounds_leave_out_rows_before_scoring():
    r = np.random.default_rng(2)
    near, far = r.normal(40, 3, (50, 32)), r.normal(-40, 3, (2000, 32))
    rows = np.floor(np.concatenate((near, far))).astype(np.float64)
    block = hard_negatives.Summaries(np.arange(len(rows)), np.zeros(len(rows), dtype=np.int64), rows)
    at, score = block.nearest(rows[0], np.arange(1, len(rows)), 5)
    want = sorted(range(1, len(rows)), key=lambda i: (-(rows[i] @ rows[0]), i))[:5]
    assert at.tolist() == want and block.scored <= 50


# --- earlier operators --------------------------------------------------------------


def test_a_repeated_query_asks_once(spark):
    rows = [(20, [1.0, 2.0]), (20, [1.0, 2.0]), (30, [2.0, 1.0]), (31, [0.5, 0.5])]
    df = mtree.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [(r["rank"], r.vec_id) for r in mtree.top_k(df, df.where("vec_id % 20 = 0")).orderBy("rank").collect()]
    assert got == [(1, 30), (2, 31)]


def test_signs_are_no_letters():
    assert [langid.has_letter(t) for t in (None, "", "²½Ⅷ①", "x²", "_5", "ß", "日")] == [False, False, False, True, False, True, True]


def test_nothing_learned_keeps_what_has_letters(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "²", None), (3, None, None)], "doc_id long, text string, lang string")
    kept = langid.keep_identified(docs, langid.fit(docs))
    assert [r.doc_id for r in kept.collect()] == [1]


def test_rejection_follows_the_loss():
    model = langid.Model(["a", "b", "c", "d"], langid.codewords(4), np.zeros((1, 7)), np.zeros(7), np.ones(7), limit=6.0)
    clear, mixed = model.codes[1] * 4.0, np.array([-9.0, 9.0, -9.0, 9.0, -9.0, 9.0, 9.0])
    assert langid.misfits(model, np.array([clear, mixed])).tolist() == [False, True]


def test_blocks_of_items_equal_one_pass(spark):
    docs = spark.createDataFrame([(i, f"w{i} alpha beta w{i + 1} gamma", "x") for i in range(12)], "doc_id long, text string, Hits string")
    items = spark.createDataFrame([(i, f"w{i} alpha") for i in range(9)] + [(50, "beta")], "item_id long, text string")
    one = decontaminate.digest(decontaminate.find(docs, items)).orderBy("doc_id").collect()
    assert decontaminate.digest(decontaminate.find(docs, items, limit=9)).orderBy("doc_id").collect() == one and sum(r.n_hit for r in one) == 12 + 18


LONG = "<p>" + "A text of the article that is long enough to make a surge of its own. " * 2 + "</p>"


@pytest.mark.parametrize("page", ['<article class="post with-sidebar">%s</article>', '<div class="layout has-sidebar"><article>%s</article></div>', '<div class="content with-sidebar">%s</div>',
                                  '<form><h1></h1>%s</form>', '<div class="related-work">%s</div>', '<div class="social-science">%s</div>', '<div id="the-form-of-things">%s</div>',
                                  '<div><svg class="i"/>%s</div>', '<article>%s</article><article class="x"><a href="/">Teaser</a></article>', '<div class="site-footer">No</div>%s',
                                  '<div class="comments-area"><article class="comment">No</article></div>%s'])
def test_layout_names_are_no_reason_to_drop_an_article(page):
    assert main_text.main_text(page % LONG) == LONG[3:-4].strip()


def test_pages_without_article_elements_give_the_same_text():
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist():
        assert main_text.main_text(re.sub(r"(</?)(article|main)\b", r"\1div", page)) == main_text.main_text(page) != ""


@pytest.mark.parametrize("tag", ['<p x="', '<p x=">', '<p a=">" ', '<span class="ad">', '<div class="ad">', "<nav>"])
def test_hostile_tags_take_linear_time(tag):
    import time
    start = time.process_time()
    main_text.main_text(tag * 50_000)
    assert time.process_time() - start < 3

"""SimHash, top-k, URLs, pages and licences on awkward rows, and the pipeline against a brute-force version."""

import random
import re

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from helpers import SAMPLE, components, fingerprint, hits, ids_sha256, windows
from seglake.llm import license_scan, main_text, mtree, simhash, url_filter
from seglake.llm.license_texts import OTHER, TEMPLATES


def test_fingerprints_against_brute_force():
    texts = [None, "", "  \n", "one", "One TWO three", "a b c d e", "Ä ä \x85 b\x0bc d e f", "w " * 2000, " ".join(str(i) for i in range(900))]
    assert simhash.fingerprints(texts).tolist() == [fingerprint(t) for t in texts]


def test_links_find_every_pair(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1, 1 << 63]
    prints = set(base)
    for x in base:
        for flips in (1, 2, 3, 4, 4, 5, 6):
            prints.add(x ^ sum(1 << b for b in rng.sample(range(64), flips)))
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4}
    assert len(found) == len(want) and {(r.a, r.b) for r in found} == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(205, 201), (201, 203), (203, 202), (-5, 300)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {201: 201, 202: 201, 203: 201, 205: 201, -5: -5, 300: -5}
    assert got == want
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_copies(spark):
    rng = random.Random(9)
    text = [rng.choice("abcdefghijklmnop") * rng.randint(1, 5) for _ in range(400)]
    rows = [(i, " ".join(text[:k] + ["zz"] + text[k:])) for i, k in enumerate([0, 100, 399, 200])] + [(9, " ".join(text)), (8, " ".join(text).upper())]
    rows += [(20 + i, " ".join(rng.choice("qrstuvwxyz") * rng.randint(1, 6) for _ in range(50))) for i in range(5)]
    rows += [(40, None), (41, ""), (42, " \n"), (None, "a text without id"), (None, "a text without id"), (30, "twice"), (30, "twice"), (31, "tiny")]
    return spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, fp string")


def test_near_duplicates_against_brute_force(spark):
    docs = near_copies(spark)
    rows = docs.collect()
    prints = [fingerprint(r.text) for r in rows]
    root = components(prints)
    want = []
    for i, r in enumerate(rows):
        ids = [rows[j].doc_id for j in range(len(rows)) if root[j] == root[i] and rows[j].doc_id is not None]
        linked = {p for p in prints if p != prints[i] and (p ^ prints[i]).bit_count() <= 4}
        want.append((str(r.doc_id), f"{prints[i]:016x}", min(ids, default=None), len(linked)))
    got = [(str(r.doc_id), r.fingerprint, r.component_id, r.n_links) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r.fp for r in kept.collect()} == {"mine"}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(c) for _, _, c, _ in want})
    assert simhash.near_duplicates(docs.where("1 = 0")).count() == 0 and simhash.keep_one(docs.where("1 = 0")).count() == 0


def brute_top(rows, queries, k):
    out = []
    for q, v in queries:
        best = sorted((-int(np.dot(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("page,numbers", [(4, 200), (256, 1 << 19)])
def test_top_k_against_brute_force(spark, page, numbers):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=6).tolist()) for i in range(150)] + [(i, [0.5] * 6) for i in range(150, 260)] + [(i, [0.0] * 6) for i in range(260, 270)]
    vectors += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (304, []),
                (305, [100.0, -3.0, 0.0, 0.0, 1.0, 2.0]), (320, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "mine") for i, v in vectors], "vec_id long, embedding array<float>, score string")
    rows = mtree.integers(df)
    fine = [(r.vec_id, np.array(r.row)) for r in rows.collect()]
    assert {i for i, _ in fine}.isdisjoint({None, 300, 301, 302, 303})
    got = mtree.top_k(rows, rows.where("vec_id % 20 = 0"), k=7, page=page, numbers=numbers)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(fine, [x for x in fine if x[0] % 20 == 0], 7)
    assert mtree.top_k(rows.where("1 = 0"), rows.where("1 = 0")).count() == 0


def test_stored_bounds_save_distances():
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.normal(c * 400, 3, size=(500, 4)) for c in range(-4, 5)]).round()
    tree = mtree.Tree(np.arange(len(rows)), rows, float((rows * rows).sum(1).max()), page=32)
    ids, score = tree.search(rows[-1], len(rows) - 1, 5)
    want = sorted((-(rows[i] @ rows[-1]), i) for i in range(len(rows) - 1))[:5]
    assert [(-s, i) for i, s in zip(ids, score)] == want and tree.measured < len(rows) / 2


URLS = ["http://a.net/x", "https://Example.NET/en/1?q=/de/", "http://example.net/english", "http://example.net/EN/", "http://sub.example.com/de/2#x", "http://example.com/de", "http://x.org/fr/",
        "http://org/fr/", "http://x.org/en/", "http://notexample.com/de/", "http://net", "http://net/", "mailto:x", "", None, "://", "http://?a/b", "ftp://spam-farm.example.org/a", "http://x.org/login",
        "http://www.casino.example.org/fr/1", "http://ads.example.com/", "http://a.net\n.org/fr/", "http://éa.net/" + "x" * 50_000]


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
            if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    plain = any(p.action == "block" and re.search(p.pattern.replace(r"\z", r"\Z"), host + path) for p in url_filter.PATTERNS)
    return host, path, best and best[0] + best[1], best[2] if best else "block" if plain else "allow"


def test_urls_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, rule string")
    got = url_filter.judge(pages, url_filter.SITES + url_filter.PATTERNS)
    assert got.columns[:2] == ["page_id", "url"]
    for r in got.collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute_url(r.url), r.url
    assert url_filter.judge(pages.where("1 = 0"), url_filter.SITES).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, ()).collect()} == {"allow"}
    assert "ArrowPython" not in got._jdf.queryExecution().toString() and "PythonUDF" not in got._jdf.queryExecution().toString()


def test_only_candidates_run(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.example.com/p/{i}") for i in range(50)] + [(99, "http://casino.example.com/")], "page_id long, url string")
    rules = [url_filter.Rule("casino", "block", "casino", ("casino", "com")), url_filter.Rule("p7", "block", "/p/7$", ("p", "7"))]
    got = {r.page_id: (r.verdict, r.n_candidates) for r in url_filter.judge(pages, rules).collect()}
    assert got[99] == ("block", 1) and got[7] == ("block", 1) and got[3] == ("allow", 0)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>if (a<b) {x = "</p>";}</script></head><body class="page with-sidebar">
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">More</a></li></ul></nav><!-- ad <p>hidden</p> --><div class="ad">Buy now and save a lot of money on everything you want today.</div>
<header><p>The site of all sites and a slogan that is long enough to count as text.</p></header>%s
<div id="comments"><p>I think that this is a very good article, thanks for all the work you do.</p></div>
<aside>Other things that you may want to read when you are done with this one.</aside><footer><p>&copy; 2020 somebody &middot; imprint</p></footer></body></html>"""
BODY = "<h1>A  title</h1><p>First &lt;paragraph&gt;\n with&nbsp;<b>bold</b> and <a href='x'>a link</a>.<br>After the break<p>No.</p><ul><li>One</li><li>Two</li></ul>"
TEXT = "A title\nFirst <paragraph> with bold and a link.\nAfter the break\nNo.\nOne\nTwo"


@pytest.mark.parametrize("around", ["<article>%s</article>", "<main>%s</main>", "<main><article>%s</article></main>", "<article>%s", "<div class='content'>%s</div>", "<div><div>%s</div></div>"])
def test_main_text_of_common_layouts(around):
    assert main_text.main_text(PAGE % (around % BODY)) == TEXT


def test_main_text_without_or_with_broken_markup():
    assert main_text.main_text(None) == main_text.main_text("") == main_text.main_text("<nav><a>x</a></nav><script>1") == ""
    assert main_text.main_text("just some words") == "just some words"
    assert main_text.main_text("<article><p>Kept<div class=comment>gone</div><p>kept</article><p>") == "Kept\nkept"
    assert main_text.main_text("<div class='ad'>open advert<article><p>text &am") == "text &am"
    assert main_text.main_text("<article><p>one two<p title='x") == "one two"
    assert main_text.main_text("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"


@pytest.mark.parametrize("page, text", [
    ('<article><p class="ad">Buy<p>First</p><p>Second</p></article>', "First\nSecond"),
    ('<article><p class="ad">Buy<br>now<div>First</div></article>', "First"),
    ('<div><p class="ad">Buy</div><article><p>First</article>', "First"),
    ('<article><ul><li class="share">Send<ul><li>by mail</ul><li>One</ul><p>Last</p></article>', "One\nLast"),
    ('<article><ul><li class="share">Send</ul><p>Last</p></article>', "Last"),
    ('<main><article><div class="ad">Buy</article><p>After</p></main>', "After"),
    ('<article><div class="share">Send<div>by mail</div></div>After</article>', "After"),
    ('<article><p>One <span class="share">Send<p>Two</article>', "One\nTwo"),
    ('<head><meta name=x><body><p>One</p></body>', "One"),
])
def test_main_text_after_elements_without_closing_tag(page, text):
    assert main_text.main_text(page) == text


LONG = "A paragraph of the article that is long enough to be a surge by itself."


@pytest.mark.parametrize("page, text", [
    (f"<div><h1>Title</h1></div><div><p>{LONG}</p></div>", f"Title\n{LONG}"),
    (f"<div><h1>Title</h1></div><div>by me</div><div>{LONG}</div><section><p>Short.</p></section>", f"Title\nby me\n{LONG}\nShort."),
    (f"<div><p>{LONG}</p></div><div><ul><li><a>One source</a></ul></div><div><p>End.</p></div>", f"{LONG}\nOne source\nEnd."),
    (f"<article><p>{LONG}</p><section><ul><li><a>One source</a><li><a>Another source</a></ul></section></article>", f"{LONG}\nOne source\nAnother source"),
    (f"<main><section><p><a>A linked paragraph</a></p></section><section>{LONG}</section></main>", f"A linked paragraph\n{LONG}"),
    (f"<div><a>Home</a> <a>More</a></div><div><p>{LONG}</p></div><div><a>Imprint</a></div>", LONG),
    ("<div>One.</div><div>Two.</div>", "One.\nTwo."),
])
def test_main_text_keeps_short_and_linked_parts(page, text):
    assert main_text.main_text(page) == text


def test_main_text_on_awkward_rows(spark):
    long = "<article>" + "<p>word and word</p>" * 20_000 + "</article>"
    rows = [(1, "u", None, "mine"), (2, None, "", "mine"), (3, "u", PAGE % f"<article>{BODY}</article>", "mine"), (3, "u", PAGE % f"<article>{BODY}</article>", "mine"), (None, "u", long, "mine")]
    got = main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [r.text for r in got] == ["", "", TEXT, TEXT, "\n".join(["word and word"] * 20_000)] and all(r.n_chars == len(r.text) for r in got)
    assert main_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_licence(model, paragraph):
    own = license_scan.words(paragraph)
    family, score = license_scan.predict(model, own)
    pairs = set(license_scan.grams(own, (2,)))
    alike = [set(license_scan.grams(license_scan.words(t), (2,))) for t in TEMPLATES.get(family, ())]
    near = max((len(t & pairs) / min(len(t), max(1, len(pairs))) for t in alike), default=0)
    return family if family != license_scan.NONE and score >= license_scan.THRESHOLD and near >= license_scan.SIMILAR else None


def test_licences_against_brute_force(spark):
    model = license_scan.fit()
    assert license_scan.held_out_accuracy(model) > 0.97
    texts = ["\n\n".join(t) for t in TEMPLATES.values()] + ["\n\n".join(OTHER)] + [
        None, "", "\n\n", "no such words here", "First line.\nReleased under the MIT\nLicense.\n\nlast", "license " * 5000, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0"]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)] + [(0, texts[0], "mine")], "doc_id long, text string, paragraphs string")
    scanned = license_scan.scan(docs, model)
    assert "ArrowPython" not in scanned._jdf.queryExecution().toString()
    for r in scanned.collect():
        split = [(i, p) for i, p in enumerate(re.split(license_scan.PARAGRAPHS, r.text or ""))]
        want = [(i, brute_licence(model, p)) for i, p in split if any(a in p.lower() for a in license_scan.ANCHORS)]
        assert [(p.paragraph, p.family) for p in r.paragraphs] == want
    told = {r.doc_id: r for r in license_scan.summary(scanned).collect()}
    for i, family in enumerate(TEMPLATES):
        assert family in told[i].families.split(",") and told[i].n_licensed >= 0.8 * len(TEMPLATES[family])
    assert told[len(TEMPLATES)].n_licensed == 0 and told[len(texts) - 3].families == "mit" and told[len(texts) - 1].families == "apache-2.0"
    assert license_scan.scan(docs.where("1 = 0"), model).count() == 0


def test_licences_without_anchors_against_every_paragraph(spark):
    """Paragraphs with and without anchors against the model and the templates alone."""
    rng = random.Random(4)
    model = license_scan.fit()
    some = [" ".join(rng.sample(license_scan.words(t), rng.randint(1, len(license_scan.words(t))))) for ts in TEMPLATES.values() for t in ts for _ in range(3)]
    parts = ["Unauthorized copying of this file is strictly prohibited.", "Distributed under the GPL v2.", "Released under MIT.", "This file is under GPLv3.", "Er kam mit dem Zug",
             "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written consent of the publisher.",
             "This is free and unencumbered software released into the wild.", "Use, copy, modify, merge, publish, distribute this software free of charge", "of the", *some, *OTHER]
    assert not any(a in p.lower() for p in parts[:9] for a in license_scan.ANCHORS)
    docs = spark.createDataFrame([(0, "\n\n".join(parts))], "doc_id long, text string")
    got = {p.paragraph: p.family for p in license_scan.scan(docs, model).first().paragraphs}
    brute = {i: brute_licence(model, p) for i, p in enumerate(parts)}
    assert {i: f for i, f in got.items() if f} == {i: f for i, f in brute.items() if f}
    assert any(brute[i] for i in range(9))
    called = {i for i, p in enumerate(parts) if license_scan.predict(model, license_scan.words(p))[0] != license_scan.NONE}
    assert called | {0, 1, 2, 3} <= got.keys() and 4 not in got and 8 not in got


def test_pipeline_against_brute_force(spark):
    docs = sorted(pq.read_table(f"{SAMPLE}/documents.parquet").to_pylist(), key=lambda r: r["doc_id"])
    docs = [r for r in docs if r["text"] and any(c.isalpha() for c in r["text"])]
    root = components([fingerprint(r["text"]) for r in docs])
    docs = [r for i, r in enumerate(docs) if root[i] == i]
    found = windows([(r["item_id"], r["text"]) for r in pq.read_table(f"{SAMPLE}/benchmark.parquet").to_pylist()])
    docs = [r for r in docs if not hits(r["text"], found)[1]]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r["doc_id"]: ids_sha256(library.encode(r["text"], add_special_tokens=False).ids) for r in docs}
    got = corpus_pipeline.run(spark, SAMPLE)
    assert {r.doc_id: r.ids_sha256 for r in got.collect()} == want and got.count() == len(want)


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame(
        [(1, "The cat and the dog are in the house.", "en", "s", 10), (1, "The cat and the dog are in the house.", "en", "s", 10), (2, None, None, None, None), (3, "1 2 3", "en", "s", 5)],
        "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SAMPLE).columns == docs.columns, name
        assert stage(spark, docs.where("1 = 0"), SAMPLE).count() == 0
    assert [r.doc_id for r in corpus_pipeline.identify_language(spark, docs, SAMPLE).collect()] == [1, 1]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SAMPLE).collect()) == [1, 2, 3]

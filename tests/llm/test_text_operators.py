"""Encoding, counting, files, language and decontamination on awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from helpers import SAMPLE, hits, ids_sha256, windows
from seglake.llm import bpe, decontaminate, langid, token_counts, token_files
from seglake.llm.pieces import PieceEncoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [" ", "\n", "\t", "\r", "\xa0", "\x1c", " ", "a", "B", "'s", "'", "é", "é", "́", "1", "²", "½", "中", "文", "<|endoftext|>",
            "<|end", "oftext|>", "!", "...", "_", "İ", "ß", "한", "😀", "the ", "and "]
AWKWARD = [None, "", " ", "\n\n", "a", "One two  three\n\n four\tfive", "éclair café ́x", "word " * 30_000, "x" * 20_000, "a\x00b <|endoftext|> c<|startoftext|>",
           "The same text.", "The same text."]


def awkward(spark):
    rows = [(i, t, "old", i) for i, t in enumerate(AWKWARD)] + [(None, "no id", "old", 1), (3, "\n\n", "old", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, extra long")


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.choice([1, 3, 9, 40, 200]))) for _ in range(n)]


def test_pieces_and_chunks_equal_the_library():
    library, pieces, chunks = Tokenizer.from_file(WORDS), PieceEncoder(WORDS), bpe.ChunkEncoder(WORDS)
    rng = random.Random(5)
    for text in random_texts(1500, 1):
        want = library.encode(text, add_special_tokens=False).ids
        assert pieces.encode([text])[0].tolist() == want
        at = sorted({0, len(text), *(rng.randint(0, len(text)) for _ in range(4))})
        parts = [text[a:b] for a, b in zip(at, at[1:])] or [""]
        assert chunks.encode([parts])[0].tolist() == want


def test_words_with_marks_equal_the_library():
    library, pieces = Tokenizer.from_file(WORDS), PieceEncoder(WORDS)
    assert pieces.lowers
    rng = random.Random(6)
    letters = ["a", "B", "é", "É", "ß", "ÿ", "À", "µ", "ª", "n", "S", "K", "x"]
    marks = [".", ",", "!!", "***", "%%%", "'s", "'", "’", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "2", "³", "_", "\u0301", "\xad", "¨", "/", "-"]
    for _ in range(3000):
        text = " ".join("".join(rng.choices(letters, k=rng.randint(1, 7))) + "".join(rng.choices([*marks, ""], k=rng.randint(0, 3))) for _ in range(rng.randint(1, 12)))
        assert pieces.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_cuts_depend_on_content_only():
    rng = np.random.default_rng(1)
    passage = bytes(rng.integers(97, 123, 20_000, dtype=np.uint8))
    a, b = bpe.cuts(b"front " + passage), bpe.cuts(b"another front " + passage)
    assert set((a[a > 60] - 6).tolist()) == set((b[b > 60] - 14).tolist()) and len(a) > 20


def test_shared_chunks_are_encoded_once():
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(4000))
    parts = [text[i:i + 500] for i in range(0, len(text), 500)]
    encoder = bpe.ChunkEncoder(WORDS)
    encoder.encode([parts, parts, parts])
    assert encoder.asked == 3 * len(parts) and len(encoder.known) == len(set(parts)) and encoder.chars == sum(map(len, set(parts)))


def test_roundtrip_on_awkward_rows(spark):
    library = Tokenizer.from_file(WORDS)
    done = bpe.encode_decode(awkward(spark), WORDS, ("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"))
    assert set(done.columns) == {"doc_id", "extra", "ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"}
    got = done.collect()
    assert len(got) == len(AWKWARD) + 2
    texts = {i: t for i, t in enumerate(AWKWARD)} | {None: "no id"}
    for r in got:
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        text = library.decode(want, skip_special_tokens=False)
        assert (r.ids, r.n_tokens, r.ids_sha256, r.decoded) == (want, len(want), ids_sha256(want), text)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_roundtrip_of_an_empty_table(spark):
    assert bpe.encode_decode(awkward(spark).where("1 = 0"), WORDS).count() == 0


def test_counts_equal_the_library():
    library, counter = Tokenizer.from_file(BYTES), token_counts.MergeCounter(BYTES)
    for text in [t for t in AWKWARD if t] + random_texts(1500, 2):
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), text[:80]


def test_merges_take_the_leftmost_of_equal_rank():
    counter = token_counts.MergeCounter(BYTES)
    library = Tokenizer.from_file(BYTES)
    for text in ("aaaaaaa", "abababab", "ssssssst", "  ", "zzzzzzzzzzzzzzzzzzzz"):
        assert counter.merged_length(text.encode()) == len(library.encode(text, add_special_tokens=False).ids)


def test_token_counts_on_awkward_rows(spark):
    got = token_counts.with_token_counts(awkward(spark), BYTES).collect()
    assert len(got) == len(AWKWARD) + 2 and got[0].asDict().keys() == {"doc_id", "text", "extra", "n_bytes", "n_tokens", "over_limit"}
    for r in got:
        assert r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 512)
    assert token_counts.with_token_counts(awkward(spark).where("1 = 0"), BYTES).count() == 0


def test_files_hold_all_ids_in_order(spark):
    library = Tokenizer.from_file(WORDS)
    docs = awkward(spark).repartition(3)
    manifest = token_files.write(docs, WORDS, end_id=2)
    got = token_files.read(manifest).orderBy("start").collect()
    want = sorted(((r.doc_id is not None, r.doc_id or 0, r.text) for r in docs.collect()), key=lambda r: r[:2])
    assert [r.doc_id for r in got] == [d if known else None for known, d, _ in want]
    start = 0
    for r, (_, _, text) in zip(got, want):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.ids, r.start, r.n_tokens, r.ids_crc32) == (ids, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    one = token_files.read(manifest, wanted=[5]).collect()
    assert [r.doc_id for r in one] == [5] and one[0].ids == library.encode(AWKWARD[5], add_special_tokens=False).ids + [2]


def test_files_of_an_empty_table(spark):
    manifest = token_files.write(awkward(spark).where("1 = 0"), WORDS, end_id=2)
    assert manifest.count() == 0 and token_files.read(manifest).count() == 0


def test_a_damaged_frame_is_told(spark):
    manifest = token_files.write(spark.createDataFrame([(1, "some words to keep")], "doc_id long, text string"), WORDS)
    path = manifest.first().path
    files, base = token_files.shared_filesystem(path)
    raw = bytearray(files.open_input_file(base).read())
    reader = token_files.Reader(files, base)
    raw[int(reader.offsets[1]) + int(reader.entries[1, 0]) - 1] ^= 1
    with files.open_output_stream(base, compression=None) as out:
        out.write(bytes(raw))
    with pytest.raises(Exception):
        token_files.Reader(files, base).document(0)


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    told = langid.identify(docs, langid.fit(docs.where(~langid.held_out()))).collect()
    held = [r for r in told if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) > 20
    assert all(0 <= r.score <= 1 for r in told)


def test_language_on_awkward_rows(spark):
    rows = [(1, "The cat and the dog and the house.", "en"), (2, "Der Hund und die Katze und das Haus.", "de"), (3, None, "en"), (4, "", "de"),
            (5, "12 34 !!", None), (None, "Und der Hund mit der Katze.", None), (1, "The cat and the dog and the house.", "en"), (7, "the " * 40_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'mine' AS score")
    model = langid.fit(docs)
    told = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs, model).collect()]
    assert [t[1] for t in told] == ["en", "de", "und", "und", "und", "de", "en", "en"] and told[2][2] == 0
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and [(r.doc_id, r.score) for r in kept.collect()] == [(1, "mine"), (2, "mine"), (None, "mine"), (1, "mine"), (7, "mine")]
    assert langid.identify(docs.where("1 = 0"), model).count() == 0
    nothing = langid.fit(docs.where("1 = 0"))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    single = langid.fit(docs.where("lang = 'en'"))
    assert [(r.lang_pred, r.score) for r in langid.identify(docs, single).limit(1).collect()] == [("en", 1.0)]


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 12, 40])
def test_codewords_differ(n):
    codes = langid.codewords(n).astype(int)
    assert len({tuple(c) for c in codes}) == n and (abs(codes.sum(0)) < n).all()
    if n >= 4:
        apart = min((a != b).sum() for i, a in enumerate(codes) for b in codes[:i])
        assert apart >= 4


def test_a_wrong_bit_is_mended():
    model = langid.Model(["a", "b", "c", "d"], langid.codewords(4), np.zeros((1, 7)), np.zeros(7), np.ones(7))
    outputs = model.codes[2].astype(float) * 3
    outputs[1] *= -1
    best, _, unclear = langid.decode(model, np.array([outputs, np.zeros(7)]))
    assert best[0] == 2 and not unclear[0] and unclear[1]


def test_windows_against_brute_force(spark):
    items = [(1, "Alpha beta gamma"), (2, "one two three four five six seven eight nine ten eleven"), (3, None), (4, "..."), (5, "éa Éa"), (2, "zulu"), (None, "yankee xray")]
    texts = ["x alpha, BETA gamma y alpha beta", "zero one two three four five six seven eight nine TEN eleven 12", "two three four five six seven eight nine ten twelve",
             None, "", "Éa éa Éa ÉA", "zulu " * 5000, "yankee-xray", "gamma"]
    docs = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(texts)] + [(0, texts[0], "keep")], "doc_id long, text string, items string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = windows(items)
    for limit in (decontaminate.BLOCK_CHARS, 20):
        got = decontaminate.digest(decontaminate.find(docs, benchmark, limit=limit)).collect()
        assert len(got) == len(texts) + 1
        for r in got:
            n, hit, own = hits(texts[r.doc_id], found)
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(own), bool(hit))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
    clean = decontaminate.remove_documents(docs, benchmark)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [i for i, t in enumerate(texts) if not hits(t, found)[1]]
    cut = {r.doc_id: (r.text, r["items"]) for r in decontaminate.remove_spans(docs, benchmark).collect()}
    assert cut[0] == ("x  y alpha beta", "keep") and cut[3] == (None, "keep") and cut[1] == ("zero  12", "keep") and cut[8] == ("gamma", "keep")
    assert decontaminate.find(docs, benchmark.where("1 = 0")).where("size(hits) > 0").count() == 0
    assert decontaminate.find(docs.where("1 = 0"), benchmark).count() == 0


def test_decontamination_of_the_sample(spark):
    items = pq.read_table(f"{SAMPLE}/benchmark.parquet").to_pylist()
    found = windows([(r["item_id"], r["text"]) for r in items])
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    got = decontaminate.digest(decontaminate.find(docs, spark.read.parquet(f"{SAMPLE}/benchmark.parquet"))).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        n, hit, own = hits(texts[r.doc_id], found)
        assert (r.n_words, r.n_hit, r.n_items) == (n, len(hit), len(own))

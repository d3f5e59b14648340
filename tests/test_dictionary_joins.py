"""Dictionaries meet the texts by joins: no task holds one whole."""

from conftest import rows

from seglake.functions import entries as EN


def test_words_meet_entries_by_a_join(spark, monkeypatch):
    def none(*_, **__):
        raise AssertionError("whole words need no block of the dictionary")

    monkeypatch.setattr(EN, "blocks", none)
    monkeypatch.setattr(EN, "SLICE_ROWS", 2)
    docs = spark.createDataFrame([(1, "a cat's cat, a"), (1, "a cat's cat, a"), (2, None), (3, ""), (4, "12 !"), (5, "dog a")], "id long, text string").repartition(1)
    words = spark.createDataFrame([("a", "b"), ("b", "c"), ("cat", "a"), ("cat's", "x"), ("dog", None), ("", "q")], "wrong string, correct string")
    assert sorted(rows(EN.replaced(docs, words, "text", True)), key=str) == sorted([(1, "b x a, b"), (1, "b x a, b"), (2, None), (3, ""), (4, "12 !"), (5, "dog b")], key=str)


def test_keys_inside_words_meet_distinct_runs(spark):
    docs = spark.createDataFrame([(1, "banana ban 9 a.nan"), (2, None), (3, "banana"), (4, "xyz]^-\\ é"), (5, "😀 n")], "id long, text string")
    keys = spark.createDataFrame([("an", "1"), ("ana", "2"), ("n", "3"), ("]^", "4"), ("-\\", "5"), ("😀", "6")], "wrong string, correct string")
    want = [(1, "b2na b1 9 a.31"), (2, None), (3, "b2na"), (4, "xyz45 é"), (5, "6 3")]
    want = [(i, t and t.replace("b2na", "b23a")) for i, t in want]
    for limit in (1, EN.BLOCK_CHARS):
        assert sorted(rows(EN.replaced(docs, keys, "text", False, limit=limit)), key=str) == sorted(want, key=str)
    assert rows(EN.replaced(docs.where("id = 3"), keys.where("1 = 0"), "text", False)) == [(3, "banana")]


def test_glossary_entries_come_once_without_a_shuffle_of_what_was_found(spark):
    docs = spark.createDataFrame([(1, "the İstanbul cat"), (1, "A CAT"), (2, None), (None, "cat"), (None, "cat dog"), (3, "dog")], "id long, text string")
    glossary = spark.createDataFrame([("Cat", "CAT"), ("Cat", "CAT"), ("dog", None), ("", "tac"), ("İ", "x"), ("zz", "the")], "origin string, translation string")
    want = [(1, "Cat", "CAT"), (1, "zz", "the"), (1, "İ", "x"), (None, "Cat", "CAT"), (None, "dog", None), (3, "dog", None)]
    for limit in (60, EN.BLOCK_CHARS):
        got = EN.holding_entries(docs.selectExpr("id", "lower(text) AS low"), glossary, "id", "low", limit)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_entries_meet_pages_of_rows(spark, monkeypatch):
    """A word that many rows hold meets the entries once for a page of rows, and every row still gets its value."""
    seen = []
    words = EN._words
    monkeypatch.setattr(EN, "_words", lambda *a: seen.append(words(*a)) or seen[-1])
    docs = spark.createDataFrame([(i, f"cat {'dog' if i % 2 else 'ox'} cat") for i in range(3000)], "id long, text string").repartition(1)
    entries = spark.createDataFrame([("cat", "a"), ("dog", "b")], "wrong string, correct string")
    got = rows(EN.replaced(docs, entries, "text", True))
    assert got == [(i, f"a {'b' if i % 2 else 'ox'} a") for i in range(3000)]
    assert seen[0].count() == 3 * 3

"""The language stage takes out texts in none of the learned languages, and no others."""

import pytest

pytest.importorskip("seglake.llm")

from pyspark.sql import functions as F  # noqa: E402

from seglake.llm import langid  # noqa: E402

FOREIGN = [
    "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
    "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다.",
    "4f9a8b2c77de01aa93bc55e0f1d2c3b4a59687786950413223140f5e6d7c8b9a",
]


def test_texts_of_no_learned_language_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    told = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(-1 - i, t, "en") for i, t in enumerate(FOREIGN)], "doc_id long, text string, lang string"))
    kept = {r.doc_id for r in langid.keep_identified(told, model).select("doc_id").collect()}
    assert not kept & {-1 - i for i in range(len(FOREIGN))}
    assert kept == {r.doc_id for r in docs.where(F.col("text").rlike(r"\p{L}")).select("doc_id").collect()}
    short = spark.createDataFrame([(1, "Да.", "en"), (2, "Re.", "en")], "doc_id long, text string, lang string")
    assert langid.keep_identified(short, model).count() == 2

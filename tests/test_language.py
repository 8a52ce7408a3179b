"""The language model on held-out documents and on odd texts."""

import os

import pytest

from corpusq.operators.language import language_model, with_language

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").where("length(text) >= 40")
    found = with_language(docs.where("doc_id % 5 = 0"), language_model(docs.where("doc_id % 5 > 0"))).collect()
    assert len(found) > 100 and sum(r["lang"] == r["detected"] for r in found) >= 0.97 * len(found)


def test_odd_texts(spark):
    taught = spark.createDataFrame([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("x", None), (None, "de"), ("...", "en")], "text string, lang string")
    model = language_model(taught, most_runs=15)
    assert {r["lang"] for r in model.collect()} == {"en", "de"} and model.where("run IS NULL").count() == 2
    asked = spark.createDataFrame([(1, "The Dog"), (2, "UND DIE"), (3, None), (4, "12 !"), (5, "日本 😀")], "id int, text string")
    got = {r["id"]: r["detected"] for r in with_language(asked, model).collect()}
    assert got[1] == "en" and got[2] == "de" and got[5] in ("en", "de")
    assert with_language(asked.limit(0), model).count() == 0
    none = language_model(taught.limit(0))
    assert {r["detected"] for r in with_language(asked, none).collect()} == {None}

"""Python functions take a batch apart in slices, so that their memory doesn't follow the length of texts."""

import pyarrow as pa
import pytest

from corpusq.operators import extract as E
from corpusq.operators import language as L
from corpusq.sources import readers as R
from corpusq.sources import shared
from pyspark.sql import functions as F
from pyspark.sql import types as T


def test_slices_hold_all_rows_in_order():
    rows = ["x" * n for n in (0, 5, 900, 3000, 1, 1, 2000, 700)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(rows), pa.array([[r] * 2 if r else None for r in rows])], ["t", "a"])
    got = list(shared.small([batch, batch.slice(2, 3)], 2500))
    assert [r for b in got for r in b.to_pylist()] == batch.to_pylist() + batch.slice(2, 3).to_pylist()
    assert all(b.num_rows == 1 or b.nbytes <= 2500 for b in got) and len(got) > 4


def test_sections_are_made_slice_by_slice(spark, monkeypatch):
    """A batch of texts of 6 MB is taken apart in several slices, and all rows come out."""
    docs = spark.range(60).repartition(1).select("id", F.concat(F.repeat(F.lit("word "), F.lit(20_000)), "id").alias("t"))
    taken = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: taken.append(f) or self)
    E._mapped(docs, ["t"], "n", T.LongType(), len)
    table = pa.Table.from_pandas(docs.toPandas(), preserve_index=False).combine_chunks()
    made = list(taken[0](iter(table.to_batches())))
    assert {r["id"]: r["n"] for b in made for r in b.to_pylist()} == {i: 100_000 + len(str(i)) for i in range(60)}
    assert len(made) > 2 and all(b.nbytes <= shared.SLICE_BYTES + 1000 for b in made)


def _function(monkeypatch, df, make):
    """The Python function that ``make`` gives to ``mapInArrow``."""

    class Taken(Exception):
        pass

    def take(self, f, schema):
        raise Taken(f)

    monkeypatch.setattr(type(df), "mapInArrow", take)
    with pytest.raises(Taken) as e:
        make()
    return e.value.args[0]


def test_xml_is_parsed_slice_by_slice(spark, monkeypatch):
    docs = spark.createDataFrame([], "id long, xml string")
    xml = [f"<a><b>{i}</b>{'word ' * 20_000}</a>" for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(xml)], ["id", "xml"])
    made = list(_function(monkeypatch, docs, lambda: R.xml_elements(docs, "id", "xml"))(iter([batch])))
    assert [(r["id"], r["texts"][0]) for b in made for r in b.to_pylist()] == [(i, str(i)) for i in range(60)] and len(made) > 2


def test_pages_become_text_slice_by_slice(spark, monkeypatch):
    pages = spark.createDataFrame([], "id long, html string")
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array([f"<b>{i}</b>{' word' * 20_000}" for i in range(60)])], ["id", "html"])
    made = list(_function(monkeypatch, pages, lambda: R.html_text(pages, "id", "html"))(iter([batch])))
    assert [(r["id"], r["text"].split(" ")[0]) for b in made for r in b.to_pylist()] == [(i, str(i)) for i in range(60)] and len(made) > 2


def test_runs_are_counted_and_told_slice_by_slice(monkeypatch):
    sizes, whole = [], L._runs
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "fi"] * 30), pa.array([f"{'abc ' * 25_000}{i}" for i in range(60)])], ["lang", "text"])
    monkeypatch.setattr(L, "_runs", lambda t: sizes.append(len(t)) or whole(t))
    made = list(L._counts(iter([batch])))
    total = {}
    for b in made:
        for r in b.to_pylist():
            total[r["lang"]] = total.get(r["lang"], 0) + r["n"]
    assert total == {lang: sum(100_000 + len(str(i)) - 2 for i in range(60) if i % 2 == k) for k, lang in enumerate(("en", "fi"))}
    assert len(made) > 4

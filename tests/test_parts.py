"""Searches part by part: what a part or a task sends on is bounded by its best rows, and the rows stay the same."""

import numpy as np
import pyarrow as pa

from corpusq.operators import parts as P
from corpusq.operators.blocks import prefix_search, top_search
from corpusq.sources.index import TextIndex
from corpusq.sources.shared import shared_path


def _table(texts):
    """A part's postings, a row a term and document."""
    rows = [(w, [i], [len(t.split())], [t.split().count(w)]) for i, t in texts.items() for w in sorted(set(t.split()))]
    return pa.table({"term": [r[0] for r in rows], "ids": pa.array([r[1] for r in rows], pa.list_(pa.int64())), "dls": pa.array([r[2] for r in rows], pa.list_(pa.int32())), "tfs": pa.array([r[3] for r in rows], pa.list_(pa.int32()))})


def test_a_part_sends_its_best_rows_alone():
    texts = {900 - i: "alpha beta" if i % 3 else "alpha alpha gamma" for i in range(300)}
    asked = pa.table({"query_id": [7, 7, 8, 9], "term": ["alpha", "beta", "beta", "none"], "idf": [0.5, 1.0, 1.0, 2.0], "n_terms": [2, 2, 1, 1]})
    got = P._searched(P.any_terms(2.0), 4)(_table(texts), asked).to_pylist()
    both = sorted(i for i, t in texts.items() if "beta" in t)[:4]
    assert {q: sorted(r["id"] for r in got if r["query_id"] == q) for q in (7, 8, 9)} == {7: both, 8: both, 9: []}
    every = P._searched(P.all_terms(2.0), 4)(_table(texts), asked).to_pylist()
    assert sorted((r["query_id"], r["id"]) for r in every) == [(q, i) for q in (7, 8) for i in both]


def test_ties_in_six_digits_go_by_document():
    scores = np.array([1.0000001, 1.0000004, 0.5, 1.0000003, 2.0])
    assert sorted(P.best(np.arange(5), scores, 3)) == [0, 1, 4]


def test_queries_meet_postings_part_by_part(spark, monkeypatch):
    """No posting is joined with the queries: what a search shuffles is a row a block and a part's best rows."""
    monkeypatch.setattr(P, "_searched", lambda scored, k, whole=P._searched: lambda left, right: _noted(whole(scored, k)(left, right), k))

    def _noted(out, k):
        assert max(np.unique(out.column("query_id").to_numpy(), return_counts=True)[1], default=0) <= k
        return out

    texts = [(i, f"etamorphosis common{i % 7} w{i}") for i in range(400)]
    index = TextIndex(spark, shared_path(spark, "index")).add(spark.createDataFrame(texts, "id long, text string"))
    queries = spark.createDataFrame([(q, f"etamorphosis common{q % 7}") for q in range(40)], "query_id int, text string")
    for found in (top_search(queries, index, 3, direct=0), prefix_search(queries, index, 3)):
        got = {}
        for r in found.collect():
            got.setdefault(r["query_id"], set()).add(r["id"])
        assert got == {q: {q % 7, q % 7 + 7, q % 7 + 14} for q in range(40)}

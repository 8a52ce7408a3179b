"""Cover density against brute force over all stretches, with repeated terms, ties and fields."""

import random

import pytest

from corpusq.operators.proximity import APART, cover_density, proximity_search
from corpusq.sources.index import TextIndex
from corpusq.sources.shared import shared_path
from pyspark.sql import functions as F


def brute(hits, n):
    """All stretches from hit to hit that hold all terms and contain no smaller one that does."""
    full = [(i, j) for i in range(len(hits)) for j in range(i, len(hits)) if len({h[1] for h in hits[i : j + 1]}) == n]
    covers = [(i, j) for i, j in full if not any((a, b) != (i, j) and i <= a and b <= j for a, b in full)]
    return sum((j - i + 1) / sum(1 / h[2] for h in hits[i : j + 1]) / (1 + hits[j][0] - hits[i][0] + 1 - (j - i + 1)) for i, j in covers)


def test_cover_density_by_brute_force(spark):
    r, rows = random.Random(8), []
    for i in range(300):
        n = r.randint(1, 4)
        places = sorted(r.sample(range(40), r.randint(0, 14)))
        rows.append((i, n, [(p, r.randrange(n), r.choice([1.0, 0.4, 0.1])) for p in places]))
    df = spark.createDataFrame(rows, "id int, n int, hits array<struct<place:long,term:int,weight:double>>")
    got = {x["id"]: x["s"] for x in df.select("id", cover_density(F.col("hits"), F.col("n")).alias("s")).collect()}
    for i, n, hits in rows:
        assert got[i] == pytest.approx(brute(hits, n), abs=1e-9), (n, hits)


def test_fields_weights_and_ties(spark):
    titles = {1: "alpha beta", 2: "alpha", 3: "other", 4: "Alpha, beta!", 5: None}
    texts = {1: "gamma", 2: "beta x x alpha", 3: "alpha beta alpha beta", 4: "gamma", 5: "alpha x beta"}
    make = lambda t: TextIndex(spark, shared_path(spark, "index")).add(spark.createDataFrame(list(t.items()), "id long, text string"))
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, None)], "query_id int, text string")
    got = [tuple(x) for x in proximity_search(queries, {"title": make(titles), "text": make(texts)}, 4).orderBy(F.desc("score"), "id").collect()]
    hits = {i: sorted([(p + f * APART, ["alpha", "beta"].index(w), weight) for f, (t, weight) in enumerate(((titles, 1.0), (texts, 0.1))) for p, w in enumerate((t[i] or "").lower().replace(",", "").replace("!", "").split()) if w in ("alpha", "beta")]) for i in titles}
    want = sorted(((1, i, round(brute(h, 2), 6), len({p // APART for p, _, _ in h})) for i, h in hits.items()), key=lambda x: (-x[2], x[1]))[:4]
    assert got == want and got[0][2] == got[1][2] and [x[1] for x in got[:2]] == [1, 4]


def test_common_terms_meet_no_query_by_themselves(spark):
    """Documents with a query's common terms alone are not put together with it, in whatever field they stand."""
    texts = {i: "alpha beta" + (" rare" if i == 5 else "") for i in range(300)}
    titles = {i: "rare" if i == 9 else "alpha" for i in range(300)}
    make = lambda t: TextIndex(spark, shared_path(spark, "index")).add(spark.createDataFrame(list(t.items()), "id long, text string"))
    queries = spark.createDataFrame([(q, "alpha beta rare") for q in range(40)] + [(99, "alpha beta unknown")], "query_id int, text string")
    found = proximity_search(queries, {"title": make(titles), "text": make(texts)}, 400)
    assert {(r["query_id"], r["id"], r["n_fields"]) for r in found.collect()} == {(q, i, 2) for q in range(40) for i in (5, 9)}
    asked = found.inputFiles()
    wanted = spark.read.parquet(*[f for f in asked if "wanted-terms" in f])
    assert wanted.count() == 40 * 2 * 3


def test_parts_give_the_same_rows(spark, monkeypatch):
    """Many queries part by part, in small slices, give the rows of one table, with ids of either type, replaced documents and
    queries of the same terms; a document and query that meet are no row of any table."""
    from corpusq.operators import proximity as X

    r = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    text = lambda most: " ".join(r.choices(words, range(12, 0, -1), k=r.randint(0, most)))
    queries = spark.createDataFrame([(q, " ".join(r.sample(words, 1 + q % 4))) for q in range(60)] + [(100 + q, "w1 w0 w2") for q in range(30)] + [(200, "w0 none"), (201, None)], "query_id int, text string")
    monkeypatch.setattr(X, "LOOKED", 50)
    for kind in ("long", "string"):
        ids = [i if kind == "long" else f"d{i}" for i in range(150)]
        make = lambda most: TextIndex(spark, shared_path(spark, "index")).add(spark.createDataFrame([(i, text(most)) for i in ids], f"id {kind}, text string")).add(spark.createDataFrame([(i, text(most)) for i in ids[:20]], f"id {kind}, text string"))
        fields = {"title": make(4), "text": make(30)}
        direct = proximity_search(queries, fields, 5, form="plain", direct=1 << 40)
        parts = proximity_search(queries, fields, 5, form="plain", direct=0)
        want = sorted(tuple(x) for x in direct.collect())
        assert sorted(tuple(x) for x in parts.collect()) == want and parts.columns == direct.columns and parts.dtypes == direct.dtypes
        assert {q for q, *_ in want} >= {100 + q for q in range(30)} and {f for *_, f in want} == {1, 2}
        assert not any("wanted-terms" in f for f in parts.inputFiles())


def test_a_part_sends_its_best_rows_alone():
    """What leaves a part doesn't grow with the documents that hold a set's terms."""
    import pyarrow as pa
    from corpusq.operators.proximity import _looked_into

    n = 500
    left = pa.table({"t": [t for t in (3, 8) for _ in range(n)], "id": [i for _ in range(2) for i in range(n)], "field": pa.array([0] * 2 * n, pa.int8()), "places": pa.array([[t] if i % 2 else [t, t + 9] for t in (0, 1) for i in range(n)], pa.list_(pa.int32()))})
    right = pa.table({"set": [1, 2, 3], "terms": pa.array([[3, 8], [8], [3, 9]], pa.list_(pa.int64()))})
    got = _looked_into(4, [0.5])(left, right).to_pylist()
    assert [(x["set"], x["id"]) for x in got] == [(2, 0), (2, 2), (2, 4), (2, 6), (1, 0), (1, 2), (1, 4), (1, 6)] and {x["score"] for x in got if x["set"] == 2} == {1.0}

"""Registered queries against their SQL in DuckDB on the smallest tables, and the rest against small models."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from corpusq.plans import registry  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tools.compare import TABLES, rows  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cur = duck.execute(registry.oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize(("name", "texts"), [("e11_sufficiency", ["", "", " \n ", "\n\n", None, None]), ("e9_e10_sections", ["", "", " \n ", "\n\n"])])
def test_sections_of_blank_texts(spark, tmp_path, name, texts):
    """Blank texts with even and odd ids have their section, which is empty."""
    texts = [*texts, "a" * 197, "a" * 197, "a" * 196, "a" * 3797, "b" * 3796]  # at the least coverage and below it
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cur = con.execute(registry.oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns[:3] == ["query_id", "pos", "id"]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_approximate_vectors_recall(spark, sf):
    """The query as it is registered against the ten exact neighbours of each query, whatever their similarity."""
    from corpusq.operators.retrieval import vector_search

    e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    exact = vector_search(e.where("id % 50 = 0").withColumnRenamed("id", "query_id"), e, 10, -2.0)
    want = {(r["query_id"], r["id"]): r["score"] for r in exact.collect()}
    got = {(r["query_id"], r["id"]): r["score"] for r in registry.queries()["r15_approximate_vectors"](spark, f"/root/testdata/{sf}").collect()}
    assert len(got) == len(want) and len(want.keys() & got) >= 0.95 * len(want)
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want.keys() & got)


def test_vector_index_follows_groups(spark, monkeypatch):
    """Vectors in 200 groups: eight cells of 64 hold all neighbours; cells and their queries in small parts; vectors that
    can't be compared are left out."""
    import numpy as np
    from corpusq.operators.retrieval import vector_search
    from corpusq.sources import vectors
    from corpusq.sources.shared import shared_path

    monkeypatch.setattr(vectors, "CELL_ROWS", 20)
    monkeypatch.setattr(vectors, "CELL_QUERIES", 3)
    r = np.random.default_rng(3)
    centres = r.normal(size=(200, 24))
    rows = [(i, (centres[i % 200] + 0.15 * r.normal(size=24)).tolist()) for i in range(3_000)]
    schema = "id long, embedding array<double>"
    good = spark.createDataFrame(rows, schema)
    odd = spark.createDataFrame([(9_000, None), (9_001, []), (9_002, [1.0]), (9_003, [0.0] * 24), (9_004, [None] * 24)], schema)
    index = vectors.VectorIndex(spark, shared_path(spark, "vectors")).build(good.unionByName(odd))
    assert index.rows().count() == 3_001
    queries = good.where("id % 60 = 0").withColumnRenamed("id", "query_id")
    want = {tuple(x) for x in vector_search(queries, good, 10, -2.0).select("query_id", "id").collect()}
    got = {tuple(x) for x in index.search(queries, 10, probes=8).select("query_id", "id").collect()}
    assert len(want & got) >= 0.95 * len(want)
    assert index.search(odd.withColumnRenamed("id", "query_id").where("query_id <> 9003"), 10).count() == 0
    with pytest.raises(ValueError):
        vectors.VectorIndex(spark, shared_path(spark, "vectors")).build(odd.where("id < 9002"))


def whole_table(spark, name, columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]


def gathered(paragraphs, limit, overlap):
    """Chunks of paragraphs by the rule alone: as many as fit, and before them those of the last chunk that fit in the overlap."""
    size = lambda ps: sum(len(p) + 2 for p in ps)
    chunks, own = [], []
    for p in paragraphs:
        if own and size(own) + len(p) + 2 > limit:
            chunks.append(own)
            own = next(own[k:] for k in range(len(own) + 1) if size(own[k:]) <= overlap)
        own = [*own, p]
    return ["\n\n".join(c) for c in [*chunks, own]]


def test_sub_chunks_by_brute_force(spark):
    got = {}
    for i, k, t in [tuple(r) for r in registry.queries()["c1_sub_chunks"](spark, SF).orderBy("doc_id", "chunk").collect()]:
        got.setdefault(i, []).append(t)
    for i, t in whole_table(spark, "documents", ["doc_id", "text"]):
        own = t.replace("\n", "\n\n")
        assert got[i] == (gathered(own.split("\n\n"), 2000, 200) if len(own) > 2000 else [own])


def test_section_rows_by_brute_force(spark):
    import re

    from corpusq.plans.documents import decisions

    rows = {}
    for r in registry.queries()["c2_section_rows"](spark, SF).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    docs = decisions(spark, SF).collect()
    assert set(rows) == {r["doc_id"] for r in docs if r["text"] or r["doc_id"] % 10}
    for r in docs:
        own = sorted(rows.get(r["doc_id"], []), key=lambda x: x["section_number"])
        assert [x["section_number"] for x in own] == list(range(1, len(own) + 1))
        if r["doc_id"] % 10 == 0:
            parts = gathered(r["text"].split("\n\n"), 2000, 200) if len(r["text"]) > 2000 else [r["text"]]
            want = [("reasoning", f"Full Text Part {k + 1}/{len(parts)}", "medium", p) for k, p in enumerate(parts)]
        else:
            cut = re.split(r"(?m)^(Background of the matter|Reasoning|Judgment)\s*$", r["full_text"])
            want = []
            for title, content in zip(cut[1::2], cut[2::2]):
                content = content.strip()
                parts = gathered(content.split("\n\n"), 2000, 200) if len(content) > 2000 else [content]
                kind = {"Background of the matter": "background"}.get(title, title.lower())
                want += [(kind, title + (f" (Part {k + 1}/{len(parts)})" if len(parts) > 1 else ""), "high", p) for k, p in enumerate(parts) if content]
        assert [(x["section_type"], x["section_title"], x["priority"]) for x in own] == [w[:3] for w in want]
        for x, w in zip(own, want):
            head = f"[{r['doc_id']}] {r['source']}\n" + ("" if x["priority"] == "medium" else f"Section: {w[1].split(' (Part')[0]}\n") + f"Keywords: {r['lang']}\nJurisdiction: Lower court: {r['source']}\n"
            assert x["content"].startswith(head) and x["content"].endswith("\n\n" + w[3])


def test_section_chunks_by_brute_force(spark):
    got = {}
    for r in registry.queries()["c5_c6_section_chunks"](spark, SF).orderBy("doc_id", "chunk").collect():
        got.setdefault(r["doc_id"], []).append((r["number"], r["text"], r["merged"]))
    for i, t in whole_table(spark, "documents", ["doc_id", "text"]):
        want = []
        for k, line in enumerate(t.split("\n")):
            w, n = line.split(), str(k + 1)
            if len(w) > 200:
                want += [(f"{n} (part {j + 1})", " ".join(w[180 * j : 180 * j + 200]), []) for j in range(-(-len(w) // 180))]
            elif len(w) < 40 and want:
                want[-1] = (want[-1][0], want[-1][1] + "\n\n" + line, want[-1][2] + [n])
            else:
                want.append((n, line, []))
        assert got[i] == want


def test_embedding_by_brute_force(spark):
    import numpy as np
    import regex
    import xxhash

    texts = {(c, t): x for c, t, x in whole_table(spark, "conversations", ["conv_id", "turn", "text"])}
    for r in registry.queries()["c7_embedding"](spark, SF).collect():
        v = np.zeros(64)
        for w in regex.findall(r"[\p{L}\p{N}]+", texts[r["conv_id"], r["turn"]][:8000].lower()):
            v[xxhash.xxh64_intdigest(w.encode(), seed=42) % 64] += 1
        if v.any():
            assert np.allclose(r["embedding"], v / np.linalg.norm(v), atol=1e-6)
        else:
            assert r["embedding"] is None


def test_html_text_by_brute_force(spark):
    import html
    import re

    pages = dict(whole_table(spark, "pages", ["page_id", "html"]))
    blocks = "p|div|br|li|tr|h[1-6]|title|article|nav|ul|table"
    for r in registry.queries()["s8_html_text"](spark, SF).collect():
        t = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", "", pages[r["page_id"]])
        t = html.unescape(re.sub(r"<[^>]*>", "", re.sub(rf"(?i)</?(?:{blocks})\b[^>]*>", "\n", t)))
        assert r["text"].split() == t.split() and "\n\n\n" not in r["text"]

"""Column functions, query forms, fusion and chunking on small tables."""

import random

from corpusq.functions import scalars as S
from corpusq.functions import terms as N
from corpusq.operators import chunk as C
from corpusq.operators import extract as E
from corpusq.operators import filters as P
from corpusq.operators import fusion as X
from corpusq.operators import relational as R
from pyspark.sql import functions as F


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_dates(spark):
    got = column(spark, ["2024-01-02", "1.2.2024", " 01.02.2024 ", "1.2.30", "1.2.31", None, "", "-", "garbage", "31.2.2024"], S.iso_date)
    assert got == ["2024-01-02", "2024-02-01", "2024-02-01", "2030-02-01", "1931-02-01", None, None, None, None, "2024-02-31"]


def test_case_ids(spark):
    texts = ["KKO:2022:18", "kko 2022:18 and KKO:2022:18", "KHO 2023 5", "KKO:1983-II-124", "C-311/18, T-123/20", "ECLI:EU:C:2024:123", "Application no. 12345/06", "none", None, ""]
    assert column(spark, texts, S.case_ids) == [
        ["KKO:2022:18"], ["KKO:2022:18"], ["KHO:2023:5"], ["KKO:1983:124", "KKO:1983-II-124"], ["C-311/18", "T-123/20"], ["ECLI:EU:C:2024:123"], ["12345/06"], [], [], [],
    ]


def test_year_ranges(spark):
    texts = ["2010-2020", "from 1927 to 1926", "between 2010 and 2012", "cases in 2015", "2026", "1700", "KKO 2024-76", None]
    assert [tuple(x) if x else None for x in column(spark, texts, S.year_range)] == [(2010, 2020), (1926, 1927), (2010, 2012), (2015, 2015), (2026, 2026), (None, None), (None, None), (None, None)]


def test_query_forms(spark):
    assert column(spark, ["onko vai?", None], N.or_query) == ["", ""]
    assert column(spark, ["vahingonkorvaus", "vuokra ja korvaus sopimus"], N.and_terms) == [[], ["korvaus", "sopimus", "vuokra"]]
    got = column(spark, ["oikeuspaikkasäännös", "oikeuspaikkasäännös vuokra", "vuokra", ""], N.prefix_query)
    assert got == ["( oikeuspaikkasäännös | oikeuspai:* | oikeuspaikka:* | oikeuspaikkasää:* )", "( oikeuspaikkasäännös | oikeuspai:* | oikeuspaikka:* | oikeuspaikkasää:* ) | vuokra", "vuokra", ""]


def test_filters_fall_back(spark):
    hits = spark.createDataFrame([(1, 1, "supreme_court"), (1, 2, "cjeu"), (1, 3, None), (2, 4, "cjeu")], "query_id int, id int, court_type string")
    assert sorted(r["id"] for r in P.by_court(hits, ["KKO"]).collect()) == [1, 3, 4]
    years = spark.createDataFrame([(1, "1999"), (2, "x"), (3, None), (4, "2001")], "id int, case_year string")
    assert sorted(r["id"] for r in P.by_years(years, 2000, None).collect()) == [2, 3, 4]


def test_rrf(spark):
    a = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.5)], "query_id int, id int, score double")
    b = spark.createDataFrame([(1, 11, 7.0), (1, 12, 7.0)], "query_id int, id int, score double")
    got = {r["id"]: (round(r["rrf_score"], 6), r["channel"], r["score"]) for r in X.rrf({"a": a, "b": b}).collect()}
    assert got == {10: (round(1 / 61, 6), "a", 0.9), 11: (round(1 / 62 + 1 / 61, 6), "a", 0.5), 12: (round(1 / 62, 6), "b", 7.0)}
    assert X.rrf({"a": a.limit(0), "b": b.limit(0)}).count() == 0


def capped(rows, per_case, top_k, exempt):
    """The cap as a loop."""
    if len(rows) <= 2:
        return rows[:top_k]
    out, seen = rows[:2], {}
    for r in out:
        seen[r[1]] = seen.get(r[1], 0) + 1
    for r in rows[2:]:
        if len(out) >= top_k:
            break
        if r[1] in exempt or seen.get(r[1], 0) < per_case:
            out = [*out, r]
            seen[r[1]] = seen.get(r[1], 0) + 1
    return out


def test_diversity_cap_is_the_loop(spark):
    r = random.Random(3)
    lists = {q: [(i, r.choice("abcd")) for i in range(r.randint(0, 14))] for q in range(60)}
    rows = [(q, i, c) for q, xs in lists.items() for i, c in xs]
    hits = spark.createDataFrame(rows, "query_id int, id int, c string")
    for top_k, per_case in ((1, 2), (5, 1), (8, 3)):
        got = X.diversity_cap(hits, [F.col("id")], F.col("c"), per_case, top_k, F.col("c") == "d").collect()
        for q, xs in lists.items():
            assert [x["id"] for x in sorted((x for x in got if x["query_id"] == q), key=lambda x: x["pos"])] == [i for i, _ in capped(xs, per_case, top_k, {"d"})]


def test_earlier_is_strictly_earlier(spark):
    r = random.Random(5)
    rows = [(k, r.randint(1, 4), i, float(i)) for k in range(4) for i in range(k * 10, k * 10 + 9)]
    df = spark.createDataFrame(rows, "k int, t int, id int, v double")
    for x in R.earlier(df, ["k"], "t", "id", "v", 3).collect():
        want = sorted(((t, i) for k, t, i, _ in rows if k == x["k"] and t < x["t"]), reverse=True)[:3]
        assert [(e["time"], e["id"]) for e in x["earlier"]] == want


def test_sections_and_votes(spark):
    text = "Intro\nReasoning\nabc\nBackground of the matter\nzz\nTuomiolauselma\nend"
    got = [(s["type"], s["content"]) for s in E.split_text(text)]
    assert got == [("reasoning", "abc"), ("background", "zz"), ("judgment", "end")]
    overlapping = {s["type"]: s["content"] for s in E.split_text("Judgment\na\nReasoning\nb", "reference")}
    assert overlapping == {"judgment": "a\nReasoning\nb", "reasoning": "b"}
    votes = column(spark, ["Äänestys 6-1", "Vote 4-2-1", "Asian ovat ratkaisseet oikeusneuvokset Anna Ek, Bo Aho (eri mieltä) ja Cia Oja. Esittelijä X", "none"], E.vote)
    assert [tuple(v) if v else None for v in votes] == [(7, 1, "6-1"), (7, 2, "4-2-1"), (3, 1, "2-1"), None]


def test_outcomes(spark):
    texts = ["Tuomiolauselma\nTuomio kumotaan ja palautetaan", "Päätöslauselma\nValitus HYLÄTÄÄN", "hylätään", None]
    assert column(spark, texts, S.outcome) == ["overturned_and_remanded", "dismissed", None, None]


def test_paragraph_chunks():
    assert C.paragraph_chunks(None) == [""]
    assert C.paragraph_chunks("short") == ["short"]
    text = "\n\n".join(f"p{i} " + "x" * 50 for i in range(12))
    got = C.paragraph_chunks(text, 200, 60)
    assert all(len(c) <= 260 for c in got)
    assert all(b.startswith(a.split("\n\n")[-1]) for a, b in zip(got, got[1:]))
    assert C.paragraph_chunks("y" * 300 + "\n\nz", 100, 10) == ["y" * 300, "z"]


def test_section_sizes():
    parts = [{"number": "1", "text": "w " * 250}, {"number": "2", "text": "short"}]
    got = C.sized_sections(parts, 100, 50, 10)
    assert [x["number"] for x in got] == ["1 (part 1)", "1 (part 2)", "1 (part 3)"]
    assert got[-1]["merged"] == ["2"] and got[-1]["text"].endswith("short")


def test_constraints(spark):
    df = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "id int, kind string")
    good, bad = P.quarantined(df, {"kind": F.col("kind").isin("a", "b")})
    assert sorted(r["id"] for r in good.collect()) == [1, 3]
    assert [(r["id"], r["reasons"]) for r in bad.collect()] == [(2, ["kind"])]

"""Extraction from made decisions: each pattern, order, fallback and limit."""

import pytest

from corpusq.operators import extract as E
from corpusq.sources import readers as I
from pyspark.sql import functions as F


def each(spark, texts, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in rows.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


PROVISIONS = [
    ("RL 46 1", ["RL 46 luku 1 §"]), ("Chapter 3, Section 5 a", ["Luku 3 § 5"]), ("TSL 7 luvun 2 §", ["TSL 7 luku 2 §", "7 luku 2 §"]), ("OK 17 luvun 1 §", ["OK 17 luku 1 §", "17 luku 1 §"]),
    ("vahingonkorvauslain 5 luvun 2 §", ["vahingonkorvauslain 5 luku 2 §", "5 luku 2 §"]), ("osakeyhtiölain 12 §", ["osakeyhtiölain 1 luku 2 §", "lain 12 §"]), ("5 luvun 3 §:n", ["5 luku 3 §"]), ("lain 12 §:ssä", ["1 luku 2 §", "lain 12 §"]),
    ("HE 44/2002 vp", ["HE 44/2002 vp"]), ("PL § 10", ["PL § 10"]), ("Directive 2020/60/EU", ["Directive 2020/60/EU"]), ("Regulation (EU) No 1301/2013", ["Regulation (EU) No 1301/2013"]), ("Law no. 123/2020", ["Law 123/2020"]), ("C-123/45", ["C-123/45"]),
]


@pytest.mark.parametrize("text,want", PROVISIONS)
def test_each_provision(spark, text, want):
    assert set(want) <= set(each(spark, [text], E.provisions)[0])


def test_provisions_are_few_and_short(spark):
    many = ", ".join(f"HE {i}/2001 vp" for i in range(60)) + ", HE 3/2001 vp"
    found = each(spark, [many], E.provisions)[0]
    assert found == [f"HE {i}/2001 vp" for i in range(30)]
    applied = each(spark, ["HE 9/1990 vp\nPerustelut\nHE 1/2001 vp\nPäätös\nHE 2/2001 vp", "HE 9/1990 vp\nKORKEIN OIKEUS\nHE 3/2001 vp", many, "", None], E.applied_provisions)
    assert applied[:2] == ["HE 1/2001 vp", "HE 3/2001 vp"] and len(applied[2]) <= 800 and not applied[3]


def test_provision_report(spark):
    r = each(spark, ["RL § 46 and TFEU Article 101, European Convention; Laki No 1/2020", "none"], E.provision_report)
    assert {"RL § 46", "TFEU Article 101", "European Convention", "Laki No 1/2020"} <= set(r[0]["provisions"]) and r[0]["statutes"] == ["RL"]
    assert r[0]["provisions"] == sorted(r[0]["provisions"]) and r[1]["confidence"] == 0 and r[0]["confidence"] == pytest.approx(0.15 + len(r[0]["provisions"]) / 10)


def test_votes(spark):
    texts = [
        "Vote 5-2. Äänestys 6-1", "Voting 3–2", "Ratkaisuun osallistuneet: presidentti A Ek, oikeusneuvokset B Ask, C Ola ja D Uus\n\nEri mieltä olevien jäsenten lausunnot\nOikeusneuvos Ask: x\nOikeusneuvos Ola: y",
        "Ratkaisuun osallistuneet: Eko sekä Ask", "x. The case has been resolved by President Anna Ek, Bo Ask and Cia Oja. Rapporteur Eva. Statement of dissenting member", "none", "", None,
    ]
    got = [tuple(v) if v else None for v in each(spark, texts, E.vote)]
    assert got == [(7, 1, "6-1"), (5, 2, "3-2"), (4, 2, "2-2"), (2, 0, "2-0"), (3, 1, "2-1"), None, None, None]


def test_courts(spark):
    text = "a b\nHelsinki District Court judgment of 18.10.2021 no. 21/489\nTurku Court of Appeal judgment 18 October 2022 no. 1234 x"
    assert [tuple(x) for x in each(spark, [text], E.lower_court)] == [("Helsinki", "18.10.2021", "21/489")]
    assert [tuple(x) for x in each(spark, [text], E.appeal_court)] == [("Turku", "18 October 2022", "1234")]
    assert tuple(each(spark, ["word " * 200_000], E.lower_court)[0]) == (None, None, None)


def test_phrases_in_the_order_of_the_text(spark):
    text = "Vaikka yleensä näin on tehty. Poikkeuksena tilanteissa, joissa muuta on sovittu. Vaikka yleensä näin on tehty. Ratkaisevaa oli se mitä tapahtui. Siltä osin."
    assert each(spark, [text], E.exceptions) == ["Vaikka yleensä näin on tehty. | Poikkeuksena tilanteissa, joissa muuta on sovittu."]
    assert each(spark, [text], E.distinctive_facts) == ["Ratkaisevaa oli se mitä tapahtui."]
    long = " ".join(f"Rajoituksena {i} {'x' * 200}." for i in range(20))
    assert len(each(spark, [long], E.exceptions)[0]) <= 2000


def test_excerpts(spark):
    old = "ECLI:FI\nTiivistelmä asiasta on tässä kappaleessa.\n\nKKO\n" + "perustelu " * 10 + "\nAsian ovat ratkaisseet x"
    new = "Perustelut\nkoska   näin\nPäätöslauselma\nTuomio\n pysyy."
    keyed = "Asiasanat\nx\nTapausvuosi\n2001\n\nEnsimmäinen varsinainen kappale, joka on tarpeeksi pitkä.\n\nz"
    assert each(spark, [new, old, "x"], E.reasoning_excerpt) == ["koska näin", ("perustelu " * 10).strip(), ""]
    assert each(spark, [new, old, keyed, "x"], E.ruling_instruction) == ["Tuomio pysyy.", "Tiivistelmä asiasta on tässä kappaleessa.", "Ensimmäinen varsinainen kappale, joka on tarpeeksi pitkä.", ""]


def test_markers_out_of_order(spark):
    rows = spark.createDataFrame([(1, "p" * 120 + "\nOn those grounds\nz\nLegal framework\nw"), (2, "p\nTHE LAW\nx\nFOR THESE REASONS\ny"), (3, "none"), (4, None)], "i int, t string")
    kinds = lambda df: {r["i"]: [x["type"] for x in r["sections"]] for r in df.collect()}
    assert kinds(E.cjeu_sections(rows, "t"))[1] == ["background", "operative_part", "legal_framework"]
    assert kinds(E.echr_sections(rows, "t")) == {1: ["reasoning"], 2: ["law", "operative_part"], 3: ["reasoning"], 4: []}


def test_backfills(spark):
    rows = spark.createDataFrame([("Asian tausta ja kysymyksenasettelu: x Eri mieltä y", None, None), ("(Ään.)", False, ""), ("Eri mieltä z", True, ""), ("Eri mieltä z", True, "own"), ("x", None, None)], "t string, f boolean, d string")
    got = [tuple(r["x"]) for r in rows.select(E.dissent(F.col("t"), F.col("f"), F.col("d")).alias("x")).collect()]
    assert got == [(True, "Eri mieltä y"), (True, ""), (True, "Eri mieltä z"), (True, "own"), (False, None)]
    assert [r["b"] for r in rows.select(E.background(F.col("t")).alias("b")).collect()][:2] == [": x Eri mieltä y", None]


XML = """<?xml version="1.0"?><akn:akomaNtoso xmlns:akn="http://a" xmlns:finlex="http://f"><akn:meta><FRBRWork><FRBRdate name="dateIssued" date="2020-01-02"/><FRBRdate date="2020-02-03" name="datePublished"/></FRBRWork>
<finlex:isInForce value="True"/></akn:meta><akn:act><akn:preface><akn:docTitle>Laki <b>eräs</b></akn:docTitle></akn:preface><akn:preamble><akn:block name="insertions">uusi 2 §</akn:block><akn:block name="repeals"> </akn:block></akn:preamble>
<akn:body><akn:section><akn:num>1 §</akn:num><akn:heading>Määritelmät</akn:heading><akn:p>a &amp; b</akn:p><akn:p>c</akn:p></akn:section><akn:section><akn:heading>no number</akn:heading></akn:section>
<akn:entryIntoForce>Tulee voimaan</akn:entryIntoForce><akn:a href="x.PDF">f</akn:a><akn:a href="x.PDF">g</akn:a><affectedDocument href="/1"/><affectedDocument href="/2">muutossäädös 5</affectedDocument></akn:body>
<hcontainer name="attachments"><hcontainer name="attachment"><heading>Liite 1</heading><content><p>p1</p><table><tr><td>a</td><td> b </td></tr><tr><td>c</td><td></td></tr></table></content></hcontainer></hcontainer></akn:act></akn:akomaNtoso>"""


def test_statute_xml(spark):
    docs = spark.createDataFrame([(1, XML), (2, "<open>"), (3, None), (4, "<a><body><section><num>3 §</num><p>t</p></section></body></a>")], "i int, x string")
    got = {r["i"]: r.asDict(recursive=True) for r in I.statutes(docs, "i", "x").collect()}
    r = got[1]
    assert r["title"] == "Laki eräs" and r["text"].startswith("Laki eräs uusi 2 § 1 § Määritelmät a & b c")
    assert r["sections"] == [{"number": "1 §", "heading": "Määritelmät", "content": "a & b c"}] and r["pdf_links"] == ["x.PDF"]
    assert r["attachments"] == [{"heading": "Liite 1", "content": "p1\n\na | b\nc"}]
    assert r["definitions"] == [{"section": "1 §", "text": "a & b"}, {"section": "1 §", "text": "c"}]
    assert r["references"] == [{"statute": "", "uri": "/1", "type": "referenced"}, {"statute": "muutossäädös 5", "uri": "/2", "type": "amending"}]
    assert r["scope"] == {"issued": "2020-01-02", "published": "2020-02-03", "in_force": True, "entry_into_force": "Tulee voimaan"}
    assert r["amendments"] == {"insertions": ["uusi 2 §"], "repeals": [], "substitutions": [], "modifications": []}
    assert got[2]["title"] is None and got[3]["sections"] is None
    assert got[4]["title"] == "Untitled Document" and got[4]["sections"][0]["number"] == "3 §" and got[4]["scope"]["in_force"] is None


def test_citations_of_many_forms(spark):
    text = (
        "KKO 2001: 5 and kko\n1999:12, KKO 2001:5. See C-12/34 and C-12/34. RL Chapter 3 Section 4 Subsection 2, Rikoslaki 5 6; Luku 7 § 8a. "
        "Council Regulation (EU) No 12/2001 on common rules, then council  regulation (EU) No 5/99. Regulation (EU) 7/2020 and Regulation (EU) No 9/2021 x. "
        "Article 5(2) of the Regulation and Article 6a Council Regulation (EU) No 77/2002 at the end"
    )
    c = each(spark, [text, "", None], E.citations)
    assert c[0]["cases"] == ["KKO:2001:5", "KKO:1999:12"] and c[0]["eu_cases"] == ["C-12/34"]
    assert c[0]["laws"] == ["RL 3:4", "RL 5:6", "Chapter 3 Section 4", "Chapter 7 Section 8a"]
    assert c[0]["regulations"] == ["Council Regulation (EU) No 12/2001 on common rules", "council  regulation (EU) No 5/99", "Regulation (EU) 7/2020", "Regulation (EU) No 9/2021", "Council Regulation (EU) No 77/2002 at the end"]
    assert c[0]["articles"] == ["Article 5(2)", "Article 6a"]
    assert c[1]["cases"] == [] and c[1]["regulations"] == []


NESTED = """<?xml version="1.0" encoding="utf-8"?><!-- <section>no</section> --><a:act xmlns:a="http://a"><a:body><a:section><a:num>1 §</a:num><a:heading>Outer</a:heading><a:p>before</a:p>
<a:section><a:num>1 a §</a:num><a:p>inner <![CDATA[<b> & co]]></a:p></a:section>tail <a:p>after</a:p></a:section><a:p><a:a href="in.pdf"/></a:p></a:body><a:a href="out.pdf"/>
<a:hcontainer name="attachments"><a:hcontainer name="attachment"><a:content><a:table><a:tr><a:td>x<a:table><a:tr><a:td>y</a:td></a:tr></a:table></a:td><a:td>z</a:td></a:tr></a:table>loose<a:p>p<!-- c -->q</a:p></a:content></a:hcontainer></a:hcontainer></a:act>"""


def test_xml_by_structure(spark):
    """Sections within sections, tables in tables, CDATA and comments."""
    docs = spark.createDataFrame([(1, NESTED), (2, "<a><b></a></b>"), (3, ""), (4, "<FRBRWork><body/></FRBRWork>"), (5, "&amp;")], "i int, x string")
    got = {r["i"]: r.asDict(recursive=True) for r in I.statutes(docs, "i", "x").collect()}
    assert got[1]["sections"] == [{"number": "1 §", "heading": "Outer", "content": "before 1 a § inner <b> & co tail after"}, {"number": "1 a §", "heading": None, "content": "inner <b> & co"}]
    assert got[1]["attachments"] == [{"heading": "Liite", "content": "x y | y | z\ny\n\npq"}] and got[1]["pdf_links"] == ["in.pdf"]
    assert all(v is None for i in (2, 3, 5) for k, v in got[i].items() if k != "i")
    assert got[4]["sections"] == [] and got[4]["title"] == "Untitled Document" and got[4]["scope"]["issued"] is None
    e = {r["i"]: r["elements"] for r in I.xml_elements(docs, "i", "x").collect()}
    assert [(x["name"], x["depth"], x["parent"], x["last"]) for x in e[1][:4]] == [("act", 0, -1, 23), ("body", 1, 0, 11), ("section", 2, 1, 9), ("num", 3, 2, 3)]

"""Stems of inflected Finnish words, compounds, and a search that finds inflected forms."""

from corpusq.functions.finnish import stem, stems
from corpusq.functions.terms import tokens
from corpusq.operators.blocks import all_terms_search
from corpusq.operators.language import compounds
from corpusq.sources.index import TextIndex
from corpusq.sources.shared import shared_path
from pyspark.sql import functions as F

#: Forms of words whose stem does not change, by what is put behind them: singular cases, plural cases, clitics.
BACK = "n a na ksi ssa sta lla lta lle tta t ni nsa mme nne kin ko kaan ssako stani llamme".split()
FRONT = "n ä nä ksi ssä stä llä ltä lle ttä t ni nsä mme nne kin kö kään ssäkö stäni llämme".split()
WORDS = {
    "talo": BACK + ["on", "ja", "jen", "issa", "ista", "ihin", "illa", "ilta", "ille", "iksi"],
    "valvonta": [], "laki": [], "hinta": [],
    "katu": [], "pykälä": FRONT + ["än", "ssäkään"], "vuokra": BACK + ["an"], "kauppa": [], "tuomio": BACK + ["on", "ita", "issa", "ista", "ihin", "iden"],
    "päätös": [], "sopimus": [], "seuraamus": [], "korvausvelvollinen": [], "asianajaja": BACK + ["an"], "määräaika": [], "oikeus": [], "kanne": [], "todistaja": BACK + ["an"], "yhtiö": FRONT + ["ön", "itä", "issä", "istä", "ihin", "iden"],
    "hallinto": [], "tutkija": BACK + ["an"], "virkailija": BACK + ["an"], "velallinen": [], "omistaja": BACK + ["an"], "myyjä": FRONT + ["än"], "tekijä": FRONT + ["än"], "kuluttaja": BACK + ["an"], "radio": BACK + ["on", "ita", "issa", "ista"],
}


def test_forms_share_a_stem(spark):
    forms = [(w, w + e) for w, endings in WORDS.items() for e in ["", *endings]]
    assert len(forms) > 250
    got = {r["form"]: r["stem"] for r in spark.createDataFrame(forms, "word string, form string").select("form", stem(F.col("form")).alias("stem")).collect()}
    met = sum(got[f] == got[w] for w, f in forms)
    assert met >= 0.9 * len(forms), [(f, got[f], got[w]) for w, f in forms if got[f] != got[w]][:20]
    # Different words keep different stems.
    assert len({got[w] for w in WORDS}) == len(WORDS)


def test_short_and_odd_words_stay(spark):
    words = ["ja", "on", "12a", "§", "", None, "kko2020", "maa", "työ"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(stem(F.col("w"))).collect()]
    assert got == words


def test_compounds(spark):
    words = ["vahingonkorvaus", "vahingon", "korvaus", "korvausvelvollisuus", "velvollisuus", "oikeus", "oikeusturva", "turva", "vahingonkorvausvelvollisuus", "abc"]
    got = {tuple(r) for r in compounds(spark.createDataFrame([(w,) for w in words], "term string")).collect()}
    assert got == {("vahingonkorvaus", "vahingon", "korvaus"), ("korvausvelvollisuus", "korvaus", "velvollisuus"), ("oikeusturva", "oikeus", "turva"), ("vahingonkorvausvelvollisuus", "vahingonkorvaus", "velvollisuus")}
    assert compounds(spark.createDataFrame([], "term string")).count() == 0


def test_search_by_stems_finds_inflected_forms(spark):
    texts = [(1, "Tuomioistuin katsoi, että vuokralaisen yhtiöllä oli talossa tutkijoita"), (2, "Yhtiön talosta"), (3, "talo ilman muuta")]
    docs = spark.createDataFrame(texts, "id long, text string")
    plain = TextIndex(spark, shared_path(spark, "index")).add(docs)
    stemmed = TextIndex(spark, shared_path(spark, "index")).add(docs, tokens=stems(tokens(F.col("text"))))
    queries = spark.createDataFrame([(1, "yhtiö talo")], "query_id int, text string")
    by_stem = queries.withColumn("text", F.array_join(stems(tokens(F.col("text"))), " "))
    assert all_terms_search(queries, plain, 9).count() == 0
    assert {r["id"] for r in all_terms_search(by_stem, stemmed, 9).collect()} == {1, 2}

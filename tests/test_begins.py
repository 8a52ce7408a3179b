"""Sentences that except or decide are looked for where two of their first letters stand."""

import re

import pytest
from corpusq.functions import legal as P
from corpusq.operators import extract as E
from pyspark.sql import functions as F


@pytest.mark.parametrize(("patterns", "begin"), [(P.EXCEPTIONS, P.EXCEPTIONS_BEGIN), (P.FACTS, P.FACTS_BEGIN)])
def test_all_sentences_begin_with_the_letters(patterns, begin):
    """Each way in which a pattern can begin is one of the pairs."""
    for p in patterns:
        ways = re.match(r"\(\?:([^()]*?)\)", p)
        for way in ways[1].split("|") if ways else [p.removeprefix("(?:")]:
            assert way[1].lower() in begin[way[0].lower()], way


def test_sentences_are_found_in_any_case(spark):
    texts = ["x UNLESS OTHERWISE STATED in these rules of ours. the decisive facts were others than those.", "\u212auitenkin jos tämä ei ole niin kuin luullaan.", "\u017f\u0130ltä osin kuin muuta ei ole sovittu siitä.", "ja TÄMÄ sääntö ei sovellu tällaiseen asiaan lainkaan. kko katsoi, että asia on näin selvä.", "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    plain = [E.phrases(F.col("t"), P.EXCEPTIONS, 20, 2000).alias("a"), E.phrases(F.col("t"), P.FACTS, 15, 1500).alias("b")]
    got = [tuple(r) for r in docs.select(E.exceptions(F.col("t")), E.distinctive_facts(F.col("t"))).collect()]
    assert got == [tuple(r) for r in docs.select(*plain).collect()] and sum(bool(a) + bool(b) for a, b in got) >= 5, got

"""References to provisions are looked for where digits are."""

from corpusq.operators import extract as E
from pyspark.sql import functions as F

FOUND = ["Regulation (EU) No 12/2003", "hallituksen esitys 5/2001 vp", "RL 10 Section 3 Subsection 4", "Chapter 5, Section 7a", "Perustuslaki pykälä 6", "oikeudenkäymiskaaren 17 luvun 3 §", "vesilain 2 §:n", "C-12/18 EEC", "Laki N:o 4/1999", "x7y", "RL § 8:2", "ECHR", "European Convention"]


def test_the_surroundings_of_digits_hold_all_references(spark):
    """The same references as in the whole text, behind and before words in any number; long stretches go."""
    texts = [(i * 100 + n, f"{'sana lain ' * n}{r}{' luvun Section' * (n % 7)} {'sana ' * (n * 3 % 11)}{FOUND[i - 1]} loppu") for i, r in enumerate(FOUND) for n in range(0, 14, 3)]
    texts += [(9000, "sana " * 5000 + "HE 3/2001 vp" + " sana" * 5000), (9001, ""), (9002, None)]
    docs = spark.createDataFrame(texts, "id int, t string")
    whole = F.struct(E._provisions(F.col("t"), 30).alias("p"), E._report(F.col("t"), F.regexp_extract_all("t", F.lit(E.P.ANY_PROVISION[-1]), F.lit(0))).alias("r"))
    got = docs.select("id", whole.alias("whole"), F.struct(E.provisions(F.col("t")).alias("p"), E.provision_report(F.col("t")).alias("r")).alias("near"), F.length(E.near_digits(F.col("t"))).alias("n")).collect()
    assert all(r["whole"] == r["near"] for r in got) and sum(len(r["near"]["p"] or []) for r in got) > 100
    assert {r["id"]: r["n"] for r in got}[9000] < 2000

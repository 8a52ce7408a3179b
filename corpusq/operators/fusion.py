"""Ranked lists into one: fusion, blending, boosts and caps, for all queries at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from corpusq.functions import scalars as S
from corpusq.operators.relational import top_per_key
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that the share of query words leaves out, and words of conditions. Fixed values.
PLAIN_WORDS = ["milloin", "mitä", "miten", "miksi", "missä", "voiko", "voidaan", "onko", "oliko", "pitää", "täytyy", "kuuluu", "mukaan", "että"]
CONDITION_WORDS = ["jos", "kun", "saattaa todennäköiseksi", "on myönnettävä", "voi jäädä", "lopulliseksi", "riittämättömiksi", "näin on asia"]
#: How much boosts weigh by what a query asks about; other queries have 1.5. Fixed values.
BOOST_WEIGHTS = {"statute_interpretation": 2.5, "conditions": 2.0}


def ranked(hits: DataFrame, by: Sequence[str] = ("query_id",), score: str = "score", rank: str = "rank") -> DataFrame:
    """Adds each row's place in its list."""
    return hits.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), "id")))


def rrf(channels: Mapping[str, DataFrame], k: int = 60) -> DataFrame:
    """query_id, id, rrf_score, score, channel: the sum of 1 / (k + rank) over all channels; score and channel are those of the first channel that has the row."""
    lists = [ranked(hits.select("query_id", "id", "score")).withColumns({"channel": F.lit(name), "_no": F.lit(i)}) for i, (name, hits) in enumerate(channels.items())]
    union = reduce(lambda a, b: a.unionByName(b), lists)
    fused = union.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf_score"), F.min_by(F.struct("score", "channel"), "_no").alias("_first"))
    return fused.select("query_id", "id", "rrf_score", F.col("_first.score").alias("score"), F.col("_first.channel").alias("channel"))


def with_named_cases(fused: DataFrame, named: DataFrame) -> DataFrame:
    """query_id, pos, id, rrf_score, channel: fused hits, and behind them those on cases that a query names, unless they
    are among them (R17)."""
    more = named.select("query_id", "id").distinct().join(fused.select("query_id", "id").hint("merge"), ["query_id", "id"], "left_anti")
    both = fused.select("query_id", "id", "rrf_score", "channel").unionByName(more.withColumns({"rrf_score": F.lit(None).cast("double"), "channel": F.lit("case_id")}))
    w = Window.partitionBy("query_id").orderBy(F.col("rrf_score").desc_nulls_last(), "id")
    return both.select("query_id", F.row_number().over(w).alias("pos"), "id", "rrf_score", "channel")


def rerank(hits: DataFrame, scorer: Column, first: int, order: str) -> DataFrame:
    """Adds ``rerank_score`` to the first rows of each list; others are left out."""
    return top_per_key(hits, ["query_id"], [F.col(order).desc(), F.col("id")], first).withColumn("rerank_score", scorer)


def overlap_score(query_words: Column, text: Column) -> Column:
    """The share of a query's words that a text holds: the scorer where no other is given."""
    n = F.size(query_words)
    return F.coalesce(F.round(F.try_divide(F.size(F.filter(query_words, lambda w: F.contains(F.lower(text), w))), n), 6), F.lit(0.0))


def base_score(score: Column) -> Column:
    """What a hit counts where reranking is off: its score, 0.3 without one."""
    return F.when(score.isNull() | (score == 0), 0.3).otherwise(score)


def blend(hits: DataFrame, k: int = 60, prior: str = "score") -> DataFrame:
    """Adds ``blended``: 1 / (k + rank by rerank_score) + 1 / (k + rank by ``prior``)."""
    both = ranked(ranked(hits, score="rerank_score", rank="_r1"), score=prior, rank="_r2")
    return both.withColumn("blended", F.round(1.0 / (k + F.col("_r1")) + 1.0 / (k + F.col("_r2")), 9)).drop("_r1", "_r2")


def query_words(query: Column) -> Column:
    """Words of a query of four letters or more that say something."""
    return F.array_distinct(F.filter(F.split(F.trim(F.lower(query)), r"\s+"), lambda w: (F.length(w) >= 4) & ~w.isin(PLAIN_WORDS)))


def title_boost(title: Column, words: Column) -> Column:
    """1.3 or 1.6 where the first six letters of two, or of more, words stand in the title."""
    n = F.size(F.filter(words, lambda w: (F.length(w) >= 6) & F.contains(F.lower(title), F.left(w, F.lit(6)))))
    return F.when(F.coalesce(title, F.lit("")) == "", 1.0).when(n >= 3, 1.6).when(n == 2, 1.3).otherwise(1.0)


def exact_boost(query: Column, text: Column, case_id: Column, section: Column, title: Column) -> Column:
    """The product of the boosts for what query and text have in common (R22): statutes, chapters, items, case ids,
    conditions, words and roots of the title."""
    q, t = F.lower(F.coalesce(query, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    named = lambda c: F.transform(F.regexp_extract_all(c, F.lit(S.STATUTE + r"\b"), F.lit(0)), F.upper)
    statute = F.arrays_overlap(named(query), named(text))
    places = F.regexp_extract_all(q, F.lit(r"(\d+\s+luvun\s+\d+)\s*§"), F.lit(1))
    place = F.exists(places, lambda p: F.regexp(t, F.concat(F.lit(r"\b"), F.regexp_replace(p, r"\s+", r"\\s+"), F.lit(r"\b"))) | F.regexp(t, F.concat(F.lit(r"\b"), F.regexp_replace(p, r"\s+luvun\s+", r"\\s+§\\s*:\\s*"), F.lit(r"\b"))) | F.regexp(t, F.concat(F.lit(r"chapter\s+"), F.regexp_replace(p, r"\s+luvun\s+", r".*section\\s+"))))
    item = F.nullif(F.regexp_extract(q, r"(\d+)\s+kohd(?:an|a)\b", 1), F.lit(""))
    same_item = item.isNotNull() & t.rlike(S.CHAPTER_SECTION) & F.regexp(t, F.concat(F.lit(r"\b"), item, F.lit(r"\s+kohd(?:an|a)\b")))
    mentioned = F.array_contains(F.transform(S.case_ids(query), F.upper), F.upper(F.coalesce(case_id, F.lit(""))))
    asks = q.rlike("milloin|missä tapauksessa|edellyty")
    reasons = F.lower(section).isin("reasoning", "perustelut")
    conditions = sum((F.contains(t, F.lit(w)).cast("int") for w in CONDITION_WORDS), F.lit(0)) >= 3
    words = query_words(query)
    share = F.try_divide(F.size(F.filter(words, lambda w: F.contains(t, w))), F.size(words))
    on = lambda test, x: F.when(F.coalesce(test, F.lit(False)), x).otherwise(1.0)
    product = on(statute, 2.0) * on(place, 2.0) * on(same_item, 1.8) * on(mentioned, 1.5) * on(asks & reasons, 1.4) * on(asks & conditions, 1.3)
    return product * F.when(share >= 0.5, 1 + share * 0.5).otherwise(1.0) * title_boost(title, words)


def boosted(score: Column, boost: Column, kind: Column) -> Column:
    """A score times boost^(m - 1), m by what the query asks about."""
    m = F.lit(1.5)
    for name, w in BOOST_WEIGHTS.items():
        m = F.when(kind == name, w).otherwise(m)
    return score * F.pow(boost, m - 1)


def diversity_cap(hits: DataFrame, order: Sequence[Column], case: Column, per_case: int, top_k: int, exempt: Column | None = None) -> DataFrame:
    """The first two rows of each list, then rows whose case has fewer than ``per_case`` so far or is exempt, up to
    ``top_k`` (W6). Adds ``pos``. A list of two rows or fewer is only cut at ``top_k``."""
    q = Window.partitionBy("query_id")
    h = hits.withColumn("_case", F.coalesce(case, F.lit(""))).withColumn("_pos", F.row_number().over(q.orderBy(*order)))
    h = h.withColumns({"_n": F.count("*").over(q), "_nth": F.row_number().over(Window.partitionBy("query_id", "_case").orderBy("_pos"))})
    keep = (F.col("_pos") <= 2) | (F.col("_nth") <= per_case) | (F.coalesce(exempt, F.lit(False)) if exempt is not None else F.lit(False))
    h = h.where(keep).withColumn("pos", F.row_number().over(q.orderBy("_pos")))
    return h.where(F.col("pos") <= F.when(F.col("_n") <= 2, top_k).otherwise(max(top_k, 2))).drop("_case", "_pos", "_n", "_nth")


def with_alternatives(hits: DataFrame, mode: str = "reference") -> DataFrame:
    """Hits of a query's wordings (query_id, alt_no, id, score, rrf_score) as one list: the best of each id by score,
    or with mode ``rrf`` by rrf_score (R18)."""
    by = F.col("score" if mode == "reference" else "rrf_score")
    best = hits.groupBy("query_id", "id").agg(F.max_by(F.struct("score", "rrf_score", "alt_no"), F.struct(by, -F.col("alt_no"))).alias("x"))
    return best.select("query_id", "id", "x.*")


def contexts(hits: DataFrame, label: Column, text: Column, most: int = 1200) -> DataFrame:
    """query_id, context: the texts of a list in order, each under its label (R26). A list is bounded by its top-k."""
    part = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] "), label, F.lit("\n"), F.left(text, F.lit(most)))
    gathered = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos"), part.alias("part")))).alias("parts"))
    return gathered.select("query_id", F.array_join(F.transform("parts", lambda x: x["part"]), "\n\n").alias("context"))


def retried(queries: DataFrame, hits: DataFrame, attempts: Column, most: int = 2) -> DataFrame:
    """Queries without a hit that may be asked once more in other words."""
    return queries.where(attempts < most).join(hits.select("query_id").distinct(), "query_id", "left_anti")

"""Search in a stored index: blocks that can't change the result are left unread."""

from __future__ import annotations

from corpusq.functions import terms as N
from corpusq.operators.parts import SLACK, all_terms, any_terms, part_search, patterns_met
from corpusq.operators.relational import top_per_key
from corpusq.operators.retrieval import K1, B, query_terms
from corpusq.sources.index import TextIndex
from corpusq.sources.shared import written
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Postings of all queries up to which they are scored in one table.
DIRECT = 1_000_000
#: A range of documents of a query.
PLACE = ["query_id", "segment", "range"]


def idf(df: Column, n_docs: int) -> Column:
    return F.log(1 + (F.lit(n_docs) - df + 0.5) / (df + 0.5))


def bm25(tf: Column, dl: Column, df: Column, n_docs: int, mean_dl: float) -> Column:
    return idf(df, n_docs) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(mean_dl)))


def asked_blocks(asked: DataFrame, index: TextIndex, k: int = 0) -> DataFrame:
    """The blocks of the terms of ``asked`` (query_id, term, n_terms, and df where it is known), read from the index once: query_id, n_terms, term,
    df, lead, segment, range, n, bound, postings. ``bound`` is the most that a posting of the block can count, by its
    greatest tf and least length. ``lead`` is true for a query's rarest terms until they have ``k`` documents."""
    terms = asked.select("term").distinct()
    buckets = index.buckets(terms)
    before = F.sum("df").over(Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1))
    known = asked if "df" in asked.columns else asked.join(index.terms(terms, buckets), "term")
    asked = written(known.withColumn("lead", F.coalesce(before, F.lit(0)) < k), "asked-terms")
    blocks = index.blocks(asked.select("term").distinct(), buckets).select("segment", "term", "range", "n", "top_tf", "least_dl", "postings")
    bound = bm25(F.col("top_tf"), F.col("least_dl"), F.col("df"), index.n_docs(), index.mean_dl())
    return written(asked.join(blocks, "term").withColumn("bound", bound).drop("top_tf", "least_dl"), "asked-blocks")


def _scored(index: TextIndex, blocks: DataFrame) -> DataFrame:
    """query_id, segment, range, id, n_terms, weight of the live postings of ``blocks`` (rows of ``asked_blocks``)."""
    weight = bm25(F.col("tf"), F.col("dl"), F.col("df"), index.n_docs(), index.mean_dl())
    return index.exploded(blocks).select(*PLACE, "id", "n_terms", weight.alias("weight"))


def chosen_blocks(blocks: DataFrame, index: TextIndex, k: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The blocks of ``asked_blocks`` that must be looked into for the ``k`` best of any term (R3), and their postings
    (of ``_scored``), each in three parts.

    The leading terms' blocks are all looked into. In each range of documents, a candidate's score is at most what it
    has so far and the bounds of the other terms' blocks there. The ranges of the 2 ``k`` most promising candidates come
    next; the k-th score among their documents is one that the result's last row has at least. Of the other ranges,
    those follow where that score can be reached, by a candidate or by a document that only the other terms hold. The
    rest is never taken apart, scored or shuffled."""
    own, rest = blocks.where("lead"), blocks.where("NOT lead")
    found = written(_scored(index, own), "lead-postings")
    held = found.groupBy(*PLACE, "id").agg(F.sum("weight").alias("score")).groupBy(*PLACE).agg(F.max("score").alias("score"))
    others = rest.groupBy(*PLACE).agg(F.sum("bound").alias("others"))
    ranges = held.join(others.hint("merge"), PLACE, "full").select(*PLACE, "score", "others", (F.coalesce("score", F.lit(0.0)) + F.coalesce("others", F.lit(0.0))).alias("reach"))
    ranges = written(ranges, "range-bounds")
    best = top_per_key(ranges.where("score IS NOT NULL"), ["query_id"], [F.desc("reach"), F.col("segment"), F.col("range")], 2 * k).select(*PLACE)
    second = rest.join(best.hint("merge"), PLACE, "left_semi")
    more = written(_scored(index, second), "best-postings")
    whole = found.join(best.hint("merge"), PLACE, "left_semi").unionByName(more).groupBy("query_id", "id").agg(F.sum("weight").alias("score"))
    least = top_per_key(whole, ["query_id"], [F.desc("score"), F.col("id")], k, rank="nth").where(F.col("nth") == k).select("query_id", F.col("score").alias("least"))
    open_ = ranges.where("others IS NOT NULL").join(best.hint("merge"), PLACE, "left_anti").join(least.hint("merge"), "query_id", "left")
    open_ = open_.where(F.col("least").isNull() | (F.col("reach") + SLACK >= F.col("least"))).select(*PLACE)
    third = rest.join(open_.hint("merge"), PLACE, "left_semi")
    return [own, second, third], [found, more, _scored(index, third)]


def top_search(queries: DataFrame, index: TextIndex, k: int, text_col: str = "text", direct: int = DIRECT) -> DataFrame:
    """query_id, id, score: the ``k`` best texts with any of a query's key terms by BM25 (R3). Where queries have more than
    ``direct`` postings together, they are scored part by part of the index; the rows are the same."""
    asked = known_terms(queries, index, text_col, "or")
    if (asked.agg(F.sum("df")).first()[0] or 0) > direct:
        return part_search(asked.select("query_id", "term", idf(F.col("df"), index.n_docs()).alias("idf")), index, k, any_terms(index.mean_dl()))
    found = _scored(index, asked_blocks(asked, index, k))
    found = found.groupBy("query_id", "id").agg(F.round(F.sum("weight"), 6).alias("score"))
    return top_per_key(found, ["query_id"], [F.desc("score"), F.col("id")], k)


def known_terms(queries: DataFrame, index: TextIndex, text_col: str, form: str) -> DataFrame:
    """query_id, n_terms, term, df: the terms of queries that the index has."""
    asked = written(query_terms(queries, text_col, form), "query-terms")
    terms = asked.select("term").distinct()
    return written(asked.join(index.terms(terms, index.buckets(terms)), "term"), "known-terms")


def all_terms_search(queries: DataFrame, index: TextIndex, k: int | None, form: str = "and", text_col: str = "text", direct: int = DIRECT) -> DataFrame:
    """query_id, id, score, n_terms: texts with all of a query's terms by BM25 (R4, R9), the ``k`` best or all.

    Queries with a term that no text holds are left out by the dictionary. The ranges of documents where a query's rarest
    term has a block are looked up for its other terms, by the blocks' places alone; postings are read only where each
    term has a block. So a query costs what its rarest term has, however common the others are. Where the ``k`` best are
    asked for and queries have more than ``direct`` postings together, they are scored part by part of the index."""
    known = known_terms(queries, index, text_col, form)
    whole = known.groupBy("query_id").agg(F.count("*").alias("met"), F.first("n_terms").alias("n_terms")).where("met = n_terms").select("query_id")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("df", "term"))
    asked = written(known.join(whole.hint("merge"), "query_id").withColumn("nth", nth), "asked-terms")
    if k is not None and (asked.agg(F.sum("df")).first()[0] or 0) > direct:
        found = part_search(asked.select("query_id", "term", "n_terms", idf(F.col("df"), index.n_docs()).alias("idf")), index, k, all_terms(index.mean_dl()))
        return found.join(asked.where("nth = 1").select("query_id", "n_terms").hint("merge"), "query_id")
    terms = written(asked.select("term").distinct(), "terms")
    blocks = index.blocks(terms, index.buckets(terms))
    at = blocks.select("segment", "range", "term")
    ranges = asked.where("nth = 1").select("query_id", "term").join(at, "term").drop("term").distinct()
    wanted = ranges.join(asked.select("query_id", "n_terms", "term").hint("merge"), "query_id")
    shared = wanted.join(at.hint("merge"), ["segment", "range", "term"]).groupBy(*PLACE).agg(F.count_distinct("term").alias("n_blocks"), F.first("n_terms").alias("n_terms")).where("n_blocks = n_terms")
    wanted = written(shared.select(*PLACE).join(asked.select("query_id", "n_terms", "df", "term").hint("merge"), "query_id"), "shared-ranges")
    light = F.transform("postings", lambda p: F.struct(p["id"].alias("id"), p["dl"].alias("dl"), p["tf"].alias("tf")))
    found = _scored(index, blocks.select("segment", "range", "term", light.alias("postings")).join(wanted, ["segment", "range", "term"]))
    found = found.groupBy("query_id", "id").agg(F.round(F.sum("weight"), 6).alias("score"), F.count("*").alias("matched"), F.first("n_terms").alias("n_terms"))
    found = found.where("matched = n_terms").select("query_id", "id", "score", "n_terms")
    return found if k is None else top_per_key(found, ["query_id"], [F.desc("score"), F.col("id")], k)


def prefix_search(queries: DataFrame, index: TextIndex, k: int, text_col: str = "text") -> DataFrame:
    """Texts that meet the prefix form of a query (R6): all of its groups, or any of the further terms; the score is the
    number of patterns met. A pattern is looked up in the index's dictionary once, whatever queries have it, by those of
    a term's prefixes that have a pattern's length; postings of terms that meet no pattern are not read. Queries meet
    them part by part of the index."""
    p = queries.select("query_id", F.explode(N.prefix_patterns(F.col(text_col))).alias("p")).select("query_id", "p.*").distinct()
    # No word has an asterisk.
    p = written(p.select("query_id", "group", "is_prefix", "pattern", F.concat("pattern", F.when(F.col("is_prefix"), "*").otherwise("")).alias("key")), "query-patterns")
    keys, terms = p.select("key", "pattern", "is_prefix").distinct(), index.terms().select("term")
    begin = F.explode(F.sequence(F.lit(N.LEAST_PREFIX), F.length("term")))
    by_prefix = terms.where(F.length("term") >= N.LEAST_PREFIX).select("term", begin.alias("n")).select("term", F.left("term", F.col("n")).alias("pattern"))
    met = by_prefix.join(keys.where("is_prefix").hint("merge"), "pattern").select("key", "term")
    met = met.unionByName(terms.withColumn("pattern", F.col("term")).join(keys.where("NOT is_prefix").hint("merge"), "pattern").select("key", "term"))
    met = written(met, "met-terms")
    need = p.groupBy("query_id").agg(F.max("group").alias("n_groups"))
    asked = written(p.select("query_id", F.col("key").alias("term"), "group").join(need.hint("merge"), "query_id"), "asked-patterns")
    return part_search(asked, index, k, patterns_met, met)

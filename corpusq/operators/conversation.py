"""Conversations as tables of turns: context of a question, histories, titles and feedback."""

from __future__ import annotations

from corpusq.functions import scalars as S
from corpusq.operators.relational import top_per_key
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Replies that lift a filter by years. Fixed values.
ALL_YEARS = ["all years", "any year", "kaikki vuodet", "alla år"]


def last_messages(turns: DataFrame, n: int) -> DataFrame:
    """The last ``n`` turns of each conversation."""
    return top_per_key(turns, ["conv_id"], [F.col("turn").desc()], n)


def titles(turns: DataFrame, n: int = 80) -> DataFrame:
    """The first user message of each conversation, cut."""
    user = F.col("role") == "user"
    return turns.groupBy("conv_id").agg(F.left(F.min_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))), F.lit(n)).alias("title"))


def latest_matching(turns: DataFrame, test: Column, name: str) -> DataFrame:
    """The last message of each conversation that meets a test."""
    return turns.groupBy("conv_id").agg(F.max_by(F.when(test, F.col("text")), F.when(test, F.col("turn"))).alias(name))


def history(turns: DataFrame, n: int = 6, most: int = 500) -> DataFrame:
    """The last messages as one text with the speakers' names, each cut."""
    line = F.concat(F.initcap("role"), F.lit(": "), F.left("text", F.lit(most)))
    kept = last_messages(turns, n).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("x"))
    return kept.select("conv_id", F.array_join(F.transform("x", lambda m: m["line"]), "\n").alias("history"))


def resolved_queries(turns: DataFrame, topic_words: list[str]) -> DataFrame:
    """The question that the last user message of each conversation stands for (Q1): a reply of years alone is asked
    of the last topic before it, a short question without years takes those of an earlier message, and "all years"
    lifts them. Returns conv_id, query, first, last."""
    user = turns.where("role = 'user'").withColumn("r", S.year_range(F.col("text")))
    last = user.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"), F.max_by("r", "turn").alias("r"))
    before = user.select("conv_id", F.col("turn").alias("t"), F.col("text").alias("x"), F.col("r").alias("y")).join(last.select("conv_id", "turn"), "conv_id").where("t < turn")
    topic, dated = S.any_of(F.col("x"), topic_words), F.col("y.first").isNotNull()
    known = before.groupBy("conv_id").agg(F.max_by(F.when(topic, F.col("x")), F.when(topic, F.col("t"))).alias("topic"), F.max_by(F.when(dated, F.col("y")), F.when(dated, F.col("t"))).alias("years"))
    j = last.join(known, "conv_id", "left")
    only_years = F.col("r.first").isNotNull() & (F.length(F.trim("text")) <= 20) & ~S.any_of(F.col("text"), topic_words)
    lifted = S.any_of(F.col("text"), ALL_YEARS)
    years = F.when(lifted, None).otherwise(F.coalesce(F.when(F.col("r.first").isNotNull(), F.col("r")), F.when(F.length("text") < 80, F.col("years"))))
    return j.select("conv_id", F.when((only_years | lifted) & F.col("topic").isNotNull(), F.col("topic")).otherwise(F.col("text")).alias("query"), years["first"].alias("first"), years["last"].alias("last"))


def saved(stored: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """Conversations after an owner has saved some; those of others can't be replaced (Q2)."""
    own = new.where(F.col("user_id") == owner)
    theirs = stored.where(F.col("user_id") != owner).select("id")
    own = own.join(theirs, "id", "left_anti")
    return stored.join(own.select("id"), "id", "left_anti").unionByName(own.select(*stored.columns))


def deleted(stored: DataFrame, ids: DataFrame, owner: str) -> DataFrame:
    """Conversations without those of ``ids`` that the owner has (Q2, Q3)."""
    return stored.join(ids.select("id").withColumn("user_id", F.lit(owner)), ["id", "user_id"], "left_anti")


def ratings(feedback: DataFrame) -> DataFrame:
    """Ratings by day (Q3)."""
    return feedback.groupBy(F.to_date("created_at").alias("day"), "rating").agg(F.count("*").alias("n"))


def next_step(intent: Column, n_results: Column, attempts: Column, most: int = 2) -> Column:
    """Where a question goes by its intent and results (Q4)."""
    return F.when(intent != "legal_search", "answer").when(F.coalesce(n_results, F.lit(0)) > 0, "reason").when(F.coalesce(attempts, F.lit(0)) < most, "reformulate").otherwise("give_up")


def asks_for_years(text: Column) -> Column:
    """Whether to ask for years: the question names no case and no year (Q5)."""
    return (F.size(S.case_ids(text)) == 0) & S.year_range(text)["first"].isNull()


def document_analysis(hits: DataFrame, queries: DataFrame, pattern: str) -> DataFrame:
    """Whether a question is about an own document: it says so, and one is among its hits (Q6)."""
    own = hits.groupBy("query_id").agg(F.bool_or(F.col("case_id").startswith("CLIENT:")).alias("_own"))
    j = queries.join(own, "query_id", "left")
    return j.select("query_id", (F.coalesce("_own", F.lit(False)) & F.col("text").rlike(pattern)).alias("document_analysis"))

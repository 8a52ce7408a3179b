"""Counts, coverage and health reports of a corpus, each in one pass over its table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def statistics(df: DataFrame, keys: Sequence[str], year: str, precedent: Column) -> DataFrame:
    """Rows, first and last year and precedents of each key (A2)."""
    return df.groupBy(*keys).agg(F.count("*").alias("total"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count_if(precedent).alias("precedents"))


def coverage(df: DataFrame, present: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """How many rows have each column filled."""
    measures = [F.count("*").alias("total"), *[F.count_if(test).alias(name) for name, test in present.items()]]
    return df.groupBy(*keys).agg(*measures)


def health(tracking: DataFrame) -> DataFrame:
    """Status counts, documents and failures over a tracking table (A5)."""
    s = F.col("status")
    return tracking.agg(
        *[F.count_if(s == x).alias(x) for x in ("completed", "in_progress", "partial", "pending")],
        F.sum("total").alias("documents"), F.sum("failed").alias("failed"), F.sum(F.greatest(F.lit(0), F.col("total") - F.col("processed"))).alias("remaining"),
    )


def percent(part: Column, total: Column, digits: int) -> Column:
    """part / total in per cent; null without a total."""
    return F.round(F.try_divide(part * F.lit(100.0), F.nullif(total, F.lit(0))), digits)


def distinct_list(c: str, separator: str = ", ") -> Column:
    """The distinct values of a column, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(c)), separator)


def outcome(df: DataFrame, status: str = "status") -> DataFrame:
    """Totals by outcome and the share of success."""
    s = F.col(status)
    out = df.agg(F.count("*").alias("total"), F.count_if(s == "ok").alias("successful"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "skipped").alias("skipped"))
    return out.withColumn("success_rate", percent(F.col("successful"), F.col("total"), 2))


def term_counts(df: DataFrame, id_col: str, text_col: str, terms: Sequence[str]) -> DataFrame:
    """id, term, n: how often each term stands as a word of letters in each text."""
    words = F.split(text_col, r"[^\p{L}]+")
    same = lambda t: lambda w: w == t
    n = [F.struct(F.lit(t).alias("term"), F.size(F.filter(words, same(F.lit(t)))).alias("n")) for t in terms]
    return df.select(id_col, F.explode(F.array(*n)).alias("x")).select(id_col, "x.term", F.col("x.n").cast("long").alias("n")).where("n > 0")

"""Predicates of retrieval and of table constraints, as columns and DataFrame filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Court names that a filter accepts for each alias. Fixed values.
COURT_ALIASES: Mapping[str, Sequence[str]] = {
    "KKO": ["supreme_court"],
    "KHO": ["supreme_administrative_court"],
    "CJEU": ["cjeu"],
    "GC": ["general_court"],
    "ECHR": ["echr"],
    "EU": ["cjeu", "general_court", "echr"],
}


def visible_to(tenant: Column, principal: str | None) -> Column:
    """Rows without a tenant are shared; others are seen by their tenant alone."""
    return tenant.isNull() | (F.lit(principal).isNotNull() & (tenant == F.lit(principal)))


def owned_by(df: DataFrame, tenant_col: str, principal: str) -> DataFrame:
    """Row security: a principal reads and changes own rows only."""
    return df.where(F.col(tenant_col) == principal)


def optional_filters(df: DataFrame, equal: Mapping[str, object] | None = None, least: Mapping[str, object] | None = None, most: Mapping[str, object] | None = None, contains: Mapping[str, object] | None = None) -> DataFrame:
    """Keeps rows that meet all given conditions; a condition whose value is None is off."""
    tests = [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    tests += [F.col(c) >= v for c, v in (least or {}).items() if v is not None]
    tests += [F.col(c) <= v for c, v in (most or {}).items() if v is not None]
    tests += [F.array_contains(c, v) for c, v in (contains or {}).items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def or_all(df: DataFrame, keep: Column, by: str | Sequence[str]) -> DataFrame:
    """Rows of each group that meet ``keep``; groups of which none does keep all their rows (the fallback of P5, P6).

    A group is a query's result list, which top-k bounds."""
    keys = [by] if isinstance(by, str) else list(by)
    w = Window.partitionBy(*keys)
    return df.withColumn("_keep", F.coalesce(keep, F.lit(False))).withColumn("_any", F.max("_keep").over(w)).where("_keep OR NOT _any").drop("_keep", "_any")


def by_court(hits: DataFrame, courts: Sequence[str], court_col: str = "court_type", by: str = "query_id", aliases: Mapping[str, Sequence[str]] = COURT_ALIASES) -> DataFrame:
    """Hits of the courts named or of none, with the fallback (P5)."""
    if not courts:
        return hits
    allowed = sorted({x for c in courts for x in aliases.get(c, [c])})
    court = F.col(court_col)
    return or_all(hits, court.isNull() | (court == "") | court.isin(allowed), by)


def by_domain(hits: DataFrame, domains: Sequence[str], words_col: str = "keywords", by: str = "query_id") -> DataFrame:
    """Hits that share a domain regardless of case, or name none, with the fallback."""
    if not domains:
        return hits
    words = F.coalesce(F.col(words_col), F.array().cast("array<string>"))
    wanted = F.array(*[F.lit(d.lower()) for d in domains])
    return or_all(hits, (F.size(words) == 0) | F.arrays_overlap(F.transform(words, F.lower), wanted), by)


def by_years(hits: DataFrame, start: int | None, end: int | None, year_col: str = "case_year") -> DataFrame:
    """Hits of the years given, both included, or of no year; without a fallback."""
    year = F.expr(f"try_cast(`{year_col}` AS int)")
    test = year.isNull()
    inside = F.lit(True)
    if start is not None:
        inside = inside & (year >= start)
    if end is not None:
        inside = inside & (year <= end)
    return hits.where(test | inside)


def missing(c: Column | str, kind: str = "string") -> Column:
    """NULL, blank text or an empty array."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.size(c), F.lit(0)) <= 0 if kind == "array" else c.isNull() | (F.trim(c) == "")


def changed(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def safe_pattern(c: Column) -> Column:
    """An identifier without the characters that mean something in patterns (P10)."""
    return F.regexp_replace(c, r"[^A-Za-z0-9:/ \-]", "")


def valid_tenant(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[a-zA-Z0-9_\-]+$"), F.lit(False))


def quarantined(df: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet all checks, and the others with the names of those they break as ``reasons``."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in checks.items()]))
    tagged = df.withColumn("reasons", reasons)
    return tagged.where(F.size("reasons") == 0).drop("reasons"), tagged.where(F.size("reasons") > 0)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count as ``n``."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose reference names no parent; a null reference is none."""
    keys = parent.select(F.col(parent_key).alias(child_key))
    return child.where(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def meaningful(text: Column, markers: Sequence[str]) -> Column:
    """100 characters or more, and under 300 not all of the boilerplate's markers."""
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    boiler = reduce(lambda a, b: a & b, [F.contains(F.lower(text), F.lit(m)) for m in markers]) if markers else F.lit(False)
    return (n >= 100) & ~((n < 300) & F.coalesce(boiler, F.lit(False)))


def first_given(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def recent(df: DataFrame, date_col: str, as_of: str, days: int) -> DataFrame:
    """Rows of the last days before a given day."""
    return df.where(F.col(date_col) >= F.date_sub(F.lit(as_of).cast("date"), days))

"""Joins, ranked selections and set operations of the corpus tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in the given order, which must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank or "_rank", F.row_number().over(w)).where(F.col(rank or "_rank") <= n)
    return ranked if rank else ranked.drop("_rank")


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One whole row of each key, the greatest in ``order``: an aggregate that tasks begin before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in others])


def expected_and_actual(plan: DataFrame, rows: DataFrame, keys: Sequence[str], expected: str) -> DataFrame:
    """Expected and actual counts of each planned key and their difference."""
    actual = rows.groupBy(*keys).agg(F.count("*").alias("actual"))
    joined = plan.select(*keys, F.col(expected).alias("expected")).join(actual, list(keys), "left")
    return joined.withColumn("actual", F.coalesce("actual", F.lit(0))).withColumn("difference", F.col("expected") - F.col("actual"))


def related(cases: DataFrame, id_col: str = "case_id", cited_col: str = "cited_cases") -> DataFrame:
    """source, related: cases that cite each other in either direction, without repeats or self-citations.

    Two equi-joins over citation edges; a join on "either cites the other" would compare all pairs."""
    edges = cases.select(F.col(id_col).alias("source"), F.explode(cited_col).alias("related")).where("source != related").distinct()
    known = cases.select(F.col(id_col).alias("related")).distinct()
    forth = edges.join(known.hint("merge"), "related", "left_semi").select("source", "related")
    return forth.union(forth.select(F.col("related"), F.col("source"))).distinct()


def keyed_lookup(keys: DataFrame, rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows whose first column of ``columns`` equals the key; keys not found there are looked up in the next."""
    out, rest = None, keys
    for c in columns:
        found = rest.join(rows.withColumn(key, F.col(c)) if c != key else rows, key)
        out = found if out is None else out.unionByName(found)
        rest = rest.join(rows.select(F.col(c).alias(key)).distinct(), key, "left_anti")
    return out


def unchanged_skipped(new: DataFrame, stored: DataFrame, key: str, hash_col: str = "content_hash") -> DataFrame:
    """New rows whose hash isn't the stored one."""
    old = stored.select(key, F.col(hash_col).alias("_stored"))
    return new.join(old, key, "left").where(~F.col(hash_col).eqNullSafe(F.col("_stored"))).drop("_stored")


def earlier(df: DataFrame, by: Sequence[str], time_col: str, id_col: str, value_col: str, n: int = 5) -> DataFrame:
    """Adds ``earlier``: value, time and id of the last ``n`` rows of a strictly earlier time, newest first.

    The window's frame ends before the row's own time. Only a bounded tail of the frame is kept: rows are ranked by
    time first, and each takes the n rows that stand before the first one of its own time."""
    order = Window.partitionBy(*by).orderBy(time_col, id_col)
    placed = df.withColumn("_row", F.row_number().over(order)).withColumn("_first", F.min("_row").over(Window.partitionBy(*by, time_col)))
    item = F.struct(F.col(time_col).alias("time"), F.col(id_col).alias("id"), F.col(value_col).alias("value"))
    marked = placed.withColumn("_items", F.array(*[F.lag(item, k).over(order) for k in range(1, n + 1)]))
    # The n rows before the first of its own time are those that the first row of that time sees.
    firsts = marked.where(F.col("_row") == F.col("_first")).select(*by, time_col, F.filter("_items", lambda x: x.isNotNull()).alias("earlier"))
    return df.join(firsts, [*by, time_col])


def fill_missing(base: DataFrame, detail: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``base`` with empty columns taken from ``detail``."""
    extra = detail.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = base.join(extra, key, "left")
    return joined.select(*[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_new_{c}")).alias(c) if c in columns else F.col(c) for c in base.columns])


def counts_of(parent: DataFrame, key: str, children: Mapping[str, DataFrame]) -> DataFrame:
    """``parent`` with the number of rows of each child table, 0 where there is none."""
    for name, child in children.items():
        parent = parent.join(child.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return parent


def priority_union(lists: Sequence[DataFrame], keys: Sequence[str], position: str) -> DataFrame:
    """All lists one behind the other; of rows with the same key the first stays (U2). Adds ``list_no``."""
    out = None
    for i, x in enumerate(lists):
        x = x.withColumn("list_no", F.lit(i))
        out = x if out is None else out.unionByName(x)
    return top_per_key(out, keys, [F.col("list_no"), F.col(position)])


def best_score(hits: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Of rows with the same key that of the highest score."""
    return latest_by_key(hits, keys, F.col(score))

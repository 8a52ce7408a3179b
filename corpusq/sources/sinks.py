"""Sinks: snapshots with upserts, replaced children, cascaded deletes and incremental exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upserted(stored: DataFrame, new: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """Stored rows without those that have new ones, and the new ones: of several with a key the last in ``order``."""
    if order is not None:
        others = [c for c in new.columns if c not in keys]
        best = new.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_row"))
        new = best.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in stored.columns])
    return stored.join(new.select(*keys), list(keys), "left_anti").unionByName(new.select(*stored.columns))


def children_replaced(stored: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in ``new`` are replaced by those in it."""
    return stored.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new.select(*stored.columns))


def ingest_plan(incoming: DataFrame, stored: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Adds ``action`` to incoming documents: replace where they are modified, skip where they are stored, insert."""
    known = stored.select(key).distinct().withColumn("_known", F.lit(True))
    action = F.when(F.col("_known").isNull(), "insert").when(F.col(status) == "MODIFIED", "replace").otherwise("skip")
    return incoming.join(known, key, "left").withColumn("action", action).drop("_known")


def merged_scrape(stored: DataFrame, new: DataFrame, key: str, text: str, good: Column) -> DataFrame:
    """Stored documents with the text of newly scraped ones that are meaningful."""
    patch = new.where(good).select(key, F.col(text).alias("_text"))
    return stored.join(patch, key, "left").withColumn(text, F.coalesce("_text", text)).drop("_text")


def cascade(tables: Mapping[str, DataFrame], parents: DataFrame, links: Mapping[str, tuple[str, str]]) -> dict[str, DataFrame]:
    """What is left of each table when ``parents`` go; links: the table's column and the parents' it refers to."""
    out = {}
    for name, df in tables.items():
        own, theirs = links[name]
        out[name] = df.join(parents.select(F.col(theirs).alias(own)).distinct(), own, "left_anti")
    return out


def cascade_counts(tables: Mapping[str, DataFrame], parents: DataFrame, links: Mapping[str, tuple[str, str]]) -> DataFrame:
    """How many rows of each table would go."""
    out = None
    for name, df in tables.items():
        own, theirs = links[name]
        n = df.join(parents.select(F.col(theirs).alias(own)).distinct(), own, "left_semi").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionAll(n)
    return out


def export_new(docs: DataFrame, exported: DataFrame, path: str | None = None, key: str = "name") -> DataFrame:
    """Documents with text whose name and hash weren't exported yet; written by type and year where a path is given."""
    new = docs.where(F.trim(F.coalesce("text", F.lit(""))) != "").join(exported.select(key, "content_hash"), [key, "content_hash"], "left_anti")
    if path:
        new.select("text", "type", "year").write.mode("append").partitionBy("type", "year").text(path)
    return new

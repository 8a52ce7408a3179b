"""Tracking of ingestion, failures and backfills."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def progress(tracking: DataFrame, events: DataFrame, key: str = "tracking_id") -> DataFrame:
    """Tracking rows after a log of events (key, kind processed or failed, at): counters and status (K1, K4)."""
    log = events.groupBy(key).agg(F.count_if(F.col("kind") == "processed").alias("_p"), F.count_if(F.col("kind") == "failed").alias("_f"), F.max("at").alias("updated_at"))
    t = tracking.select(key, "total").join(log, key, "left")
    t = t.withColumns({"processed": F.coalesce("_p", F.lit(0)), "failed": F.coalesce("_f", F.lit(0))}).drop("_p", "_f")
    status = F.when(F.col("processed") + F.col("failed") == 0, "pending").when(F.col("processed") + F.col("failed") < F.col("total"), "in_progress").when(F.col("failed") == 0, "completed").otherwise("partial")
    return t.withColumns({"status": status, "remaining": F.greatest(F.lit(0), F.col("total") - F.col("processed"))})


def resume(work: DataFrame, tracking: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Requested work that isn't completed, with the count stored so far (K2)."""
    done = tracking.where("status = 'completed'").select(*keys)
    n = actual.groupBy(*keys).agg(F.count("*").alias("stored"))
    return work.join(done, keys, "left_anti").join(n, keys, "left").withColumn("stored", F.coalesce("stored", F.lit(0)))


def reconciled(tracking: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Tracked and stored counts side by side, with what is off (K3)."""
    n = actual.groupBy(*keys).agg(F.count("*").alias("stored"))
    t = tracking.join(n, keys, "full").withColumns({"processed": F.coalesce("processed", F.lit(0)), "stored": F.coalesce("stored", F.lit(0))})
    return t.withColumn("state", F.when(F.col("processed") == F.col("stored"), "ok").when(F.col("processed") > F.col("stored"), "missing").otherwise("untracked"))


def work_list(spark, first: int, last: int, subtypes: list[str], most_years: int | None = None) -> DataFrame:
    """Years from the last one down, for each subtype (K8)."""
    years = spark.range(1).select(F.explode(F.sequence(F.lit(last), F.lit(first), F.lit(-1))).alias("year"))
    if most_years:
        years = years.where(F.col("year") > last - most_years)
    return years.select("year", F.explode(F.array(*map(F.lit, subtypes))).alias("subtype"))


def failure_reason(text: Column, error: Column) -> Column:
    """Why a document failed (K5)."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty_full_text").when(error.rlike("(?i)store|insert|upsert"), "storage_error").when(error.rlike("(?i)fetch|http|timeout|connection"), "fetch_failed").when(error.isNotNull(), "extraction_error")


def failures(stored: DataFrame, new: DataFrame, succeeded: DataFrame, key: str, most: int) -> DataFrame:
    """Failed documents with retry counts: a new failure counts one more, success clears; ``retry`` where the count is under ``most`` (K6)."""
    seen = stored.select(key, "retry_count").unionByName(new.select(key, F.lit(0).alias("retry_count")))
    known = seen.groupBy(key).agg((F.max("retry_count") + F.count("*") - 1).alias("retry_count")).join(succeeded.select(key).distinct(), key, "left_anti")
    return known.withColumn("retry", F.col("retry_count") < most)


def backfilled(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """Columns filled where they are empty."""
    return df.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), v) for c, v in values.items()})


def error_kind(message: Column) -> Column:
    """Whether an error is one of connection or quota, which a later attempt may not meet."""
    return F.when(message.rlike(r"(?i)quota|rate limit|429"), "quota").when(message.rlike(r"(?i)connection|timed? ?out|unreachable"), "connection").otherwise("other")

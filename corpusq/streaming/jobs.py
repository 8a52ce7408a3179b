"""Structured Streaming jobs: ingestion of landed files, counters and errors."""

from __future__ import annotations

from collections.abc import Callable

from corpusq.operators.relational import latest_by_key
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def landed(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files: int = 100) -> DataFrame:
    """Files that land in a folder, as a stream."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(path)


def ingest(stream: DataFrame, table: str, errors: str, checkpoint: str, key: str, check: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> StreamingQuery:
    """Each batch is checked; good rows are appended to ``table``, the others to ``errors``.

    The table is a log: a batch writes its own rows alone, to a folder named by its number, with overwrite, so a batch
    that runs again after a failure leaves the same table. ``current`` reads the last row of each ``key``, and
    ``compacted`` joins many batches to one."""

    def write(batch: DataFrame, number: int) -> None:
        good, bad = check(batch)
        bad.write.mode("overwrite").parquet(f"{errors}/batch={number}")
        good.dropDuplicates([key]).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _batches(spark: SparkSession, table: str):
    """The file system, and the numbers of the batches that are whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listStatus(path) if fs.exists(path) else []
    return fs, sorted(int(f.getPath().getName().split("=")[1]) for f in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")))


def current(spark: SparkSession, table: str, key: str) -> DataFrame | None:
    """The last row of each key; None where no batch is there."""
    _, numbers = _batches(spark, table)
    if not numbers:
        return None
    log = spark.read.option("basePath", table).parquet(*[f"{table}/batch={n}" for n in numbers])
    return latest_by_key(log, [key], F.col("batch")).drop("batch")


def compacted(spark: SparkSession, table: str, key: str, most: int = 50) -> None:
    """Where a log has more than ``most`` batches, the rows that are current replace them all, as the last of them. To be
    run between streaming queries; the rows that it replaces are deleted after the new ones stand."""
    fs, numbers = _batches(spark, table)
    if len(numbers) > most:
        fresh, last = f"{table}-compacting", f"{table}/batch={numbers[-1]}"
        path = spark._jvm.org.apache.hadoop.fs.Path
        current(spark, table, key).write.mode("overwrite").parquet(fresh)
        fs.delete(path(last), True)
        fs.rename(path(fresh), path(last))
        for n in numbers[:-1]:
            fs.delete(path(f"{table}/batch={n}"), True)


def unique(stream: DataFrame, keys: list[str], time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Rows whose keys haven't come before, within the delay where a time is given."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys) if time else stream.dropDuplicates(keys)


def counters(stream: DataFrame, key: str, kind: str) -> DataFrame:
    """Running counts of events by key, as a stateful sum for output mode ``update`` or ``complete``."""
    return stream.groupBy(key).agg(F.count_if(F.col(kind) == "processed").alias("processed"), F.count_if(F.col(kind) == "failed").alias("failed"))

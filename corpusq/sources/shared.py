"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

#: Bytes of an Arrow batch that a Python function takes apart at once; a longer row is handled alone.
SLICE_BYTES = 2 << 20
#: Keys that are sent to the rows they are looked for in; more are met by a merge, which shuffles the rows.
KEYS = 2_000_000


def small(batches: Iterable[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in their order, in slices of at most ``most`` bytes or one row: a batch has a fixed number of
    rows, so what Python makes of it would follow the length of texts."""
    for batch in batches:
        held = [batch]
        while held:
            b = held.pop()
            if b.num_rows > 1 and b.nbytes > most:
                held += [b.slice(b.num_rows // 2), b.slice(0, b.num_rows // 2)]
            else:
                yield b


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``. Where it is unset, in a temporary folder if Spark runs in one process;
    a cluster must have it set, as there is no other place that all executors share for certain."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and spark.sparkContext.master.startswith("local"):
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def met(rows: DataFrame, keys: DataFrame, on: Column | list[Column] | str, how: str, n: int) -> DataFrame:
    """``rows`` with (left_semi) or without (left_anti) those of the ``n`` rows of ``keys``. Rows stay where they lie as long as
    the keys can be sent there, so that what is shuffled doesn't follow the rows' length."""
    return rows.join(keys.hint("broadcast" if n <= KEYS else "merge"), on, how)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: what several steps read is made once, and Spark knows its true size for joins."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

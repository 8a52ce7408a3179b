"""Tables by key whose changes rewrite only the buckets that they touch, with a log of what changed."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from corpusq.sources.shared import met, written
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of stored rows that a task of a change reads, so that it can order them by bucket in memory.
TASK_BYTES = 32 << 20


class Versions:
    """The versions of what lies in a folder: numbered files with a line of JSON, each made whole by a rename. Readers go
    by the newest one when they open it; of two writers that start from the same version, the second fails."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}")
        self.files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.files.listStatus(self._at(folder))] if self.files.exists(self._at(folder)) else []

    def read(self, version: int | None = None) -> tuple[int, dict | None]:
        known = [int(n) for n in self.names("versions") if n.isdigit()]
        if not known:
            return 0, None
        version = max(known) if version is None else version
        return version, json.loads(self.spark.read.text(f"{self.path}/versions/{version:08d}", wholetext=True).first()[0])

    def commit(self, version: int, content: dict) -> None:
        draft, final = self._at(f"versions/.{uuid.uuid4().hex}"), self._at(f"versions/{version:08d}")
        out = self.files.create(draft, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if self.files.exists(final) or not self.files.rename(draft, final):
            raise RuntimeError(f"another change has made version {version} of {self.path}")

    def delete(self, name: str) -> None:
        self.files.delete(self._at(name), True)


class KeyedTable:
    """A table in the folder ``path``, in ``buckets`` by a hash of the columns ``by`` (the key, or the parent's part of it).

    A change reads and writes the buckets that its rows fall into; all other files stay as they are, and a new version
    names the folder of each bucket. It also writes the rows that it changed as ``before`` and ``after`` (null for what
    wasn't there), from which views follow by difference; only these are shuffled, not the rows that stay, as long as
    the keys of a change can be sent to them. Keys may be null; a key stands once in the table."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.log = spark, Versions(spark, path)
        self.path = self.log.path
        self.version, self.state = self.log.read(version)

    @classmethod
    def create(cls, spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], by: Sequence[str] | None = None, buckets: int = 64) -> KeyedTable:
        """A new table with ``rows``, whose keys are distinct."""
        table = cls(spark, path)
        if table.state is not None:
            raise ValueError(f"there is a table in {path}")
        table.state = {"schema": rows.schema.json(), "keys": list(keys), "by": list(by or keys), "n": buckets, "folders": {}, "changes": None}
        folder = f"rows-{uuid.uuid4().hex}"
        table._write(rows, folder)
        table._commit({b: f"{folder}/{b}" for b in table.log.names(folder) if b.startswith("bucket=")}, None)
        return table

    @property
    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.state["schema"]))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.state["by"]), F.lit(self.state["n"])).cast("int")

    def _write(self, rows: DataFrame, folder: str) -> None:
        """Rows go to their buckets from where they are: a task writes a file for each of its buckets, and none is as large as a
        bucket."""
        rows.withColumn("bucket", self._bucket()).write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/{folder}")

    def _commit(self, folders: dict[str, str], changes: str | None) -> None:
        state = self.state | {"folders": folders, "changes": changes}
        self.log.commit(self.version + 1, state)
        self.version, self.state = self.version + 1, state

    def _rows(self, buckets: Sequence[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
        folders = [f"{self.path}/{f}" for b, f in self.state["folders"].items() if buckets is None or b in buckets]
        return (spark or self.spark).read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows()

    def _pairs(self, log: str) -> DataFrame:
        return self.spark.read.schema(StructType().add("before", self.schema).add("after", self.schema)).parquet(f"{self.path}/{log}")

    def changes(self) -> DataFrame:
        """before and after of the rows that the last change changed."""
        if not self.state["changes"]:
            return self.spark.createDataFrame([], StructType().add("before", self.schema).add("after", self.schema))
        return self._pairs(self.state["changes"]).where(~F.col("before").eqNullSafe(F.col("after")))

    def _touched(self, rows: DataFrame) -> list[str]:
        """The buckets that ``rows`` fall into, as many as there are buckets at most."""
        return [f"bucket={r[0]}" for r in rows.select(self._bucket()).distinct().collect()]

    def _row(self) -> Column:
        return F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])

    def _change(self, touched: list[str], gone: DataFrame, columns: Sequence[str], paired: Callable[[DataFrame], DataFrame]) -> KeyedTable:
        """Rows of the ``touched`` buckets whose ``columns`` are in ``gone`` (distinct) give way. ``paired`` makes before and after
        of what changes from these rows; equal pairs are no change."""
        folder, log, n = f"rows-{uuid.uuid4().hex}", f"changes-{uuid.uuid4().hex}", gone.count()
        own = self.spark.newSession()
        own.conf.set("spark.sql.files.maxPartitionBytes", str(TASK_BYTES))
        rows, names = self._rows(touched, own), [f"_{i}" for i in range(len(columns))]
        keys = gone.select(*[F.col(c).alias(x) for c, x in zip(columns, names, strict=True)])
        on = [F.col(c).eqNullSafe(F.col(x)) for c, x in zip(columns, names, strict=True)]
        paired(met(rows, keys, on, "left_semi", n)).select("before", "after").write.option("compression", "zstd").parquet(f"{self.path}/{log}")
        after = self._pairs(log).where("after IS NOT NULL").select("after.*")
        self._write(met(rows, keys, on, "left_anti", n).unionByName(after), folder)
        made = {b: f"{folder}/{b}" for b in self.log.names(folder) if b.startswith("bucket=")}
        self._commit({b: f for b, f in self.state["folders"].items() if b not in touched} | made, log)
        return self

    def upsert(self, new: DataFrame, order: Column | None = None) -> KeyedTable:
        """Rows of ``new`` take the place of those with their keys, or are added (S11, S12). Of several with a key, the last in
        ``order`` counts, else the greatest row."""
        keys, kind = self.state["keys"], self.schema
        new = written(new.select(self._row().alias("after"), *([] if order is None else [order.alias("_order")])), "upserted-rows")
        gone = written(new.select("after.*").select(*keys).distinct(), "upserted-keys")
        last = F.max("after") if order is None else F.max_by("after", "_order")
        kinds = {"before": kind, "after": kind} | ({} if order is None else {"_order": new.schema["_order"].dataType})
        side = lambda rows, of: rows.select(*[F.col(of)[k].alias(f"_key{i}") for i, k in enumerate(keys)], *[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()])

        def paired(rows: DataFrame) -> DataFrame:
            both = side(rows.select(self._row().alias("before")), "before").unionByName(side(new, "after"))
            return both.groupBy(*[f"_key{i}" for i in range(len(keys))]).agg(F.first("before", ignorenulls=True).alias("before"), last.alias("after"))

        touched = self._touched(gone)
        return self._change(touched, gone, keys, paired) if touched else self

    def replace_children(self, new: DataFrame) -> KeyedTable:
        """All rows of the parents in ``new`` (columns ``by``) are replaced by those in it."""
        keys, by = self.state["keys"], self.state["by"]
        new = written(new.select(self._row().alias("after")), "new-children")
        gone = written(new.select("after.*").select(*by).distinct(), "new-parents")
        same = [F.col("before")[k].eqNullSafe(F.col("after")[k]) for k in keys]
        touched = self._touched(gone)
        return self._change(touched, gone, by, lambda rows: rows.select(self._row().alias("before")).join(new.hint("merge"), same, "full")) if touched else self

    def delete(self, gone: DataFrame, columns: Sequence[str] | None = None) -> KeyedTable:
        """Rows go whose ``columns`` (the table's ``by`` or more) are in ``gone``."""
        columns = list(columns or self.state["keys"])
        gone = written(gone.select(*columns).distinct(), "gone-keys")
        touched = [b for b in self._touched(gone) if b in self.state["folders"]]
        return self._change(touched, gone, columns, lambda rows: rows.select(self._row().alias("before"), F.lit(None).cast(self.schema).alias("after"))) if touched else self

    def vacuum(self) -> None:
        """Deletes what this version doesn't use."""
        used = {f.split("/")[0] for f in self.state["folders"].values()} | {self.state["changes"], "versions"}
        for name in self.log.names(""):
            if name not in used:
                self.log.delete(name)
        for name in self.log.names("versions"):
            if name != f"{self.version:08d}":
                self.log.delete(f"versions/{name}")


def counted(table: KeyedTable, by: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """Rows and sums by group, from the whole table: what ``recounted`` keeps up."""
    return table.read().groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in sums])


def recounted(counts: DataFrame, changes: DataFrame, by: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """``counts`` (of ``counted``) after ``changes``, without the table: rows before count less, rows after count more."""
    part = lambda side, sign: changes.where(F.col(side).isNotNull()).select(*[F.col(side)[c].alias(c) for c in by], F.lit(sign).cast("long").alias("n"), *[(F.coalesce(F.col(side)[c], F.lit(0)) * sign).alias(c) for c in sums])
    rows = counts.unionByName(part("before", -1)).unionByName(part("after", 1))
    return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", *sums)]).where("n > 0")


def reindexed(index, changes: DataFrame, id_col: str, text_col: str):
    """A ``TextIndex`` after ``changes``: texts that are new or others than before are added, ids that are gone are deleted."""
    new = changes.where(F.col("after").isNotNull() & ~(F.col("before")[id_col].eqNullSafe(F.col("after")[id_col]) & F.col("before")[text_col].eqNullSafe(F.col("after")[text_col])))
    new = new.select(F.col("after")[id_col].alias("id"), F.col("after")[text_col].alias("text"))
    gone = written(changes.where(F.col("after").isNull()).select(F.col("before")[id_col].alias("id")), "gone-texts")
    if not new.isEmpty():
        index.add(new)
    return index if gone.isEmpty() else index.delete(gone)

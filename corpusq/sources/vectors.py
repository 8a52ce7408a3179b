"""A stored index of nearest vectors: trained cells with coded residuals, written once and read by many queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from corpusq.operators.relational import top_per_key
from corpusq.sources.shared import shared_path, written
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vectors of a cell, and queries that look into it, that meet in one task.
CELL_ROWS, CELL_QUERIES = 50_000, 20_000
#: Similarities that a task holds at once.
SIMILARITIES = 4_000_000


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _codes(shared):
    """mapInArrow over id, vector: the unit vector's nearest cell, and what it differs from the cell's centre by, a byte a
    dimension with one scale."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            own = _unit(_matrix(b.column(1)))
            step = max(1, SIMILARITIES // len(centres))
            cell = np.concatenate([(own[i : i + step] @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1) for i in range(0, len(own), step)])
            rest = own - centres[cell]
            scale = np.maximum(np.abs(rest).max(axis=1), 1e-12) / 127
            codes = np.round(rest / scale[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.astype(np.int32)), b.column(0), pa.array(scale.astype(np.float32)), pa.array([c.tobytes() for c in codes], pa.binary()), b.column(1)], ["cell", "id", "scale", "codes", "vector"]
            )

    return coded


def _probed(shared, probes: int):
    """mapInArrow over query_id, vector: a row for each of the cells whose centres are nearest."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for b in batches:
            if b.num_rows:
                n = min(probes, len(centres))
                far = (centres**2).sum(axis=1) / 2 - _unit(_matrix(b.column(1))) @ centres.T
                cells = np.argpartition(far, n - 1, axis=1)[:, :n]
                row = pa.array(np.repeat(np.arange(b.num_rows), n))
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int32)), b.column(0).take(row), b.column(1).take(row)], ["cell", "query_id", "vector"])

    return nearest


def _scan(shared, most: int):
    """cogroup over a part of a cell and the queries that look into it: the ``most`` best of each by coded vectors."""

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": right.column("query_id").slice(0, 0), "id": left.column("id").slice(0, 0), "near": pa.array([], pa.float32())})
        if not left.num_rows or not right.num_rows:
            return empty
        centre = shared.value[left.column("cell")[0].as_py()]
        codes = np.frombuffer(b"".join(left.column("codes").to_pylist()), np.int8).reshape(left.num_rows, -1)
        own = centre + codes * left.column("scale").to_numpy()[:, None]
        asked, n, out = _unit(_matrix(right.column("vector"))), min(most, left.num_rows), [empty]
        step = max(1, SIMILARITIES // left.num_rows)
        for i in range(0, len(asked), step):
            near = asked[i : i + step] @ own.T
            at = np.argpartition(-near, n - 1, axis=1)[:, :n]
            row = np.repeat(np.arange(len(near)), n)
            out.append(pa.table({"query_id": right.column("query_id").take(pa.array(i + row)), "id": left.column("id").take(pa.array(at.ravel())), "near": near[row, at.ravel()].astype(np.float32)}))
        return pa.concat_tables(out)

    return best


class VectorIndex:
    """An inverted file of vectors by cosine similarity in the folder ``path``.

    Cells are trained by k-means on at most ``sample`` vectors, those of least hash; ``cells`` bounds what is sent to the
    tasks. Every vector is stored in its nearest cell with a code of its residual and as it is. A search looks into the
    ``probes`` nearest cells of each query, scores codes there, and scores the best of them again by the vectors
    themselves. Vectors that are null, empty or of another length than most are left out; one of no length is similar
    to nothing. Large cells, and many queries in one, are dealt to several tasks."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, corpus: DataFrame, id_col: str = "id", vector_col: str = "embedding", cells: int = 64, sample: int = 100_000, seed: int = 5) -> VectorIndex:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.feature import Normalizer
        from pyspark.ml.functions import array_to_vector

        rows = corpus.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vector")).where("size(vector) > 0 AND NOT exists(vector, x -> x IS NULL)")
        rows = written(rows, "vectors")
        width = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
        if width is None:
            raise ValueError("there is no vector to index")
        rows, n = rows.where(F.size("vector") == width[0]), width[1]
        share = min(1.0, 2 * sample / n)
        some = rows.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 31)) < int(share * (1 << 31))).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample)
        some = Normalizer(inputCol="raw", outputCol="features").transform(some.select(array_to_vector(F.col("vector").cast("array<double>")).alias("raw")))
        model = KMeans(k=max(1, min(cells, n // 4 or 1)), seed=seed, maxIter=15).fit(written(some.select("features"), "sample"))
        centres = np.array(model.clusterCenters(), np.float32)
        kind = rows.schema["id"].dataType.simpleString()
        coded = rows.mapInArrow(_codes(self.spark.sparkContext.broadcast(centres)), f"cell int, id {kind}, scale float, codes binary, vector array<float>")
        coded.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("cell").write.parquet(f"{self.path}/cells")
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<float>").write.parquet(f"{self.path}/centres")
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")

    def search(self, queries: DataFrame, k: int, probes: int = 8, again: int = 4, vector_col: str = "embedding") -> DataFrame:
        """query_id, id, score: the ``k`` most similar vectors of each query in its ``probes`` nearest cells; ``again`` times
        as many are scored by the vectors themselves."""
        centres = self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()  # as many as cells
        shared = self.spark.sparkContext.broadcast(np.array([r["centre"] for r in centres], np.float32))
        rows, width = self.rows(), len(centres[0]["centre"])
        kinds = queries.schema["query_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
        asked = written(queries.select("query_id", F.col(vector_col).cast("array<float>").alias("vector")).where((F.size("vector") == width) & ~F.exists("vector", F.isnull)), "query-vectors")
        looks = written(asked.mapInArrow(_probed(shared, probes), f"cell int, query_id {kinds[0]}, vector array<float>"), "probes")
        # Parts of a cell and of its queries, each pair of which is a group.
        sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts"))
        counts = looks.groupBy("cell").agg(F.ceil(F.count("*") / CELL_QUERIES).cast("int").alias("lots"))
        sizes = written(sizes.join(counts, "cell"), "cell-parts")
        part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        left = rows.select("cell", "id", "scale", "codes").join(sizes, "cell").withColumn("part", part("id", "parts")).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
        right = looks.join(sizes, "cell").withColumn("lot", part("query_id", "lots")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keys = ["cell", "part", "lot"]
        pairs = left.select(*keys, "id", "scale", "codes").groupBy(*keys).cogroup(right.select(*keys, "query_id", "vector").toDF(*keys, "query_id", "vector").groupBy(*keys))
        near = pairs.applyInArrow(_scan(shared, k * again), f"query_id {kinds[0]}, id {kinds[1]}, near float")
        near = written(top_per_key(near, ["query_id"], [F.desc("near"), F.col("id")], k * again), "near-vectors")
        both = near.join(asked, "query_id").join(rows.select("id", F.col("vector").alias("own")).hint("merge"), "id")
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
        cosine = F.try_divide(dot("vector", "own"), F.sqrt(dot("vector", "vector")) * F.sqrt(dot("own", "own")))
        scored = both.select("query_id", "id", F.round(cosine, 6).alias("score")).where("score IS NOT NULL")
        return top_per_key(scored, ["query_id"], [F.desc("score"), F.col("id")], k)


_built: dict[tuple, str] = {}


def kept_vectors(spark: SparkSession, table: str, id_col: str, vector_col: str, **how) -> VectorIndex:
    """The index of the Parquet table ``table``, made at an application's first call for the table as it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    key = (spark.sparkContext.applicationId, table, id_col, vector_col, str(how), files.getContentSummary(path).getLength(), files.getFileStatus(path).getModificationTime())
    if key not in _built:
        _built[key] = VectorIndex(spark, shared_path(spark, "vectors")).build(spark.read.parquet(table), id_col, vector_col, **how).path
    return VectorIndex(spark, _built[key])

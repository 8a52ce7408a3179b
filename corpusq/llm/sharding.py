"""Shards whose mixture of sources follows the whole, by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.llm.storage import written

#: Rows that a rank bucket is meant to hold, and buckets whose counts are summed up in one task.
BUCKET_ROWS, SPAN = 2_000, 4_096


def _ranked(rows: DataFrame, by: list[str], bucket: Column, order: list[Column], rank: str) -> DataFrame:
    """Adds ``rank``, the row's place from 0 within ``by`` in the order of ``bucket``, then ``order``. No task gets
    more than one bucket: buckets are counted, counts summed up by spans of ``SPAN`` buckets, and rows ranked within
    their bucket alone."""
    rows = rows.withColumn("_bucket", bucket)
    counts = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_n")).withColumn("_span", F.floor(F.col("_bucket") / F.lit(SPAN)))
    counts = written(counts, "bucket-counts")
    before = lambda keys, at: F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = counts.groupBy(*by, "_span").agg(F.sum("_n").alias("_n"))
    spans = spans.select(*by, "_span", before(by, "_span").alias("_base"))
    counts = counts.withColumn("_before", before([*by, "_span"], "_bucket")).join(spans.hint("merge"), [*by, "_span"])
    counts = written(counts.select(*by, "_bucket", (F.col("_base") + F.col("_before")).alias("_before")), "bucket-starts")
    keys = [*by, "_bucket"]
    ranked = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return ranked.join(counts, keys).withColumn(rank, F.col("_before") + F.col("_place")).drop("_bucket", "_before", "_place")


def _bucket(hashed: str, n: Column) -> Column:
    """Buckets that cut the 64-bit range of hashes evenly, as many as ``n`` rows need."""
    buckets = F.ceil(n / F.lit(BUCKET_ROWS))
    return F.floor(F.shiftrightunsigned(hashed, 33) * buckets / F.lit(float(1 << 31))).cast("long")


def shard(documents: DataFrame, shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Deals all rows to ``shards`` shards that hold the sources in the proportions of the whole.

    Rows of a source (null is a source of its own) are ranked in a seeded shuffled order; the row of rank r among n
    has the fraction (r + u) / n. The k sources of an equal number of rows have the offsets u = 1/2k, 3/2k, ... in a
    seeded shuffled order, so that they stand side by side instead of on one another. All rows are sorted by that
    fraction and cut into ``shards`` stretches whose counts differ by one at most
    (law ``rows``); within a stretch, a source has its share to within one row at each end. Equal fractions go by the
    source's name. ``slot`` is the row's place in its shard, gapless from 0. Equal rows, texts and ids may stand in any
    order among themselves; ids only break ties, so nulls and repeats are dealt like others. A null text has 0 bytes.
    Rows that are equal in id and text are ranked in one task. An empty table gives an empty table.

    Returns doc_id, source, size (bytes of the text + 1), text_crc32, shard, slot. Only these columns are shuffled,
    never texts. Ranks come from counted buckets, so no source, however large, meets in one task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"), F.col("text_crc32"))).withColumn("_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    rows = written(rows, "rows-to-deal")
    total = F.lit(rows.count())
    sizes = written(rows.groupBy("_source").agg(F.count("*").alias("_rows")), "source-sizes")
    alike = written(sizes.groupBy("_rows").agg(F.count("*").alias("_alike")), "sizes-alike")
    sizes = sizes.join(alike, "_rows").withColumn("_s", F.xxhash64(F.lit(seed), "_source"))
    sizes = written(_ranked(sizes, ["_rows"], _bucket("_s", F.col("_alike")), [F.col("_s"), F.col("_source")], "_nth").drop("_s"), "source-ranks")
    rows = rows.join(sizes, "_source")
    ties = [F.col("_h"), F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    rows = written(_ranked(rows, ["_source"], _bucket("_h", F.col("_rows")), ties, "_rank"), "ranked-rows")
    # fraction * total in whole numbers keeps the order of the fractions, with a remainder to compare exactly.
    twice = (F.col("_alike").cast("decimal(14,0)") * 2).cast("decimal(15,0)")
    above = ((F.col("_rank").cast("decimal(14,0)") * twice).cast("decimal(22,0)") + F.col("_nth").cast("decimal(14,0)") * 2 + 1).cast("decimal(23,0)")
    rows = rows.withColumns({"_above": above * total.cast("decimal(14,0)"), "_below": (F.col("_rows").cast("decimal(14,0)") * twice).cast("decimal(22,0)")})
    rows = rows.withColumns({"_whole": F.expr("cast(_above div _below as bigint)"), "_fraction": F.expr("cast(_above % _below as double) / cast(_below as double)")}).drop("_above", "_below")
    rows = rows.withColumn("_stretch", F.floor(F.col("_whole") / F.lit(BUCKET_ROWS))).withColumn("_all", F.lit(0))
    placed = _ranked(rows, ["_all"], F.col("_stretch"), [F.col("_whole"), F.col("_fraction"), F.col("_source"), *ties], "_position")
    cut = placed.withColumn("_total", total).withColumn("shard", F.expr(f"cast(_position * {shards} div _total as int)"))
    # Shard s starts at the first position p with p * shards div total = s.
    start = F.expr(f"(shard * _total + {shards} - 1) div {shards}")
    return cut.select("doc_id", "source", "size", "text_crc32", "shard", (F.col("_position") - start).cast("long").alias("slot"))

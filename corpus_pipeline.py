"""The corpus pipeline: five stages, each over what the one before has kept."""

from __future__ import annotations

from corpusq.llm.decontaminate import contamination
from corpusq.llm.lines import deduped_rows
from corpusq.llm.minhash import near_duplicates
from corpusq.llm.pieces import encode_decode
from corpusq.llm.quality import quality_rows
from corpusq.llm.queries import PIECES
from corpusq.llm.storage import written
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is none of ``ids``; null is an id like others. Few ids are dropped, so they are
    what is looked up; they are written, so that Spark chooses the join by their true size."""
    gone = written(ids.select(F.col("doc_id").alias("_id")), "dropped-ids")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]), "left_anti")


def _counted(rows: DataFrame, before: DataFrame) -> DataFrame:
    """``rows`` with n_chars of the text as it is now, where there is such a column; it keeps its type."""
    if "n_chars" not in before.columns:
        return rows
    return rows.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(before.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, each by its own verdict, without the lines that many documents of a host
    share; n_chars follows the text."""
    return _counted(quality_rows(docs), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without lines that an earlier document holds; n_chars follows the text. Rows that share an id keep their
    own text; null and empty texts stay as they are."""
    kept = deduped_rows(docs)
    return _counted(kept.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the least id of each group of near duplicates. Rows that share an id stay if one of them is kept; rows
    without words or without an id are linked with nothing and stay."""
    verdicts = near_duplicates(docs).groupBy("doc_id").agg(F.bool_or("kept").alias("kept"))
    return _without(docs, verdicts.where("NOT kept"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark, each by its own text, which a hash names; so a row goes alone, also where
    rows share an id or have none. Texts without words stay."""
    named = docs.select(F.xxhash64("text").alias("_row"), "text")
    found = contamination(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_row")
    gone = written(found.where("contaminated").select(F.col("doc_id").alias("_row")).distinct(), "dropped-texts")
    return docs.join(gone, F.xxhash64(docs["text"]) == gone["_row"], "left_anti")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row; a null text is an empty one."""
    return encode_decode(docs, PIECES)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near), ("decontamination", clean), ("pieces", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``, each written and read back before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The last stage has no SQL; tests hold each stage against brute force on its own input.
ORACLE_SQL = None

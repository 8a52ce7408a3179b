"""Exact line dedup across documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.llm.storage import quoted, written

#: Characters that are stripped at both ends of a line.
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def _hash(key: Column) -> Column:
    """128 bits of a key, as two longs."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b"))


def line_dedup(documents: DataFrame, min_chars: int = 10, min_documents: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drops each line that is common to documents, but not in the first of them.

    A text is split at \\n; null and empty texts are one empty line. A line's key is the line without blanks at its
    ends, A-Z lower-cased. Keys of at least ``min_chars`` code points that occur in at least ``min_documents``
    documents lose all their lines except in the smallest id that holds them. The other lines stay in their order.

    Rows that share an id count as one document; a row with a null id keeps all its lines and removes none elsewhere.
    Returns id, text (kept lines joined by \\n), n_lines, n_dropped for every row; columns that ``documents`` has
    besides are not looked at. An empty table gives an empty table.

    Only 128-bit hashes of lines are exploded and shuffled, aggregated per task first; a line that a third of all
    documents hold is one row per task there, and the join back to its documents is one that Spark can split.
    """
    kept = deduped_rows(documents, min_chars, min_documents, id_col, text_col)
    return kept.select(F.col("row")[id_col].cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "n_lines", "n_dropped")


def deduped_rows(documents: DataFrame, min_chars: int = 10, min_documents: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same with the whole row of ``documents`` as the struct ``row``; text is null where it was."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keys = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line_key)
    hashes = docs.where("doc_id IS NOT NULL").select("doc_id", F.explode(F.array_distinct(F.transform(F.filter(keys, lambda k: F.length(k) >= min_chars), _hash))).alias("k"))
    found = written(hashes.select("doc_id", "k.a", "k.b"), "line-hashes")
    firsts = found.groupBy("a", "b").agg(F.min("doc_id").alias("first_id"), (F.min("doc_id") != F.max("doc_id")).alias("common"), *([F.count_distinct("doc_id").alias("n")] if min_documents > 2 else []))
    firsts = written(firsts.where("common" if min_documents <= 2 else f"n >= {min_documents}").select("a", "b", "first_id"), "line-firsts")
    drops = found.join(firsts, ["a", "b"]).where("doc_id != first_id")
    drops = written(drops.groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("drop")), "line-drops")
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.struct(*[F.col(quoted(c)) for c in documents.columns if c != text_col]).alias("row"))
    joined = rows.join(drops, "doc_id", "left").withColumn("keys", F.when(F.col("drop").isNotNull(), F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, _hash(k)))))
    schema = rows.select("row", "text").schema.add("n_lines", "long").add("n_dropped", "long")
    return joined.select("row", "text", "keys", "drop").mapInArrow(_reassemble, schema)


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the lines of each text whose key isn't among those to drop; linear in the lines."""
    for batch in batches:
        texts, counts, dropped = [], [], []
        for text, keys, drop in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            lines = (text or "").split("\n")
            kept = lines
            if drop:
                gone = {(k["a"], k["b"]) for k in drop}
                kept = [line for line, k in zip(lines, keys, strict=True) if not k or (k["a"], k["b"]) not in gone]
            texts.append(None if text is None else "\n".join(kept))
            counts.append(len(lines))
            dropped.append(len(lines) - len(kept))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], ["row", "text", "n_lines", "n_dropped"])

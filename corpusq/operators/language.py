"""Languages told apart by runs of three characters, learnt from texts of known language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from corpusq.sources.shared import small, written
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Runs of a language that a model keeps, and what is added to each count.
MOST_RUNS, ADDED = 20_000, 0.5
#: Languages of a model at most, so that it is of bounded size.
MOST_LANGS = 200


def spelled(text: Column) -> Column:
    """Lower-cased words with one blank before and behind each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")), F.lit(" "))


def _runs(text: str) -> np.ndarray:
    """Each run of three characters as a number; 21 bits a character."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:] if len(c) > 2 else c[:0]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over lang, text: lang, run, n of each slice of a batch."""
    for b in small(batches):
        langs = b.column(0).dictionary_encode()
        texts = b.column(1).to_pylist()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            own = [_runs(texts[i]) for i in np.flatnonzero(langs.indices.to_numpy(zero_copy_only=False) == k)]
            runs, n = np.unique(np.concatenate(own), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(runs), pa.string()), pa.array(runs), pa.array(n.astype(np.int64))], ["lang", "run", "n"])


def language_model(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", most_runs: int = MOST_RUNS) -> DataFrame:
    """lang, run, weight: the logarithm of the share of each of a language's ``most_runs`` most frequent runs, with ``ADDED``
    to its count; a null run stands for all others. Texts without a language teach nothing."""
    rows = documents.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), spelled(F.col(text_col)).alias("text"))
    counts = written(rows.mapInArrow(_counts, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n")), "run-counts")
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("all_n"), F.count("*").alias("runs"))
    top = counts.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "run"))).where(F.col("nth") <= most_runs)
    weight = lambda n: F.log((n + ADDED) / (F.col("all_n") + ADDED * (F.col("runs") + 1)))
    known = top.join(sizes.hint("merge"), "lang").select("lang", "run", weight(F.col("n")).alias("weight"))
    return written(known.unionByName(sizes.select("lang", F.lit(None).cast("long").alias("run"), weight(F.lit(0)).alias("weight"))), "language-model")


def with_language(documents: DataFrame, model: DataFrame, out: str = "detected", text_col: str = "text") -> DataFrame:
    """Adds the language under which a text's runs are likeliest; null for texts without letters. The first of equal ones
    by name. The model that is sent to the tasks has ``MOST_LANGS`` times ``MOST_RUNS`` rows at most."""
    rows = model.toPandas()
    langs = sorted(rows["lang"].unique())
    if len(langs) > MOST_LANGS:
        raise ValueError(f"a model of more than {MOST_LANGS} languages")
    known = rows[rows["run"].notna()]
    runs, at = np.unique(known["run"].to_numpy(np.int64), return_inverse=True)
    floor = rows[rows["run"].isna()].set_index("lang")["weight"].reindex(langs).to_numpy()
    table = np.tile(floor, (len(runs) + 1, 1))
    table[at, np.searchsorted(langs, known["lang"])] = known["weight"]
    shared = documents.sparkSession.sparkContext.broadcast((langs, runs, table))

    def detected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, runs, table = shared.value
        for b in small(batches):
            found = []
            for text in b.column(b.num_columns - 1).to_pylist():
                own = _runs(text)
                if not len(own) or not len(langs):
                    found.append(None)
                    continue
                own, n = np.unique(own, return_counts=True)
                i = np.minimum(np.searchsorted(runs, own), max(0, len(runs) - 1))
                i = np.where(runs[i] == own, i, len(runs)) if len(runs) else np.zeros(len(own), np.int64)
                found.append(langs[int((n @ table[i]).argmax())])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.string())], [*b.schema.names[:-1], out])

    schema = StructType([*documents.schema.fields, StructField(out, StringType())])
    return documents.select("*", spelled(F.col(text_col)).alias("_spelled")).mapInArrow(detected, schema)


def compounds(words: DataFrame, least: int = 4, word_col: str = "term") -> DataFrame:
    """term, first, second: where a word of ``words`` (distinct) is two others of them, each of ``least`` letters at least, one
    behind the other; of several ways the one with the longest first part.

    Each distinct word is cut at each place and looked up twice by equality, so a text's length plays no part."""
    rows = words.select(F.col(word_col).alias("term"))
    known = written(rows.where(F.length("term") >= least), "compound-parts")
    cuts = known.where(F.length("term") >= 2 * least).select("term", F.explode(F.sequence(F.lit(least), F.length("term") - least)).alias("n"))
    cuts = cuts.select("term", F.left("term", F.col("n")).alias("first"), F.substr("term", F.col("n") + 1).alias("second"))
    both = cuts.join(known.select(F.col("term").alias("first")).hint("merge"), "first").join(known.select(F.col("term").alias("second")).hint("merge"), "second")
    best = both.groupBy("term").agg(F.max_by(F.struct("first", "second"), F.length("first")).alias("x"))
    return best.select("term", "x.first", "x.second")

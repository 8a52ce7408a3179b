"""How far the words of each source lie from those of the other sources and of the whole of its language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusq.llm.storage import written
from corpusq.llm.text import Words, slices, utf8

#: Terms are runs of letters A-Z and a-z and of code points from 0x80.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
#: Counts of terms by source that a segment of the vocabulary is meant to hold, and run borders compared at once.
SEGMENT, BORDERS = 500_000, 2_000_000
#: Shares are whole numbers: a share of one is SCALE.
SCALE = 1_000_000_000


def _filled(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.large_string()), "")


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over lang, source, text: for each slice of texts, how often a group's texts have a term, and how many have it."""
    for batch in batches:
        buf, off = utf8(batch.column(2))
        langs, sources = (_filled(batch.column(k)).dictionary_encode() for k in (0, 1))
        groups = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        for i, j in slices(off):
            w = Words(buf, off, i, j, LETTERS)
            if not len(w.starts):
                continue
            # The words' bytes in a row, as one string column.
            inside = LETTERS[w.bytes[: int(off[j] - off[i])]]
            ends = np.zeros(len(w.starts) + 1, np.int64)
            np.cumsum(w.lengths, out=ends[1:])
            words = pa.LargeStringArray.from_buffers(len(w.starts), pa.py_buffer(ends), pa.py_buffer(w.bytes[: len(inside)][inside])).dictionary_encode()
            k = len(words.dictionary)
            text = np.repeat(np.arange(j - i), np.diff(w.first))
            in_text, n = np.unique(text * k + words.indices.to_numpy(), return_counts=True)
            keys, at = np.unique(groups[i:j][in_text // k] * k + in_text % k, return_inverse=True)
            group = keys // k
            yield pa.RecordBatch.from_arrays(
                [
                    langs.dictionary.take(pa.array(group // len(sources.dictionary))).cast(pa.string()), sources.dictionary.take(pa.array(group % len(sources.dictionary))).cast(pa.string()),
                    words.dictionary.take(pa.array(keys % k)).cast(pa.string()), pa.array(np.bincount(at, n).astype(np.int64)), pa.array(np.bincount(at).astype(np.int64)),
                ],
                ["lang", "source", "term", "n", "texts"],
            )


def term_counts(documents: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences), texts (rows that hold the term): counted per slice of texts before the shuffle."""
    rows = documents.select(F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(_term_rows, "lang string, source string, term string, n long, texts long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))


def shares(n: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (n + 2) / total), by long division, so that nothing overflows below 9 x 10^15 occurrences."""
    rest, out = n + 2, np.zeros(len(n), np.int64)
    for _ in range(4):
        out = out * 1000 + rest // total
        rest = rest % total * 1000
    return out + 1


def _share(n: str, total: str) -> str:
    return f"1 + cast(cast({SCALE} as decimal(10,0)) * cast({n} + 2 as decimal(19,0)) div {total} as bigint)"


def _runs(at: np.ndarray, n: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and counts of the runs of a column of ``rows`` counts that is ``n`` in the ascending rows ``at``, else 0."""
    column = np.zeros(rows, np.int64)
    column[at] = n
    starts = np.flatnonzero(np.diff(column, prepend=-1))
    return starts, column[starts]


def _compared(left: pa.Table, right: pa.Table) -> pa.Table:
    """cogroup over a segment of the reordered vocabulary (at, times, counts) and the groups of its language (g, total):
    the divergence of each pair of groups a < b within the segment, by intersecting their runs."""
    left, right = left.sort_by("at"), right.sort_by("g")
    lang, rows, size = right.column("lang")[0].as_py(), left.num_rows, right.num_rows
    out = [np.zeros((3, 0), np.int64)]
    if rows:
        places = np.concatenate([[0], np.cumsum(left.column("times").to_numpy())])
        counts = left.column("counts").combine_chunks()
        counts = counts.chunk(0) if isinstance(counts, pa.ChunkedArray) else counts
        row = np.repeat(np.arange(rows), np.diff(counts.offsets.to_numpy()))
        g, n = (counts.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("g", "n"))
        order = np.lexsort((row, g))
        first = np.searchsorted(g[order], np.arange(size + 1))
        runs = []
        for k, total in enumerate(right.column("total").to_pylist()):
            own = order[first[k] : first[k + 1]]
            starts, values = _runs(row[own], n[own], rows)
            runs.append((starts, shares(values, total)))
        # The runs of all groups in a row, each start shifted by its group.
        keys = np.concatenate([k * rows + s for k, (s, _) in enumerate(runs)])
        every = np.concatenate([p for _, p in runs])
        begins = np.searchsorted(keys, np.arange(size + 1) * rows)
        for a in range(size - 1):
            starts, p = runs[a]
            some = max(1, BORDERS // len(starts))
            for b in range(a + 1, size, some):
                others = np.arange(b, min(b + some, size))
                cut = np.union1d(keys[begins[b] : begins[others[-1] + 1]], (others[:, None] * rows + starts).ravel())
                other, at = np.divmod(cut, rows)
                p_a, p_b = p[np.searchsorted(starts, at, "right") - 1], every[np.searchsorted(keys, cut, "right") - 1]
                last = np.append(other[1:] != other[:-1], True)
                length = places[np.where(last, rows, np.append(at[1:], 0))] - places[at]
                value = np.add.reduceat((p_a - p_b) ** 2 // (p_a + p_b) * length, np.searchsorted(other, others))
                out.append(np.stack([np.full(len(others), a), others, value]))
    a, b, value = np.concatenate(out, 1)
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": a, "b": b, "value": value})


def divergence(documents: DataFrame, least_texts: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: how much each source differs from the others of its language (part
    ``pair``), and the ``top`` terms that it has more of than its language (part ``term``).

    A language keeps the terms that at least ``least_texts`` of its texts hold. A group (language and source, or a
    language as a whole) gives a term the share p = 1 + floor(10^9 (n + 2) / (N + 2 V)), where n are its occurrences, N
    those of all V kept terms. Two shares p and q differ by f = floor((p - q)^2 / (p + q)). Part ``pair`` has each other
    source with the sum of f over all kept terms; part ``term`` has f for the terms that the group has and of which its
    share is above the language's. Ranks go by descending value, then by the item's bytes.

    The vocabulary is reordered: terms with the same counts in all sources become one row with their number, and rows
    are sorted by their counts, sources with few occurrences first, so that equal counts stand together. That order is
    cut into segments; in each, a source's counts are runs, and two sources are compared run by run where their runs
    intersect, f times the length of the intersection. Sums of segments add up.

    Null texts, languages and sources count as empty ones. Each row is a text of its own, also where ids or texts
    repeat. A source without terms has the share of n = 0 for each term; where a language keeps no term, pairs have
    the value 0. An empty table gives an empty one. Further columns are not looked at, whatever they are called.

    The result has a row for each ordered pair of sources of a language; all else is bounded by a segment.
    """
    every = documents.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
    counts = term_counts(documents, lang_col, source_col, text_col)
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("texts").alias("texts"), F.collect_list(F.struct("source", "n")).alias("x"))
    kept = written(kept.where(F.col("texts") >= least_texts).select("lang", "term", "all_n", "x"), "kept-terms")
    entries = kept.select("lang", "term", "all_n", F.explode("x").alias("x")).select("lang", "term", "all_n", "x.source", "x.n")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_n"))
    own = entries.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    groups = written(every, "groups").join(own, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["own_n", "v", "lang_n"])
    groups = groups.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("own_n", "source")) - 1)
    groups = written(groups.select("lang", "source", "g", "v", (F.col("own_n") + 2 * F.col("v")).alias("total"), (F.col("lang_n") + 2 * F.col("v")).alias("lang_total")), "groups")
    entries = written(entries.join(groups, ["lang", "source"]), "term-entries")

    columns = entries.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("g", "n"))).alias("counts"))
    columns = columns.groupBy("lang", "counts").agg(F.count("*").alias("times"))
    segments = max(1, -(-entries.count() // SEGMENT))
    columns = columns.repartitionByRange(segments, "lang", "counts").sortWithinPartitions("lang", "counts")
    columns = written(columns.withColumns({"segment": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "vocabulary")
    sides = groups.join(columns.select("lang", "segment").distinct(), "lang").select("lang", "segment", "g", "total").toDF("lang", "segment", "g", "total")
    values = columns.groupBy("lang", "segment").cogroup(sides.groupBy("lang", "segment")).applyInArrow(_compared, "lang string, a long, b long, value long")
    values = written(values.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pair-sums")
    both = values.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("g"), F.col("b").alias("h")), F.struct(F.col("b").alias("g"), F.col("a").alias("h")))).alias("x"))
    named = lambda g, name: groups.select("lang", F.col("g").alias(g), F.col("source").alias(name))
    pairs = both.select("lang", "value", "x.*").join(named("g", "source"), ["lang", "g"]).join(named("h", "item"), ["lang", "h"]).select("lang", "source", "item", "value")
    bare = groups.where("v = 0").select("lang", "source")
    bare = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source != item").withColumn("value", F.lit(0).cast("long"))
    pairs = pairs.unionByName(bare.select("lang", "source", "item", "value"))

    terms = entries.selectExpr("lang", "source", "term AS item", f"{_share('n', 'total')} AS p", f"{_share('all_n', 'lang_total')} AS q").where("p > q")
    terms = terms.selectExpr("lang", "source", "item", "(p - q) * (p - q) div (p + q) AS value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    parts = [x.withColumns({"part": F.lit(part), "rank": rank}) for x, part in ((pairs, "pair"), (terms, "term"))]
    return parts[0].unionByName(parts[1].where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")

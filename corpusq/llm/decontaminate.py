"""Benchmark passages in documents, found through a positional inverted index that is sharded by document blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm.storage import written
from corpusq.llm.text import ALNUM, Words, slices, utf8

#: Windows of benchmark items that are held in memory at once; more are matched in further rounds.
WINDOWS_AT_ONCE = 200_000
#: Words of the benchmark that are broadcast at most, eight bytes each.
MOST_TERMS = 4_000_000
#: Candidate starts that are intersected at once.
CANDIDATES_AT_ONCE = 1 << 21

_INDEX = "block long, term long, n long, positions binary, doc_ids binary, first_words binary"


def windows(benchmark: DataFrame, width: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, terms (word hashes): each run of ``width`` words of an item; of an item of fewer words, all of them.
    Items whose id is null, and texts that are null or without words, have none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = utf8(batch.column(1))
            ids, terms = [], []
            for i, j in slices(off):
                w = Words(buf, off, i, j, ALNUM)
                hashes = w.hashes().view(np.int64)
                for k in range(j - i):
                    own = hashes[w.first[k] : w.first[k + 1]]
                    for at in range(max(1, len(own) - width + 1) if len(own) else 0):
                        ids.append(batch.column(0)[i + k].as_py())
                        terms.append(own[at : at + width])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(terms, pa.list_(pa.int64()))], ["item_id", "terms"])

    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).where("item_id IS NOT NULL")
    return items.mapInArrow(cut, "item_id string, terms array<long>")


def positional_index(documents: DataFrame, terms: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings of the given terms (sorted 64-bit hashes; None: of all words) in all documents, one row per block of documents and term:
    the places of the term, counted in words from the start of the block, as unsigned 32-bit numbers. A row with doc_ids
    stands for no term; it lists the documents of the block and the place of each one's first word."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(terms)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            buf, off = utf8(batch.column(1))
            ids = batch.column(0)
            for i, j in slices(off):
                w = Words(buf, off, i, j, ALNUM)
                hashes = w.hashes()
                known = np.unique(hashes) if shared.value is None else shared.value
                at = np.searchsorted(known, hashes)
                at[at == len(known)] = 0
                hit = np.flatnonzero(known[at] == hashes) if len(known) else np.zeros(0, np.int64)
                order = np.argsort(at[hit], kind="stable")
                hit = hit[order]
                own, starts = np.unique(at[hit], return_index=True)
                ends = np.append(starts[1:], len(hit))[: len(own)]
                places = hit.astype("<u4")
                doc_ids = np.array([x if x is not None else 0 for x in ids[i:j].to_pylist()], "<i8")
                given = np.array([x is not None for x in ids[i:j].to_pylist()], np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(own) + 1, block, np.int64)),
                        pa.array(np.append(0, known[own].view(np.int64))),
                        pa.array([len(hashes), *(ends - starts).tolist()], pa.int64()),
                        pa.array([given.tobytes(), *(places[a:b].tobytes() for a, b in zip(starts, ends, strict=True))], pa.binary()),
                        pa.array([doc_ids.tobytes(), *[None] * len(own)], pa.binary()),
                        pa.array([w.first.astype("<u4").tobytes(), *[None] * len(own)], pa.binary()),
                    ],
                    ["block", "term", "n", "positions", "doc_ids", "first_words"],
                )
                block += 1

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(build, _INDEX)


class _Postings:
    """The postings of one block: sorted keys (number of the term, place)."""

    def __init__(self, rows: pd.DataFrame, terms: np.ndarray):
        docs = rows[rows["doc_ids"].notna()].iloc[0]
        rows = rows[rows["doc_ids"].isna()]
        own = np.searchsorted(terms, rows["term"].to_numpy(np.int64).view(np.uint64))
        order = np.argsort(own)
        self.counts = np.zeros(len(terms) + 1, np.int64)
        self.counts[own + 1] = rows["n"].to_numpy(np.int64)
        self.first = np.cumsum(self.counts)
        lists = rows["positions"].tolist()
        self.places = np.frombuffer(b"".join(lists[i] for i in order), "<u4").astype(np.int64)
        self.keys = np.repeat(np.arange(len(terms)), self.counts[1:]) << 32 | self.places
        self.first_words = np.frombuffer(docs["first_words"], "<u4").astype(np.int64)

    def matches(self, terms: np.ndarray, widths: np.ndarray, order: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows and starts. ``terms``: numbers of the words of each window, -1 beyond its width; ``order``: its
        places from the rarest word on. A word may stand up to ``slop`` words from its place in the phrase."""
        own = self.counts[1:][terms[np.arange(len(terms)), order[:, 0]]] if len(terms) else np.zeros(0, np.int64)
        found_w, found_s = [], []
        edges = np.cumsum(own)
        at = 0
        while at < len(terms):
            stop = max(at + 1, int(np.searchsorted(edges, (edges[at - 1] if at else 0) + CANDIDATES_AT_ONCE, "right")))
            w = np.repeat(np.arange(at, stop), own[at:stop])
            lead = terms[np.arange(at, stop), order[at:stop, 0]]
            n = np.arange(len(w)) - np.repeat(np.cumsum(own[at:stop]) - own[at:stop], own[at:stop])
            start = self.places[np.repeat(self.first[lead], own[at:stop]) + n] - order[w, 0]
            doc = np.searchsorted(self.first_words, start + order[w, 0], "right") - 1
            low, high = self.first_words[doc], self.first_words[doc + 1]
            fits = (start >= low - slop) & (start + widths[w] <= high + slop)
            w, start, low, high = w[fits], start[fits], low[fits], high[fits]
            for k in range(1, terms.shape[1]):
                place = order[w, k]
                live = place < widths[w]
                a = np.maximum(start + place - slop, low)
                b = np.minimum(start + place + slop, high - 1)
                key = terms[w, place] << 32
                i = np.minimum(np.searchsorted(self.keys, key | np.maximum(a, 0)), len(self.keys) - 1)
                ok = ~live | ((self.keys[i] >= key | np.maximum(a, 0)) & (self.keys[i] <= key + b))
                w, start, low, high = w[ok], start[ok], low[ok], high[ok]
            found_w.append(w)
            found_s.append(np.clip(start, low, high - 1))
            at = stop
        return (np.concatenate(found_w), np.concatenate(found_s)) if found_w else (np.zeros(0, np.int64),) * 2


def passages(index: DataFrame, window_rows: DataFrame, slop: int = 0) -> DataFrame:
    """Stretches of documents that hold windows: block, doc (place in the block), item_id, start, stop (in words of
    the block), kind ``phrase`` or, with ``slop`` over 0, ``near``. Touching matches of an item are one stretch.

    The windows are taken in rounds of about ``WINDOWS_AT_ONCE``; in each, a block of the index is intersected on its
    own, from the rarest term of each window on, as the counts of the whole index rank them."""
    spark = index.sparkSession
    counts = written(index.where("doc_ids IS NULL").groupBy("term").agg(F.sum("n").alias("n")), "term-counts")
    rounds = max(1, -(-window_rows.count() // WINDOWS_AT_ONCE))
    out = None
    for k in range(rounds):
        part = window_rows.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(rounds)) == k)
        used = part.select(F.explode("terms").alias("term")).distinct()
        known = used.join(counts.hint("merge"), "term").select("term", "n").toArrow()
        terms = known.column("term").to_numpy().view(np.uint64)
        by_term = np.argsort(terms)
        terms, often = terms[by_term], known.column("n").to_numpy()[by_term]
        asked = part.select("item_id", "terms").toArrow()  # at most about WINDOWS_AT_ONCE windows
        items, lists = asked.column("item_id").to_pylist(), asked.column("terms").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        widths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        row = np.repeat(np.arange(len(widths)), widths)
        column = np.arange(len(flat)) - np.repeat(np.cumsum(widths) - widths, widths)
        place = np.minimum(np.searchsorted(terms, flat), max(0, len(terms) - 1))
        there = terms[place] == flat if len(terms) else np.zeros(len(flat), bool)
        # Windows with a word that no document has are nowhere.
        whole = np.bincount(row, there, minlength=len(widths)) == widths
        most = int(widths.max(initial=1))
        table, rarity = np.full((len(widths), most), -1, np.int64), np.full((len(widths), most), np.iinfo(np.int64).max, np.int64)
        if len(terms):
            table[row, column], rarity[row, column] = place, often[place]
        table, rarity, widths, items = table[whole], rarity[whole], widths[whole], [x for x, w in zip(items, whole.tolist(), strict=True) if w]
        order = np.argsort(rarity, axis=1, kind="stable")
        shared = spark.sparkContext.broadcast((terms, table, widths, order, items))
        found = index.groupBy("block").applyInPandas(_matcher(shared, slop), "block long, doc int, item_id string, start long, stop long, kind string")
        out = found if out is None else out.unionByName(found)
    return out


def _matcher(shared, slop: int):
    def match(rows: pd.DataFrame) -> pd.DataFrame:
        terms, table, widths, order, items = shared.value
        known = rows["doc_ids"].notna() | np.isin(rows["term"].to_numpy(np.int64).view(np.uint64), terms)
        postings = _Postings(rows[known], terms)
        frames = []
        for kind, reach in (("phrase", 0), ("near", slop)) if slop else (("phrase", 0),):
            if not len(postings.keys) or not len(table):
                continue
            w, start = postings.matches(table, widths, order, reach)
            doc = np.searchsorted(postings.first_words, start, "right") - 1
            stop = np.minimum(start + widths[w], postings.first_words[doc + 1])
            frames.append(pd.DataFrame({"doc": doc, "item_id": [items[i] for i in w], "start": start, "stop": stop, "kind": kind}))
        if not any(map(len, frames)):
            return pd.DataFrame({c: pd.Series([], dtype=t) for c, t in (("block", "int64"), ("doc", "int32"), ("item_id", "object"), ("start", "int64"), ("stop", "int64"), ("kind", "object"))})
        found = pd.concat(frames)
        found = found.sort_values(["kind", "doc", "item_id", "start"])
        same = (found[["kind", "doc", "item_id"]].shift() == found[["kind", "doc", "item_id"]]).all(axis=1)
        stretch = (~(same & (found["start"] <= found["stop"].shift(fill_value=-1)))).cumsum()
        found = found.groupby(stretch).agg({"doc": "first", "item_id": "first", "start": "min", "stop": "max", "kind": "first"})
        found.insert(0, "block", rows["block"].iloc[0])
        return found

    return match


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A verdict for each document: doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), contaminated.

    Words are runs of [0-9a-z] and of code points from 0x80, once A-Z are lower-cased. A word is hit if it stands in
    any place where a window of ``benchmark`` occurs (see ``windows``). Each row of ``documents`` is judged by itself,
    also rows with equal or null ids; null and empty texts have no words and are clean. An empty ``documents`` gives
    an empty table, an empty ``benchmark`` clean documents. Further columns of either table are not looked at.

    The index is written to the shared folder; postings are kept for words of the benchmark only (of all words if it has millions of them), and a block holds
    about 4 MB of text or one longer document, so each task's memory is bounded whatever passage or word is frequent.
    """
    spark = documents.sparkSession
    rows = written(windows(benchmark, width).distinct(), "benchmark-windows")
    vocabulary = written(rows.select(F.explode("terms").alias("t")).distinct(), "benchmark-terms")
    # Up to MOST_TERMS words of the benchmark are sent to the tasks; beyond that, all words are indexed.
    terms = np.sort(vocabulary.toArrow().column(0).to_numpy().view(np.uint64)) if vocabulary.count() <= MOST_TERMS else None
    index = written(positional_index(documents, terms, id_col, text_col), "positional-index")
    spans = passages(index, rows).where("kind = 'phrase'")
    merged = spans.groupBy("block", "doc").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    hit = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], s["end"]))).alias("n"), F.greatest(s["end"], x["stop"]).alias("end")), lambda s: s["n"])
    docs = index.where("doc_ids IS NOT NULL").select("block", "positions", "doc_ids", "first_words").mapInArrow(_documents, "block long, doc int, doc_id long, n_words long")
    joined = docs.join(merged.select("block", "doc", hit.alias("n_hit"), "item_ids").hint("merge"), ["block", "doc"], "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.to_pylist():
            first = np.frombuffer(x["first_words"], "<u4").astype(np.int64)
            n = len(first) - 1
            ids = pa.array(np.frombuffer(x["doc_ids"], "<i8"), mask=np.frombuffer(x["positions"], np.uint8) == 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, x["block"], np.int64)), pa.array(np.arange(n, dtype=np.int32)), ids, pa.array(np.diff(first))], ["block", "doc", "doc_id", "n_words"])

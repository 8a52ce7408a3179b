"""A stored inverted index: segments of postings in blocks, extended, corrected and merged without reading texts again."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from corpusq.functions import terms as N
from corpusq.sources.keyed import Versions
from corpusq.sources.shared import met, shared_path, written
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents whose postings of a term make a block.
BLOCK = 8
#: Folders by term of a segment's blocks.
BUCKETS = 16
#: Bytes of text of a segment that one task is meant to hold, so that its blocks (15 times as many bytes) are sorted in memory, and at
#: least where there are fewer tasks than cores.
TASK_BYTES, LEAST_BYTES = 16 << 20, 1 << 20
#: Words of documents whose blocks a task makes at once; a range of documents with more is handled alone.
WORDS = 1 << 19
#: Segments of like size that are merged, and the factor up to which sizes are alike.
MERGED, ALIKE = 4, 4

_opened: dict[tuple, str] = {}


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over id, slot, dl, tokens in the order of slots: the blocks of each range of slots, for about ``WORDS`` words
    at once, so that memory doesn't follow the length of texts. A range that the next batch goes on with waits for it, so
    no word is shuffled by itself."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        ranges = rows.column("slot").to_numpy() // BLOCK
        # A folder's files may follow each other in any order, so a range ends where its number changes.
        ends = np.append(np.flatnonzero(np.diff(ranges)) + 1, len(ranges)) if len(ranges) else np.zeros(0, np.int64)
        words = np.append(0, np.cumsum(rows.column("dl").to_numpy().astype(np.int64)))[ends]
        i, begin = 0, 0
        while i < len(ends) - 1:
            j = min(len(ends) - 1, max(i + 1, int(np.searchsorted(words, (words[i - 1] if i else 0) + WORDS, "right"))))
            yield from _range_blocks(rows.slice(begin, int(ends[j - 1]) - begin).combine_chunks(), ranges[begin : ends[j - 1]])
            i, begin = j, int(ends[j - 1])
        held = rows.slice(begin).combine_chunks()
    if held is not None and held.num_rows:
        yield from _range_blocks(held, held.column("slot").to_numpy() // BLOCK)


def _range_blocks(rows: pa.Table, ranges: np.ndarray) -> Iterator[pa.RecordBatch]:
    tokens = rows.column("tokens").combine_chunks()
    tokens = tokens.chunk(0) if isinstance(tokens, pa.ChunkedArray) else tokens
    words = tokens.flatten().dictionary_encode()
    if not len(words):
        return
    sizes = np.diff(tokens.offsets.to_numpy())
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.lexsort((place, doc, words.indices.to_numpy(), ranges[doc]))
    term, doc, place = words.indices.to_numpy()[order], doc[order], place[order].astype(np.int32)
    new_range = np.diff(ranges[doc], prepend=-1) != 0
    new_block = new_range | (np.diff(term, prepend=-1) != 0)
    postings = np.flatnonzero(new_block | (np.diff(doc, prepend=-1) != 0))
    blocks = np.flatnonzero(new_block[postings])
    tf, owner = np.diff(postings, append=len(doc)).astype(np.int32), doc[postings]
    dl = rows.column("dl").to_numpy()[owner].astype(np.int32)
    to = lambda starts, n: pa.array(np.append(starts, n).astype(np.int32))
    ids = rows.column("id").take(pa.array(owner)).combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    entries = pa.StructArray.from_arrays([ids, pa.array(dl), pa.array(tf), pa.ListArray.from_arrays(to(postings, len(doc)), pa.array(place))], ["id", "dl", "tf", "places"])
    yield pa.RecordBatch.from_arrays(
        [
            words.dictionary.take(pa.array(term[postings][blocks])).cast(pa.string()), pa.array(ranges[owner[blocks]]), pa.array(np.diff(blocks, append=len(postings)).astype(np.int32)),
            pa.array(np.maximum.reduceat(tf, blocks)), pa.array(np.minimum.reduceat(dl, blocks)), pa.ListArray.from_arrays(to(blocks, len(postings)), entries),
        ],
        ["term", "range", "n", "top_tf", "least_dl", "postings"],
    )


@dataclass
class Manifest:
    """What a version of an index consists of. segments: name to the ids' type, and numbers of rows, and of live documents and their tokens;
    stale: folders of (segment, id, dl, tokens) of documents that were replaced or deleted."""

    version: int = 0
    segments: dict[str, dict] = field(default_factory=dict)
    stale: list[str] = field(default_factory=list)


class TextIndex:
    """An index in the folder ``path``, for texts under ids of one type; ``tokens`` cuts a text into terms.

    A segment is written once: ``docs`` (id, slot, dl, tokens), ``blocks`` (term, range, n, top_tf, least_dl, postings)
    and ``terms`` (term, df). Documents of a segment are ordered by length; ``BLOCK`` of them in a row are a range, and
    a term's postings in a range are a block, with the greatest tf and the least length in it. Blocks lie in folders by
    a hash of the term, sorted, so that a search reads the folders, pages and columns of what it asks for. A posting
    holds id, dl, tf and the places of the term.

    A change writes new folders and then a version file; readers go by the version that they opened, so a failed
    change leaves the old version as it was. An id that is added again replaces the document; null texts are empty
    ones, rows with null ids are left out, and of rows with the same id in one batch the greatest text stays.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, Versions(spark, path)
        self.path = self.log.path
        version, state = self.log.read()
        self.manifest = Manifest(version, **(state or {}))

    def _commit(self, segments: dict[str, dict], stale: list[str]) -> None:
        self.log.commit(self.manifest.version + 1, {"segments": segments, "stale": stale})
        self.manifest = Manifest(self.manifest.version + 1, segments, stale)

    def _read(self, part: str) -> DataFrame | None:
        """The rows of all segments with their segment."""
        out = None
        for s in self.manifest.segments:
            df = self._part(s, part).withColumn("segment", F.lit(s))
            out = df if out is None else out.unionByName(df)
        return out

    def _part(self, segment: str, part: str, kind: str | None = None, spark: SparkSession | None = None) -> DataFrame:
        """A segment's part; its columns are named here, as an empty one has no file below its folders."""
        kind = kind or self.manifest.segments[segment]["id_type"]
        return (spark or self.spark).read.schema(self._columns(kind)[part]).parquet(f"{self.path}/{segment}/{part}")

    @staticmethod
    def _columns(kind: str) -> dict[str, str]:
        return {"docs": f"id {kind}, tokens array<string>, dl int, slot long", "terms": "term string, df long, bucket int", "blocks": f"term string, range long, n int, top_tf int, least_dl int, postings array<struct<id:{kind},dl:int,tf:int,places:array<int>>>, bucket int"}

    def _stale(self) -> DataFrame | None:
        """segment, id, dl, tokens of documents that are no longer live, in segments that are still there."""
        if not self.manifest.stale:
            return None
        rows = self.spark.read.parquet(*[f"{self.path}/{p}" for p in self.manifest.stale])
        return rows.where(F.col("segment").isin(list(self.manifest.segments)))

    def documents(self) -> DataFrame | None:
        """segment, id, slot, dl, tokens of the live documents."""
        out, stale = None, self._stale()
        for s, size in self.manifest.segments.items():
            docs, gone = self._part(s, "docs"), size["rows"] - size["docs"]
            if gone:
                docs = met(docs, stale.where(F.col("segment") == s).select("id"), "id", "left_anti", gone)
            docs = docs.withColumn("segment", F.lit(s))
            out = docs if out is None else out.unionByName(docs)
        return out

    def _write_segment(self, docs: DataFrame, text: bool, n_bytes: int) -> tuple[str, dict]:
        """A segment of ``docs``, about ``n_bytes`` of text in rows of id and tokens, or with ``text`` of id and a text that
        is yet to be cut into words; its name and sizes.

        Rows are dealt out by id and ordered by length within a task, so long documents don't meet in one; a task's blocks
        are sorted where they are made. So what is shuffled is each text, once."""
        name, spark = f"segment-{uuid.uuid4().hex}", self.spark
        tasks = max(-(-n_bytes // TASK_BYTES), min(spark.sparkContext.defaultParallelism, -(-n_bytes // LEAST_BYTES)), 1)
        rows = docs.repartition(tasks, "id")
        if text:
            rows = rows.groupBy("id").agg(F.max("text").alias("text")).sortWithinPartitions(F.length("text"), "id").select("id", N.tokens(F.col("text")).alias("tokens"))
        else:
            rows = rows.sortWithinPartitions(F.size("tokens"), "id")
        rows.select("id", "tokens", F.size("tokens").alias("dl"), F.monotonically_increasing_id().alias("slot")).write.option("compression", "zstd").parquet(f"{self.path}/{name}/docs")
        kind = docs.schema["id"].dataType.simpleString()
        # A session of its own, in which a task reads no more than it can sort in memory, and few texts at once. Files are about
        # half as large as the texts in them, so a task gets one.
        own = spark.newSession()
        own.conf.set("spark.sql.files.maxPartitionBytes", str(TASK_BYTES // 2))
        own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        blocks = self._part(name, "docs", kind, own).select("id", "slot", "dl", "tokens").mapInArrow(_blocks, self._columns(kind)["blocks"].removesuffix(", bucket int"))
        blocks.withColumn("bucket", _bucket(F.col("term"))).sortWithinPartitions("bucket", "term", "range").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/{name}/blocks")
        docs, blocks = self._part(name, "docs", kind), self._part(name, "blocks", kind)
        terms = blocks.groupBy("bucket", "term").agg(F.sum("n").alias("df")).repartition("bucket").sortWithinPartitions("term")
        terms.write.partitionBy("bucket").parquet(f"{self.path}/{name}/terms")
        n = docs.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return name, {"id_type": kind, "rows": n[0], "docs": n[0], "tokens": n[1]}

    def _retired(self, ids: DataFrame, n: int) -> tuple[list[str], dict[str, dict]]:
        """Writes what goes stale when the ``n`` distinct ``ids`` are replaced or deleted; the folder, and the segments' sizes
        without it."""
        segments, live = {s: dict(x) for s, x in self.manifest.segments.items()}, self.documents()
        if live is None:
            return [], segments
        folder = f"stale-{uuid.uuid4().hex}"
        met(live, ids.select("id"), "id", "left_semi", n).select("segment", "id", "dl", "tokens").write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        gone = self.spark.read.parquet(f"{self.path}/{folder}").groupBy("segment").agg(F.count("*"), F.sum("dl")).collect()  # a row a segment
        for s, docs, tokens in gone:
            segments[s]["docs"] -= docs
            segments[s]["tokens"] -= tokens
        return ([folder] if gone else []), segments

    def add(self, corpus: DataFrame, id_col: str = "id", text_col: str = "text", tokens: Column | None = None, distinct_ids: bool = False) -> TextIndex:
        """Adds the documents of ``corpus`` as a new segment; those of known ids are replaced. Where ids are known to be
        distinct, rows are not grouped by them if ``tokens`` are given."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        new = corpus.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text.alias("text"), *([tokens.alias("tokens")] if tokens is not None else []))
        n_bytes = new.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        if tokens is not None:
            new = new.select("id", "tokens") if distinct_ids else new.groupBy("id").agg(F.max_by("tokens", "text").alias("tokens"))
        name, size = self._write_segment(new, tokens is None, n_bytes)
        folders, segments = self._retired(self._part(name, "docs", size["id_type"]), size["rows"])
        self._commit({**segments, name: size}, self.manifest.stale + folders)
        return self

    def delete(self, ids: DataFrame) -> TextIndex:
        """Documents of ``ids`` (id) are no longer found; unknown ids change nothing."""
        ids = written(ids.select("id").distinct(), "gone-ids")
        folders, segments = self._retired(ids, ids.count())
        if folders:
            self._commit(segments, self.manifest.stale + folders)
        return self

    def merge(self, every: bool = False) -> TextIndex:
        """Makes one segment of those of like size (``MERGED`` at least), or of all; what is stale there goes. The old folders
        stay for readers of older versions; ``vacuum`` deletes them."""
        by_size = sorted(self.manifest.segments, key=lambda s: (self.manifest.segments[s]["rows"], s))
        groups, group = [], []
        for s in by_size:
            if group and self.manifest.segments[s]["rows"] > ALIKE * max(1, self.manifest.segments[group[0]]["rows"]):
                groups, group = [*groups, group], []
            group.append(s)
        groups = [by_size] if every else [g for g in [*groups, group] if len(g) >= MERGED]
        for g in groups:
            if len(g) < 2 and not (every and self.manifest.stale):
                continue
            n_bytes = sum(8 * self.manifest.segments[s]["tokens"] for s in g)  # eight bytes a word
            name, size = self._write_segment(self.documents().where(F.col("segment").isin(g)).select("id", "tokens"), False, n_bytes)
            left = {s: x for s, x in self.manifest.segments.items() if s not in g}
            self._commit({**left, name: size}, [] if every else self.manifest.stale)
        return self

    def vacuum(self) -> None:
        """Deletes what this version doesn't use."""
        used = {*self.manifest.segments, *self.manifest.stale, "versions"}
        for name in self.log.names(""):
            if name not in used:
                self.log.delete(name)
        for name in self.log.names("versions"):
            if name != f"{self.manifest.version:08d}":
                self.log.delete(f"versions/{name}")

    def parts(self) -> DataFrame:
        """segment, part: the tasks that have written segments; a posting's is its range without the last 30 bits."""
        return written(self._read("docs").select("segment", F.shiftright("slot", 33).alias("part")).distinct(), "parts")

    def n_docs(self) -> int:
        return sum(s["docs"] for s in self.manifest.segments.values())

    def mean_dl(self) -> float:
        return sum(s["tokens"] for s in self.manifest.segments.values()) / max(1, self.n_docs())

    def sizes(self) -> DataFrame:
        """One row: n_docs and mean_dl of the live documents."""
        return self.spark.range(1).select(F.lit(self.n_docs()).cast("long").alias("n_docs"), F.lit(self.mean_dl()).alias("mean_dl"))

    def buckets(self, asked: DataFrame) -> list[int]:
        """The folders of the terms of ``asked``: BUCKETS numbers at most."""
        return [r[0] for r in asked.select(_bucket(F.col("term"))).distinct().collect()]

    def _asked(self, part: str, asked: DataFrame | None, buckets: list[int] | None) -> DataFrame:
        """A part's rows, or those of the terms of ``asked`` (term), from their folders where these are given."""
        rows = self._read(part)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        return rows if asked is None else rows.join(asked.select("term"), "term")

    def terms(self, asked: DataFrame | None = None, buckets: list[int] | None = None) -> DataFrame:
        """term, df over the live documents, of all terms or those of ``asked`` (term, distinct): what segments hold less
        what went stale there."""
        rows = self._asked("terms", asked, buckets).select("term", "df")
        stale = self._stale()
        if len(self.manifest.segments) == 1 and stale is None:
            return rows
        if stale is not None:
            gone = stale.select(F.explode(F.array_distinct("tokens")).alias("term"))
            gone = gone if asked is None else gone.join(asked.select("term"), "term")
            rows = rows.unionByName(gone.groupBy("term").agg((-F.count("*")).alias("df")))
        return rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def counts(self) -> DataFrame:
        """term, df, tf over the live documents: texts that hold a term, and its places in all of them. Blocks are counted
        where they lie; postings are neither taken apart nor shuffled."""
        rows = self._read("blocks")
        if rows is None:
            return self.spark.createDataFrame([], "term string, df long, tf long")
        rows = rows.select("term", F.col("n").cast("long").alias("df"), F.aggregate("postings.tf", F.lit(0).cast("long"), lambda a, x: a + x).alias("tf"))
        stale = self._stale()
        if stale is not None:
            gone = stale.select(F.explode("tokens").alias("term"), "segment", "id").groupBy("term", "segment", "id").agg(F.count("*").alias("n"))
            rows = rows.unionByName(gone.select("term", F.lit(-1).cast("long").alias("df"), (-F.col("n")).alias("tf")))
        return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).where("df > 0")

    def blocks(self, asked: DataFrame | None, buckets: list[int] | None = None) -> DataFrame:
        """The blocks of the terms of ``asked`` (term, distinct) or of all terms, of all segments."""
        return self._asked("blocks", asked, buckets)

    def exploded(self, blocks: DataFrame) -> DataFrame:
        """The live postings of blocks: their other columns without the postings, and id, dl, tf, places."""
        others = [c for c in blocks.columns if c not in ("postings", "bucket", "n", "top_tf", "least_dl")]
        rows = blocks.select(*others, F.explode("postings").alias("p")).select(*others, "p.*")
        stale = self._stale()
        return rows if stale is None else rows.join(stale.select("segment", "id"), ["segment", "id"], "left_anti")

    def postings(self, asked: DataFrame) -> DataFrame:
        """term, id, tf, dl, places of the live documents for the terms of ``asked``."""
        return self.exploded(self.blocks(asked)).select("term", "id", "tf", "dl", "places")


def kept_index(spark: SparkSession, table: str, id_col: str, text: Column) -> TextIndex:
    """The index of the Parquet table in the folder or file ``table``: made at the first call of an application for the
    table as it is, and opened again by later ones. ``text`` is what of its rows is indexed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    size = files.getContentSummary(path)
    key = (spark.sparkContext.applicationId, table, id_col, str(text), size.getLength(), size.getFileCount(), files.getFileStatus(path).getModificationTime())
    if key not in _opened:
        index = TextIndex(spark, shared_path(spark, "index"))
        index.add(spark.read.parquet(table).select(F.col(id_col).alias("id"), text.alias("text")))
        _opened[key] = index.path
    return TextIndex(spark, _opened[key])

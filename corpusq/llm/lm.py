"""Scores of texts by a word trigram model in an Elias-Fano trie that is split over tasks."""

from __future__ import annotations

import mmap
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm.storage import scratch, written
from corpusq.llm.text import Words, mix, slices, utf8

#: What a text begins with (a context, no token) and ends with (a token), as hashes.
BEGIN, END = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)
#: Added to a word's count in the unigram model.
ADDED = 0.1
#: The weight, in tokens, of the model of lower order: of single words under pairs, of pairs under triples.
WEIGHTS = (500.0, 4.0)
#: Steps of quantised log10 numbers, over twelve decades.
STEPS, DECADES = 65_535, 12.0
#: Text bytes of a block, and sequences or words that a part of the trie is meant to be asked for.
BLOCK_BYTES, PART_ASKED = 8 << 20, 2_000_000
#: Buckets that Spark writes at most, unless it is told otherwise.
MOST_BUCKETS = 100_000
#: A pair of words with more than 1 / HOT of all tokens is split into SPLIT parts; there are fewer than HOT such pairs.
HOT, SPLIT = 10_000, 32
#: Words of the code book that shortens messages, and the blocks and their words that it is taken from. It changes no result.
BOOK, BOOK_BLOCKS, BOOK_WORDS = 65_535, 16, 32_768
#: Bits of a pair's hash that tell it apart in its part; which part it is in follows from others.
BITS = 48

_BLOCKS = "block long, n_train long, n_words long, n_triples long, doc_ids binary, held binary, lengths binary, words binary, counts binary, tokens binary"
_ASKED = "part long, block long, contexts binary, totals binary, sizes binary, next binary, rare binary, counts binary"
_SAID = "part long, block long, totals binary, codes binary"
_MODEL = "part long, n_contexts long, n_sequences long, levels binary"
_KINDS = {"long": pa.int64(), "binary": pa.large_binary(), "double": pa.float64(), "boolean": pa.bool_()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[t] if t != "binary" else pa.binary()) for n, t in (x.split() for x in ddl.split(", "))])


def _rows(rows: list[dict], ddl: str) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_arrow(ddl))


def _small(x: np.ndarray) -> bytes:
    """Small numbers in the fewest bytes that hold the greatest, byte by byte of equal weight, compressed."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    planes = x.astype("<u8").view(np.uint8).reshape(len(x), 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _big(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x[1:]), np.uint8).reshape(x[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : x[0]] = planes.T
    return out.reshape(-1).view("<i8")


class EliasFano:
    """An ascending sequence of numbers: low bits packed, high parts in unary; bytes that can be mapped to memory."""

    @staticmethod
    def packed(values: np.ndarray, universe: int) -> bytes:
        n = len(values)
        low = min(range(0, 57, 8), key=lambda k: n * k + (universe >> k))  # whole bytes, as few bits as may be
        lows = values.view(np.uint8).reshape(n, 8)[:, : low // 8].tobytes() if n else b""
        high = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
        bits[high] = 1
        return np.array([n, low], "<i8").tobytes() + lows + np.packbits(bits).tobytes()

    def __init__(self, data: np.ndarray):
        self.n, self.low = data[:16].view("<i8").tolist()
        self.lows = data[16 : 16 + self.n * self.low // 8].reshape(self.n, self.low // 8) if self.low else np.zeros((self.n, 0), np.uint8)
        self.bits = data[16 + self.n * self.low // 8 :]

    def values(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.bits))
        out = np.zeros((self.n, 8), np.uint8)
        out[:, : self.low // 8] = self.lows
        return out.reshape(-1).view("<u8") | (at - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)


def _places(sequence: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The place of each asked number in an ascending sequence, -1 where it isn't there."""
    if not len(sequence):
        return np.full(len(asked), -1, np.int64)
    at = np.minimum(np.searchsorted(sequence, asked), len(sequence) - 1)
    return np.where(sequence[at] == asked, at, -1)


def _codes(x: np.ndarray) -> bytes:
    """Codes of which few are different: those that occur, and for each its place among them."""
    there = np.zeros(STEPS + 1, bool)
    there[x] = True
    kinds = np.flatnonzero(there)
    number = np.zeros(STEPS + 1, np.int64)
    number[kinds] = np.arange(len(kinds))
    return len(kinds).to_bytes(4, "little") + kinds.astype("<u2").tobytes() + _small(number[x])


def _uncoded(x: bytes) -> np.ndarray:
    n = int.from_bytes(x[:4], "little")
    return np.frombuffer(x, "<u2", n, 4).astype(np.int64)[_big(x[4 + 2 * n :])]


def _code(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(np.abs(log10) / DECADES * (STEPS - 1)), 0, STEPS - 1).astype("<u2")


def _power(code: np.ndarray, sign: int) -> np.ndarray:
    return 10.0 ** (sign * code / (STEPS - 1) * DECADES)


class Trie:
    """A part of the trie over mapped memory: contexts (hashes of pairs of words) with quantised log10 counts, pointers
    to the end of each context's successors, successors, and a quantised log10 probability for each.

    The words that follow in this part are numbered by their hashes. A successor is stored as its number on top of the
    last value of the context before, so that the successors of all contexts are one ascending sequence; it is looked
    for relative to its context, between the context's pointers alone."""

    @staticmethod
    def packed(contexts: np.ndarray, totals: np.ndarray, words: np.ndarray, of: np.ndarray, number: np.ndarray, counts: np.ndarray) -> bytes:
        """Of contexts (ascending) seen ``totals`` times and their successors: the context's place, the word's number
        (both ascending) and the count of each."""
        ends = np.cumsum(np.bincount(of, minlength=len(contexts)))
        span = np.zeros(len(contexts), np.int64)
        span[of] = number + 1  # the last of each context counts, as numbers ascend
        base = np.cumsum(span) - span
        stored = (base[of] + number + 1).astype(np.uint64)
        prob = counts / (totals[of] + WEIGHTS[1])
        levels = [
            EliasFano.packed(contexts, 1 << BITS), _code(np.log10(totals)).tobytes(), EliasFano.packed(ends.astype(np.uint64), len(of) + 1), EliasFano.packed(words, 1 << 64),
            EliasFano.packed(stored, int(span.sum()) + 1), _code(np.log10(prob)).tobytes(),
        ]
        return b"".join(len(x).to_bytes(8, "little") + x for x in levels)

    def __init__(self, data: np.ndarray):
        parts, at = [], 0
        while at < len(data):
            n = int.from_bytes(data[at : at + 8].tobytes(), "little")
            parts.append(data[at + 8 : at + 8 + n])
            at += 8 + n
        self.contexts, self.pointers, self.words, self.successors = (EliasFano(parts[k]) for k in (0, 2, 3, 4))
        self.totals, self.probabilities = (np.frombuffer(parts[k], "<u2") for k in (1, 5))

    def ask(self, contexts: np.ndarray, words: np.ndarray, of: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For contexts (hashes): codes of their log10 counts; for words[which] (hashes) after contexts[of]: codes of log10
        probabilities. STEPS stands for what was never seen."""
        place = _places(self.contexts.values(), contexts)
        totals = np.where(place >= 0, self.totals[place] if len(self.totals) else STEPS, STEPS)
        ends, stored = self.pointers.values().astype(np.int64), self.successors.values().astype(np.int64)
        own = place[of]
        number = _places(self.words.values(), words)[which]
        out = np.full(len(of), STEPS, np.int64)
        live = np.flatnonzero((own >= 0) & (number >= 0))
        own = own[live]
        if not len(own):
            return totals, out
        lo, hi = np.where(own > 0, ends[own - 1], 0), ends[own]
        end = hi
        key = np.where(lo > 0, stored[lo - 1], 0) + number[live] + 1
        open_ = np.flatnonzero(lo < hi)
        lo, hi = lo.copy(), hi.copy()
        while len(open_):  # the successor of key between the pointers
            mid = (lo[open_] + hi[open_]) >> 1
            less = stored[mid] < key[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        hit = lo < end
        hit[hit] = stored[lo[hit]] == key[hit]
        out[live[hit]] = self.probabilities[lo[hit]]
        return totals, out


def token_blocks(documents: DataFrame, id_col: str, text_col: str, held_out_of: int) -> DataFrame:
    """Blocks of documents: their distinct words (hashes), counts in training documents, and words by number."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for i, j in slices(off, BLOCK_BYTES):
                ids = batch.column(0)[i:j].to_pylist()
                held = np.array([x is not None and zlib.crc32(str(x).encode()) % held_out_of == 0 for x in ids])
                w = Words(buf, off, i, j)
                words, inverse, often = np.unique(w.hashes(), return_inverse=True, return_counts=True)
                order = np.argsort(-often, kind="stable")  # frequent words have small numbers
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                words, inverse = words[order], rank[inverse]
                n = np.diff(w.first)
                counts = np.bincount(inverse[np.repeat(~held, n)], minlength=len(words))
                given = np.array([x is not None for x in ids])
                row = {
                    "block": block, "n_train": int(n[~held].sum() + (~held).sum()), "n_words": len(words), "n_triples": len(inverse) + len(n), "doc_ids": np.array([x or 0 for x in ids], "<i8").tobytes() + given.astype(np.uint8).tobytes(),
                    "held": held.astype(np.uint8).tobytes(), "lengths": _small(n), "words": words.astype("<u8").tobytes(), "counts": _small(counts), "tokens": _small(inverse),
                }
                yield from _rows([row], _BLOCKS).to_batches()
                block += 1

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rows, _BLOCKS)


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first.copy()) * np.uint64(0x9E3779B97F4A7C15) + second)


class _Block:
    """A block's pairs and triples of words: distinct ones, training counts, and where each token has its own."""

    def __init__(self, x: dict):
        self.words = np.append(np.frombuffer(x["words"], "<u8"), [BEGIN, END])
        self.n = _big(x["lengths"])
        self.held = np.frombuffer(x["held"], np.uint8).astype(bool)
        begin, end = len(self.words) - 2, len(self.words) - 1
        tokens, total = _big(x["tokens"]), self.n + 1
        ends = np.cumsum(total) - 1
        starts = ends - total + 1
        self.token = np.full(len(tokens) + len(self.n), end)
        body = np.ones(len(self.token), bool)
        body[ends] = False
        self.token[body] = tokens
        self.before = np.empty_like(self.token)
        self.before[1:] = self.token[:-1]
        self.before[starts] = begin
        self.doc = np.repeat(np.arange(len(self.n), dtype=np.int32), total)
        train = ~self.held[self.doc]
        pairs, self.pair = np.unique(self.before << 32 | self.token, return_inverse=True)
        # The last pair is what texts begin with: nothing twice.
        self.totals = np.append(np.bincount(self.pair[train], minlength=len(pairs)), int((~self.held).sum()))
        first = self.words[np.append(pairs >> 32, begin)]
        second = self.words[np.append(pairs & 0xFFFFFFFF, begin)]
        self.contexts = _pair_hash(first, second)
        self.prints = mix(self.contexts ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(64 - BITS)
        context = np.empty_like(self.pair)
        context[1:] = self.pair[:-1]
        context[starts] = len(pairs)
        triples, self.triple = np.unique(context << 32 | self.token, return_inverse=True)
        self.of, self.next = triples >> 32, triples & 0xFFFFFFFF
        self.counts = np.bincount(self.triple[train], minlength=len(triples))

    def dealt(self, hot: np.ndarray, parts: int) -> None:
        """Puts contexts and triples into the order of parts, and in a part into that of contexts: ``entry`` holds the
        context of each entry and ``part`` its part; ``order`` the triples, ``at`` the entry of each."""
        k = len(self.contexts)
        is_hot = _places(hot, self.contexts) >= 0
        plain, split = np.flatnonzero(~is_hot), np.flatnonzero(is_hot)
        context = np.concatenate([plain, np.repeat(split, SPLIT)])
        salt = np.concatenate([np.zeros(len(plain), np.uint64), np.tile(np.arange(1, SPLIT + 1, dtype=np.uint64), len(split))])
        part = (mix(self.contexts[context] + salt * np.uint64(0xD1B54A32D192ED03)) % np.uint64(parts)).astype(np.int64)
        place = np.empty(len(context), np.int64)
        order = np.argsort(self.prints[context], kind="stable")
        order = order[np.argsort(part[order].astype(np.uint16 if parts < 1 << 16 else np.int64), kind="stable")]
        context, part = context[order], part[order]
        new = np.append(True, (context[1:] != context[:-1]) | (part[1:] != part[:-1]))  # a split context comes once to a part
        place[order] = np.cumsum(new) - 1
        self.entry, self.part = context[new], part[new]
        first = np.zeros(k, np.int64)  # where a context's entries began, before they were ordered
        first[plain] = np.arange(len(plain))
        first[split] = len(plain) + SPLIT * np.arange(len(split))
        own = first[self.of]
        salted = np.flatnonzero(is_hot[self.of])
        own[salted] += (mix(self.words[self.next[salted]].copy()) % np.uint64(SPLIT)).astype(np.int64)
        at = place[own]
        self.order = np.argsort(at.astype(np.int32), kind="stable")
        self.at = at[self.order]
        self.place = place[first]  # an entry of each context


def _parts(n: int) -> int:
    return max(4, -(-n // PART_ASKED))


def lm_scores(documents: DataFrame, held_out_of: int = 10, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Learns a model from the documents whose crc32(id as text) mod ``held_out_of`` isn't 0 and scores all.

    Words stand between [\\x20\\x09-\\x0D], lower-cased in A-Z; a text (null: an empty one) is its words and one end,
    after two begins. The model is a hierarchy of Dirichlet priors: p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),
    p(w | v) = (c(v, w) + 500 p(w)) / (c(v) + 500), p(w | u, v) = (c(u, v, w) + 4 p(w | v)) / (c(u, v) + 4), each of
    which sums to one. Counts are those of all training documents. Rows whose id is null are trained on. Repeated rows
    count as often as they stand there. With no training document, N and V are 0. An empty table gives an empty table;
    further columns are not looked at.

    Returns (scores, model). scores: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. model: one
    row per part of the trie with its levels (see ``Trie``). Words are told apart by 64 bits, pairs by 48 bits within a
    part: with the parts' fixed size, one pair in 10^8 is taken for another, at every size of the input.

    Blocks of about 8 MB of text ask for their distinct words first, then for their distinct pairs and triples, with
    counts. A part adds up the counts of all blocks, builds its levels, maps them to memory and answers each block by
    successor search. Parts hold about 2 million asked triples each, at every size of the input; triples go by their
    first two words, and those of pairs with more than 1 / 10,000 of all tokens by the third as well. A block and a part
    exchange one row each way. All tables grow with the distinct triples of blocks; none is gathered in one place.
    """
    spark = documents.sparkSession
    size = documents.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0]
    blocks = _bucketed(token_blocks(documents, id_col, text_col, held_out_of), size)
    n_train, n_words, n_triples, n_blocks = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_train", "n_words", "n_triples")), F.count("*")).first()
    parts = _parts(n_words)
    asked = blocks.select("block", "words", "counts", "held").mapInArrow(_ask_words(parts), "part long, block long, words binary, counts binary")
    # As many tasks as parts, whatever the session's number of partitions is.
    known = written(asked.repartition(parts, "part").groupBy("part").applyInArrow(_word_part, "part long, block long, n_distinct long, counts binary"), "word-counts")
    # The blocks of a part all carry the number of its distinct words.
    distinct = known.groupBy("part").agg(F.max("n_distinct").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = spark.sparkContext.broadcast((code_book(blocks, n_blocks), hot_contexts(blocks, n_triples)))
    word_parts, parts = parts, _parts(n_triples)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, hot = shared.value
        for batch in batches:
            for x in batch.to_pylist():
                yield from _ask(_Block(x), x["block"], book, hot, parts)

    asked = blocks.drop("doc_ids", "counts").mapInArrow(ask, _ASKED).repartition(parts, "part")
    said = asked.groupBy("part").applyInArrow(_part(shared, False), _SAID)
    model = asked.groupBy("part").applyInArrow(_part(shared, True), _MODEL)
    empty = F.lit(None).cast("binary")
    answers = said.unionByName(known.select((-1 - F.col("part")).alias("part"), "block", F.col("counts").alias("totals"), empty.alias("codes")))
    score = _scorer(shared, parts, word_parts, n_train, distinct)
    scores = blocks.drop("counts", "n_train", "n_words", "n_triples").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scores, model


def _bucketed(blocks: DataFrame, size: int) -> DataFrame:
    """``blocks`` of ``size`` bytes of text written into buckets by their number, of about four each: where answers come back to
    them, only answers are shuffled."""
    spark = blocks.sparkSession
    path = scratch(spark, "token-blocks")
    name = "token_blocks_" + path[-32:]
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (4 * BLOCK_BYTES)))
    blocks.write.bucketBy(buckets, "block").option("path", path).saveAsTable(name)
    return spark.table(name)


def _word_order(words: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of words by part and hash, and where parts begin and end in it."""
    part = (mix(words.copy()) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((words, part))
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _ask_words(parts: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                words, counts = np.frombuffer(x["words"], "<u8"), _big(x["counts"])
                words, counts = np.append(words, END), np.append(counts, int((np.frombuffer(x["held"], np.uint8) == 0).sum()))
                order, edges = _word_order(words, parts)
                rows = []
                for s in np.flatnonzero(np.diff(edges)).tolist():
                    own = order[edges[s] : edges[s + 1]]
                    rows.append({"part": s, "block": x["block"], "words": EliasFano.packed(words[own], 1 << 64), "counts": _small(counts[own])})
                yield from _rows(rows, "part long, block long, words binary, counts binary").to_batches()

    return ask


def _word_part(table: pa.Table) -> pa.Table:
    """Counts of a part's words over all blocks, for each block those of its own."""
    rows = table.to_pylist()
    words = [EliasFano(np.frombuffer(x["words"], np.uint8)).values() for x in rows]
    level, inverse = np.unique(np.concatenate(words), return_inverse=True)
    counts = np.bincount(inverse, np.concatenate([_big(x["counts"]) for x in rows])).astype(np.int64)
    n = int((counts > 0).sum())
    said = np.split(counts[inverse], np.cumsum([len(w) for w in words])[:-1])
    return _rows([{"part": x["part"], "block": x["block"], "n_distinct": n, "counts": _small(c)} for x, c in zip(rows, said, strict=True)], "part long, block long, n_distinct long, counts binary")


def code_book(blocks: DataFrame, n_blocks: int) -> np.ndarray:
    """Hashes of words that are frequent in a few blocks, the most frequent first: they have two bytes at most in messages,
    others ten."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                words = np.frombuffer(x, "<u8")[:BOOK_WORDS].view(np.int64)
                yield pa.RecordBatch.from_pydict({"word": words, "weight": 1.0 / (1 + np.arange(len(words)))})

    # Some sixteen blocks by their hash: they are not sorted, so that none is moved.
    share = min(1.0, BOOK_BLOCKS / max(n_blocks, 1))
    some = blocks.where(F.pmod(F.xxhash64("block"), F.lit(1 << 31)) < int(share * (1 << 31))).select("words")
    rows = some.mapInArrow(first, "word long, weight double").groupBy("word").agg(F.sum("weight").alias("w")).orderBy(F.desc("w"), "word").limit(BOOK).collect()
    return np.array([r[0] for r in rows], np.int64).view(np.uint64)


def hot_contexts(blocks: DataFrame, n: int) -> np.ndarray:
    """Hashes, ascending, of pairs of words with more than 1 / HOT of all ``n`` tokens, by the blocks in which they have at
    least half that share: fewer than HOT. The list only says what is split, so it needs no exact counts."""

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                words, n = np.frombuffer(x["words"], "<u8"), _big(x["lengths"])
                tokens, most = _big(x["tokens"]), len(n) + int(n.sum())
                # Both words of such a pair are as frequent; frequent words have small numbers.
                rare = int(np.count_nonzero(np.bincount(tokens, minlength=len(words)) * 2 * HOT > most))
                inside = np.ones(max(0, len(tokens) - 1), bool)
                inside[(np.cumsum(n)[:-1] - 1)[(np.cumsum(n)[:-1] > 0) & (np.cumsum(n)[:-1] < len(tokens))]] = False
                before, after = tokens[:-1], tokens[1:]
                keep = inside & (before < rare) & (after < rare)
                pairs, often = np.unique(before[keep] << 32 | after[keep], return_counts=True)
                pairs, often = pairs[often * 2 * HOT > most], often[often * 2 * HOT > most]
                context = np.append(_pair_hash(words[pairs >> 32], words[pairs & 0xFFFFFFFF]), _pair_hash(np.array([BEGIN]), np.array([BEGIN])))
                yield pa.RecordBatch.from_pydict({"context": context.view(np.int64), "n": np.append(often, len(n))})

    found = blocks.select("lengths", "words", "tokens").mapInArrow(frequent, "context long, n long").groupBy("context").agg(F.sum("n").alias("n"))
    # Small inputs have nothing to split.
    rows = found.where((F.col("n") * HOT > n) & (F.col("n") > PART_ASKED // 100)).collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def _ask(b: _Block, block: int, book: np.ndarray, hot: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """The rows that a block sends to parts: contexts with counts, and their successors with counts."""
    b.dealt(hot, parts)
    edges = np.searchsorted(b.part, np.arange(parts + 1))
    cuts = np.searchsorted(b.at, edges)
    sizes = np.bincount(b.at, minlength=len(b.entry))
    by_hash = np.argsort(book)
    number = _places(book[by_hash], b.words)
    code = np.where(number >= 0, by_hash[number] if len(book) else BOOK, BOOK)
    rows, held = [], 0
    for s in np.flatnonzero(np.diff(edges)).tolist():
        e, t = slice(edges[s], edges[s + 1]), b.order[cuts[s] : cuts[s + 1]]
        following = b.next[t]
        rare = following[code[following] == BOOK]
        row = {
            "part": s, "block": block, "contexts": EliasFano.packed(b.prints[b.entry[e]], 1 << BITS), "totals": _small(b.totals[b.entry[e]]), "sizes": _small(sizes[e]),
            "next": _small(code[following]), "rare": b.words[rare].astype("<u8").tobytes(), "counts": _small(b.counts[t]),
        }
        rows.append(row)
        held += sum(len(v) for v in row.values() if isinstance(v, bytes))
        if held > 8 << 20:
            yield from _rows(rows, _ASKED).to_batches()
            rows, held = [], 0
    yield from _rows(rows, _ASKED).to_batches()


def _part(shared, as_model: bool):
    def part(table: pa.Table) -> pa.Table:
        book, _ = shared.value
        rows = table.to_pylist()
        del table
        contexts = [EliasFano(np.frombuffer(x["contexts"], np.uint8)).values() for x in rows]
        ends = np.cumsum([len(c) for c in contexts])
        level, place = np.unique(np.concatenate(contexts), return_inverse=True)
        totals = np.bincount(place, np.concatenate([_big(x["totals"]) for x in rows])).astype(np.int64)
        own = np.repeat(place, np.concatenate([_big(x["sizes"]) for x in rows]))
        following = [_big(x["next"]) for x in rows]
        lengths = [len(c) for c in following]
        code = np.concatenate(following)
        rare = np.frombuffer(b"".join(x["rare"] for x in rows), "<u8")
        counts = np.concatenate([_big(x["counts"]) for x in rows])
        used = np.zeros(BOOK + 1, bool)
        used[code] = True
        words = np.union1d(book[used[: len(book)]], rare)
        number = np.searchsorted(words, book)[np.minimum(code, len(book) - 1)] if len(book) else np.zeros(len(code), np.int64)
        number[code == BOOK] = np.searchsorted(words, rare)
        asked, inverse = np.unique(own << 32 | number, return_inverse=True)
        del own, number, following, code
        count = np.bincount(inverse, counts, minlength=len(asked)).astype(np.int64)
        seen, of = count > 0, asked >> 32
        # What training documents hold goes into the levels, and what they don't is not found there.
        held, used = totals > 0, np.zeros(len(words), bool)
        used[asked[seen] & 0xFFFFFFFF] = True
        data = Trie.packed(level[held], totals[held], words[used], (np.cumsum(held) - 1)[of[seen]], (np.cumsum(used) - 1)[asked[seen] & 0xFFFFFFFF], count[seen])
        if as_model:
            return _rows([{"part": rows[0]["part"], "n_contexts": int(held.sum()), "n_sequences": int(seen.sum()), "levels": data}], _MODEL)
        memory = mmap.mmap(-1, len(data))
        memory.write(data)
        del data, count, seen, counts
        total, code = Trie(np.frombuffer(memory, np.uint8)).ask(level, words, of, asked & 0xFFFFFFFF)
        total, code = total[place], code[inverse]
        said, at, to = [], 0, 0
        for x, end, n in zip(rows, ends.tolist(), lengths, strict=True):
            said.append({"part": x["part"], "block": x["block"], "totals": _codes(total[at:end]), "codes": _codes(code[to : to + n])})
            at, to = end, to + n
        return _rows(said, _SAID)

    return part


def _scorer(shared, parts: int, word_parts: int, n_train: int, distinct: int):
    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        _, hot = shared.value
        x, said = block.to_pylist()[0], sorted(answers.to_pylist(), key=lambda a: a["part"])
        b = _Block(x)
        b.dealt(hot, parts)
        counts = np.zeros(len(b.words), np.int64)
        # Each text begins once and ends once.
        order, _ = _word_order(np.append(b.words[:-2], END), word_parts)
        order[order == len(b.words) - 2] += 1
        counts[order] = np.concatenate([_big(a["totals"]) for a in reversed(said) if a["part"] < 0])
        counts[-2] = counts[-1]
        total = np.concatenate([_uncoded(a["totals"]) for a in said if a["part"] >= 0])[b.place]
        total = np.where(total < STEPS, _power(total, 1), 0.0)  # of each pair
        code = np.empty(len(b.of), np.int64)
        code[b.order] = np.concatenate([_uncoded(a["codes"]) for a in said if a["part"] >= 0])
        base = np.log10((counts + ADDED) / (n_train + ADDED * (distinct + 1)))
        single = (10.0**base)[b.token]
        double = (total[b.pair] + WEIGHTS[0] * single) / (counts[b.before] + WEIGHTS[0])
        own = np.where(code < STEPS, _power(code, -1), 0.0)[b.triple]
        third = np.log10(own + WEIGHTS[1] / (total[b.of[b.triple]] + WEIGHTS[1]) * double)
        n = np.bincount(b.doc, minlength=len(b.n))
        ids = np.frombuffer(x["doc_ids"], "<i8", count=len(b.n))
        given = np.frombuffer(x["doc_ids"], np.uint8, offset=8 * len(b.n)).astype(bool)
        columns = {
            "doc_id": pa.array(ids, mask=~given), "held_out": pa.array(b.held), "n_tokens": n, "n_known": np.bincount(b.doc, counts[b.token] > 0, minlength=len(n)).astype(np.int64),
            "train_tokens": np.full(len(n), n_train, np.int64), "base_score": np.bincount(b.doc, base[b.token], minlength=len(n)), "score": np.bincount(b.doc, third, minlength=len(n)),
        }
        return pa.table(columns)

    return score

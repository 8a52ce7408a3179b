"""SimHash near duplicates: fingerprints that differ in few bits, found in a hierarchical index in Gray order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.llm.minhash import components
from corpusq.llm.storage import forget, written
from corpusq.llm.text import SPACED, Words, slices, utf8

SEED = 42
#: Fixed values of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Longer spans are hashed one by one.
LONG_SPAN = 1024
#: Shingles hashed at once.
CHUNK = 1 << 19
#: Fingerprints that a node of the index may hold; a larger one is taken a level deeper.
NODE = 1024
#: Fingerprints under an upper node of the index, and pairs of nodes that are looked into at once.
FAN, PAIRS = 8, 1 << 16
#: Fingerprints of a node that are compared without upper nodes.
SMALL = 24
#: Fingerprints that a task is meant to hold.
TASK_ROWS = 500_000


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def xxh64_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each span of ``data``, which ends in eight bytes of padding."""
    at8 = np.lib.stride_tricks.as_strided(data[:8].view(np.uint64), shape=(max(1, len(data) - 7),), strides=(1,))
    s, n = np.uint64(seed), len(starts)
    with np.errstate(over="ignore"):
        out = np.full(n, s + P5)
        done = np.zeros(n, np.int64)
        # Stripes of 32 bytes.
        wide = np.flatnonzero((lengths >= 32) & (lengths <= LONG_SPAN))
        if len(wide):
            lanes = [np.full(len(wide), v) for v in (s + P1 + P2, s + P2, s, s - P1)]
            live = np.arange(len(wide))
            while len(live):
                at = starts[wide[live]] + done[wide[live]]
                for k, lane in enumerate(lanes):
                    lane[live] = _turned(lane[live] + at8[at + 8 * k] * P2, 31) * P1
                done[wide[live]] += 32
                live = live[lengths[wide[live]] - done[wide[live]] >= 32]
            h = _turned(lanes[0], 1) + _turned(lanes[1], 7) + _turned(lanes[2], 12) + _turned(lanes[3], 18)
            for lane in lanes:
                h = (h ^ _turned(lane * P2, 31) * P1) * P1 + P4
            out[wide] = h
        out += lengths.astype(np.uint64)
        live = np.flatnonzero((lengths - done >= 8) & (lengths <= LONG_SPAN))
        while len(live):
            out[live] = _turned(out[live] ^ _turned(at8[starts[live] + done[live]] * P2, 31) * P1, 27) * P1 + P4
            done[live] += 8
            live = live[lengths[live] - done[live] >= 8]
        live = np.flatnonzero((lengths - done >= 4) & (lengths <= LONG_SPAN))
        out[live] = _turned(out[live] ^ (at8[starts[live] + done[live]] & np.uint64(0xFFFFFFFF)) * P1, 23) * P2 + P3
        done[live] += 4
        live = np.flatnonzero((lengths > done) & (lengths <= LONG_SPAN))
        while len(live):
            out[live] = _turned(out[live] ^ data[starts[live] + done[live]].astype(np.uint64) * P5, 11) * P1
            done[live] += 1
            live = live[lengths[live] > done[live]]
        out = (out ^ out >> np.uint64(33)) * P2
        out = (out ^ out >> np.uint64(29)) * P3
        out ^= out >> np.uint64(32)
    for k in np.flatnonzero(lengths > LONG_SPAN):
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : starts[k] + lengths[k]].tobytes(), seed)
    return out


#: The eight bits of a byte as eight bytes.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").reshape(-1).view(np.uint64)


def _bit_counts(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each stretch of ``hashes`` (n + 1 offsets), how many have each of the 64 bits."""
    # Sums of at most 255 hashes stay within a byte.
    lengths = np.diff(first)
    parts = -(-lengths // 255)
    owner = np.repeat(np.arange(len(lengths)), parts)
    begins = first[owner] + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts))
    out = np.zeros((len(lengths), 64), np.int64)
    if len(begins):
        for k in range(8):
            sums = np.add.reduceat(_SPREAD[hashes >> np.uint64(8 * k) & np.uint64(255)], begins)
            np.add.at(out[:, 8 * k : 8 * k + 8], owner, sums.view(np.uint8).reshape(-1, 8))
    return out


def _fingerprint_rows(size: int):
    """mapInArrow over doc_id and text: doc_id, fingerprint."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for i, j in slices(off):
                w = Words(buf, off, i, j)
                # The words in a row with one blank after each, so that a shingle is one span.
                at = np.cumsum(w.lengths + 1) - w.lengths - 1
                joined = np.full(int(w.lengths.sum()) + len(at) + 8, 32, np.uint8)
                inside = SPACED[w.bytes[: int(off[j] - off[i])]]
                joined[np.arange(int(inside.sum())) + np.repeat(np.arange(len(at)), w.lengths)] = w.bytes[: len(inside)][inside]
                n = np.diff(w.first)
                shingles = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
                counts = np.zeros((j - i, 64), np.int64)
                total = np.concatenate([[0], np.cumsum(shingles)])
                for a in range(0, int(total[-1]), CHUNK):
                    b = min(a + CHUNK, int(total[-1]))
                    text = np.searchsorted(total, np.arange(a, b), "right") - 1
                    head = w.first[text] + np.arange(a, b) - total[text]
                    last = head + np.minimum(n[text], size) - 1
                    hashes = xxh64_spans(joined, at[head], at[last] + w.lengths[last] - at[head])
                    texts, begin = np.unique(text, return_index=True)
                    counts[texts] += _bit_counts(hashes, np.append(begin, b - a))
                bits = (2 * counts > shingles[:, None]).astype(np.uint8)
                prints = np.packbits(bits, axis=1, bitorder="little").reshape(-1).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(prints)], ["doc_id", "fingerprint"])

    return rows


def fingerprints(documents: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (a long) of each row: a bit is 1 if more than half of the XXH64 values of the text's shingles have it."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_fingerprint_rows(shingle), "doc_id long, fingerprint long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each number in the order in which neighbours differ in one bit."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ x >> np.uint64(k)
    return x


def _gray_rank(x: Column) -> Column:
    for k in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, k))
    return x


def _index(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels of the index over fingerprints in Gray order, from the leaves up: of each node the bits that all below it
    share (mask), and what these are (pattern)."""
    levels = [(prints, np.full(len(prints), ~np.uint64(0)))]
    while len(levels[-1][0]) > FAN:
        pattern, mask = levels[-1]
        begins = np.arange(0, len(pattern), FAN)
        owner = np.arange(len(pattern)) // FAN
        first = pattern[begins]
        same = np.bitwise_and.reduceat(mask & ~(pattern ^ first[owner]), begins)
        levels.append((first & same, same))
    return levels


def close_pairs(prints: np.ndarray, most_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places a < b of fingerprints in Gray order that differ in at most ``most_bits`` bits. Pairs of upper nodes are
    followed down, and dropped with all below them once the bits that both share differ in too many places."""
    levels = _index(prints)
    top = np.arange(len(levels[-1][0]))
    todo = [(len(levels) - 1, *np.triu_indices(len(top)))]
    while todo:
        depth, a, b = todo.pop()
        pattern, mask = levels[depth]
        near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= most_bits
        a, b = a[near], b[near]
        if not depth:
            yield a[a < b], b[a < b]
            continue
        for i in range(0, len(a), PAIRS // FAN**2):
            x, y = a[i : i + PAIRS // FAN**2], b[i : i + PAIRS // FAN**2]
            below = np.arange(FAN)
            x, y = np.broadcast_arrays((x[:, None] * FAN + below)[:, :, None], (y[:, None] * FAN + below)[:, None, :])
            x, y = x.ravel(), y.ravel()
            real = (x <= y) & (y < len(levels[depth - 1][0]))
            todo.append((depth - 1, x[real], y[real]))


def _least_labels(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """``label`` with the labels of linked places made equal to the least of them."""
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for end in (a, b):
            np.minimum.at(label, before[end], low)
        label = label[label]
        while (label != label[label]).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _node_links(most_bits: int):
    """mapInArrow over mask, pattern, fingerprint, sorted by node of the index and Gray rank: links that connect the
    fingerprints of each node as all pairs within ``most_bits`` do, one a fingerprint at most."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def close(rows: np.ndarray) -> pa.RecordBatch:
            mask, pattern, prints = rows[0], rows[1], rows[2].view(np.uint64)
            n = len(prints)
            begins = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])]))
            sizes = np.diff(begins, append=n)
            run = np.repeat(np.arange(len(begins)), sizes)
            label = np.arange(n)
            few = np.flatnonzero(sizes[run] <= SMALL)
            for k in range(1, SMALL):
                few = few[few + k < begins[run[few]] + sizes[run[few]]]
                near = few[np.bitwise_count(prints[few] ^ prints[few + k]) <= most_bits]
                label = _least_labels(n, near, near + k, label)
            for r in np.flatnonzero(sizes > SMALL):
                own = slice(begins[r], begins[r] + sizes[r])
                inner = np.arange(sizes[r])
                for a, b in close_pairs(prints[own], most_bits):
                    inner = _least_labels(len(inner), a, b, inner)
                label[own] = begins[r] + inner
            far = np.flatnonzero(label != np.arange(n))
            return pa.RecordBatch.from_arrays([pa.array(rows[2][far]), pa.array(rows[2][label[far]])], ["a", "b"])

        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns]))
            rows = np.concatenate(held, 1)
            # The last node may go on in the next batch; it holds at most NODE rows.
            ends = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])) + 1
            if len(ends):
                yield close(rows[:, : ends[-1]])
                held = [rows[:, ends[-1] :]]
            else:
                held = [rows]
        if held and held[0].shape[1]:
            yield close(np.concatenate(held, 1))

    return links


def _parts(mask: int, n: int) -> list[int]:
    """``mask`` with the bits that it leaves open added in ``n`` parts, one part at a time; signed as a long."""
    free = [k for k in range(63, -1, -1) if not mask >> k & 1]
    cuts = [len(free) * k // n for k in range(n + 1)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False) if hi > lo]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hamming_links(prints: DataFrame, most_bits: int = 2, node_size: int = NODE) -> DataFrame:
    """Links a, b that connect the distinct fingerprints of ``prints`` (fingerprint) just as all pairs that differ in at
    most ``most_bits`` bits would.

    The upper nodes of the index are tables: a node is a mask and the pattern that its fingerprints share there. Under
    a node, the open bits are cut into ``most_bits`` + 1 parts, and its children share one part more each: two
    fingerprints that differ in ``most_bits`` places agree in one part, so they meet in a child, whatever differs. A
    node of more than ``node_size`` fingerprints is taken a level deeper; as fingerprints are distinct, one with b open
    bits holds 2^b at most, so each line of nodes ends. What a task gets is a node of at most ``node_size`` fingerprints in the
    order of their Gray rank; ``close_pairs`` searches it. A node's pairs are not returned, but the links of its parts.
    """
    masks, out = [0], []
    here = prints.select("fingerprint", F.lit(0).cast("long").alias("mask"))
    long = lambda x: F.lit(_signed(x)).cast("long")
    while masks:
        below = {m: _parts(m, most_bits + 1) for m in masks}
        children = F.create_map(*[x for m, parts in below.items() for x in (long(m), F.array(*map(long, parts)))])
        rows = here.select("fingerprint", F.explode(F.element_at(children, F.col("mask"))).alias("mask")).withColumn("pattern", F.col("fingerprint").bitwiseAND(F.col("mask")))
        sizes = written(rows.groupBy("mask", "pattern").agg(F.count("*").alias("size")).where("size > 1"), "index-nodes")
        rows = written(rows.join(sizes, ["mask", "pattern"]), "index-level")
        deeper = (F.col("size") > node_size) & (F.bit_count("mask") < 64 - most_bits)
        out.append(rows.where(~deeper).select("mask", "pattern", "fingerprint"))
        here = rows.where(deeper).select("fingerprint", "mask")
        masks = [] if here.isEmpty() else [p for parts in below.values() for p in parts if bin(p).count("1") < 64 - most_bits]
    leaves = out[0]
    for more in out[1:]:
        leaves = leaves.unionByName(more)
    tasks = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // TASK_ROWS))
    leaves = leaves.repartition(tasks, "mask", "pattern").sortWithinPartitions("mask", "pattern", _gray_rank(F.col("fingerprint")))
    return leaves.mapInArrow(_node_links(most_bits), "a long, b long").distinct()


def simhash_duplicates(documents: DataFrame, most_bits: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for each row of ``documents``.

    Texts are lower-cased in A-Z and cut into words at [\\x20\\x09-\\x0D]; their shingles of ``shingle`` words (the whole
    sequence where there are fewer), repeats included, are joined by blanks and hashed. Documents are linked whose
    fingerprints differ in at most ``most_bits`` bits; component_id is the least doc_id reachable, itself included.

    Null and empty texts and those without words have the fingerprint zero, which is linked like any other. Rows that
    share an id go by their own fingerprints. Rows with a null id have a fingerprint, are linked with nothing and keep
    component_id null. An empty table gives an empty one. Further columns are not looked at, whatever they are called.

    Equal fingerprints are one node, so copies, however many, are never compared; ``hamming_links`` finds the others.
    """
    prints = written(fingerprints(documents, shingle, id_col, text_col), "fingerprints")
    nodes = written(prints.where("doc_id IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    links = written(hamming_links(nodes, most_bits), "close-fingerprints")
    found = components(links).select(F.col("node").alias("fingerprint"), "component")
    nodes = written(nodes.join(found.hint("merge"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint")), "fingerprint-components")
    roots = written(nodes.groupBy("component").agg(F.min("least").alias("root")), "least-ids")
    classes = nodes.join(roots.hint("merge"), "component").select("fingerprint", "root")
    out = prints.join(classes.hint("merge"), "fingerprint", "left")
    forget(links)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("component_id"))

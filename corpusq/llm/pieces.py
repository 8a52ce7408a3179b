"""SentencePiece BPE encoding by vectorised merge rounds, and decoding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm.text import hash_spans, slices, utf8

SPACE = "▁"
#: No rank, and no symbol.
NONE = np.iinfo(np.int32).max
#: Two equal pairs closer than this many symbols may touch each other's merges.
NEAR = 40
#: Units whose ids a worker keeps for the next slices.
UNITS_KEPT = 1 << 20


class PieceEncoder:
    """Encodes like the library does for a BPE model with byte fallback, a dummy prefix and no other normalisation.

    Symbols are numbers: pieces by their id, characters that occur in pieces only from vocab_size on, and other
    characters as negative code points. Of all pairs in a unit (spaces and what follows up to the next space; no
    piece reaches over that), the pairs of least rank merge at once, from the left, as long as no merge can create a
    pair of lower rank; where one can, only the first of several close pairs merges in that round.
    """

    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        sp, n = self.library, self.library.vocab_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        pieces = {sp.id_to_piece(i): i for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece reaches over a space")
        probe = sp.encode("  a\tﬁ  ")
        if sp.decode(probe) != "  a\tﬁ  ":
            raise ValueError("the model normalises texts")
        self.begin, self.end, self.vocab = sp.bos_id(), sp.eos_id(), n
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        extra = sorted({c for p in pieces for c in p} - set(pieces))
        names = pieces | {c: n + k for k, c in enumerate(extra)}
        self.spelt = {v: k for k, v in names.items()}
        self.of_char = -np.arange(0x110000, dtype=np.int32) - 1
        for c, i in names.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        pairs = [(names[p[:k]], names[p[k:]], i) for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in names and p[k:] in names]
        scores = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.rank_of = np.full(n + len(extra), NONE, np.int32)  # equal for equal scores
        self.rank_of[plain] = [scores[sp.get_score(i)] for i in plain]
        size = 1 << (4 * len(pairs)).bit_length()
        self.mask = np.uint64(size - 1)
        self.keys, self.results = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        for a, b, i in pairs:
            key = a << 32 | b
            at = int(self._slot(np.array([key], np.int64))[0])
            while self.keys[at] != -1:
                at = (at + 1) & (size - 1)
            self.keys[at], self.results[at] = key, i
        self.jumpy = np.zeros(n + len(extra), bool)  # a pair with the merged piece may rank before further pairs like its own
        for a, b, i in pairs:
            for x in (a, b):
                self.jumpy[x] |= self.rank_of[i] <= self.rank_of[x]
        self._forget()
        spelt = [self._bytes_of(i) for i in range(n)]
        self.lengths = np.array([len(x) for x in spelt], np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(spelt), np.uint8)
        self.spaced = np.array([x.startswith(b" ") and not sp.is_byte(i) for i, x in enumerate(spelt)])

    def _bytes_of(self, i: int) -> bytes:
        if self.library.is_control(i) or self.library.is_unknown(i):
            return b""
        if self.library.is_byte(i):
            return bytes([int(self.library.id_to_piece(i)[3:5], 16)])
        return self.library.id_to_piece(i).replace(SPACE, " ").encode()

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(29))) >> np.uint64(20)) & self.mask

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair merges to, -1 where it doesn't."""
        out = np.full(len(a), -1, np.int32)
        live = np.flatnonzero((a >= 0) & (b >= 0))
        keys = a[live].astype(np.int64) << 32 | b[live]
        slot = self._slot(keys)
        while len(live):
            there = self.keys[slot]
            hit = there == keys
            out[live[hit]] = self.results[slot[hit]]
            on = ~hit & (there != -1)
            live, keys, slot = live[on], keys[on], (slot[on] + np.uint64(1)) & self.mask
        return out

    def merge(self, symbols: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols and their units; ``unit`` is the ascending number of each symbol's unit."""
        done_s, done_u = [], []
        to = np.full(len(symbols), -1, np.int32)  # what a symbol and its right neighbour merge to
        inner = np.flatnonzero(unit[1:] == unit[:-1])
        to[inner] = self.merged(symbols[inner], symbols[inner + 1])
        while len(symbols):
            rank = np.where(to >= 0, self.rank_of[to], NONE)
            starts = np.flatnonzero(np.diff(unit, prepend=-1))
            lengths = np.diff(starts, append=len(unit))
            least = np.minimum.reduceat(rank, starts)
            live = np.repeat(least != NONE, lengths)
            if not live.all():
                done_s.append(symbols[~live])
                done_u.append(unit[~live])
                symbols, unit, to, rank = symbols[live], unit[live], to[live], rank[live]
                keep = least != NONE
                least, lengths = least[keep], lengths[keep]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(least, lengths))
            # In a run of overlapping pairs, the first, third, ... merge.
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            place = np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))
            jumpy = self.jumpy[to[at]]
            close = np.zeros(len(at), bool)
            close[1:] = (unit[at[1:]] == unit[at[:-1]]) & (np.diff(at) <= NEAR)
            waits = jumpy & close
            if waits.sum() > 64 and len(long := np.flatnonzero(np.bincount(unit[at[waits]]) > 64)):
                # So many waiting pairs in one unit would take as many rounds.
                for u in long:
                    own = self.one_by_one(symbols[unit == u].tolist())
                    done_s.append(np.array(own, np.int32))
                    done_u.append(np.full(len(own), u))
                rest = ~np.isin(unit, long)
                symbols, unit, to = symbols[rest], unit[rest], to[rest]
                continue
            at = at[np.where(jumpy, ~close, place % 2 == 0)]
            symbols[at] = to[at]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, unit, to = symbols[stay], unit[stay], to[stay]
            at = at - np.arange(len(at))
            # Only pairs beside a merge have changed.
            beside = np.zeros(len(symbols) + 1, bool)
            beside[at] = beside[at - 1] = True
            touched = np.flatnonzero(beside[:-1])
            inside = touched[touched < len(unit) - 1]
            inside = inside[unit[inside] == unit[inside + 1]]
            to[touched] = -1
            to[inside] = self.merged(symbols[inside], symbols[inside + 1])
        if not done_s:
            return symbols, unit
        symbols, unit = np.concatenate(done_s), np.concatenate(done_u)
        order = np.argsort(unit, kind="stable")
        return symbols[order], unit[order]

    def one_by_one(self, symbols: list[int]) -> list[int]:
        """The same for one unit with a heap, for units whose pairs must wait for each other."""
        n = len(symbols)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        found: dict[tuple[int, int], int] = {}
        heap: list[tuple[int, int, int, int, int]] = []

        def push(i: int) -> None:
            if i >= 0 and after[i] >= 0:
                a, b = symbols[i], symbols[after[i]]
                if (a, b) not in found:
                    found[a, b] = int(self.merged(np.array([a]), np.array([b]))[0])
                if (to := found[a, b]) >= 0:
                    heappush(heap, (int(self.rank_of[to]), i, a, b, to))

        for i in range(n):
            push(i)
        while heap:
            _, i, a, b, to = heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j] = to, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            after[j] = -1
            push(before[i])
            push(i)
        return [s for s in symbols if s is not None]

    def ids(self, symbols: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their units: characters without a piece become the pieces of their bytes."""
        odd = np.flatnonzero((symbols < 0) | (symbols >= self.vocab))
        if not len(odd):
            return symbols, unit
        out, at = [], 0
        spelt = [self.bytes[np.frombuffer((chr(-int(s) - 1) if s < 0 else self.spelt[int(s)]).encode(), np.uint8)] for s in symbols[odd]]
        for k, own in zip(odd, spelt, strict=True):
            out += [symbols[at:k], own]
            at = k + 1
        out.append(symbols[at:])
        counts = np.ones(len(symbols), np.int64)
        counts[odd] = [len(x) for x in spelt]
        return np.concatenate(out).astype(np.int32), np.repeat(unit, counts)

    def _learn(self, keys: np.ndarray, own: list[bytes]) -> None:
        """Encodes units not seen before and keeps their ids, up to UNITS_KEPT units from one slice to the next."""
        chars = [x.decode() for x in own]
        points = np.frombuffer("".join(chars).encode("utf-32-le"), np.uint32)
        points = np.where(points == 32, ord(SPACE), points)
        flat, unit = self.ids(*self.merge(self.of_char[points], np.repeat(np.arange(len(own)), [len(x) for x in chars])))
        count = np.bincount(unit, minlength=len(own))
        first = np.cumsum(count) - count + len(self.store)
        self.store = np.concatenate([self.store, flat.astype(np.int32)])
        at = np.searchsorted(self.known, keys)
        self.known, self.known_first, self.known_count = np.insert(self.known, at, keys), np.insert(self.known_first, at, first), np.insert(self.known_count, at, count)

    def _forget(self) -> None:
        self.known, self.store = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.known_first, self.known_count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, without begin and end."""
        internal = [b" " + t.replace(b"\xe2\x96\x81", b" ") if t else b"" for t in texts]
        sizes = np.array([len(x) for x in internal], np.int64)
        data = np.frombuffer(b"".join(internal) + b"\0" * 8, np.uint8)
        n = len(data) - 8
        if len(self.known) > UNITS_KEPT or len(self.store) > 8 * UNITS_KEPT:
            self._forget()
        if not n:
            return [np.zeros(0, np.int32)] * len(texts)
        gap = data[:n] == 32
        start = gap.copy()
        start[1:] &= ~gap[:-1]
        docs = np.cumsum(sizes) - sizes
        start[docs[docs < n]] = True
        starts = np.flatnonzero(start)
        lengths = np.diff(starts, append=n)
        keys, index, inverse = np.unique(hash_spans(data, starts, lengths), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.known, keys), max(0, len(self.known) - 1))
        new = np.flatnonzero(self.known[place] != keys) if len(self.known) else np.arange(len(keys))
        if len(new):
            own = [data[a : a + k].tobytes() for a, k in zip(starts[index[new]].tolist(), lengths[index[new]].tolist(), strict=True)]
            self._learn(keys[new], own)
            place = np.searchsorted(self.known, keys)
        flat, first, count = self.store, self.known_first[place], self.known_count[place]
        per = count[inverse]
        place = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        all_ids = flat[np.repeat(first[inverse], per) + place]
        ends = np.concatenate([[0], np.cumsum(per)])
        edges = ends[np.searchsorted(starts, np.append(docs, n))]
        return [all_ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, as the library's decode gives it."""
        if (ids >= self.vocab).any() or (ids < 0).any():
            raise ValueError("an id is out of range")
        own = ids[(ids != self.begin) & (ids != self.end)]
        size = self.lengths[own]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        text = self.flat[np.repeat(self.first[own], size) + place].tobytes()
        if self.begin in ids[1:] or self.end in ids[:-1] or 0 in own:
            return self.library.decode(ids.tolist()).encode()
        if text.startswith(b" ") and self.spaced[own[0]]:
            text = text[1:]
        try:
            text.decode()
        except UnicodeDecodeError:  # bytes that are no text
            return self.library.decode(ids.tolist()).encode()
        return text


@lru_cache(maxsize=2)
def encoder(model: str) -> PieceEncoder:
    return PieceEncoder(model)


def encode_decode(documents: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Encodes each whole text with begin and end ids, and decodes the ids again.

    Returns for each row doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit numbers),
    decoded_sha256, and on demand ids (array<int>) and decoded. A null text is encoded as the empty one, which has
    the ids begin and end. Each row is taken by itself, so repeated rows and null ids pass through; an empty table
    gives an empty table. ``model`` is the path of the model, which the executors have as well; further columns are not looked at.
    Texts are handled in slices of about 4 MB, a longer one alone.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for i, j in slices(off):
                ids = [np.concatenate([[own.begin], x, [own.end]]).astype("<u4") for x in own.encode([buf[off[k] : off[k + 1]].tobytes() for k in range(i, j)])]
                texts = [own.decode(x.astype(np.int64)) for x in ids]
                arrays = [
                    batch.column(0).slice(i, j - i), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
                ]
                if with_ids:
                    arrays.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                if with_text:
                    arrays.append(pa.array([x.decode() for x in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids + ["decoded"] * with_text)

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rows, schema)

"""Token counts of texts and of all their prefixes, by dynamic programming over prefixes."""

from __future__ import annotations

import bisect
import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm.text import SPACED, Words, hash_spans, slices, utf8

#: Words whose counts, and pairs of tokens whose verdicts, a worker keeps.
KEPT = 1 << 21
NONE = 1 << 60


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 characters stand for
    themselves, all other bytes for the code points from 256 on, in their order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class PrefixCounter:
    """Token counts for a vocabulary file of a BPE with word ends whose texts are normalised (NFC), lower-cased and
    cut into letters, single digits and signs.

    The tokens of a word's prefix are those of a shorter prefix and one more: the only token for which the last two
    stay apart when they are encoded together. So the count of each prefix is that of the shorter one plus 1. The
    last token of a whole word is one with the word-end mark.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or kinds != ["NFC", "Replace", "Lowercase"] or model["ignore_merges"]:
            raise ValueError("not a vocabulary of the kind that this counts")
        self.end = model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: r for r, m in reversed(list(enumerate(merges)))}
        self.tokens = set(model["vocab"])
        self.letters = byte_letters()
        self.longest = max(len(t.removesuffix(self.end)) for t in self.tokens)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]"))
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.apart: dict[tuple[str, str], bool] = {}
        self.counts: dict[int, int] = {}

    def bpe(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            pairs = [self.ranks.get(p, NONE) for p in zip(symbols, symbols[1:])]
            least = min(pairs)
            if least == NONE:
                break
            out, i = [], 0
            while i < len(symbols):
                if i < len(pairs) and pairs[i] == least:
                    out.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def stay_apart(self, a: str, b: str) -> bool:
        """Whether the tokens a and b, encoded together, give a and b again; a is empty before the first token."""
        key = (a, b)
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > KEPT:
                self.apart.clear()
            ended = b.endswith(self.end)
            symbols = [*a, *(b.removesuffix(self.end) if ended else b)]
            if ended:
                symbols[-1] += self.end
            known = self.apart[key] = self.bpe(symbols) == ([a, b] if a else [b])
        return known

    def last(self, word: str, i: int, lasts: list[str], mark: str) -> str:
        """The last token of word[:i] with ``mark`` after it; ``lasts``: those of shorter prefixes without one."""
        tokens, apart = self.tokens, self.apart
        for k in range(1, i + 1):
            t = word[i - k : i] + mark
            if t in tokens:
                known = apart.get((lasts[i - k], t))
                if known or (known is None and self.stay_apart(lasts[i - k], t)):
                    return t
        raise ValueError(f"no token ends {word[:i]!r}")

    def word_counts(self, words: list[str]) -> list[int]:
        """The number of tokens of each word (letters for bytes), given in any order; sorted words share prefixes."""
        out = dict.fromkeys(words, 0)
        lasts, counts, before = [""], [0], ""
        for word in sorted(out):
            n = len(word)
            at = 0
            while at < min(len(before), n - 1, len(lasts) - 1) and before[at] == word[at]:
                at += 1
            del lasts[at + 1 :], counts[at + 1 :]
            for i in range(at + 1, n):
                t = self.last(word, i, lasts, "")
                lasts.append(t)
                counts.append(counts[i - len(t)] + 1)
            t = self.last(word, n, lasts, self.end)
            out[word] = counts[n - len(t) + len(self.end)] + 1
            before = word
        return [out[w] for w in words]

    def prefix_counts(self, word: str) -> list[int]:
        """The number of tokens of each prefix of a word, if the text ended there."""
        return self.prefix_states(word)[0]

    def prefix_states(self, word: str, most: int = NONE) -> tuple[list[int], list[str], list[int]]:
        """The same, with the last token and the count of each prefix that goes on. Ends early where counts are over
        ``most`` by more than a token can have letters, as no longer prefix can come back to it."""
        lasts, counts, out = [""], [0], [0]
        for i in range(1, len(word) + 1):
            if counts[-1] > most + self.longest:
                break
            whole = self.last(word, i, lasts, self.end)
            out.append(counts[i - len(whole) + len(self.end)] + 1)
            t = self.last(word, i, lasts, "")
            lasts.append(t)
            counts.append(counts[i - len(t)] + 1)
        return out, lasts, counts

    def pretokens(self, chunk: str) -> list[str]:
        text = "".join(c.lower() for c in unicodedata.normalize("NFC", chunk)) if not chunk.isascii() else chunk.lower()
        return self.pattern.findall(text)

    def spelt(self, pretoken: str) -> str:
        return pretoken if pretoken.isascii() and pretoken.isprintable() else "".join(self.letters[b] for b in pretoken.encode())

    def chunk_counts(self, chunks: list[str]) -> list[int]:
        """The number of tokens of each chunk, a text without white space; a special string counts as one."""
        plans, words = [], []
        for chunk in chunks:
            n = 0
            parts = [chunk]
            if self.special is not None and "<|" in chunk:
                n, parts = len(self.special.findall(chunk)), self.special.split(chunk)
            own = [self.spelt(w) for p in parts if p for w in self.pretokens(p)]
            plans.append((n, len(own)))
            words += own
        counts = self.word_counts(words)
        out, at = [], 0
        for n, k in plans:
            out.append(n + sum(counts[at : at + k]))
            at += k
        return out

    def text_count(self, text: str) -> int:
        return sum(self.chunk_counts(text.split()))

    def chunk_prefixes(self, chunk: str, most: int = NONE) -> list[int]:
        """The number of tokens of each prefix of a chunk, from the empty one on, in one pass. With ``most``, it ends
        where no longer prefix can have as few."""
        out, before, at = [0], 0, 0
        for m in self.special.finditer(chunk) if self.special is not None and "<|" in chunk else ():
            # Cut short, a special string is text that goes on.
            counts = NormalPrefixes(self, chunk[at : m.end()], most - before).counts()
            out += [before + n for n in counts[1 : m.end() - at]]
            if len(out) < m.end():
                return out
            before += counts[m.start() - at] + 1
            out.append(before)
            at = m.end()
        return out + [before + n for n in NormalPrefixes(self, chunk[at:], most - before).counts()[1:]]

    def cut(self, chunk: str, budget: int) -> int:
        """The characters of the longest prefix of a chunk that has ``budget`` tokens at most."""
        counts = self.chunk_prefixes(chunk, budget)
        return max((i for i, n in enumerate(counts) if n <= budget), default=0)


@lru_cache(maxsize=1)
def seconds() -> frozenset[str]:
    """The characters that may compose with one before them: those that stand second in a canonical decomposition, and the
    vowels and final consonants of Hangul."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    return frozenset([chr(int(d[1], 16)) for d in pairs if len(d) == 2 and not d[0].startswith("<")] + [chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))])


class NormalPrefixes:
    """The token counts of the prefixes of a text without special strings. The normal form of most prefixes is a prefix of the
    text's normal form, whose counts are stored; where it isn't (a letter whose accents are still to come), it differs in
    its last few letters, and only these are added to what is stored."""

    def __init__(self, own: PrefixCounter, text: str, most: int):
        self.own, self.text = own, text
        bounds = range(len(text) + 1)
        if not unicodedata.is_normalized("NFC", text):
            # Nothing composes or changes places over these bounds.
            bounds = [0, *(i for i in range(1, len(text)) if not unicodedata.combining(text[i]) and text[i] not in seconds()), len(text)]
        self.segments = [text[i:j] for i, j in zip(bounds, bounds[1:])]
        forms = [self.form(s) for s in self.segments]
        self.ends = [0, *np.cumsum([len(f) for f in forms]).tolist()]
        self.normal = "".join(forms)
        self.stored, self.words = [0], []
        before = 0
        for m in own.pattern.finditer(self.normal):
            self.stored += [before] * (m.start() + 1 - len(self.stored))  # over white space beyond ASCII, if any
            word = m.group()
            if word[0] == "'" and len(word) > 1 and word[1].isalpha():  # cut short, it is a quote and letters
                counts = [0, own.prefix_counts("'")[1]]
                counts += [counts[1] + n for n in own.prefix_counts(word[1:-1])[1:]] + [own.word_counts([word])[0]]
                self.words.append((m.start(), before, word, None))
            else:
                spelt = own.spelt(word)
                states = own.prefix_states(spelt, most - before)
                cuts = np.cumsum([0, *(len(c.encode()) for c in word)]).tolist()
                counts = [states[0][e] for e in cuts if e < len(states[0])]
                self.words.append((m.start(), before, spelt, (states, cuts)))
            self.stored += [before + n for n in counts[1:]]
            if len(counts) <= len(word) or before + counts[-1] > most + own.longest:
                break
            before += counts[-1]
        else:
            self.stored += [before] * (len(self.normal) + 1 - len(self.stored))
        self.starts = [w[0] for w in self.words]

    @staticmethod
    def form(text: str) -> str:
        return "".join(c.lower() for c in unicodedata.normalize("NFC", text))

    def counts(self) -> list[int]:
        out = [0]
        for k, segment in enumerate(self.segments):
            at = self.ends[k]
            for i in range(1, len(segment) + 1):
                tail = self.form(segment[:i])
                if self.normal.startswith(tail, at):
                    if at + len(tail) >= len(self.stored):
                        return out
                    out.append(self.stored[at + len(tail)])
                elif at >= len(self.stored):
                    return out
                else:
                    out.append(self.with_tail(at, tail))
        return out

    def with_tail(self, at: int, tail: str) -> int:
        """The count of the first ``at`` letters of the normal form and ``tail``."""
        own = self.own
        many = lambda words: sum(own.word_counts([own.spelt(w) for w in words]))
        k = bisect.bisect_left(self.starts, at) - 1  # the word that the letter before is in
        if k < 0 or self.normal[at - 1].isspace():
            return self.stored[at] + many(own.pattern.findall(tail))
        start, before, spelt, known = self.words[k]
        if known is None or at - start <= own.longest:
            return before + many(own.pattern.findall(self.normal[start:at] + tail))
        first, *rest = own.pattern.findall(self.normal[at - 1] + tail)
        if len(first) == 1:
            return self.stored[at] + many(rest)
        # The word goes on: no token reaches back further than the longest.
        (_, lasts, counts), cuts = known
        end = cuts[at - start]
        low = end - own.longest
        word = spelt[low:end] + own.spelt(first[1:])
        lasts, counts = lasts[low : end + 1], counts[low : end + 1]
        for i in range(end - low + 1, len(word)):
            t = own.last(word, i, lasts, "")
            lasts.append(t)
            counts.append(counts[i - len(t)] + 1)
        t = own.last(word, len(word), lasts, own.end)
        return before + counts[len(word) - len(t) + len(own.end)] + 1 + many(rest)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


class ChunkCounts:
    """Token counts of chunks by their 64-bit hash, kept from one slice of texts to the next."""

    def __init__(self, own: PrefixCounter):
        self.own, self.keys, self.counts = own, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def of(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        keys, index, inverse = np.unique(hash_spans(data, starts, lengths), return_index=True, return_inverse=True)
        if len(self.keys) > KEPT:
            self.keys, self.counts = self.keys[:0], self.counts[:0]
        at = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(np.append(self.keys, 0)[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            chunks = [data[a : a + k].tobytes().decode() for a, k in zip(starts[index[new]].tolist(), lengths[index[new]].tolist(), strict=True)]
            counts = np.array(self.own.chunk_counts(chunks), np.int64)
            self.keys, self.counts = np.insert(self.keys, at[new], keys[new]), np.insert(self.counts, at[new], counts)
            at = np.searchsorted(self.keys, keys)
        return self.counts[at][inverse]


@lru_cache(maxsize=2)
def chunk_counts(path: str) -> ChunkCounts:
    return ChunkCounts(counter(path))


def token_counts(documents: DataFrame, path: str, budget: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_prefixes: bool = False) -> DataFrame:
    """Exact token counts of whole texts, and the answer to where a budget of tokens ends.

    Returns for each row doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``budget`` tokens), cut_chars (the
    characters of the longest prefix that keeps to the budget), prefixes_sha256 (of the counts of the prefixes up to the end
    of each run of non-blank characters, as little-endian unsigned 32-bit integers) and, ``with_prefixes``, these counts as
    prefix_tokens with prefix_ends (in bytes); inside a run, ``PrefixCounter.chunk_prefixes`` has the counts. No token is added at the begin or end; strings of special
    tokens inside a text count as one token. A null text counts as empty: no bytes, no tokens. Rows are taken one by
    one, so repeated rows and null ids pass; an empty table gives an empty table. ``path`` names a vocabulary file that
    all executors have; further columns are not looked at.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long, prefixes_sha256 string" + ", prefix_ends array<long>, prefix_tokens array<long>" * with_prefixes

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chunks = counter(path), chunk_counts(path)
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for i, j in slices(off):
                w = Words(buf, off, i, j, SPACED, lower=False)
                sums = np.concatenate([[0], np.cumsum(chunks.of(w.bytes, w.starts, w.lengths))])
                base = sums[w.first]
                total = base[1:] - base[:-1]
                cuts, digests, ends, prefixes = [], [], [], []
                for k in range(j - i):
                    a, b = int(off[i + k]), int(off[i + k + 1])
                    first, last = w.first[k], w.first[k + 1]
                    if total[k] <= budget:
                        cuts.append(len(buf[a:b].tobytes().decode()))
                    else:
                        x = first + int(np.searchsorted(sums[first + 1 : last + 1] - base[k], budget, "right"))  # the chunk that goes over
                        start = int(w.starts[x]) + int(off[i]) - a
                        text = buf[a:b].tobytes()
                        chunk = text[start : start + int(w.lengths[x])].decode()
                        cuts.append(len(text[:start].decode()) + own.cut(chunk, budget - int(sums[x] - base[k])))
                    digests.append(hashlib.sha256((sums[first + 1 : last + 1] - base[k]).astype("<u4").tobytes()).hexdigest())
                    if with_prefixes:
                        ends.append(w.starts[first:last] + w.lengths[first:last] + off[i] - a)
                        prefixes.append(sums[first + 1 : last + 1] - base[k])
                arrays = [batch.column(0).slice(i, j - i), pa.array(np.diff(off[i : j + 1])), pa.array(total), pa.array(total > budget), pa.array(cuts, pa.int64()), pa.array(digests, pa.string())]
                if with_prefixes:
                    arrays += [pa.array(ends, pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars", "prefixes_sha256"] + ["prefix_ends", "prefix_tokens"] * with_prefixes)

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rows, schema)

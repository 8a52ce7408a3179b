"""SimHash near duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash

P = pytest.importorskip("public_tokenizers")

from corpusq.llm.simhash import close_pairs, gray_rank, hamming_links, simhash_duplicates, xxh64_spans  # noqa: E402
from test_operators import SCHEMA, lower, made, words  # noqa: E402


def fingerprint(text):
    w = words(lower(text))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, most_bits):
    """The least number of each one's component, by comparing all pairs."""
    own = list(range(len(prints)))

    def find(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most_bits:
                a, b = find(i), find(j)
                own[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_hashes_of_spans_equal_the_library():
    r = random.Random(3)
    spans = [bytes(r.randrange(256) for _ in range(n)) for n in [*range(100), 255, 256, 1023, 1024, 1025, 4000, *(r.randint(0, 90) for _ in range(300))]]
    lengths = np.array([len(s) for s in spans])
    data = np.frombuffer(b"".join(spans) + bytes(8), np.uint8).copy()
    got = xxh64_spans(data, np.cumsum(lengths) - lengths, lengths)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(s, 42) for s in spans]


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_index_finds_all_pairs(bits):
    r = random.Random(bits)
    centres = [r.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for c in centres for _ in range(60)}
    order = sorted(prints, key=lambda x: int(gray_rank(np.array([x], np.uint64))[0]))
    found = {(int(a), int(b)) for x, y in close_pairs(np.array(order, np.uint64), bits) for a, b in zip(x, y, strict=True)}
    assert found == {(i, j) for j in range(len(order)) for i in range(j) if (order[i] ^ order[j]).bit_count() <= bits}


@pytest.mark.parametrize("size", [2, 16, 1024])
def test_links_connect_as_all_pairs_do(spark, size):
    """Crowded nodes go deeper: groups whose fingerprints differ in the last bits, and chains that lead away in steps of two bits."""
    r = random.Random(size)
    prints = {r.getrandbits(64) for _ in range(50)} | {0, (1 << 64) - 1}
    for c in (r.getrandbits(64), r.getrandbits(64) >> 30):
        prints |= {c ^ r.getrandbits(7) for _ in range(90)} | {c ^ (r.getrandbits(4) << 40) for _ in range(12)}
        x = c
        for _ in range(20):
            x ^= sum(1 << b for b in r.sample(range(64), 2))
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = hamming_links(spark.createDataFrame([(p,) for p in signed], "fingerprint long"), 2, size).collect()
    at = {p: i for i, p in enumerate(signed)}
    own = list(range(len(prints)))

    def find(i):
        while own[i] != i:
            i = own[i]
        return i

    for a, b in links:
        x, y = find(at[a]), find(at[b])
        own[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(prints))] == classes(prints, 2)


def test_documents(spark):
    rows = made(seed=5, n=60)
    text = rows[4][1]
    rows += [(500 + k, text + " x" * k, "s", 1, "t", 1, 1) for k in range(1, 12)] + [(700, "w" * 3000 + " a " + "v" * 2000, "s", 1, "t", 1, 1), (None, text, "s", 1, "t", 1, 1)]
    got = simhash_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    prints = [fingerprint(r[1]) for r in rows]
    named = [i for i, r in enumerate(rows) if r[0] is not None]
    label = classes([prints[i] for i in named], 2)
    least = {}
    for i, c in zip(named, label, strict=True):
        least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    want = [(rows[i][0], f"{prints[i]:016x}", least[c]) for i, c in zip(named, label, strict=True)] + [(None, f"{prints[i]:016x}", None) for i, r in enumerate(rows) if r[0] is None]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert any(w[0] != w[2] for w in want)


def test_empty_table(spark):
    out = simhash_duplicates(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0

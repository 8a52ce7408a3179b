"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

P = pytest.importorskip("public_tokenizers")

from corpusq.llm.counts import PrefixCounter, token_counts  # noqa: E402
from corpusq.llm.decontaminate import contamination, passages, positional_index, windows  # noqa: E402
from corpusq.llm.lines import line_dedup  # noqa: E402
from corpusq.llm.lm import lm_scores  # noqa: E402
from corpusq.llm.minhash import REGION, components, near_duplicates  # noqa: E402
from corpusq.llm.pieces import PieceEncoder, encode_decode  # noqa: E402
from corpusq.llm.quality import quality_rows, quality_rules  # noqa: E402
from corpusq.llm.sharding import shard  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SCHEMA = "doc_id long, text string, source string, node long, term string, row int, a long"
WORDS = "the of and lorem ipsum dolor amet Sit zwölf été naïve #tag x1 y2 && state".split()


def made(seed=1, n=40):
    """Documents with copies, near copies, common lines and odd texts."""
    r = random.Random(seed)
    texts = [" ".join(r.choice(WORDS) + str(r.randint(0, 60)) for _ in range(r.randint(1, 120))) for _ in range(n)]
    for i in range(0, n - 6, 6):
        words = texts[i].split(" ")
        words[len(words) // 2] = "changed"
        texts[i + 1] = " ".join(words).upper()
        texts[i + 2] = texts[i] + "\nA common line of many documents\n  short  \n" + "and and and and"
        texts[i + 3] = texts[i]
    texts += ["", " \n\t ", None, "one two", "ONE  two", "a\x00b \x1c c", "q" * 5000, "w " * 3000, "\n\n\n", "A common line of many documents "]
    rows = [(i, t, None if i % 11 == 0 else f"s{i % 3}", 7, "t", 1, 2) for i, t in enumerate(texts)]
    return [*rows, rows[2], rows[3], (None, "a row without an id " * 5, "s0", 7, "t", 1, 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t):
    w = words(lower(t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets.setdefault(i, shingles(t))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates(spark, docs, none):
    got = near_duplicates(docs).collect()
    want = groups(made())
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["kept"] and r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["component_id"] == r["doc_id"])
    assert near_duplicates(none).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    r = random.Random(4)
    base = [f"w{r.randint(0, 999)}" for _ in range(200)]
    rows = []
    for i in range(8 * REGION):
        own = list(base)
        for _ in range(r.randint(0, 6)):
            own[r.randrange(200)] = f"v{r.randint(0, 10**6)}"
        rows.append((i, " ".join(own)))
    want = groups(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == {i: c for i, (_, c) in want.items()}


def test_near_duplicates_in_a_template_group(spark):
    """Texts of shared passages, similar by about 0.7 to all others, and planted pairs over 0.75 among them."""
    r = random.Random(5)
    passages = [" ".join(f"p{k}x{j}" for j in range(12)) for k in range(60)]
    rows = []
    for i in range(300):
        own = [f"o{i}y{j}" for j in range(75)]
        rows.append((i, " ".join([p for p in passages if r.random() < 0.9] + own)))
        if i % 10 == 0:
            rows.append((1000 + i, rows[-1][1].replace(f"o{i}y40", "other").replace("p7x", "q7x").replace("p30x", "q30x")))
    want = groups(rows)
    assert 20 < len({c for _, c in want.values()}) < 300
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == {i: c for i, (_, c) in want.items()}


def test_pairs_among_pages_of_one_site(spark):
    """A sixth of each page is its own, which makes all alike by 0.73; pairs of 0.75 to 0.78 lose none of their links."""
    import numpy as np

    r, rows = random.Random(6), []
    site = [f"s{j}" for j in range(254)]
    for i in range(1500):
        own = [f"o{i}y{j}" for j in range(46)]
        rows.append((i, " ".join(site + own)))
        if i % 5 == 0:
            k = r.randint(7, 9)
            rows.append((10_000 + i, " ".join(site + own[:k] + [f"n{i}y{j}" for j in range(46 - k)])))
    r.shuffle(rows)
    sets = {i: shingles(t) for i, t in rows}
    at, number = list(sets), {}
    codes = [[number.setdefault(g, len(number)) for g in sets[i]] for i in at]
    often = Counter(c for own in codes for c in own)
    used = {c: k for k, c in enumerate(c for c, n in often.items() if n > 1)}
    m = np.zeros((len(at), len(used)), np.float32)
    for k, own in enumerate(codes):
        m[k, [used[c] for c in own if c in used]] = 1
    both, n = m @ m.T, np.array([len(x) for x in codes])
    share = both / (n[:, None] + n[None, :] - both)
    linked = {tuple(sorted((at[i], at[j]))) for i, j in zip(*np.nonzero(np.triu(share >= 0.75, 1)), strict=True)}
    assert len(linked) == 300 and 0.7 < np.median(share) < 0.745
    got = {x["doc_id"]: x["component_id"] for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = {i: i for i in at} | {b: a for a, b in linked}
    assert got == want


@pytest.mark.parametrize("pages", [200, 400])
def test_candidates_among_pages_that_leave_out_passages(spark, monkeypatch, pages):
    """Pages hold each of a site's passages with a chance of 0.85: alike by 0.6, they are not made into pairs, while all
    planted near copies are found. Cells are small here, so that they are compared across."""
    from corpusq.llm import minhash

    monkeypatch.setattr(minhash, "CELL", 50)
    counted, plain = [], minhash.crowded_pairs

    def crowded_pairs(*args):
        out = plain(*args)
        counted.append(out.count())
        return out

    monkeypatch.setattr(minhash, "crowded_pairs", crowded_pairs)
    r, rows = random.Random(8), []
    passages = [" ".join(f"p{k}x{j}" for j in range(10)) for k in range(60)]
    for i in range(pages):
        kept = [p for p in passages if r.random() < 0.85]
        rows.append((i, " ".join(kept + [f"o{i}y{j}" for j in range(60)])))
        if i % 20 == 0:
            rows.append((100_000 + i, " ".join(kept[r.randint(1, 5) :] + [f"o{i}y{j}" for j in range(40)] + [f"n{i}y{j}" for j in range(20)])))
    want = groups(rows)
    got = {x["doc_id"]: x["component_id"] for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: c for i, (_, c) in want.items()}
    assert len(counted) == 1 and counted[0] <= 2 * pages


def test_bounds_of_bitmaps():
    """No pair at the similarity is lost, at sizes whose bitmaps differ in length too."""
    import numpy as np
    import pyarrow as pa

    from corpusq.llm.minhash import _bitmaps, _compared

    r = np.random.default_rng(1)
    sets, k = {}, 0
    for size in (1, 2, 3, 60, 70, 500, 513, 520, 1030, 9000):
        base = r.integers(-(1 << 63), 1 << 63, size)
        for changed in (0, size // 20, size // 8, size // 6, size // 3):
            sets[k] = np.concatenate([base[changed // 2 :], r.integers(-(1 << 63), 1 << 63, changed // 2)])
            k += 1
    want = set()
    for a, x in sets.items():
        for b, y in sets.items():
            common = len(np.intersect1d(x, y))
            if a < b and 100 * common >= 75 * (len(x) + len(y) - common):
                want.add((a, b))
    batch = pa.RecordBatch.from_arrays([pa.array([*sets], pa.int64()), pa.array([*sets], pa.int64()), pa.array([True] * len(sets)), pa.array([*sets.values()], pa.list_(pa.int64()))], ["node", "component", "leads", "shingles"])
    made = pa.Table.from_batches(_bitmaps(iter([batch])))
    for cells in (1, 2):
        pieces = []
        for lo, hi in [(0, 0)] if cells == 1 else [(0, 0), (0, 1), (1, 1)]:
            for row in made.to_pylist():
                cell = row["node"] % cells
                if cell in (lo, hi):
                    pieces.append({"region": 7, "lo": lo, "hi": hi, "cell": cell, **row})
        got = {(a, b) for out in _compared(75)(iter(pa.Table.from_pylist(pieces).to_batches(max_chunksize=7))) for a, b in zip(*out.to_pydict().values(), strict=True) if a != b}
        assert want <= got and len(got) <= 1.2 * len(want)


def test_neighbours_in_the_sorted_orders():
    """Regions deepen where they are crowded; rows stand beside what shares their longest prefix."""
    import numpy as np
    import pyarrow as pa

    from corpusq.llm.minhash import _neighbours

    q = lambda *v: v[0] << 32 | v[1] << 16 | v[2]
    rows = [(1, 5, q(1, 1, 1)), (2, 5, q(9, 9, 9))]  # a small region
    rows += [(10 + i, 6, q(1, 1, i)) for i in range(3)] + [(20 + i, 6, q(2 + i, 0, 0)) for i in range(REGION)]  # a crowded one
    rows += [(0, 4, 0), (99, 7, 0)]
    rows.sort(key=lambda x: (x[1], x[2], x[0]))
    batch = pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in range(3)], ["node", "p", "q"])
    got = [r for b in _neighbours(iter([batch])) for r in b.to_pylist()]
    pairs = {(r["a"], r["b"]) for r in got if r["region"] is None}
    assert {(1, 2), (10, 11), (10, 12), (11, 12), (20, 21), (12, 20)} <= pairs and (21, 23) not in pairs
    assert {(10, 20 + i) for i in range(REGION)} <= pairs
    assert {r["a"] for r in got if r["region"] == 6} == {*range(10, 13), *range(20, 20 + REGION)}
    assert {r["a"] for r in got if r["region"] in (4, 7)} == {0, 99} and not any(r["region"] == 5 for r in got)
    assert np.array(list(pairs)).min() > 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (103, 102), (101, 103)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 104)}}


def strings(seed, n, alphabet):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 90))) for _ in range(n)]


ODD = "aabbeeiiooththesntr  ▁\n\té日本́\U0001f600ÿ0<>x'"


def test_piece_encoder_is_the_library():
    import sentencepiece

    own, lib = PieceEncoder(P.path("piece_bpe_32k.model")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = [*strings(1, 600, ODD), *strings(2, 600, "thean "), " " * 700, "the" * 500, "a" * 900, "", "▁", "<s></s><unk><0x41>"]
    for t, ids in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        want = lib.encode(t, add_bos=True, add_eos=True)
        assert [1, *ids.tolist(), 2] == want
        assert own.decode(__import__("numpy").array(want)).decode() == lib.decode(want)


def test_encode_decode(spark, docs, none):
    import struct

    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = encode_decode(docs, P.path("piece_bpe_32k.model"), with_ids=True, with_text=True).collect()
    texts = {i: t or "" for i, t, *_ in made()}
    assert len(got) == docs.count()
    for r in got:
        ids = lib.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded"] == lib.decode(ids) and r["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert encode_decode(none, P.path("piece_bpe_32k.model")).count() == 0


def test_shards(spark, docs, none):
    got = shard(docs, shards=8).collect()
    assert len(got) == docs.count()
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    total = Counter(r["source"] for r in got)
    for s in sizes:
        for source, n in total.items():
            assert abs(sum(r["shard"] == s and r["source"] == source for r in got) - n * sizes[s] / len(got)) <= 2
    for i, t, *_ in made():
        assert any(r["doc_id"] == i and r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((t or "").encode()) for r in got)
    assert shard(none).count() == 0
    again = shard(docs.repartition(5), shards=8).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_shards_are_those_of_the_rule(spark, docs):
    """Shard and slot by brute force, with the hashes that order rows and part sources."""
    import struct

    import xxhash

    def hashed(*values):
        h = 42
        for k, v in enumerate(values):
            if v is not None:
                h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q" if k else "<i", v), seed=h)
        return h - (1 << 64) if h >> 63 else h

    rows, sources = [], {}
    for i, t, s, *_ in made():
        row = (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
        name = "" if s is None else f"={s}"
        sources.setdefault(name, []).append((hashed(17, *row), row, s))
    total = len(made())
    alike = {n: sorted((hashed(17, x), x) for x, own in sources.items() if len(own) == n) for n in {len(x) for x in sources.values()}}
    for name, own in sources.items():
        nth, k = alike[len(own)].index((hashed(17, name), name)), len(alike[len(own)])
        own.sort(key=lambda x: (x[0], x[1][0] is not None, x[1][0] or 0))
        for rank, (h, row, s) in enumerate(own):
            above, below = (rank * 2 * k + 2 * nth + 1) * total, len(own) * 2 * k
            rows.append((above // below, above % below / below, name, h, row, s))
    rows.sort(key=lambda x: (*x[:4], x[4][0] or 0))
    want, slots = [], Counter()
    for at, (*_, row, s) in enumerate(rows):
        k = at * 8 // total
        want.append((row[0], s, row[1], row[2], k, slots[k]))
        slots[k] += 1
    got = [tuple(r) for r in shard(docs, shards=8).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_shards_of_many_small_sources(spark):
    """Sources of one row each are spread over buckets and shards like others."""
    from corpusq.llm.sharding import BUCKET_ROWS

    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") % 3 == 0, F.lit("big")).otherwise(F.concat(F.lit("h"), "id")).alias("source"))
    got = shard(docs, shards=8).cache()
    by = got.groupBy("shard").agg(F.count("*").alias("n"), F.count_if(F.col("source") == "big").alias("big")).collect()
    assert {r["n"] for r in by} == {7500} and all(abs(r["big"] - 2500) <= 2 for r in by)
    assert got.select("shard", "slot").distinct().count() == 60_000
    fraction = F.floor((F.col("shard") * 7500 + F.col("slot")) / BUCKET_ROWS)
    assert got.where("source != 'big'").groupBy(fraction).count().agg(F.max("count")).first()[0] <= BUCKET_ROWS


def test_lm_scores(spark, docs, none):
    rows = made()
    train = [lower(t) for i, t, *_ in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    one, two, three, at_start = Counter(), Counter(), Counter(), len(train)
    for t in train:
        w = ["<>", "<>", *words(t), "</>"]
        one.update(w[2:])
        two.update(zip(w[1:], w[2:]))
        three.update(zip(w, w[1:], w[2:]))
    total, distinct = sum(one.values()), len(one)
    known = one | {"<>": at_start}
    pairs = two | {("<>", "<>"): at_start}
    base = lambda w: math.log10((one[w] + 0.1) / (total + 0.1 * (distinct + 1)))

    def log(u, v, w):
        double = (two[v, w] + 500 * 10 ** base(w)) / (known.get(v, 0) + 500)
        return math.log10((three[u, v, w] + 4 * double) / (pairs.get((u, v), 0) + 4))

    scores, model = lm_scores(docs)
    texts = {i: t for i, t, *_ in rows}
    for r in scores.collect():
        w = [*words(lower(texts[r["doc_id"]])), "</>"]
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(one[x] > 0 for x in w), total)
        assert r["base_score"] == pytest.approx(sum(map(base, w)), abs=1e-6)
        assert r["score"] == pytest.approx(sum(log(*x) for x in zip(["<>", "<>", *w], ["<>", *w], w)), abs=2e-4 * len(w))
    assert model.agg(F.sum("n_sequences"), F.sum("n_contexts")).first() == (len(three), len(pairs))
    assert lm_scores(none)[0].count() == 0


def test_trie_is_asked_through_its_pointers():
    import numpy as np

    from corpusq.llm.lm import STEPS, EliasFano, Trie

    r = np.random.default_rng(3)
    contexts, words = np.unique(r.integers(0, 1 << 48, 50).astype(np.uint64)), np.unique(r.integers(0, 1 << 63, 30).astype(np.uint64))
    held = np.unique(r.integers(0, 50 * 30, 400))
    of, number, counts = held // 30, held % 30, r.integers(1, 9, len(held))
    totals = np.maximum(np.bincount(of, counts, minlength=50).astype(np.int64), 1)
    data = np.frombuffer(Trie.packed(contexts, totals, words, of, number, counts), np.uint8)
    asked = np.arange(50 * 30)
    many, found = Trie(data).ask(np.append(contexts, np.uint64(7)), words, np.append(asked // 30, 50), np.append(asked % 30, 0))
    assert many[-1] == STEPS and found[-1] == STEPS and (many[:-1] < STEPS).all()
    assert set(np.flatnonzero(found < STEPS)) == set(held.tolist())
    want = np.log10(counts / (totals[of] + 4))
    assert np.abs(found[held] / (STEPS - 1) * -12 - want).max() < 1e-4
    broken = Trie(data)
    ends = broken.pointers.values()
    broken.pointers = EliasFano(np.frombuffer(EliasFano.packed(np.append(ends[:-1] // np.uint64(2), ends[-1:]), len(held) + 1), np.uint8))
    assert (broken.ask(contexts, words, asked // 30, asked % 30)[1] != found[:-1]).sum() > 100


def test_split_contexts_score_as_others(spark, docs, monkeypatch):
    """Parts of every size, a tiny code book and split contexts give the same scores."""
    import corpusq.llm.lm as lm

    plain = {str(tuple(r)[:5]): tuple(r)[5:] for r in lm_scores(docs)[0].collect()}
    found = []
    for name, value in (("HOT", 10), ("PART_ASKED", 90), ("BLOCK_BYTES", 900)):
        monkeypatch.setattr(lm, name, value)
    hot, book = lm.hot_contexts, lm.code_book
    monkeypatch.setattr(lm, "code_book", lambda blocks, n: book(blocks, n)[:3])
    monkeypatch.setattr(lm, "hot_contexts", lambda blocks, n: found.append(hot(blocks, 50)) or found[-1])
    for r in lm.lm_scores(docs)[0].collect():
        assert tuple(r)[5:] == pytest.approx(plain[str(tuple(r)[:5])], abs=1e-3)
    assert len(found[0]) > 0


def test_lm_beats_unigrams_on_held_out_texts(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not __import__("os").path.exists(path):
        pytest.skip("no test tables")
    s = lm_scores(spark.read.parquet(path))[0].where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert s[0] > s[1]


def test_prefix_counter_is_the_library():
    from tokenizers import Tokenizer

    own, lib = PrefixCounter(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    n = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    for t in [*strings(3, 500, ODD + " 　<>İßΣς"), *strings(4, 400, "thean's l"), "x<|endoftext|>y <|startoftext|><|ENDOFTEXT|>", "I'll we've 're", "a" * 300]:
        assert own.text_count(t) == n(t)
        for chunk in t.split()[:2]:
            for budget in (0, 2, 5):
                assert own.cut(chunk, budget) == max(i for i in range(len(chunk) + 1) if n(chunk[:i]) <= budget)
    r = random.Random(8)
    marks = ["e", "a", "\u0301", "\u0323", "İ", "가", "\u1100", "\u1161", "\u11a8", "Å", "x", "1", "'s", "!", "<|endoftext|>", "\u0344", "th", "　", "ﬁ", "ẞ"]
    for t in ["".join(r.choice(marks) for _ in range(r.randint(1, 25))) for _ in range(150)] + ["e\u0301" * 40, "a\u0323\u0301" * 20 + "!", "x" * 60 + "e\u0301"]:
        for chunk in t.split():
            assert own.chunk_prefixes(chunk) == [n(chunk[:i]) for i in range(len(chunk) + 1)], ascii(chunk)
            assert own.cut(chunk, 7) == max(i for i in range(len(chunk) + 1) if n(chunk[:i]) <= 7)
    for word in ("unbelievable", "thethethe", "a", "internationalization"):
        assert own.prefix_counts(word) == [n(word[:i]) for i in range(len(word) + 1)]


def test_prefixes_of_long_chunks_take_linear_time():
    """Letters whose lower case is longer, accents of their own and special strings lead to no second encoding."""
    import time

    own = PrefixCounter(P.path("word_bpe_49k.json"))
    for chunk in ("İ" + "ab" * 50_000, "e\u0301" * 50_000, "<|endoftext|>" * 3 + "the" * 33_000):
        began = time.process_time()
        assert len(own.chunk_prefixes(chunk)) == len(chunk) + 1
        assert time.process_time() - began < 5
        assert own.cut(chunk, 2048) < len(chunk)


def test_token_counts(spark, docs, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    n = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    texts = {i: t or "" for i, t, *_ in made()}
    for r in token_counts(docs, P.path("word_bpe_49k.json"), budget=50, with_prefixes=True).collect():
        t = texts[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n(t), n(t) > 50)
        if r["over_limit"]:
            assert n(t[: r["cut_chars"]]) <= 50 < n(t[: r["cut_chars"] + 1]) or t[r["cut_chars"]].isspace()
        else:
            assert r["cut_chars"] == len(t)
        for end, tokens in list(zip(r["prefix_ends"], r["prefix_tokens"], strict=True))[:5]:
            assert n(t.encode()[:end].decode()) == tokens
    assert token_counts(none, P.path("word_bpe_49k.json")).count() == 0


def key(line):
    return lower(line.strip(" \t\n\x0b\f\r"))


def lines_of_hosts(rows, limit, by_text=False, first_keeps=False):
    """(source, key) of common lines with the id that keeps them."""
    held = {}
    for i, t, s, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                held.setdefault((s, key(line)), set()).add((t, i))
    n = lambda x: len({t for t, _ in x} if by_text else {i for _, i in x if i is not None})
    return {k: min((i for _, i in x if i is not None), default=None) if first_keeps else None for k, x in held.items() if n(x) > limit}


def judged(rows, limit=2, least=20, **how):
    """Measures, verdict and cleaned text of each row."""
    common, out = lines_of_hosts(rows, limit, **how), []
    for i, t, s, *_ in rows:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        at = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeats = {k + j for k in range(len(w) - 2) if at[tuple(w[k : k + 3])] > 1 for j in range(3)}
        gone = lambda x: (s, key(x)) in common and (i is None or common[s, key(x)] != i)  # noqa: B023, E731
        lost = sum(len(words(x)) for x in (t or "").split("\n") if gone(x))
        failed = len(w) < least or 100 * len(repeats) > 50 * len(w)
        row = (i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(repeats), lost, failed, not failed and len(w) - lost >= 0.3 * len(w))
        out.append((row, None if t is None else "\n".join(x for x in t.split("\n") if not gone(x))))
    return out


@pytest.mark.parametrize("how", [{}, {"by_text": True}, {"first_keeps": True}])
def test_quality_rules(spark, docs, none, how):
    want = [row for row, _ in judged(made(), **how)]
    assert sum(r[6] > 0 for r in want) > 3
    got = quality_rules(docs, min_words=20, line_limit=2, **how)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert quality_rules(none).count() == 0


def test_rows_without_common_lines(spark, docs, none):
    rows = made()
    found = judged(rows)
    assert any(t != text for (_, t, *_), (_, text) in zip(rows, found))
    for only in (True, False):
        want = [(r[0], text, *r[2:]) for r, (row, text) in zip(rows, found) if row[-1] or not only]
        got = quality_rows(docs, min_words=20, line_limit=2, only_kept=only)
        assert got.columns == docs.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert quality_rows(none).count() == 0


def test_line_dedup(spark, docs, none):
    rows = made()
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= 10:
                    first.setdefault(key(line), set()).add(i)
    want = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(first.get(key(x), [])) < 2 or min(first[key(x)]) == i]
        want.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert sorted(map(str, (tuple(r) for r in line_dedup(docs).collect()))) == sorted(map(str, want))
    assert line_dedup(none).count() == 0


def test_contamination(spark, docs, none):
    rows = made()
    items = [(10, rows[0][1]), (2, "one two"), (3, ""), (None, rows[5][1]), (5, None), (6, " ".join((rows[12][1] or "").split(" ")[:11])), (7, "and and and and and and and and and and")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    cut = {(str(i), tuple(w[k : k + 10])) for i, t in items if i is not None and (w := low(t)) for k in range(max(1, len(w) - 9))}
    for r in contamination(docs, bench).collect():
        w = low({i: t for i, t, *_ in rows}[r["doc_id"]])
        hit, found = set(), set()
        for i, g in cut:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found.add(i)
        assert (r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) == (len(w), len(hit), sorted(found), bool(hit))
    assert contamination(none, bench).count() == 0
    assert contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_near_passages(spark):
    import numpy as np

    docs = spark.createDataFrame([(1, "a b c d"), (2, "a x b c d"), (3, "d c b a q q")], "doc_id long, text string")
    rows = windows(spark.createDataFrame([(1, "a b c d")], "item_id long, text string"), 4)
    terms = np.sort(np.array([t for r in rows.collect() for t in r["terms"]], np.int64).view(np.uint64))
    found = passages(positional_index(docs, terms), rows, slop=1).collect()
    kinds = Counter(r["kind"] for r in found)
    assert kinds["phrase"] == 1 and kinds["near"] >= 2

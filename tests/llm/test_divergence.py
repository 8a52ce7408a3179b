"""Divergence of sources against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

import corpusq.llm.divergence as divergence_module  # noqa: E402
from corpusq.llm.divergence import divergence, shares  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, g int"


def made(seed=1, n=300):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdeäöñ" for b in ("x", "yy", "Zé")] + ["The", "the"]
    rows = []
    for i in range(n):
        lang, source = r.choice(["en", "en", "de", None]), r.choice(["s1", "s1", "s1", "s2", "ä", "z", None])
        some = vocabulary if lang == "en" else vocabulary[:9]
        rows.append((i, r.choice(["", "1,2 "]) + r.choice([" ", "\n", "-", "_"]).join(r.choice(some[:: 1 + (source == "s2")]) for _ in range(r.randint(0, 25))), lang, source, "t", 1, 2))
    rows += [(1, None, "en", "s1", "t", 1, 2), (2, "", "en", "bare", "t", 1, 2), (3, "word " * 4000, "en", "long", "t", 1, 2)]
    rows += [(4, "few words", "fr", s, "t", 1, 2) for s in ("a", "b", None)] + [(5, "alone", "it", "a", "t", 1, 2)] + [rows[0]] * 2
    return rows


def brute(rows, least=10, top=10):
    counts, texts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        groups[lang].add(source)
        counts[lang, source].update(words)
        texts[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in texts[lang].items() if n >= least)
        share = lambda own: {t: 1 + 1_000_000_000 * (own[t] + 2) // (sum(own[k] for k in kept) + 2 * len(kept)) for t in kept}
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pair), ("term", term)):
                items = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


@pytest.mark.parametrize(("segment", "borders"), [(500_000, 2_000_000), (20, 3)])
def test_against_brute_force(spark, monkeypatch, segment, borders):
    """Also with small segments, so that a language's vocabulary lies in several, and few borders compared at once."""
    monkeypatch.setattr(divergence_module, "SEGMENT", segment)
    monkeypatch.setattr(divergence_module, "BORDERS", borders)
    rows = made(seed=segment)
    got = sorted(tuple(r) for r in divergence(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect())
    assert got == brute(rows)
    assert {r[0] for r in got if r[2] == "pair" and r[4] == 0} >= {"fr"}


def test_shares_of_large_counts_are_exact():
    n, total = np.array([0, 5, 10**12, 8 * 10**15 - 3]), 8 * 10**15 + 7
    assert [int(x) for x in shares(n, total)] == [1 + 10**9 * (int(k) + 2) // total for k in n]


def test_empty_table(spark):
    out = divergence(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and out.count() == 0

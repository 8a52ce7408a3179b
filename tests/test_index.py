"""The stored index against a model that keeps all texts: added, replaced, deleted and merged documents, and unread blocks."""

import math
import random
import re
from collections import Counter

import pytest

import numpy as np
import pyarrow as pa

from corpusq.operators.blocks import all_terms_search, asked_blocks, chosen_blocks, prefix_search, top_search
from corpusq.operators.retrieval import query_terms
from corpusq.sources import index as I
from corpusq.sources.index import TextIndex, kept_index
from corpusq.sources.shared import shared_path, written
from pyspark.sql import functions as F

WORDS = ["alpha", "beta", "gamma", "deltas", "epsilonic", "zetawords", "etamorphosis", "thetaverse", "iotagraphical", "kappa"]


def cut(text):
    return [w for w in re.split(r"[^\w]+", (text or "").lower().replace("_", " ")) if w]


def scores(texts, terms):
    docs = {i: Counter(cut(t)) for i, t in texts.items()}
    n, mean = len(docs), sum(sum(c.values()) for c in docs.values()) / max(1, len(docs))
    out = {}
    for i, c in docs.items():
        dl, total, met = sum(c.values()), 0.0, 0
        for t in terms:
            if c[t]:
                df = sum(1 for x in docs.values() if x[t])
                total += math.log(1 + (n - df + 0.5) / (df + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * dl / mean))
                met += 1
        if met:
            out[i] = (round(total, 6), met)
    return out


def ranked(found, k):
    return sorted(((i, s) for i, s in found.items()), key=lambda x: (-x[1], x[0]))[:k]


def same(got, want):
    """Scores to five digits, as sums differ in their order; ids of equal scores may only differ among these."""
    got = [(r["id"], r["score"]) for r in sorted(got, key=lambda r: (-r["score"], r["id"]))]
    assert [round(s, 4) for _, s in got] == pytest.approx([round(s, 4) for _, s in want], abs=2e-4)
    assert {i for i, _ in got} == {i for i, _ in want}


def compared(spark, index, texts, k=5):
    queries = spark.createDataFrame([(0, "alpha zetawords"), (1, "epsilonic gamma thetaverse iotagraphical"), (2, "unknown"), (3, "etamorphosis deltas beta")], "query_id int, text string")
    asked = {0: ["zetawords", "alpha"], 1: ["iotagraphical", "thetaverse", "epsilonic", "gamma"], 2: ["unknown"], 3: ["etamorphosis", "deltas", "beta"]}
    any_, all_ = top_search(queries, index, k, direct=0).collect(), all_terms_search(queries, index, k).collect()
    for q, terms in asked.items():
        same([r for r in any_ if r["query_id"] == q], ranked({i: s for i, (s, _) in scores(texts, terms).items()}, k))
        three = terms[:3] if len(terms) > 1 else []
        same([r for r in all_ if r["query_id"] == q], ranked({i: s for i, (s, m) in scores(texts, three).items() if m == len(three)}, k))
    df = Counter(t for x in texts.values() for t in set(cut(x)))
    assert {r["term"]: r["df"] for r in index.terms().collect()} == df
    assert (index.n_docs(), round(index.mean_dl(), 9)) == (len(texts), round(sum(len(cut(t)) for t in texts.values()) / max(1, len(texts)), 9))
    places = {(r["term"], r["id"]): (r["tf"], r["dl"], r["places"]) for r in index.postings(spark.createDataFrame([("alpha",), ("kappa",)], "term string")).collect()}
    want = {(t, i): (cut(x).count(t), len(cut(x)), [p for p, w in enumerate(cut(x)) if w == t]) for i, x in texts.items() for t in ("alpha", "kappa") if t in cut(x)}
    assert places == want


def test_index_follows_changes(spark):
    r = random.Random(4)
    text = lambda: " ".join(r.choice(WORDS) for _ in range(r.choice([0, 1, 3, 9, 40])))
    index, texts = TextIndex(spark, shared_path(spark, "index")), {}
    for step in range(4):
        batch = {i: text() for i in r.sample(range(60), 25)}
        rows = [*batch.items(), (None, "alpha alpha"), (70 + step, None)]
        index.add(spark.createDataFrame(rows, "id long, text string"))
        texts |= batch | {70 + step: ""}
        if step in (1, 3):
            gone = r.sample(sorted(texts), 9)
            index.delete(spark.createDataFrame([(i,) for i in [*gone, 999]], "id long"))
            texts = {i: t for i, t in texts.items() if i not in gone}
            compared(spark, index, texts)
    before = TextIndex(spark, index.path)
    assert len(before.manifest.segments) == 4
    index.merge()
    assert len(index.manifest.segments) == 1
    compared(spark, index, texts)
    # An index that was opened before goes on with its version.
    assert before.n_docs() == len(texts) and before.terms().count() == index.terms().count()
    with pytest.raises(RuntimeError):
        before.delete(spark.createDataFrame([(min(texts),)], "id long"))
    index.delete(spark.createDataFrame([(min(texts),)], "id long")).merge(every=True).vacuum()
    texts.pop(min(texts))
    assert index.manifest.stale == []
    compared(spark, TextIndex(spark, index.path), texts)


def test_rows_of_an_id_in_a_batch_and_empty_tables(spark):
    index = TextIndex(spark, shared_path(spark, "index")).add(spark.createDataFrame([], "id long, text string"))
    assert index.n_docs() == 0 and index.terms().count() == 0
    assert top_search(spark.createDataFrame([(1, "alpha")], "query_id int, text string"), index, 3).count() == 0
    index.add(spark.createDataFrame([(1, "alpha"), (1, "beta"), (2, "...")], "id long, text string"))
    assert [tuple(r) for r in index.terms().select("term", "df").collect()] == [("beta", 1)] and index.n_docs() == 2


def test_failed_change_leaves_the_version(spark):
    index = TextIndex(spark, shared_path(spark, "index")).add(spark.createDataFrame([(1, "alpha beta")], "id long, text string"))
    broken = spark.createDataFrame([(2, "gamma")], "id long, text string").withColumn("text", F.expr("cast(raise_error('lost') as string)"))
    with pytest.raises(Exception):
        index.add(broken)
    again = TextIndex(spark, index.path)
    assert again.manifest.version == 1 and {r["term"] for r in again.terms().collect()} == {"alpha", "beta"}
    index.vacuum()
    assert TextIndex(spark, index.path).n_docs() == 1


def zipf(r, n):
    return [f"w{min(int(1 / max(r.random(), 1e-4)), 3000):04d}" for _ in range(n)]


def test_blocks_that_cannot_matter_are_not_read(spark):
    """Queries of rare and common words over texts whose words have Zipf's law: the same rows as from all postings, of
    which less than a third are read for k = 25."""
    r = random.Random(9)
    texts = {i: " ".join(zipf(r, r.randint(20, 200))) for i in range(6_000)}
    index = TextIndex(spark, shared_path(spark, "index")).add(spark.createDataFrame(list(texts.items()), "id long, text string"))
    queries = spark.createDataFrame(list(enumerate(["w0002 w0060 w0100", "w0003 w0080", "w0005 w0004 w0050", "w0010 w0070 w0090 w0002", "w0007 w0006 w0040 w0120"])), "query_id int, text string")
    asked = written(query_terms(queries), "asked")
    blocks = asked_blocks(asked, index, 25)
    looked = sum(part.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for part in chosen_blocks(blocks, index, 25)[0])
    every = blocks.agg(F.sum("n")).first()[0]
    assert looked * 3 < every, (looked, every)
    chosen, every = top_search(queries, index, 25, direct=0).collect(), top_search(queries, index, 25).collect()
    for q, text in [tuple(x) for x in queries.collect()]:
        want = ranked({i: s for i, (s, _) in scores(texts, text.split()).items()}, 25)
        for got in (chosen, every):
            same([x for x in got if x["query_id"] == q], want)


def test_prefixes_are_looked_up_in_the_dictionary(spark):
    texts = {1: "etamorphosis kappa", 2: "etamorphical", 3: "etam", 4: "iotagraphicalness alpha etamorphose", 5: "thetaverse"}
    index = TextIndex(spark, shared_path(spark, "index")).add(spark.createDataFrame(list(texts.items()), "id long, text string"))
    got = {(r["query_id"], r["id"]) for r in prefix_search(spark.createDataFrame([(1, "etamorphosis"), (2, "thetaverse kappa"), (3, "iotagraphical etamorphosis")], "query_id int, text string"), index, 9).collect()}
    assert got == {(1, 1), (1, 2), (1, 4), (2, 5), (2, 1), (3, 4)}


def test_kept_index_is_made_once_and_anew_for_a_changed_table(spark, tmp_path):
    path = f"{tmp_path}/docs.parquet"
    spark.createDataFrame([(1, "alpha")], "id long, text string").write.parquet(path)
    first = kept_index(spark, path, "id", F.col("text"))
    assert kept_index(spark, path, "id", F.col("text")).path == first.path
    spark.createDataFrame([(1, "alpha"), (2, "beta")], "id long, text string").write.mode("overwrite").parquet(path)
    again = kept_index(spark, path, "id", F.col("text"))
    assert again.path != first.path and again.n_docs() == 2


def test_counts_follow_changes_without_taking_postings_apart(spark):
    index = TextIndex(spark, shared_path(spark, "index")).add(spark.createDataFrame([(1, "alpha alpha beta"), (2, "alpha gamma"), (3, "beta")], "id long, text string"))
    index.add(spark.createDataFrame([(2, "beta beta delta"), (4, "gamma")], "id long, text string")).delete(spark.createDataFrame([(3,)], "id long"))
    counts = index.counts()
    assert {tuple(r) for r in counts.collect()} == {("alpha", 1, 2), ("beta", 2, 3), ("gamma", 1, 1), ("delta", 1, 1)}
    once = TextIndex(spark, shared_path(spark, "index")).add(spark.createDataFrame([(1, "alpha alpha")], "id long, text string")).counts()
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_blocks_are_made_of_a_bounded_number_of_words(monkeypatch):
    """Long texts in a batch are taken apart a few ranges at once, and all ranges are there, each whole."""
    r, made = random.Random(3), []
    docs = [[f"w{r.randrange(30)}" for _ in range(r.choice([0, 3, 90, 400]))] for _ in range(203)]
    slot = np.arange(203) + 5 + (np.arange(203) > 99) * 1000
    batch = pa.RecordBatch.from_arrays([pa.array(range(203)), pa.array(slot), pa.array([len(d) for d in docs], pa.int32()), pa.array(docs, pa.list_(pa.string()))], ["id", "slot", "dl", "tokens"])
    whole = I._range_blocks
    monkeypatch.setattr(I, "WORDS", 3000)
    monkeypatch.setattr(I, "_range_blocks", lambda rows, ranges: made.append(sum(rows.column("dl").to_pylist())) or whole(rows, ranges))
    got = [b for part in I._blocks(iter([batch.slice(0, 77), batch.slice(77)])) for b in part.to_pylist()]
    assert max(made) <= 3000 + 8 * 400
    want = {}
    for i, (s, d) in enumerate(zip(slot, docs)):
        for w in set(d):
            want.setdefault((w, int(s) // I.BLOCK), []).append((i, len(d), d.count(w), [p for p, x in enumerate(d) if x == w]))
    assert {(b["term"], b["range"]): [tuple(p.values()) for p in b["postings"]] for b in got} == want and len(got) == len(want)


def test_all_terms_are_looked_up_from_the_rarest(spark, monkeypatch):
    """Only postings where all terms of a query have a block are taken apart; a query with an unknown word costs none."""
    texts = {i: "alpha beta" + (" rare gamma" if i in (7, 90) else "") + (" single" if i == 8 else "") for i in range(400)}
    index = TextIndex(spark, shared_path(spark, "index")).add(spark.createDataFrame(list(texts.items()), "id long, text string"))
    queries = spark.createDataFrame([(1, "rare alpha beta"), (2, "alpha beta unknown"), (3, "single gamma"), (4, "rare gamma Rare")], "query_id int, text string")
    taken, whole = [], TextIndex.exploded
    monkeypatch.setattr(TextIndex, "exploded", lambda self, blocks: taken.append(blocks.agg(F.sum(F.size("postings"))).first()[0]) or whole(self, blocks))
    got = {tuple(r) for r in all_terms_search(queries, index, None, "plain").select("query_id", "id", "n_terms").collect()}
    assert got == {(1, 7, 3), (1, 90, 3), (4, 7, 2), (4, 90, 2)} and sum(taken) <= 2 * (8 + 8 + 2) + 2 * 4

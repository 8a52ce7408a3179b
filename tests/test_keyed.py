"""Keyed tables against a dictionary: what a change writes, what it logs, and the views that follow it."""

import random
import time

import pytest

from corpusq.sources import shared
from corpusq.sources.index import TextIndex
from corpusq.sources.keyed import KeyedTable, counted, recounted, reindexed
from corpusq.sources.shared import shared_path, written
from pyspark.sql import functions as F

SCHEMA = "id long, part int, word string, size long"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_changes_write_touched_buckets_only(spark):
    rows = [(i, 0, f"w{i}", i) for i in range(400)] + [(None, 0, "none", 1)]
    path = shared_path(spark, "keyed")
    table = KeyedTable.create(spark, path, spark.createDataFrame(rows, SCHEMA), ["id", "part"], buckets=16)
    before = dict(table.state["folders"])
    new = [(7, 0, "new", 1), (7, 0, "older", 0), (1_000, 2, "more", 3), (None, 0, "nothing", 2)]
    table.upsert(spark.createDataFrame(new, SCHEMA), F.col("size"))
    want = {(i, p): (i, p, w, n) for i, p, w, n in rows} | {(7, 0): (7, 0, "new", 1), (1_000, 2): new[2], (None, 0): new[3]}
    assert rows_of(table.read()) == sorted(want.values(), key=repr)
    after = table.state["folders"]
    moved = {b for b in after if after[b] != before.get(b)}
    assert len(moved) <= 3 and all(after[b] == before[b] for b in before if b not in moved)
    # The rows written are those of the touched buckets.
    wrote = spark.read.parquet(f"{path}/{after[next(iter(moved))].split('/')[0]}")
    assert wrote.count() == KeyedTable(spark, path)._rows(sorted(moved)).count() < 120
    assert rows_of(table.changes().selectExpr("before.word AS b", "after.word AS a")) == sorted([("w7", "new"), (None, "more"), ("none", "nothing")], key=repr)
    # Readers of the version before still find it; a second writer from it fails and leaves the new one.
    old = KeyedTable(spark, path, version=1)
    assert rows_of(old.read()) == sorted(map(tuple, rows), key=repr)
    with pytest.raises(RuntimeError):
        old.delete(spark.createDataFrame([(1, 0)], "id long, part int"))
    assert rows_of(KeyedTable(spark, path).read()) == sorted(want.values(), key=repr)


def test_failed_change_leaves_the_version(spark):
    path = shared_path(spark, "keyed")
    table = KeyedTable.create(spark, path, spark.createDataFrame([(1, 0, "a", 1)], SCHEMA), ["id", "part"])
    broken = spark.createDataFrame([(1, 0, "b", 1)], SCHEMA).withColumn("word", F.expr("cast(raise_error('lost') as string)"))
    with pytest.raises(Exception):
        table.upsert(broken)
    again = KeyedTable(spark, path)
    assert again.version == 1 and rows_of(again.read()) == [(1, 0, "a", 1)]
    again.vacuum()
    assert rows_of(KeyedTable(spark, path).read()) == [(1, 0, "a", 1)]


def test_children_and_cascades(spark):
    rows = [(i, p, "old", p) for i in range(50) for p in range(3)]
    table = KeyedTable.create(spark, shared_path(spark, "keyed"), spark.createDataFrame(rows, SCHEMA), ["id", "part"], ["id"], buckets=8)
    table.replace_children(spark.createDataFrame([(4, 9, "new", 0), (4, 10, "new", 0), (99, 1, "new", 0)], SCHEMA))
    table.delete(spark.createDataFrame([(5,), (6,), (777,)], "id long"), ["id"])
    want = [r for r in rows if r[0] not in (4, 5, 6)] + [(4, 9, "new", 0), (4, 10, "new", 0), (99, 1, "new", 0)]
    assert rows_of(table.read()) == sorted(want, key=repr)
    assert table.changes().where("after IS NULL").count() == 6
    empty = KeyedTable.create(spark, shared_path(spark, "keyed"), spark.createDataFrame([], SCHEMA), ["id"])
    assert empty.read().count() == 0 and empty.changes().count() == 0
    assert rows_of(empty.upsert(spark.createDataFrame(rows[:1], SCHEMA)).read()) == [rows[0]]
    assert empty.upsert(spark.createDataFrame([], SCHEMA)).delete(spark.createDataFrame(rows[:1], SCHEMA)).read().count() == 0


def test_views_follow_changes(spark):
    """After random inserts, updates and deletes, kept counts and the kept index equal those made anew."""
    r = random.Random(6)
    make = lambda n: [(i, r.randrange(3), " ".join(r.choice("ab cd ef gh ij".split()) for _ in range(r.randint(0, 4))), r.choice([None, 1, 5])) for i in r.sample(range(40), n)]
    table = KeyedTable.create(spark, shared_path(spark, "keyed"), spark.createDataFrame(make(25), SCHEMA), ["id"], buckets=4)
    counts = written(counted(table, ["part"], ["size"]), "counts")
    index = TextIndex(spark, shared_path(spark, "index")).add(table.read(), "id", "word")
    for step in range(4):
        if step % 2:
            table.delete(spark.createDataFrame([(i,) for i in r.sample(range(40), 8)], "id long"))
        else:
            table.upsert(spark.createDataFrame(make(12), SCHEMA))
        counts = written(recounted(counts, table.changes(), ["part"], ["size"]), "counts")
        reindexed(index, table.changes(), "id", "word")
    assert rows_of(counts) == rows_of(counted(table, ["part"], ["size"]))
    anew = TextIndex(spark, shared_path(spark, "index")).add(table.read(), "id", "word")
    assert rows_of(index.terms().select("term", "df")) == rows_of(anew.terms().select("term", "df")) and index.n_docs() == anew.n_docs() and index.mean_dl() == anew.mean_dl()


def shuffled(spark):
    """Bytes shuffled so far: a task after a pause brings the store of figures up to date."""
    time.sleep(0.5)
    spark.range(1).count()
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    found = sc.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_only_what_changes_is_shuffled(spark):
    """Rows that stay, and texts of an index of which some are replaced or deleted, are not shuffled, whatever Spark takes for small."""
    r = random.Random(8)
    text = lambda: " ".join(f"{r.getrandbits(48):x}" for _ in range(80))
    texts = {i: text() for i in range(3_000)}
    rows = lambda d: spark.createDataFrame(list(d.items()), "id long, text string")
    size = sum(map(len, texts.values()))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = KeyedTable.create(spark, shared_path(spark, "keyed"), rows(texts), ["id"], buckets=8)
        index = TextIndex(spark, shared_path(spark, "index")).add(rows(texts))
        new, began = {i: text() for i in range(0, 3_000, 30)}, shuffled(spark)
        table.upsert(rows(new))
        assert shuffled(spark) - began < size / 5
        reindexed(index, table.changes(), "id", "text")
        began = shuffled(spark)
        gone = spark.createDataFrame([(i,) for i in range(0, 3_000, 45)], "id long")
        reindexed(index, table.delete(gone).changes(), "id", "text")
        assert shuffled(spark) - began < size / 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    left = {i: t for i, t in (texts | new).items() if i % 45}
    assert rows_of(table.read()) == sorted(left.items(), key=repr) and index.n_docs() == len(left)
    assert {x["id"] for x in index.documents().select("id").collect()} == set(left)


def test_many_keys_are_met_by_a_merge(spark, monkeypatch):
    monkeypatch.setattr(shared, "KEYS", 0)
    test_views_follow_changes(spark)
    test_changes_write_touched_buckets_only(spark)


def test_pairs_keep_rows_that_did_not_change_and_types(spark):
    """Rows given again as they are stand in the table and are no change; values take the table's types."""
    table = KeyedTable.create(spark, shared_path(spark, "keyed"), spark.createDataFrame([(i, 0, "w", i) for i in range(9)], SCHEMA), ["id"], buckets=2)
    table.upsert(spark.createDataFrame([(i, 0, "w", i if i else None) for i in range(5)], "id int, part int, word string, size int"))
    assert rows_of(table.read()) == sorted([(i, 0, "w", i if i else None) for i in range(9)], key=repr)
    assert rows_of(table.changes().selectExpr("before.id AS b", "after.id AS a", "after.size AS s")) == [(0, 0, None)]
    table.replace_children(spark.createDataFrame([(3, 0, "w", 3), (4, 1, "x", 4)], SCHEMA))
    assert table.read().count() == 9 and rows_of(table.changes().selectExpr("before.word AS b", "after.word AS a")) == [("w", "x")]

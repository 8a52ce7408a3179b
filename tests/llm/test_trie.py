"""The conversation trie against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

P = pytest.importorskip("public_tokenizers")

import corpusq.llm.trie as trie  # noqa: E402
from corpusq.llm.trie import MessageQueue, conversation_trie, grafted_trie  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string, depth long, ka string, n int, place int"


def made(seed=2, convs=60):
    """Conversations with shared beginnings, copies, nulls, gaps, a long one, and first turns that most share."""
    r, out = random.Random(seed), {}
    for c in r.sample(range(300), convs):
        out[c] = [(r.choice(["user", "assistant", None]), r.choice(["", None, "hallo", "ähm", "x" * 9])) for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12]))]
        if r.random() < 0.6:
            out[c][0] = ("system", "the same first turn")
    ids = sorted(out)
    for c in ids[::7]:
        out[c] = list(out[ids[0]])
    out[ids[3]] = [("user", str(k)) for k in range(70)]
    rows = [(c, t * 2 - 1 if t else None, *turn, 1, "k", 2, 3) for c, turns in out.items() for t, turn in enumerate(turns)]
    r.shuffle(rows)
    return [*rows, (None, 1, "user", "no conversation", 1, "k", 2, 3)]


def read(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn), role or "", text or ""))
    return {c: [x[1:] for x in sorted(turns, key=lambda x: x[0])] for c, turns in convs.items()}


def graft(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    return out


def nodes(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node))
        out.append(
            (min(own), len(node), min(members[node[:-1]]) if node else None, len(own), sum(len(n) == len(node) + 1 for n in below),
             sum(not any(m[:-1] == n and m for m in below) for n in below), sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(ends.encode()).hexdigest())
        )
    return out


@pytest.mark.parametrize(("shard", "queue", "stretch"), [(200_000, 500_000, 4096), (5, 2, 3), (1, 1, 1)])
def test_against_brute_force(spark, monkeypatch, shard, queue, stretch):
    """With tiny bounds: shards of shards, queues that spill, and conversations of many stretches."""
    monkeypatch.setattr(trie, "STRETCH", stretch)
    rows = made(seed=shard)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for f, want in ((conversation_trie, nodes(read(rows))), (grafted_trie, nodes(graft(read(rows))))):
        got = [tuple(r) for r in f(table, shard_turns=shard, queue=queue).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_ids_in_pieces(spark, monkeypatch):
    """Many conversations that end at one node: their ids go in pieces, in order of numbers."""
    monkeypatch.setattr(trie, "ID_CHARS", 20)
    rows = [(c, 0, "user", "same", 1, "k", 2, 3) for c in range(400)] + [(c, 0, "user", "other", 1, "k", 2, 3) for c in (1000, 9, 500)]
    rows = [r for r in rows if not (r[0] == 9 and r[3] == "same")]
    got = [tuple(r) for r in conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=repr) == sorted(nodes(read(rows)), key=repr)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, 0, "user", "a", 1, "k", 2, 3)] * 2 + [(2, 0, "user", "a", 1, "k", 2, 3)]
    assert sorted((r.conv_id, r.depth, r.n_convs) for r in conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()) == [(1, 0, 2), (1, 1, 2), (1, 2, 1)]
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert grafted_trie(spark.createDataFrame([(None, 0, "user", "a", 1, "k", 2, 3)], SCHEMA)).count() == 0


def test_queue_keeps_order_beyond_memory():
    r = random.Random(5)
    sent = [((r.randint(-9, 0), r.randint(0, 20), 0), (1, r.randint(1, 5), r.randint(0, 9))) for _ in range(2_000)]
    queue = MessageQueue(37)
    for to, total in sent:
        queue.send(to, total)
    assert queue.runs
    want = defaultdict(lambda: [0, 0, 0])
    for to, total in sent:
        want[to] = [a + b for a, b in zip(want[to], total, strict=True)]
    assert {at: list(queue.received(at)) for at in sorted(want)} == want
    assert not queue.heap and not queue.runs

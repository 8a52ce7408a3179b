"""Prefix trie of conversations; totals of subtrees by time-forward processing."""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.llm.sharding import _ranked
from corpusq.llm.storage import written

#: Turns of a conversation that are ordered and summed up in one task.
STRETCH = 4096
#: Turns of all members below the root of a shard, at most; the factor by which that bound grows for the shards of shard roots.
SHARD_TURNS = 200_000
#: Messages that a queue holds in memory.
QUEUE = 500_000
#: Nodes that a task is meant to hold, and characters of ids that are hashed as one.
TASK_ROWS, ID_CHARS = 1_000_000, 1 << 16

KEY = ["depth", "ka", "kb"]


def hashed_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, place (from 0, by turn, null first), a and b (128 bits that tell role and text apart), chars (code points
    of the text): all that the trie needs, without texts. Rows without a conversation are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(7), role, text, F.length(text)).alias("b"), F.length(text).cast("long").alias("chars"),
    )
    # A long conversation is ordered by stretches of its turns.
    stretch = F.coalesce(F.floor(F.col("turn") / F.lit(STRETCH)), F.lit(-(1 << 62)))
    ranked = _ranked(written(rows, "turns"), ["conv_id"], stretch.cast("long"), [F.asc_nulls_first("turn"), F.col("a"), F.col("b")], "place")
    return ranked.select("conv_id", "place", "a", "b", "chars")


def grafted(turns: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """``turns`` (of ``hashed_turns``) with the first h turns of each conversation c replaced by those of the first
    conversation of its block, c - c % block; h is crc32 of c in decimal digits, modulo ``most``. Where that one has
    fewer turns or is absent, all that it has are taken. Also all conversations with their numbers of turns; one may
    have none."""
    turns = written(turns, "ordered-turns")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = sizes.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % block)
    heads = turns.where(F.col("place") < most).select(F.col("conv_id").alias("base"), "place", "a", "b", "chars")
    have = heads.groupBy("base").agg(F.count("*").alias("have"))
    convs = convs.join(have.hint("merge"), "base", "left").withColumn("taken", F.least("h", F.coalesce("have", F.lit(0))))
    convs = written(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("n")), "conversations")
    first = convs.select("conv_id", "base", "taken").join(heads.hint("merge"), "base").where("place < taken").select("conv_id", "place", "a", "b", "chars")
    own = turns.join(convs.select("conv_id", "h", "taken").hint("merge"), "conv_id").where("place >= h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).cast("long").alias("place"), "a", "b", "chars")
    return first.unionByName(own), convs.select("conv_id", "n")


def _prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, ka, kb (128 bits of the first ``depth`` turns), pa, pb (of one turn less), chars (of the last
    turn), n (turns of the conversation) for all prefixes, the empty one too. A prefix's bits are those of its turns,
    hashed with their places, by exclusive or; a long conversation's come from its stretches."""
    rows = turns.withColumn("depth", F.col("place") + 1).select("conv_id", "depth", "chars", F.xxhash64("depth", "a", "b").alias("ha"), F.xxhash64(F.lit(13), "b", "depth", "a").alias("hb"))
    rows = rows.withColumn("stretch", F.floor((F.col("depth") - 1) / F.lit(STRETCH)))
    sums = rows.groupBy("conv_id", "stretch").agg(F.bit_xor("ha").alias("sa"), F.bit_xor("hb").alias("sb"))
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "stretch", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(c) for c in ("sa", "sb")])
    within = Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({c: F.bit_xor(h).over(within) for c, h in (("ka", "ha"), ("kb", "hb"))}).join(sums.hint("merge"), ["conv_id", "stretch"])
    rows = rows.withColumns({c: F.col(c).bitwiseXOR(F.col(s)) for c, s in (("ka", "sa"), ("kb", "sb"))}).join(convs.hint("merge"), "conv_id")
    rows = rows.select("conv_id", "depth", "ka", "kb", F.col("ka").bitwiseXOR(F.col("ha")).alias("pa"), F.col("kb").bitwiseXOR(F.col("hb")).alias("pb"), "chars", "n")
    zero = F.lit(0).cast("long")
    return rows.unionByName(convs.select("conv_id", zero.alias("depth"), *[zero.alias(c) for c in ("ka", "kb", "pa", "pb", "chars")], "n"))


class MessageQueue:
    """Totals sent to nodes that come later, least first. Beyond ``most`` messages, those at hand are sorted and put into
    a file without a name, that goes with the task and that no other task reads."""

    def __init__(self, most: int = QUEUE):
        self.most, self.heap, self.runs = most, [], []

    def send(self, to: tuple, total: tuple) -> None:
        heapq.heappush(self.heap, (to, total))
        if len(self.heap) > self.most:
            self.heap.sort()
            run = tempfile.TemporaryFile()
            for i in range(0, len(self.heap), 4096):
                pickle.dump(self.heap[i : i + 4096], run)
            run.seek(0)
            self.heap = []
            self._next(self._read(run))

    @staticmethod
    def _read(run) -> Iterator[tuple]:
        with run:
            while True:
                try:
                    yield from pickle.load(run)
                except EOFError:
                    return

    def _next(self, run: Iterator[tuple]) -> None:
        message = next(run, None)
        if message is not None:
            heapq.heappush(self.runs, (*message, id(run), run))

    def received(self, at: tuple) -> tuple[int, int, int]:
        """The sum of what was sent to ``at``, which must be the least place of all that still hold messages."""
        children = leaves = saved = 0
        while True:
            if self.heap and self.heap[0][0] == at:
                _, (c, n, s) = heapq.heappop(self.heap)
            elif self.runs and self.runs[0][0] == at:
                _, (c, n, s), _, run = heapq.heappop(self.runs)
                self._next(run)
            else:
                return children, leaves, saved
            children, leaves, saved = children + c, leaves + n, saved + s


_TOTALS = "depth long, ka long, kb long, pa long, pb long, n_children long, n_leaves long, saved_tokens long"


def _forward(most: int):
    """mapInArrow over sd, sa, sb (the root of a shard), depth, ka, kb, pa, pb, own (what the node itself saves), children,
    leaves, saved (what came from other shards), sorted by shard and descending depth: each node's totals. A node gets
    what its children in the shard have sent, which came earlier, and sends on to its parent."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, queue = None, MessageQueue(most)
        for batch in batches:
            out = []
            for *root, depth, ka, kb, pa_, pb, own, c, n, s in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if root != shard:
                    shard, queue = root, MessageQueue(most)
                children, leaves, saved = queue.received((-depth, ka, kb))
                children, leaves, saved = children + c, leaves + n, saved + s + own
                leaves = leaves or 1
                out.append((depth, ka, kb, pa_, pb, children, leaves, saved))
                if depth > root[0]:
                    queue.send((1 - depth, pa_, pb), (1, leaves, saved))
            if out:
                yield _rows(out, [f.split()[0] for f in _TOTALS.split(", ")])

    return totals


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over depth, ka, kb, conv_id, sorted: the ids of a node in pieces (depth, ka, kb, first id, ids)."""
    at, first, ids, size, out, held = None, 0, [], 0, [], 0
    for batch in batches:
        for *key, c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if key != at or size > ID_CHARS:
                if ids:
                    out.append((*at, first, ",".join(ids)))
                at, first, ids, held, size = key, c, [], held + size, 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if held > 16 * ID_CHARS:
            yield _rows(out, [*KEY, "first", "ids"])
            out, held = [], 0
    if ids:
        out.append((*at, first, ",".join(ids)))
    if out:
        yield _rows(out, [*KEY, "first", "ids"])


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if isinstance(x[0], str) else pa.int64()) for x in zip(*rows, strict=True)], names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over depth, ka, kb, first, ids, sorted: the SHA-256 of a node's ids. Nothing but its state is held."""
    at, state, out = None, None, []
    for batch in batches:
        for *key, _, ids in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if key != at:
                if at:
                    out.append((*at, state.hexdigest()))
                at, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(out) > 10_000:
            yield _rows(out, [*KEY, "ends_sha256"])
            out = []
    if at:
        yield _rows([*out, (*at, state.hexdigest())], [*KEY, "ends_sha256"])


def _end_digests(prefixes: DataFrame, tasks: int) -> DataFrame:
    """depth, ka, kb, ends_sha256 of the nodes where conversations end. Ids are put together in pieces by range, so that
    the one task that must see all ids of a node, as SHA-256 goes in order, gets some thousands of them in a row."""
    ends = prefixes.where("depth = n").select(*KEY, "conv_id")
    pieces = ends.repartitionByRange(tasks, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(_ids, "depth long, ka long, kb long, first long, ids string")
    pieces = written(pieces, "id-pieces")
    return pieces.repartition(tasks, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digests, "depth long, ka long, kb long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, shard_turns: int = SHARD_TURNS, queue: int = QUEUE) -> DataFrame:
    """The nodes of the prefix trie of ``turns`` (conv_id, place, a, b, chars) and ``convs`` (conv_id, n: all
    conversations and their numbers of turns): one for each distinct sequence of first turns.

    Returns conv_id (the node's smallest member: a conversation that begins with it), depth, parent_conv_id (null for
    the root), n_convs, n_children, n_leaves (nodes without children in the subtree), saved_tokens (code points of last
    turns that members share with the first of them, in the subtree), ends_sha256 (of the ids that end here).

    Totals of subtrees go by time-forward processing. The trie is cut into shards: subtrees whose members have at most
    ``shard_turns`` turns there. A shard is sorted by reverse level order (Spark sorts, and spills); each node takes
    what its children have sent out of a queue in that order, which spills, and sends its totals on. Nodes above all
    shards are cut in the same way with the square, then the cube of the bound, and start from what the shard roots
    below have sent; so each shard is bounded by that factor times its depth, and there are as many rounds as the
    logarithm of all turns has. A node that a third of all conversations share is one row by then.
    """
    spark = turns.sparkSession
    prefixes = written(_prefixes(turns, convs), "prefixes")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-prefixes.count() // TASK_ROWS))
    nodes = prefixes.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("n") - F.col("depth") + 1).alias("below"), *[F.min(c).alias(c) for c in ("chars", "pa", "pb")]
    )
    nodes = written(nodes, "trie-nodes")
    # Bounds of the rounds: the last one is beyond the root's.
    all_turns, bounds = nodes.agg(F.max("below")).first()[0] or 0, [shard_turns]
    while bounds[-1] < all_turns:
        bounds.append(bounds[-1] * max(2, shard_turns))
    # Where a conversation's path comes below each bound. Few nodes are beyond the first.
    high = written(nodes.where(F.col("below") > bounds[0]).select(*KEY, "below"), "high-nodes")
    cuts = prefixes.select("conv_id", *KEY).join(high, KEY, "left").groupBy("conv_id").agg(
        *[F.min(F.when(F.coalesce("below", F.lit(0)) <= b, F.struct(*KEY))).alias(f"root{k}") for k, b in enumerate(bounds)]
    )
    level = F.lit(len(bounds) - 1)
    for k in range(len(bounds) - 2, -1, -1):
        level = F.when(F.col("below") <= bounds[k], k).otherwise(level)
    root: Column = F.col(f"root{len(bounds) - 1}")
    for k in range(len(bounds) - 2, -1, -1):
        root = F.when(F.col("level") == k, F.col(f"root{k}")).otherwise(root)
    nodes = nodes.withColumn("level", level).join(cuts.hint("merge"), "conv_id").withColumn("root", root).drop(*[f"root{k}" for k in range(len(bounds))])
    nodes = written(nodes, "sharded-nodes")
    done = None
    for k in range(len(bounds)):
        own = nodes.where(F.col("level") == k).select(F.col("root.depth").alias("sd"), F.col("root.ka").alias("sa"), F.col("root.kb").alias("sb"), *KEY, "pa", "pb", ((F.col("n_convs") - 1) * F.col("chars")).alias("own"))
        if done is None:
            own = own.withColumns({c: F.lit(0).cast("long") for c in ("c", "l", "s")})
        else:
            sent = done.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb"))
            sent = sent.agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
            own = own.join(sent.hint("merge"), KEY, "left").na.fill(0, ["c", "l", "s"]).select("sd", "sa", "sb", *KEY, "pa", "pb", "own", "c", "l", "s")
        order = ["sd", "sa", "sb", F.desc("depth"), "ka", "kb"]
        totals = written(own.repartition(tasks, "sd", "sa", "sb").sortWithinPartitions(*order).mapInArrow(_forward(queue), _TOTALS), "totals")
        done = totals if done is None else done.unionByName(totals)
    out = nodes.select(*KEY, "conv_id", "n_convs", "pa", "pb").join(done.drop("pa", "pb").hint("merge"), KEY)
    ends = _end_digests(prefixes, tasks)
    out = out.join(ends.hint("merge"), KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    out = written(out, "nodes-with-totals").join(parents.hint("merge"), ["depth", "pa", "pb"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, queue: int = QUEUE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``trie`` of the conversations as they are.

    Turns go by ``turn``, null first; those of the same turn by a hash of role and text. Null roles and texts count as
    empty ones. Rows without a conversation are left out. Rows that repeat are turns of their own. An empty table has no
    node. Further columns are not looked at, whatever they are called. Sequences are told apart by 128 bits.
    """
    turns = written(hashed_turns(conversations, conv_col, turn_col, role_col, text_col), "ordered-turns")
    return trie(turns, turns.groupBy("conv_id").agg(F.count("*").alias("n")), shard_turns, queue)


def grafted_trie(conversations: DataFrame, block: int = 100, most: int = 6, shard_turns: int = SHARD_TURNS, queue: int = QUEUE) -> DataFrame:
    """``trie`` of the conversations whose first turns are those of the first of their block (``grafted``); one that has
    no turn then counts at the root. Else as ``conversation_trie``."""
    return trie(*grafted(hashed_turns(conversations), block, most), shard_turns, queue)

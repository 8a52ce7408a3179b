"""Near-duplicate documents by an LSH forest over MinHash signatures, with exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusq.llm.storage import forget, written
from corpusq.llm.text import Words, mix, slices, utf8

#: Signature orders of the forest, and the MinHash values that each order sorts by.
TREES, DEPTH = 32, 6
#: Depth at which a region begins: two sets of similarity 0.75 meet there in one of the 32 orders but for 3 in 10^8.
LEAST_DEPTH = 3
#: Rows of a region that are all compared; a larger one is taken a level deeper.
REGION = 12
#: Nodes that hold a shingle, up to which those that lead with it are paired there.
RARE = 16
#: Nodes of a crowded region that are compared with as many others at once, and the bits of a set's bitmap at most.
CELL, MOST_BITS = 2048, 65536
#: Rows of an order that a task is meant to hold.
TASK_ROWS = 1_000_000

_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _shingles(w: Words, hashes: np.ndarray, k: int, size: int) -> np.ndarray:
    """The distinct shingles of the k-th text of ``w``, as sorted 64-bit hashes."""
    own = hashes[w.first[k] : w.first[k + 1]]
    if not len(own):
        return own
    n = min(size, len(own))
    out = np.full(len(own) - n + 1, n, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + own[i : len(own) - n + 1 + i]
    return np.unique(mix(out))


def _signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of each MinHash value."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 4096):
        np.minimum(least, ((h[i : i + 4096, None] ^ _XOR) * _MUL).min(axis=0), out=least)
    return ((least * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.uint64)


def _set_rows(size: int, what: str):
    """mapInArrow over doc_id and text; what: "signature", or "set" for the whole set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for i, j in slices(off):
                w = Words(buf, off, i, j)
                hashes = w.hashes()
                n, a, b, first, rest, sets = [], [], [], [], [], []
                for k in range(j - i):
                    own = _shingles(w, hashes, k, size)
                    n.append(len(own))
                    # Two sums over the set tell sets apart by 128 bits.
                    a.append(int(own.sum(dtype=np.uint64).view(np.int64)) if len(own) else 0)
                    b.append(int(mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)) if len(own) else 0)
                    if what == "set":
                        sets.append(own.view(np.int64))
                        continue
                    s = _signature(own).reshape(TREES, DEPTH)
                    trees = np.arange(TREES, dtype=np.uint64) << np.uint64(48)
                    first.append((trees | s[:, 0] << np.uint64(32) | s[:, 1] << np.uint64(16) | s[:, 2]).view(np.int64))
                    rest.append((s[:, 3] << np.uint64(32) | s[:, 4] << np.uint64(16) | s[:, 5]).view(np.int64))
                ids = batch.column(0).slice(i, j - i)
                if what == "set":
                    yield pa.RecordBatch.from_arrays([ids, pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])
                    continue
                arrays = [ids, pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())]
                arrays += [pa.ListArray.from_arrays(np.arange(0, TREES * (j - i) + 1, TREES, dtype=np.int32), np.concatenate(x)) for x in (first, rest)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "a", "b", "first", "rest"])

    return rows


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of all nodes of ``edges`` (a, b), by alternating large and small
    stars: each round sums up least neighbours, and no node's neighbours are ever gathered."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges = written(edges, "edges")
    state, now = None, ()
    while now != state:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        before, edges = edges, written(small, "edges")
        forget(before)
        state, now = now, edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


_FOREST = "a long, b long, region long"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over a stretch of the sorted orders (p, q, node): candidate pairs a < b, and for each row of a crowded
    or cut region its node as a and the region's three values."""
    held = list(batches)
    if not held:
        return
    node, p, q = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(3))
    n = len(node)
    # The longest common prefix of each row and the one before, in MinHash values; below three it doesn't matter.
    differs = (q[1:] ^ q[:-1]).view(np.uint64)
    lcp = np.zeros(n, np.int64)
    lcp[1:] = np.where(p[1:] == p[:-1], LEAST_DEPTH + np.searchsorted(-np.array([1 << 32, 1 << 16, 1]), -differs.astype(np.int64)), 0)
    out_a, out_b = [], []

    def add(x: np.ndarray, y: np.ndarray) -> None:
        out_a.append(np.minimum(x, y)[x != y])
        out_b.append(np.maximum(x, y)[x != y])

    inside = np.ones(n, bool)  # rows whose region is crowded one level above
    for depth in range(LEAST_DEPTH, DEPTH + 1):
        starts = np.flatnonzero(lcp < depth)
        sizes = np.diff(starts, append=n)
        run = np.repeat(np.arange(len(starts)), sizes)
        small = inside & (sizes[run] <= REGION)
        for k in range(1, REGION):
            i = np.flatnonzero(small[:-k] & (run[:-k] == run[k:])) if n > k else []
            if len(i):
                add(node[i], node[i + k])
        crowded = inside & (sizes[run] > REGION)
        least = np.minimum.reduceat(node, starts)[run]
        add(node[crowded], least[crowded])
        # Neighbours in the order share the longest prefixes.
        i = np.flatnonzero(crowded[:-1] & (run[:-1] == run[1:]))
        add(node[i], node[i + 1])
        if depth == LEAST_DEPTH:
            # A region that another task may hold a part of counts as crowded.
            marked = crowded | (run == 0) | (run == run[-1])
        inside = crowded
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    pairs = np.unique(np.stack([a, b], 1), axis=0)
    none = lambda k: pa.nulls(k, pa.int64())
    for i in range(0, len(pairs), 100_000):
        own = pairs[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), none(len(own))], ["a", "b", "region"])
    at = np.flatnonzero(marked)
    yield pa.RecordBatch.from_arrays([pa.array(node[at]), none(len(at)), pa.array(p[at])], ["a", "b", "region"])


def forest(nodes: DataFrame) -> DataFrame:
    """The neighbours of ``nodes`` (node, first, rest) in the sorted orders of the forest.

    Each of the 32 orders sorts all nodes by six MinHash values; a task holds a stretch of an order. A node's region
    is what shares its longest common prefix with it: it begins at three values, and where more than ``REGION`` nodes
    share those, it goes a value deeper, up to six. Nodes of a region are all paired. In a larger one, a node is paired
    with those before and after it in the order, whose common prefix with it is longest, and with the least node.

    Returns rows of pairs a < b with a null region, and rows of a node as a with the region of more than ``REGION``
    nodes (or one that a stretch's border cuts) that it is in; what pairs leave open there, ``crowded_pairs`` finds.
    """
    rows = nodes.select("node", F.explode(F.arrays_zip("first", "rest")).alias("x")).select("node", F.col("x.first").alias("p"), F.col("x.rest").alias("q"))
    n = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() * TREES // TASK_ROWS))
    return rows.repartitionByRange(n, "p", "q", "node").sortWithinPartitions("p", "q", "node").mapInArrow(_neighbours, _FOREST)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs whose sets have 100 x intersection >= percent x union. sets: node, shingles."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")).hint("merge"), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")).hint("merge"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.withColumn("i", common).where(F.col("i") * 100 >= (F.size("x") + F.size("y") - F.col("i")) * percent).select("a", "b")


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over node, component, leads, shingles: the set's size and a bitmap of it by the low bits of its hashes,
    eight or more bits a shingle up to ``MOST_BITS``."""
    for batch in batches:
        off = batch.column(3).offsets.to_numpy()
        flat = batch.column(3).values.to_numpy()
        maps = []
        for i, j in zip(off[:-1], off[1:]):
            m = min(MOST_BITS, max(512, 8 << int(j - i - 1).bit_length()))
            held = np.zeros(m, bool)
            held[flat[i:j] & (m - 1)] = True
            maps.append(np.packbits(held, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(off).astype(np.int64)), pa.array(maps, pa.binary())], ["node", "component", "leads", "size", "bits"])


def _alike(x: dict, y: dict, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes of pairs of a row of ``x`` that leads and a row of ``y`` of no smaller set in another component, whose
    bitmaps leave room for the similarity. Both are rows of one bitmap length each, in order of size.

    A bit that one bitmap has and the other hasn't stands for a shingle at least, so the sets have no more in common
    than size - bits + common bits of either. A longer bitmap is folded to the length of the shorter."""
    words = min(x["bits"].shape[1], y["bits"].shape[1])
    fold = lambda b: np.bitwise_or.reduce(b.reshape(len(b), -1, words), axis=1)
    p, q = fold(x["bits"]), fold(y["bits"])
    spare_x, spare_y = (t["size"] - np.bitwise_count(b).sum(axis=1, dtype=np.int64) for t, b in ((x, p), (y, q)))
    first = np.searchsorted(y["size"], x["size"], "left")
    end = np.searchsorted(y["size"], x["size"] * 100 // percent, "right")
    for i in np.flatnonzero(x["leads"] & (first < end)):
        for at in range(first[i], end[i], 512):
            k = slice(at, min(at + 512, end[i]))
            most = np.minimum(spare_x[i], spare_y[k]) + np.bitwise_count(p[i] & q[k]).sum(axis=1, dtype=np.int64)
            fits = ((100 + percent) * most >= percent * (x["size"][i] + y["size"][k])) & (x["component"][i] != y["component"][k])
            if fits.any():
                other = y["node"][k][fits]
                yield np.full(len(other), x["node"][i]), other


def _compared(percent: int):
    """mapInArrow over region, lo, hi, cell, node, component, leads, size, bits, sorted by the first three: pairs a < b of
    the cells lo and hi of a region that ``_alike`` leaves. One pair of cells is held at a time."""

    def pairs_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        column = {c: rows.column(c).to_numpy() for c in ("cell", "node", "component", "leads", "size")}
        bits = rows.column("bits").combine_chunks()
        length = pc.binary_length(bits).to_numpy()
        order = np.argsort(column["size"], kind="stable")
        sides: dict[int, list[dict]] = {}
        for cell in np.unique(column["cell"]):
            for n in np.unique(length):
                at = order[(column["cell"][order] == cell) & (length[order] == n)]
                if len(at):
                    held = {c: column[c][at] for c in ("node", "component", "leads", "size")}
                    held["bits"] = np.frombuffer(b"".join(bits[int(i)].as_py() for i in at), np.uint64).reshape(len(at), -1)
                    sides.setdefault(int(cell), []).append(held)
        same = rows.column("lo")[0] == rows.column("hi")[0]
        for c, d in [(c, d) for c in sides for d in sides if (c == d) == same]:
            for x in sides[c]:
                for y in sides[d]:
                    for a, b in _alike(x, y, percent):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = [held.column(c).to_numpy() for c in ("region", "lo", "hi")]
            starts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for i, j in zip([0, *starts[:-1]], starts):
                yield from pairs_of(held.slice(int(i), int(j - i)))
            if len(starts):
                held = held.slice(int(starts[-1]))
        if held is not None and len(held):
            yield from pairs_of(held)

    return rows


def crowded_pairs(regions: DataFrame, found: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """All pairs a < b of nodes of crowded ``regions`` (node, region) that are in different components of ``found``
    (node, component; a node without one is its own) and may be similar: an exact join over the rarest shingles.

    Shingles that one component alone holds can't be shared by such a pair, so they count as rarest of all; the others
    follow by the number of nodes that hold them. Of a pair of the least similarity, the smaller set has a common
    shingle among its first size - 2 p size / (100 + p) + 1 and the larger among its first size - p size / 100 + 1.
    Pairs whose sizes or places leave too few common shingles are not made. Texts of one template share all but
    what is their own, and that is rarest: they meet nowhere.

    A pair that meets in a shingle of at most ``RARE`` nodes is made there. Where the smaller set leads with a more
    frequent one, as on pages that each leave out some of a site's passages, both nodes are compared within the regions
    they share, by bitmaps that bound what two sets have in common, and the pair is made only if the bound allows it.
    Regions are cut into cells of ``CELL`` nodes, and each two cells are a piece of work of their own.
    """
    rows = regions.join(found.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = rows.groupBy("region").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("region")
    rows = written(rows.join(mixed.hint("merge"), "region").select("node", "component", "region").distinct(), "crowded-rows")
    nodes = written(rows.select("node", "component").distinct(), "crowded-nodes")
    own = nodes.join(sets.hint("merge"), "node").select("node", "component", F.size("shingles").alias("size"), F.explode("shingles").alias("token"))
    common = own.groupBy("token").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
    common = written(common.select("token", "n"), "common-shingles")
    by_node = Window.partitionBy("node")
    place = F.col("size") - F.count("*").over(by_node) + F.row_number().over(by_node.orderBy("n", "token"))
    placed = own.join(common.hint("merge"), "token").withColumn("place", place)
    least = f"({percent} * size + 99) div 100"
    leads = f"place <= size - (2 * {percent} * size + {99 + percent}) div {100 + percent} + 1"
    placed = placed.where(f"place <= size - {least} + 1").select("node", "component", "size", "token", "place", "n", F.expr(leads).alias("leads"))
    placed = written(placed, "rarest-shingles")
    rare = placed.where(f"n <= {RARE}")
    sides = [t.select("token", *(F.col(c).alias(c + k) for c in ("node", "component", "size", "place"))) for t, k in ((rare.where("leads"), "x"), (rare, "y"))]
    pairs = sides[0].join(sides[1].hint("merge"), "token").where("componentx != componenty AND (sizex < sizey OR (sizex = sizey AND nodex < nodey))")
    pairs = pairs.where(f"100 * sizex >= {percent} * sizey AND ({100 + percent}) * (1 + least(sizex - placex, sizey - placey)) >= {percent} * (sizex + sizey)")
    pairs = pairs.select(F.least("nodex", "nodey").alias("a"), F.greatest("nodex", "nodey").alias("b"))
    frequent = placed.where(f"n > {RARE}")
    led = frequent.where("leads").select("token").distinct()
    busy = frequent.join(led.hint("merge"), "token").groupBy("node", "component").agg(F.max("leads").alias("leads"))
    maps = busy.join(sets.hint("merge"), "node").select("node", "component", "leads", "shingles").mapInArrow(_bitmaps, "node long, component long, leads boolean, size long, bits binary")
    maps = written(maps, "bitmaps")
    busy_rows = written(rows.select("node", "region").join(maps.select("node").hint("merge"), "node"), "busy-rows")
    cells = busy_rows.groupBy("region").agg(F.ceil(F.count("*") / CELL).cast("long").alias("cells"), F.count("*").alias("n")).where("n > 1").drop("n")
    at = busy_rows.join(cells.hint("merge"), "region").withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")))
    at = at.join(maps.hint("merge"), "node").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    at = at.select("region", F.least("cell", "other").alias("lo"), F.greatest("cell", "other").alias("hi"), "cell", "node", "component", "leads", "size", "bits")
    # Pieces are in the order of their keys in each task; a task reads as many as fall to it, one at a time.
    pieces = at.repartition("region", "lo", "hi").sortWithinPartitions("region", "lo", "hi")
    alike = pieces.mapInArrow(_compared(percent), "a long, b long")
    out = written(pairs.unionByName(alike).distinct(), "crowded-candidates")
    forget(rows, nodes, common, placed, maps, busy_rows)
    return out


def _joined(links: DataFrame, found: DataFrame, pairs: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links and their components once those of ``pairs`` are added that are similar; without any, both stay as they are."""
    more = written(confirmed(pairs, sets, percent), "links")
    if more.isEmpty():
        return links, found
    links = written(links.unionByName(more), "links")
    return links, written(components(links), "components")


def near_duplicates(documents: DataFrame, percent: int = 75, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``documents``.

    Texts are lower-cased in A-Z and cut into words at [\\x20\\x09-\\x0D]; a document's set are its distinct shingles
    of ``shingle`` words, or the whole sequence where it has fewer. Documents are linked whose sets have
    100 x intersection >= ``percent`` x union; component_id is the least doc_id reachable over links, itself included,
    and kept says whether it is the document's own. Texts without words, empty or null have the empty set and are
    linked with nothing. Rows that share an id each go by their own set. Rows with null ids are linked with nothing,
    keep component_id null and kept true. An empty table gives an empty table; further columns are not looked at.

    Equal sets are collapsed to the least id that has them first. Candidates come from ``forest`` and are confirmed on
    full sets: first one candidate of each node, then those that lead out of a component found that way. Last,
    ``crowded_pairs`` finds what is left between components in crowded regions, exactly. A pair of similarity 0.75 is
    missed if it shares three values in none of the orders, a chance of 3 in 10^8, however crowded its regions are.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(docs.mapInArrow(_set_rows(shingle, "signature"), "doc_id long, n_shingles long, a long, b long, first array<long>, rest array<long>"), "signatures")
    keys = ["n_shingles", "a", "b"]
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    leads = written(full.groupBy(*keys).agg(F.min("doc_id").alias("node")), "set-classes")
    nodes = full.join(leads.hint("merge"), keys).where("doc_id = node").select("node", "first", "rest").dropDuplicates(["node", "first"])
    nodes = written(nodes, "forest-nodes")
    trees = written(forest(nodes), "forest")
    pairs = written(trees.where("region IS NULL").select("a", "b").distinct(), "candidates")
    regions = trees.where("region IS NOT NULL").select(F.col("a").alias("node"), "region")
    members = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(regions.select(F.col("node").alias("doc_id"))).distinct()
    texts = docs.join(written(members, "candidate-members"), "doc_id", "left_semi")
    sets = written(texts.mapInArrow(_set_rows(shingle, "set"), "doc_id long, shingles array<long>").select(F.col("doc_id").alias("node"), "shingles").distinct(), "candidate-sets")
    links = written(confirmed(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets, percent), "links")
    found = written(components(links), "components")
    side = lambda n: found.select(F.col("node").alias(n), F.col("component").alias(f"c{n}"))
    left_open = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where("coalesce(ca, a) != coalesce(cb, b)").select("a", "b")
    links, found = _joined(links, found, written(left_open, "open-candidates"), sets, percent)
    links, found = _joined(links, found, crowded_pairs(regions, found, sets, percent), sets, percent)
    forget(nodes, trees, pairs, sets)
    roots = leads.join(found, "node", "left").select(*keys, F.coalesce("component", "node").alias("root"))
    # Nodes are least ids of their classes, so the least node of a component is the least id in it.
    out = signed.select("doc_id", *keys).join(roots.hint("merge"), keys, "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("root")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))

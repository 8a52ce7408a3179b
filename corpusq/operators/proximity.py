"""Ranking by how near a query's terms stand to each other, and in which fields."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from corpusq.operators.parts import SENT_TERMS, _array, best
from corpusq.operators.relational import top_per_key
from corpusq.operators.retrieval import query_terms
from corpusq.sources.index import TextIndex
from corpusq.sources.shared import written
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a word of a field counts (R8). Fixed values.
WEIGHTS = {"title": 1.0, "keywords": 0.4, "text": 0.1}
#: Places between the beginnings of fields, which stand apart in this order.
APART = 1 << 28
#: Documents with rarest terms, over all queries, up to which they are looked into in one table.
DIRECT = 100_000
#: Postings of a part of the documents that a task looks into at once, on average; documents and places that it takes at once.
POSTINGS, LOOKED = 1_000_000, 1_000_000


def cover_density(hits: Column, n_terms: Column) -> Column:
    """The cover density (Clarke, Cormack and Tudhope, 2000) of ``hits``, an array of (place, term, weight) in the order of
    places, term counting from 0 to ``n_terms`` - 1.

    A cover is a stretch that holds all terms and no smaller one that does. It counts the harmonic mean of the weights
    of the terms' places in it, over one plus the number of other words in it. One pass keeps the last place of each
    term; a cover ends where the least of these moves on."""
    start = F.struct(
        F.array_repeat(F.struct(F.lit(-1).cast("long").alias("place"), F.lit(0).alias("nth"), F.lit(0.0).alias("sum")), n_terms).alias("last"),
        F.lit(0).alias("nth"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("begun"), F.lit(0.0).alias("score"),
    )

    def step(s: Column, h: Column) -> Column:
        # What stands before the hit: how many hits, and the sum of their inverse weights.
        own = F.struct(h["place"].alias("place"), s["nth"].alias("nth"), s["sum"].alias("sum"))
        seen = F.transform(s["last"], lambda x, i: F.when(i == h["term"], own).otherwise(x))
        least = F.array_min(seen)
        total, nth = s["sum"] + 1 / h["weight"], s["nth"] + 1
        n = nth - least["nth"]
        worth = (n / (total - least["sum"])) / (1 + (h["place"] - least["place"] + 1 - n))
        new = (least["place"] >= 0) & (least["place"] > s["begun"])
        return F.struct(seen.alias("last"), nth.alias("nth"), total.alias("sum"), F.when(new, least["place"]).otherwise(s["begun"]).alias("begun"), (s["score"] + F.when(new, worth).otherwise(0.0)).alias("score"))

    return F.aggregate(hits, start, step, lambda s: s["score"])


def _spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The numbers of the ranges that begin at ``starts`` and are ``lens`` long, one range behind the other."""
    return np.repeat(starts - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())


def _slices(lens: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that are at most ``most`` long together, or one row."""
    ends, a = np.cumsum(lens), 0
    while a < len(lens):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _densities(owner: np.ndarray, place: np.ndarray, no: np.ndarray, n_terms: int, weights: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """The cover density of each owner, and its number of fields; ``owner`` counts from 0 and has all of its terms, ``no``, at its
    places. As in ``cover_density``, a cover ends where the least of the terms' last places moves on."""
    order = np.lexsort((place, owner))
    owner, place, no = owner[order], place[order], no[order]
    at, field = np.arange(len(owner)), place // APART
    begin = np.flatnonzero(np.diff(owner, prepend=-1))
    least = at.copy()
    for t in range(n_terms):
        np.minimum(least, np.maximum.accumulate(np.where(no == t, at, -1)), out=least)
    ends = np.flatnonzero((least >= begin[owner]) & (np.diff(least, prepend=-1) > 0))
    least = least[ends]
    n, inverse, n_fields = ends - least + 1, np.zeros(len(ends)), np.zeros(len(begin), np.int64)
    for f, weight in enumerate(weights):
        seen = np.append(0, np.cumsum(field == f))
        inverse += (seen[ends + 1] - seen[least]) * (1 / weight)
        n_fields += seen[np.append(begin[1:], len(owner))] > seen[begin]
    worth = (n / inverse) / (1 + (place[ends] - place[least] + 1 - n))
    return np.bincount(owner[ends], worth, len(begin)), n_fields


def _looked_into(k: int, weights: Sequence[float]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """cogroup over a part's postings (t, id, field, places) and all sets of terms (set, terms): the part's ``k`` best documents
    that hold all terms of a set."""

    def looked(left: pa.Table, right: pa.Table) -> pa.Table:
        sets, ids = _array(right.column("set")), _array(left.column("id")).dictionary_encode()
        none = pa.table({"set": sets.slice(0, 0), "id": ids.dictionary.slice(0, 0), "score": pa.array([], pa.float64()), "n_fields": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return none
        order = pc.sort_indices(ids.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        ids, doc, n_docs = ids.dictionary.take(order), rank[ids.indices.to_numpy()], len(order)
        terms, t = np.unique(left.column("t").to_numpy(), return_inverse=True)
        # Postings of a term and document stand together, field by field, and so do their places: what is found is a key.
        key, field, lists = t * n_docs + doc, left.column("field").to_numpy().astype(np.int64), _array(left.column("places"))
        starts = lists.offsets.to_numpy().astype(np.int64)
        lens, starts, values = np.diff(starts), starts[:-1], lists.values.to_numpy()
        order = np.lexsort((field, key))
        key, lens = key[order], lens[order]
        places = values[_spread(starts[order], lens)] + np.repeat(field[order] * APART, lens)
        first, ends = np.flatnonzero(np.diff(key, prepend=-1)), np.append(0, np.cumsum(lens))
        key, starts = key[first], ends[first]
        lens = np.append(starts[1:], len(places)) - starts
        of = np.searchsorted(key, np.arange(len(terms) + 1) * n_docs)  # where a term's keys begin
        # Sets of which all terms are here, by their number of terms, the rarest one of this part before others.
        asked = _array(right.column("terms"))
        size = np.diff(asked.offsets.to_numpy())
        asked = asked.flatten().to_numpy()
        found = np.minimum(np.searchsorted(terms, asked), len(terms) - 1)
        owner = np.repeat(np.arange(len(size)), size)
        here = np.bincount(owner, terms[found] == asked, len(size)) == size
        out = []
        for m in np.unique(size[here & (size > 0)]):
            mine = np.flatnonzero(here & (size == m))
            table = found[np.isin(owner, mine)].reshape(-1, m)
            table = np.take_along_axis(table, np.argsort(of[table + 1] - of[table], axis=1, kind="stable"), axis=1)
            n = of[table[:, 0] + 1] - of[table[:, 0]]
            for a, b in _slices(n, LOOKED):
                whose, at = np.repeat(np.arange(a, b), n[a:b]), _spread(of[table[a:b, 0]], n[a:b])
                docs, entries = key[at] - table[whose, 0] * n_docs, [at]
                for j in range(1, m):
                    wanted = table[whose, j] * n_docs + docs
                    at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
                    held = key[at] == wanted
                    whose, docs, entries = whose[held], docs[held], [e[held] for e in [*entries, at]]
                entries = np.stack(entries, axis=1)
                scores, n_fields = np.zeros(len(whose)), np.zeros(len(whose), np.int64)
                for c, d in _slices(lens[entries].sum(axis=1), LOOKED):
                    some = entries[c:d].ravel()
                    row = np.repeat(np.arange(len(some)), lens[some])
                    scores[c:d], n_fields[c:d] = _densities(row // m, places[_spread(starts[some], lens[some])], row % m, m, weights)
                bounds = np.append(np.flatnonzero(np.diff(whose, prepend=-1)), len(whose))
                kept = np.ones(len(whose), bool)
                for i in np.flatnonzero(np.diff(bounds) > k):
                    x, y = bounds[i], bounds[i + 1]
                    kept[x:y] = False
                    kept[x + best(docs[x:y], scores[x:y], k)] = True
                out.append((mine[whose[kept]], docs[kept], scores[kept], n_fields[kept]))
        if not out:
            return none
        whose, docs, scores, n_fields = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"set": sets.take(pa.array(whose)), "id": ids.take(pa.array(docs)), "score": pa.array(scores), "n_fields": pa.array(n_fields)})

    return looked


def _sent(terms: DataFrame) -> DataFrame:
    """``terms`` for a join with blocks: a bounded number goes to them; else all blocks of their folders are shuffled."""
    return terms.hint("broadcast" if terms.count() <= SENT_TERMS else "merge")


def _by_parts(asked: DataFrame, fields: Mapping[str, TextIndex], k: int, weights: Mapping[str, float]) -> DataFrame:
    """The rows of ``proximity_search`` for ``asked`` (query_id, term, df), part by part of the documents, dealt out by id.

    Postings are sent to their part once, however many queries ask for them, and so is each distinct set of terms; the
    documents that hold all terms of a set are found and scored there, and a part gives ``k`` rows a set at most."""
    spark = asked.sparkSession
    terms = written(asked.select("term", "df").distinct().withColumn("t", F.monotonically_increasing_id()), "terms")
    numbered = asked.select("query_id", "term").join(terms.hint("merge"), "term")
    of = written(numbered.groupBy("query_id").agg(F.sort_array(F.collect_list("t")).alias("terms")), "term-sets")
    sets = of.groupBy("terms").agg(F.min("query_id").alias("set"))
    members = of.join(sets.hint("merge"), "terms").select("query_id", "set")
    n = max(-(-(terms.agg(F.sum("df")).first()[0] or 0) // POSTINGS), spark.sparkContext.defaultParallelism)
    rows, sent = [], _sent(terms.select("term", "t"))
    for no, index in enumerate(fields.values()):
        blocks = index.blocks(None, index.buckets(terms)).select("segment", "term", "postings").join(sent, "term").drop("term")
        part = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("part")
        rows.append(index.exploded(blocks).select(part, "t", "id", F.lit(no).cast("byte").alias("field"), "places"))
    rows = reduce(DataFrame.unionByName, rows)
    parts = F.broadcast(spark.range(n).select(F.col("id").cast("int").alias("part")))
    kinds = (x.dataType.simpleString() for x in (sets.schema["set"], rows.schema["id"]))
    found = rows.groupBy("part").cogroup(sets.crossJoin(parts).groupBy("part")).applyInArrow(_looked_into(k, [weights[name] for name in fields]), "set {}, id {}, score double, n_fields long".format(*kinds))
    found = top_per_key(found.withColumn("score", F.round("score", 6)), ["set"], [F.desc("score"), F.col("id")], k)
    return found.hint("merge").join(members, "set").select("query_id", "id", "score", "n_fields")


def proximity_search(queries: DataFrame, fields: Mapping[str, TextIndex], k: int, weights: Mapping[str, float] = WEIGHTS, form: str = "and", text_col: str = "text", direct: int = DIRECT) -> DataFrame:
    """query_id, id, score, n_fields: the ``k`` best documents that hold all terms of a query in some of their ``fields``, by
    cover density over the places in all fields, each with its weight (R8, R12). Fields stand far apart, so covers
    within one are what counts; equal scores go by id. Documents of a query are put together by their ids, so what meets
    in a row are the places of a query's terms in one document. Only documents with a query's rarest term are looked into.
    Where these are more than ``direct`` for all queries together, queries and postings meet part by part of the
    documents instead; the rows are the same."""
    asked = written(query_terms(queries, text_col, form), "query-terms")
    terms = written(asked.select("term").distinct(), "terms")
    df = reduce(DataFrame.unionByName, [index.terms(terms) for index in fields.values()]).groupBy("term").agg(F.sum("df").alias("df"))
    known = asked.join(df.hint("merge"), "term")
    whole = known.groupBy("query_id").agg(F.count("*").alias("met"), F.first("n_terms").alias("n_terms")).where("met = n_terms").select("query_id")
    of = Window.partitionBy("query_id")
    known = known.join(whole.hint("merge"), "query_id").select("*", (F.row_number().over(of.orderBy("term")) - 1).alias("no"), F.row_number().over(of.orderBy("df", "term")).alias("nth"))
    asked = written(known, "asked-terms")
    if (asked.where("nth = 1").agg(F.sum("df")).first()[0] or 0) > direct:
        return _by_parts(asked, fields, k, weights)
    terms, rarest = (_sent(written(rows.select("term").distinct(), "terms")) for rows in (asked, asked.where("nth = 1")))

    def places(no: int, weight: float) -> Column:
        return F.transform("places", lambda p: F.struct((p + F.lit(no * APART)).cast("long").alias("place"), F.lit(float(weight)).alias("weight")))

    # The documents of a query's rarest term are those that others are looked up in; so common terms cost each place once.
    held = reduce(DataFrame.unionByName, [index.postings(rarest).select("term", "id") for index in fields.values()]).distinct()
    wanted = held.join(asked.where("nth = 1").select("query_id", "term").hint("merge"), "term").select("query_id", "id")
    wanted = written(wanted.join(asked.select("query_id", "term", "n_terms", "no").hint("merge"), "query_id"), "wanted-terms")
    rows = [index.postings(terms).select("term", "id", F.lit(no).alias("field"), places(no, weights[name]).alias("places")) for no, (name, index) in enumerate(fields.items())]
    found = reduce(DataFrame.unionByName, rows).join(wanted.hint("merge"), ["term", "id"])
    found = found.groupBy("query_id", "id").agg(F.first("n_terms").alias("n_terms"), F.count_distinct("no").alias("met"), F.count_distinct("field").alias("n_fields"), F.collect_list(F.struct("no", "places")).alias("x")).where("met = n_terms")
    hits = F.array_sort(F.flatten(F.transform("x", lambda t: F.transform(t["places"], lambda p: F.struct(p["place"].alias("place"), t["no"].alias("term"), p["weight"].alias("weight"))))))
    scored = found.withColumn("hits", hits).select("query_id", "id", F.round(cover_density(F.col("hits"), F.col("n_terms")), 6).alias("score"), "n_fields")
    return top_per_key(scored, ["query_id"], [F.desc("score"), F.col("id")], k)

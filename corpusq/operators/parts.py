"""Searches part by part of a stored index: queries meet the postings of a part of the documents once, and only each
part's best rows go on."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from corpusq.operators.relational import top_per_key
from corpusq.operators.retrieval import K1, B
from corpusq.sources.index import TextIndex
from corpusq.sources.shared import written
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slack for scores that are rounded to six digits.
SLACK = 2e-6
#: Terms that are sent to all tasks at most, some 100 bytes each.
SENT_TERMS = 500_000

#: The postings of a part: term to documents, tf and dl. And a query there: its rows to documents and their scores.
Postings = Callable[[int], tuple[np.ndarray, np.ndarray, np.ndarray]]
Scored = Callable[[Postings, np.ndarray, dict[str, np.ndarray], int], tuple[np.ndarray, np.ndarray]]


def any_terms(mean_dl: float) -> Scored:
    """BM25 of documents with any of a query's terms; rows have idf."""

    def scored(postings, terms, rows, n_docs):
        found = [(idf, *postings(t)) for t, idf in zip(terms, rows["idf"], strict=True)]
        docs = np.concatenate([d for _, d, _, _ in found])
        weights = [idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean_dl)) for idf, _, tf, dl in found]
        score = np.bincount(docs, np.concatenate(weights), n_docs)
        at = np.flatnonzero(np.bincount(docs, minlength=n_docs))
        return at, score[at]

    return scored


def all_terms(mean_dl: float) -> Scored:
    """BM25 of documents with all of a query's terms; rows have idf and n_terms."""
    weighed = any_terms(mean_dl)

    def scored(postings, terms, rows, n_docs):
        found = [postings(t)[0] for t in terms]
        if len(found) < rows["n_terms"][0] or not all(len(d) for d in found):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.flatnonzero(np.bincount(np.concatenate(found), minlength=n_docs) == len(found))
        if not len(at):
            return at, np.zeros(0)
        docs, score = weighed(postings, terms, rows, n_docs)
        return at, score[np.searchsorted(docs, at)]

    return scored


def patterns_met(postings, terms, rows, n_docs):
    """The number of a query's patterns that documents meet, where these meet all of its groups or a pattern of group 0; rows
    have group and n_groups."""
    met, groups, last = np.zeros(n_docs), np.zeros(n_docs, np.int64), int(rows["n_groups"][0])
    for t, group in zip(terms, rows["group"], strict=True):
        docs = np.unique(postings(t)[0])  # a document may meet a pattern by several words
        met[docs] += 1
        groups[docs] |= 1 << int(group)
    whole = (1 << (last + 1)) - 2
    at = np.flatnonzero((groups & 1 > 0) | ((groups & whole == whole) & (last > 0)))
    return at, met[at]


def best(docs: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of ``docs`` (ascending) by score in six digits, then by document. Only scores near the edge
    are rounded, half up as Spark does."""
    if len(docs) <= k:
        return np.arange(len(docs))
    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
    sure, near = np.flatnonzero(scores > edge + SLACK), np.flatnonzero(np.abs(scores - edge) <= SLACK)
    values, at = np.unique(scores[near], return_inverse=True)
    rounded = np.array([float(Decimal(repr(float(v))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for v in values])[at]
    return np.append(sure, near[np.lexsort((near, -rounded))][: k - len(sure)])


def _array(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _searched(scored: Scored, k: int):
    """cogroup over a part's postings (term, ids, dls, tfs) and the rows of all queries (query_id, term, ...): the part's ``k``
    best documents of each query."""

    def searched(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = left.schema.field("ids").type.value_type
        none = pa.table({"query_id": right.column("query_id").slice(0, 0), "id": pa.array([], kind), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return none
        terms = pa.concat_arrays([_array(left.column("term")), _array(right.column("term"))]).dictionary_encode()
        numbers = terms.indices.to_numpy()
        lists = _array(left.column("ids"))
        ids = lists.flatten().dictionary_encode()
        order = pc.sort_indices(ids.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        of = np.repeat(numbers[: left.num_rows], np.diff(lists.offsets.to_numpy()))
        by_term = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[by_term], np.arange(len(terms.dictionary) + 1))
        doc, dl, tf = rank[ids.indices.to_numpy()][by_term], *(_array(left.column(c)).flatten().to_numpy()[by_term] for c in ("dls", "tfs"))
        ids = ids.dictionary.take(order)
        postings = lambda t: tuple(x[starts[t] : starts[t + 1]] for x in (doc, tf, dl))
        # A query's rows that have postings here, one behind the other.
        asked, queries = numbers[left.num_rows :], _array(right.column("query_id")).dictionary_encode()
        here = np.flatnonzero(starts[asked + 1] > starts[asked])
        here = here[np.lexsort((asked[here], queries.indices.to_numpy()[here]))]
        whose, asked = queries.indices.to_numpy()[here], asked[here]
        rows = {c: _array(right.column(c)).to_numpy(zero_copy_only=False)[here] for c in right.column_names if c not in ("query_id", "term", "segment", "part")}
        bounds = np.append(np.flatnonzero(np.diff(whose, prepend=-1)), len(whose))
        q, d, s = [], [], []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            docs, scores = scored(postings, asked[a:b], {c: x[a:b] for c, x in rows.items()}, len(ids))
            at = best(docs, scores, k)
            q.append(np.full(len(at), whose[a]))
            d.append(docs[at])
            s.append(scores[at])
        if not q:
            return none
        return pa.table({"query_id": queries.dictionary.take(pa.array(np.concatenate(q))), "id": ids.take(pa.array(np.concatenate(d))), "score": pa.array(np.concatenate(s))})

    return searched


def part_search(asked: DataFrame, index: TextIndex, k: int, scored: Scored, met: DataFrame | None = None) -> DataFrame:
    """query_id, id, score: the ``k`` best documents of each query of ``asked`` (query_id, term, what ``scored`` needs), by score
    and id. With ``met`` (key, term), a term of ``asked`` is a key that stands for all its terms.

    A part is what one task has written of a segment (``TASK_BYTES`` of text about), and holds all words of its documents. The
    postings of terms that are asked for are sent to their parts once, without places, however many queries ask for
    them; so are the rows of ``asked`` to each part. Scores are summed where they meet, and a part gives ``k`` rows a
    query at most: no posting is joined with the queries in a table."""
    terms = written((asked if met is None else met).select("term").distinct(), "terms")
    buckets = index.buckets(terms)
    # A bounded number of terms goes to the blocks; else all blocks of their folders would be shuffled.
    terms = F.broadcast(terms) if terms.count() <= SENT_TERMS else terms.hint("merge")
    part = F.shiftright("range", 30).alias("part")  # slots begin with the number of their task at bit 33
    if index.manifest.stale:
        lists = [F.array(c).alias(f"{c}s") for c in ("id", "dl", "tf")]
        rows = index.exploded(index.blocks(terms, buckets)).select("segment", part, "term", *lists)
    else:
        rows = index.blocks(terms, buckets).select("segment", part, "term", *[F.col(f"postings.{c}").alias(f"{c}s") for c in ("id", "dl", "tf")])
    if met is not None:
        rows = rows.join(met.hint("merge"), "term").select("segment", "part", F.col("key").alias("term"), "ids", "dls", "tfs")
    parts = F.broadcast(index.parts())  # a row a task of the index's making
    asked, keys = asked.crossJoin(parts), ["segment", "part"]
    kinds = asked.schema["query_id"].dataType.simpleString(), rows.schema["ids"].dataType.elementType.simpleString()
    found = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_searched(scored, k), f"query_id {kinds[0]}, id {kinds[1]}, score double")
    return top_per_key(found.withColumn("score", F.round("score", 6)), ["query_id"], [F.desc("score"), F.col("id")], k)

"""Batch retrieval: a table of queries against a corpus, one channel at a time.

All channels return (query_id, id, score) with at most ``k`` rows for each query; equal scores stand in the order of
their ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from corpusq.functions import terms as N
from corpusq.operators.relational import top_per_key
from corpusq.sources.shared import written
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: BM25's parameters (Robertson and Zaragoza, 2009).
K1, B = 1.2, 0.75
#: Numbers in the query vectors that are compared with the corpus at once.
QUERY_NUMBERS = 8_000_000
#: Similarities that a task holds at once, and rows that wait to be cut to the best.
SIMILARITIES, HELD = 2_000_000, 1_000_000


def postings(corpus: DataFrame, id_col: str, text_col: str, stop_words: list[str] | None = None) -> DataFrame:
    """term, id, tf and dl (the text's number of tokens): the inverted index as a table."""
    rows = corpus.select(F.col(id_col).alias("id"), N.tokens(F.col(text_col), stop_words).alias("w")).withColumn("dl", F.size("w"))
    return rows.select("id", "dl", F.explode("w").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def index_for(corpus: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The postings of ``terms`` (distinct) alone, and the sizes of the whole corpus (n_docs, mean_dl), written from one
    pass over the texts. What other terms have is dropped before anything is shuffled or counted.

    Each text sends a row without a term, which stands for itself."""
    known = written(terms.select("term", F.lit(True).alias("asked")), "asked-terms")
    rows = corpus.select(F.col(id_col).alias("id"), N.tokens(F.col(text_col)).alias("w")).withColumn("dl", F.size("w"))
    rows = rows.select("id", "dl", F.explode(F.concat(F.array(F.lit(None).cast("string")), "w")).alias("term"))
    rows = rows.join(known, "term", "left").where("asked OR term IS NULL")
    table = written(rows.groupBy("term", "id", "dl").agg(F.count("*").alias("tf")), "postings")
    sizes = table.where("term IS NULL").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_docs"), (F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).alias("mean_dl"))
    return table.where("term IS NOT NULL"), sizes


def query_terms(queries: DataFrame, text_col: str = "text", form: str = "or") -> DataFrame:
    """query_id, term and n_terms, the number of the query's distinct terms."""
    kept = {"or": N.key_terms, "and": N.and_terms, "plain": N.tokens}[form](F.col(text_col))
    return queries.select("query_id", F.array_distinct(kept).alias("w")).select("query_id", F.size("w").alias("n_terms"), F.explode("w").alias("term"))


def keyword_search(queries: DataFrame, index: DataFrame, sizes: DataFrame, k: int, form: str = "or", text_col: str = "text") -> DataFrame:
    """Texts with any (R3) or all (R4, R9) of a query's terms by BM25. sizes: one row, n_docs and mean_dl.

    The index is joined by term, so only postings of terms that are asked for are moved."""
    asked = written(query_terms(queries, text_col, form), "query-terms")
    hits = index.join(asked, "term")
    df = index.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    hits = hits.join(df.hint("merge"), "term").crossJoin(F.broadcast(sizes))  # sizes is a single row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean_dl")))
    found = hits.groupBy("query_id", "id").agg(F.round(F.sum(weight), 6).alias("score"), F.count("*").alias("matched"), F.first("n_terms").alias("n_terms"))
    if form != "or":
        found = found.where("matched = n_terms")
    return top_per_key(found, ["query_id"], [F.col("score").desc(), F.col("id")], k).select("query_id", "id", "score")


def corpus_sizes(corpus: DataFrame, text_col: str) -> DataFrame:
    return corpus.select(F.size(N.tokens(F.col(text_col))).alias("dl")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("mean_dl"))


def prefix_search(queries: DataFrame, index: DataFrame, k: int, text_col: str = "text") -> DataFrame:
    """Texts that meet the prefix form of a query (R6): all of its groups, or any of the further terms; the score is the number of patterns met.

    Index terms are joined by their prefixes of the lengths that are asked for: an equi-join, where "starts with"
    would compare each pattern with each term."""
    p = queries.select("query_id", F.explode(N.prefix_patterns(F.col(text_col))).alias("p")).select("query_id", "p.*")
    p = written(p.withColumn("n", F.when(F.col("is_prefix"), F.length("pattern")).otherwise(0)), "query-patterns")
    terms = index.select("term").distinct()
    # Each term is looked up by all of its prefixes that a pattern can be: six letters and more.
    longer = terms.where(F.length("term") >= N.LEAST_PREFIX).select("term", F.explode(F.sequence(F.lit(N.LEAST_PREFIX), F.length("term"))).alias("n"))
    by_prefix = longer.select("term", "n", F.left("term", F.col("n")).alias("pattern"))
    whole = terms.select("term", F.lit(0).alias("n"), F.col("term").alias("pattern"))
    met = p.join(by_prefix.unionByName(whole).hint("merge"), ["n", "pattern"]).select("query_id", "group", "pattern", "is_prefix", "term")
    met = written(met, "met-terms")
    hits = index.join(met, "term").select("query_id", "id", "group", "pattern", "is_prefix").distinct()
    need = p.groupBy("query_id").agg(F.max("group").alias("n_groups"))
    found = hits.groupBy("query_id", "id").agg(F.count_distinct(F.when(F.col("group") > 0, F.col("group"))).alias("g"), F.count_if(F.col("group") == 0).alias("extras"), F.count("*").cast("double").alias("score"))
    found = found.join(need.hint("merge"), "query_id").where("(n_groups > 0 AND g = n_groups) OR extras > 0")
    return top_per_key(found, ["query_id"], [F.col("score").desc(), F.col("id")], k).select("query_id", "id", "score")


def vector_search(queries: DataFrame, corpus: DataFrame, k: int, threshold: float, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` texts of a cosine similarity over ``threshold`` for each query vector.

    Query vectors go to the tasks in rounds of at most QUERY_NUMBERS numbers; a task multiplies a few rows of the corpus
    with them, as many as give SIMILARITIES numbers, and gives the ``k`` best of each query among all of its rows. Vectors
    of no length are similar to nothing."""
    spark = corpus.sparkSession
    asked = queries.select("query_id", vector_col).where(F.size(vector_col) > 0)
    size = asked.agg(F.count("*"), F.max(F.size(vector_col))).first()
    rounds = max(1, -(-size[0] * (size[1] or 1) // QUERY_NUMBERS))
    kind = queries.schema["query_id"].dataType.simpleString()
    id_kind = corpus.schema[id_col].dataType.simpleString()
    out = None
    for r in range(rounds):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r).collect()  # QUERY_NUMBERS numbers about
        shared = spark.sparkContext.broadcast(([x[0] for x in rows], _unit(np.array([x[1] for x in rows], np.float64))))
        vectors = corpus.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.size("v") == (size[1] or 0))
        found = vectors.mapInArrow(_nearest(shared, k, threshold), f"query_id {kind}, id {id_kind}, score double")
        out = found if out is None else out.unionByName(found)
    return top_per_key(out, ["query_id"], [F.col("score").desc(), F.col("id")], k)


def _nearest(shared, k: int, threshold: float):
    """mapInArrow over id, vector: query_id, id, score of the ``k`` best vectors of the task for each query.

    What may be among them waits until it is HELD rows, of which the best stay; after that, and after each step, a query takes
    only what reaches the k-th best that it has seen. Equal scores go by id."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = shared.value
        edge = np.full(len(names), -np.inf)
        held, n_held, most = [], 0, HELD

        def cut() -> pa.Table:
            rows = pa.concat_tables(held).combine_chunks()
            rows = rows.take(pc.sort_indices(rows, [("q", "ascending"), ("score", "descending"), ("id", "ascending")]))
            q = rows.column("q").to_numpy()
            starts = np.searchsorted(q, q)
            nth = np.arange(len(q)) - starts
            last = nth == k - 1
            edge[q[last]] = np.maximum(edge[q[last]], rows.column("score").to_numpy()[last])
            return rows.filter(pa.array(nth < k))

        for b in batches:
            lists = b.column(1)
            if not len(lists) or not len(names):
                continue
            own = _unit(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1))
            step = max(1, SIMILARITIES // len(names))
            for i in range(0, len(own), step):
                similar = np.round(own[i : i + step] @ asked.T, 6)
                if len(similar) >= k:
                    # The k-th best of each query in this step, with all that equal it, so that ties are cut by id later.
                    np.maximum(edge, np.partition(similar, len(similar) - k, axis=0)[len(similar) - k], out=edge)
                at, q = np.nonzero((similar >= edge) & (similar > threshold))
                held.append(pa.table({"q": pa.array(q.astype(np.int32)), "id": b.column(0).take(pa.array(i + at)), "score": pa.array(similar[at, q])}))
                n_held += len(q)
                if n_held > most:
                    held = [cut()]
                    n_held = held[0].num_rows
                    most = max(HELD, 2 * n_held)
        if n_held:
            rows = cut()
            names = pa.array(names)
            for b in rows.combine_chunks().to_batches(max_chunksize=100_000):
                yield pa.RecordBatch.from_arrays([names.take(b.column(0)), b.column(1), b.column(2)], ["query_id", "id", "score"])

    return best


def _unit(x: np.ndarray) -> np.ndarray:
    if not len(x):
        return x.reshape(0, 1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def id_search(mentions: DataFrame, sections: DataFrame, key: str, score: float = 1.0, sections_each: int | None = None) -> DataFrame:
    """All sections, or the first few, of the cases that a query names (R10, R11). mentions: query_id and ``key``."""
    hits = mentions.select("query_id", key).distinct().join(sections.select(F.col("id"), key), key)
    if sections_each:
        hits = top_per_key(hits, ["query_id", key], [F.col("id")], sections_each)
    return hits.select("query_id", "id", F.lit(score).alias("score"))


def best_section(hits: DataFrame, sections: DataFrame, key: str, k: int) -> DataFrame:
    """Hits on cases as hits on their first section, the best cases first."""
    first = sections.groupBy(F.col(key).alias("case")).agg(F.min("id").alias("section"))
    found = hits.join(first, F.col("id") == F.col("case")).select("query_id", F.col("section").alias("id"), "score")
    return top_per_key(found, ["query_id"], [F.col("score").desc(), F.col("id")], k)


def combined_score(cosine: Column, rank: Column, priority: Column) -> Column:
    """The weighted score of the older search: by priority 0.75, 0.70 or 0.65 of the cosine and 0.3 of the rank."""
    weight = F.when(priority == "high", 0.75).when(priority == "medium", 0.70).otherwise(0.65)
    return weight * cosine + 0.3 * rank

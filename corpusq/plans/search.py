"""Queries of search, fusion and ranking (§2.9 of the survey).

Every fiftieth conversation's first turn is a query, all documents are the corpus, and every fiftieth vector is a
query vector."""

from __future__ import annotations

from corpusq.functions import finnish as W
from corpusq.functions import scalars as S
from corpusq.functions import terms as N
from corpusq.operators import blocks as K
from corpusq.operators import fusion as X
from corpusq.operators import relational as L
from corpusq.operators import retrieval as R
from corpusq.operators.language import compounds, language_model, with_language
from corpusq.operators.proximity import WEIGHTS, proximity_search
from corpusq.plans.registry import query, table
from corpusq.sources.index import TextIndex, kept_index
from corpusq.sources.shared import shared_path, written
from corpusq.sources.vectors import kept_vectors
from pyspark.sql import functions as F

#: Cells that a query of vectors looks into, of 64: more than half, as these vectors form no groups that cells could follow.
PROBES = 36
_STOPS = ", ".join(f"'{w}'" for w in N.STOP_WORDS)


def _terms_sql(text: str, n: int = 5) -> str:
    words = f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) > 2 AND x NOT IN ({_STOPS}) AND NOT regexp_matches(x, '^[0-9]+$'))"
    return f"list_transform(list_sort(list_transform({words}, lambda x, i: {{'n': -length(x), 'i': i, 'w': x}})), lambda s: s.w)[1:{n}]"


QUERIES_SQL = "q AS (SELECT conv_id AS query_id, text FROM conversations WHERE turn = 0 AND conv_id % 50 = 0)"
TOKENS_SQL = r"tok AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents)"

_CUT = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w"


def _bm25_sql(terms: str, need_all: bool, k: int, name: str, tok: str = "tok") -> str:
    return f"""{name}t AS (SELECT query_id, len(w) AS n_terms, unnest(w) AS term FROM (SELECT query_id, list_distinct({terms}) AS w FROM q)),
{name}p AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM {tok}) GROUP BY ALL HAVING term IN (SELECT term FROM {name}t)),
{name}d AS (SELECT term, count(*) AS df FROM {name}p GROUP BY 1), {name}s AS (SELECT count(*) AS n, avg(len(w)) AS m FROM {tok}),
{name} AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / m))), 6) AS score FROM {name}p JOIN {name}t USING (term) JOIN {name}d USING (term) CROSS JOIN {name}s
GROUP BY query_id, id {"HAVING count(*) = any_value(n_terms)" if need_all else ""} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {k})"""


_T = _terms_sql("text")
OR_SQL = _bm25_sql(_T, False, 25, "ors")
AND_SQL = _bm25_sql(f"CASE WHEN len({_T}) >= 2 THEN ({_T})[1:3] ELSE [] END", True, 25, "ands")


def asked(spark, d):
    return table(spark, d, "conversations").where("turn = 0 AND conv_id % 50 = 0").select(F.col("conv_id").alias("query_id"), "text")


def stored(spark, d):
    """The stored index of all documents; queries of a session share it."""
    return kept_index(spark, f"{d}/documents.parquet", "doc_id", F.col("text"))


def _or(spark, d):
    return K.top_search(asked(spark, d), stored(spark, d), 25)


def _and(spark, d):
    return K.all_terms_search(asked(spark, d), stored(spark, d), 25).select("query_id", "id", "score")


def _both(spark, d):
    """The OR and the AND channel."""
    return _or(spark, d), _and(spark, d)


@query(rf"SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '' AND x NOT IN ('the', 'la')) AS w FROM documents")
def n1_analyzer(spark, d):
    return table(spark, d, "documents").select("doc_id", N.tokens(F.col("text"), ["the", "la"]).alias("w"))


def _stem_sql(word: str) -> str:
    out = word
    for least, endings in W.STEPS:
        out = f"regexp_replace({out}, '{W.ending(least, endings)}', '\\1')"
    return f"CASE WHEN length({word}) < {W.LEAST} THEN {word} ELSE {out} END"


@query(f"WITH {TOKENS_SQL}, t AS (SELECT term, count(DISTINCT id) AS df FROM (SELECT id, unnest(w) AS term FROM tok) GROUP BY 1), s AS (SELECT term, {_stem_sql('term')} AS stem FROM t), n AS (SELECT stem, count(*) AS forms FROM s GROUP BY 1) SELECT term, stem, forms FROM s JOIN n USING (stem)")
def n1_stems(spark, d):
    """Each distinct word of the stored index with its stem, and how many words share that."""
    rows = written(stored(spark, d).terms().select("term", W.stem(F.col("term")).alias("stem")), "stems")
    return rows.join(rows.groupBy("stem").agg(F.count("*").alias("forms")).hint("merge"), "stem").select("term", "stem", "forms")


@query(f"""WITH {TOKENS_SQL}, t AS (SELECT DISTINCT unnest(w) AS term FROM tok), k AS (SELECT term FROM t WHERE length(term) >= 4),
c AS (SELECT term, left(term, n) AS first, substr(term, n + 1) AS second FROM (SELECT term, unnest(range(4, length(term) - 3)) AS n FROM k WHERE length(term) >= 8))
SELECT term, first, second FROM c WHERE first IN (SELECT term FROM k) AND second IN (SELECT term FROM k) QUALIFY row_number() OVER (PARTITION BY term ORDER BY length(first) DESC) = 1""")
def n1_compounds(spark, d):
    """Words that are two other words of the corpus."""
    return compounds(stored(spark, d).terms())


@query(f"WITH {TOKENS_SQL} SELECT term, count(DISTINCT id) AS df, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM tok) GROUP BY term")
def n2_inverted_index(spark, d):
    """The dictionary of the stored index, with the number of all places from its postings."""
    return stored(spark, d).counts()


@query(f"SELECT conv_id, turn, {_T} AS terms FROM conversations")
def n3_t5_key_terms(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", N.key_terms(F.col("text")).alias("terms"))


@query(f"SELECT conv_id, turn, array_to_string({_T}, ' OR ') AS ors, array_to_string(CASE WHEN len({_T}) >= 2 THEN ({_T})[1:3] ELSE [] END, ' ') AS ands FROM conversations")
def r3_r4_query_forms(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", N.or_query(F.col("text")).alias("ors"), F.array_join(N.and_terms(F.col("text")), " ").alias("ands"))


_LONG = f"list_filter({_T}, lambda x: length(x) > 10)[1:2]"
_PREFIXES = "list_transform(list_sort(list_distinct(list_filter([greatest(6, CAST(floor(length(x) * 0.5) AS INT)), greatest(6, CAST(floor(length(x) * 0.65) AS INT)), greatest(6, CAST(floor(length(x) * 0.8) AS INT))], lambda n: n < length(x) - 2))), lambda n: left(x, n) || ':*')"


@query(f"""WITH t AS (SELECT conv_id, turn, {_T} AS terms, {_LONG} AS longs FROM conversations), g AS (SELECT conv_id, turn, terms, longs, array_to_string(list_transform(longs, lambda x: CASE WHEN len({_PREFIXES}) > 0 THEN '( ' || x || ' | ' || array_to_string({_PREFIXES}, ' | ') || ' )' ELSE x END), ' & ') AS core,
 array_to_string(list_transform(list_sort(list_transform(list_distinct(list_filter(terms, lambda x: NOT list_contains(longs, x))), lambda x: {{'i': list_position(terms, x), 'w': x}})), lambda s: s.w), ' | ') AS rest FROM t)
SELECT conv_id, turn, concat_ws(' | ', nullif(core, ''), nullif(rest, '')) AS form FROM g""")
def r5_prefix_form(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", N.prefix_query(F.col("text")).alias("form"))


@query(f"WITH {QUERIES_SQL}, {TOKENS_SQL}, {OR_SQL} SELECT * FROM ors")
def r3_fts_or(spark, d):
    return _or(spark, d)


@query(f"WITH {QUERIES_SQL}, {TOKENS_SQL}, {AND_SQL} SELECT * FROM ands")
def r4_fts_and(spark, d):
    return _and(spark, d)


@query(rf"""WITH {QUERIES_SQL}, {TOKENS_SQL}, q1 AS (SELECT query_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM q), q2 AS (SELECT query_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS w FROM q1)
SELECT query_id, id, len(q2.w) AS n FROM q2, tok WHERE list_has_all(tok.w, q2.w) AND len(q2.w) > 0""")
def r9_plain_and(spark, d):
    return K.all_terms_search(asked(spark, d), stored(spark, d), None, "plain").select("query_id", "id", F.col("n_terms").cast("long").alias("n"))


def _prefix_sql(name: str, k: int, tok: str = "tok") -> str:
    """The k best of the prefix form of each query; CTEs begin with the name."""
    n, at = name, [f"greatest(6, CAST(floor(length(longs[g]) * {x}) AS INT))" for x in N.PREFIX_SHARES]
    return f"""{n}t AS (SELECT query_id, {_T} AS terms, {_LONG} AS longs FROM q), {n}p AS (SELECT query_id, longs, terms, unnest(range(1, len(longs) + 1)) AS g FROM {n}t),
{n}g AS (SELECT DISTINCT query_id, g, u.* FROM (SELECT query_id, g, unnest(list_concat([{{'pat': longs[g], 'pre': false}}], list_transform(list_filter([{', '.join(at)}], lambda n: n < length(longs[g]) - 2), lambda n: {{'pat': left(longs[g], n), 'pre': true}}))) AS u FROM {n}p)),
{n}e AS (SELECT DISTINCT query_id, 0 AS g, unnest(list_filter(terms, lambda x: NOT list_contains(longs, x))) AS pat, false AS pre FROM {n}t), {n}a AS (SELECT query_id, g, pat, pre FROM {n}g UNION ALL SELECT * FROM {n}e),
{n}w AS (SELECT DISTINCT id, unnest(w) AS term FROM {tok}), {n}m AS (SELECT DISTINCT query_id, id, g, pat, pre FROM {n}a JOIN {n}w ON (CASE WHEN pre THEN starts_with(term, pat) ELSE term = pat END)), {n}n AS (SELECT query_id, max(g) AS n FROM {n}a GROUP BY 1),
{n} AS (SELECT query_id, id, CAST(count(*) AS DOUBLE) AS score FROM {n}m JOIN {n}n USING (query_id) GROUP BY query_id, id, n HAVING (n > 0 AND count(DISTINCT CASE WHEN g > 0 THEN g END) = n) OR count(*) FILTER (g = 0) > 0
 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {k})"""


@query(f"WITH {QUERIES_SQL}, {TOKENS_SQL}, {_prefix_sql('pre', 25)} SELECT * FROM pre")
def r6_prefix_channel(spark, d):
    return K.prefix_search(asked(spark, d), stored(spark, d), 25)


VECTORS_SQL = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), vec AS (SELECT a.id AS query_id, b.id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a, v b WHERE a.id % 50 = 0 QUALIFY score > {t} AND row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.id) <= {k})"


def _vectors(spark, d, k, t):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return R.vector_search(e.where("id % 50 = 0").withColumnRenamed("id", "query_id"), e, k, t)


@query(f"WITH {VECTORS_SQL.format(t=0.3, k=25)} SELECT * FROM vec")
def r1_j19_vector_search(spark, d):
    return _vectors(spark, d, 25, 0.3)


@query(f"WITH {VECTORS_SQL.format(t=0.5, k=10)} SELECT * FROM vec")
def r2_p8_chunk_vectors(spark, d):
    return _vectors(spark, d, 10, 0.5)


@query("WITH m AS (SELECT page_id AS query_id, (page_id * 7) % 40 AS conv FROM pages WHERE page_id % 50 = 0) SELECT query_id, conv_id * 1000 + turn AS id, 1.0 AS score FROM m JOIN conversations ON conv_id = conv")
def r10_direct_lookup(spark, d):
    m = table(spark, d, "pages").where("page_id % 50 = 0").selectExpr("page_id AS query_id", "(page_id * 7) % 40 AS conv_id")
    return R.id_search(m, table(spark, d, "conversations").selectExpr("conv_id * 1000 + turn AS id", "conv_id"), "conv_id")


@query("WITH m AS (SELECT page_id AS query_id, (page_id * 7) % 40 AS conv FROM pages WHERE page_id % 50 = 0) SELECT query_id, conv_id * 1000 + turn AS id, 0.95 AS score FROM m JOIN conversations ON conv_id = conv QUALIFY row_number() OVER (PARTITION BY query_id, conv_id ORDER BY turn) <= 2")
def r11_id_fallback(spark, d):
    m = table(spark, d, "pages").where("page_id % 50 = 0").selectExpr("page_id AS query_id", "(page_id * 7) % 40 AS conv_id")
    return R.id_search(m, table(spark, d, "conversations").selectExpr("conv_id * 1000 + turn AS id", "conv_id"), "conv_id", 0.95, 2)


@query(f"""WITH {QUERIES_SQL}, {TOKENS_SQL}, {OR_SQL}, s AS (SELECT source, min(doc_id) AS section FROM documents GROUP BY 1), h AS (SELECT query_id, source, max(score) AS score FROM ors JOIN documents ON doc_id = id GROUP BY 1, 2)
SELECT query_id, section AS id, score FROM h JOIN s USING (source) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section) <= 10""")
def r7_r8_best_section(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    h = _or(spark, d).join(docs, "id").groupBy("query_id", F.col("source").alias("id")).agg(F.max("score").alias("score"))
    return R.best_section(h, docs, "source", 10)


@query(f"WITH {VECTORS_SQL.format(t=0.3, k=25)} SELECT query_id, id, round((CASE WHEN id % 3 = 0 THEN 0.75 WHEN id % 3 = 1 THEN 0.70 ELSE 0.65 END) * score + 0.3 * (id % 10) / 10, 6) AS score FROM vec")
def r12_weighted_score(spark, d):
    p = F.when(F.col("id") % 3 == 0, "high").when(F.col("id") % 3 == 1, "medium").otherwise("low")
    return _vectors(spark, d, 25, 0.3).select("query_id", "id", F.round(R.combined_score(F.col("score"), F.col("id") % 10 / 10, p), 6).alias("score"))


_FIELDS = ("left(text, 150)", "concat_ws(' ', lang, source, lang)", "text")


@query(rf"""WITH q AS (SELECT doc_id AS query_id, left(text, 120) AS text FROM documents WHERE doc_id % 50 = 0), t AS (SELECT query_id, len(w) AS n_terms, unnest(w) AS term FROM (SELECT query_id, list_distinct(CASE WHEN len({_T}) >= 2 THEN ({_T})[1:3] ELSE [] END) AS w FROM q)),
f AS ({" UNION ALL ".join(f"SELECT doc_id AS id, {no} AS field, {w} AS weight, {_CUT.format(text)} FROM documents" for no, (w, text) in enumerate(zip(WEIGHTS.values(), _FIELDS, strict=True)))}),
h AS (SELECT query_id, n_terms, id, field, weight, term, pos + field::BIGINT * 268435456 AS pos FROM (SELECT id, field, weight, unnest(w) AS term, unnest(range(len(w))) AS pos FROM f) JOIN t USING (term)),
c AS (SELECT e.query_id, e.id, e.pos AS stop, p.term, max(p.pos) AS pos, any_value(e.n_terms) AS n_terms FROM h e JOIN h p ON e.query_id = p.query_id AND e.id = p.id AND p.pos <= e.pos GROUP BY 1, 2, 3, 4),
s AS (SELECT query_id, id, begin, min(stop) AS stop FROM (SELECT query_id, id, stop, min(pos) AS begin FROM c GROUP BY 1, 2, 3 HAVING count(*) = any_value(n_terms)) GROUP BY 1, 2, 3),
m AS (SELECT s.query_id, s.id, begin, stop, count(*) AS n, sum(1 / weight) AS inv FROM s JOIN h ON h.query_id = s.query_id AND h.id = s.id AND h.pos BETWEEN begin AND stop GROUP BY 1, 2, 3, 4),
k AS (SELECT query_id, id, count(DISTINCT field) AS n_fields FROM h GROUP BY 1, 2)
SELECT query_id, id, round(sum((n / inv) / (1 + (stop - begin + 1 - n))), 6) AS score, any_value(n_fields) AS n_fields FROM m JOIN k USING (query_id, id) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10""")
def r8_r12_cover_density(spark, d):
    """The first words of every fiftieth document as queries, ranked by nearness in titles, keywords and texts."""
    docs = table(spark, d, "documents")
    q = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.left("text", F.lit(120)).alias("text"))
    short = {name: kept_index(spark, f"{d}/documents.parquet", "doc_id", F.expr(text)) for name, text in zip(("title", "keywords"), _FIELDS, strict=False)}
    return proximity_search(q, short | {"text": stored(spark, d)}, 10)


RRF_SQL = """u AS (SELECT query_id, id, score, 0 AS no, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM ors UNION ALL SELECT query_id, id, score, 1, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) FROM ands),
rrf AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS rrf_score, min_by(score, no) AS score, CASE WHEN min(no) = 0 THEN 'or' ELSE 'and' END AS channel FROM u GROUP BY query_id, id)"""


@query(f"WITH {QUERIES_SQL}, {TOKENS_SQL}, {OR_SQL}, {AND_SQL}, {RRF_SQL} SELECT * FROM rrf")
def r16_rrf_merge(spark, d):
    return X.rrf(dict(zip(("or", "and"), _both(spark, d), strict=True)))


#: Five documents in a row are a case; its title is how its first one begins, its metadata are that, language and source.
TITLE, META = "left(text, 150)", "concat_ws(' ', left(text, 150), lang, source)"
CHANNELS = ("vector", "or", "and", "metadata", "prefix_title", "prefix_content")
HYBRID_SQL = f"""WITH q AS (SELECT conv_id AS query_id, text || CASE WHEN conv_id % 100 = 0 THEN ' KKO:2020:' || (conv_id // 50 + 1) ELSE '' END AS text FROM conversations WHERE turn = 0 AND conv_id % 50 = 0), {TOKENS_SQL},
f AS (SELECT min(doc_id) AS id FROM documents GROUP BY doc_id // 5), tt AS (SELECT id, {_CUT.format(TITLE)} FROM f JOIN documents ON doc_id = id), mt AS (SELECT id, {_CUT.format(META)} FROM f JOIN documents ON doc_id = id),
{OR_SQL}, {AND_SQL}, {_bm25_sql(_T, False, 20, "meta", "mt")}, {_prefix_sql("tit", 20, "tt")}, {_prefix_sql("pre", 20)}, {VECTORS_SQL.format(t=0.3, k=25)},
u AS ({" UNION ALL ".join(f"SELECT query_id, id, score, {no} AS no, '{name}' AS channel FROM {cte} SEMI JOIN q USING (query_id)" for no, (name, cte) in enumerate(zip(CHANNELS, ("vec", "ors", "ands", "meta", "tit", "pre"), strict=True)))}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, no ORDER BY score DESC, id) AS r FROM u),
m AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS rrf_score, min_by(channel, no) AS channel FROM r GROUP BY 1, 2),
b AS (SELECT query_id, doc_id AS id FROM q JOIN documents ON doc_id // 5 = query_id // 50 WHERE query_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY doc_id) <= 2),
a AS (SELECT * FROM m UNION ALL SELECT query_id, id, NULL, 'case_id' FROM b ANTI JOIN m USING (query_id, id))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC NULLS LAST, id) AS pos, id, rrf_score, channel FROM a"""


@query(HYBRID_SQL)
def r17_hybrid_search(spark, d):
    """All channels: vectors, any and all key terms, metadata, prefixes in titles and in texts, fused by rank; behind them
    the first two sections of a case that the query names."""
    q = table(spark, d, "conversations").where("turn = 0 AND conv_id % 50 = 0")
    q = q.select(F.col("conv_id").alias("query_id"), F.concat("text", F.when(F.col("conv_id") % 100 == 0, F.concat(F.lit(" KKO:2020:"), F.expr("conv_id div 50 + 1"))).otherwise("")).alias("text"))
    docs = table(spark, d, "documents").withColumn("case_id", F.concat(F.lit("KKO:2020:"), F.expr("doc_id div 5 + 1")))
    firsts = docs.groupBy("case_id").agg(F.min("doc_id").alias("doc_id"))
    cases = written(docs.join(firsts, ["case_id", "doc_id"]).select("doc_id", F.expr(TITLE).alias("title"), F.expr(META).alias("meta")), "cases")
    index, (titles, meta) = stored(spark, d), (TextIndex(spark, shared_path(spark, "index")).add(cases, "doc_id", c, distinct_ids=True) for c in ("title", "meta"))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    vectors = e.join(q.select(F.col("query_id").alias("id")), "id").withColumnRenamed("id", "query_id")
    found = X.rrf(dict(zip(CHANNELS, (
        R.vector_search(vectors, e, 25, 0.3), K.top_search(q, index, 25), K.all_terms_search(q, index, 25), K.top_search(q, meta, 20), K.prefix_search(q, titles, 20), K.prefix_search(q, index, 20),
    ), strict=True)))
    named = q.select("query_id", F.explode(S.case_ids(F.col("text"))).alias("case_id"))
    return X.with_named_cases(found, R.id_search(named, docs.select(F.col("doc_id").alias("id"), "case_id"), "case_id", 0.95, 2))


@query(f"WITH {QUERIES_SQL}, {TOKENS_SQL}, {OR_SQL}, {AND_SQL}, a AS (SELECT query_id, id, score, 0 AS n FROM ors UNION ALL SELECT query_id, id, score, 1 FROM ands) SELECT query_id, id, max(score) AS score FROM a GROUP BY 1, 2")
def r18_multi_query(spark, d):
    none = F.lit(0.0)
    first, second = _both(spark, d)
    both = first.withColumns({"alt_no": F.lit(0), "rrf_score": none}).unionByName(second.withColumns({"alt_no": F.lit(1), "rrf_score": none}))
    return X.with_alternatives(both).select("query_id", "id", "score")


@query(f"WITH {VECTORS_SQL.format(t=0.0, k=50)}, r AS (SELECT *, (id * 37) % 101 AS rs FROM vec), b AS (SELECT query_id, id, round(1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY rs DESC, id)) + 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)), 9) AS blended FROM r) SELECT * FROM b")
def r19_r21_rerank_blend(spark, d):
    h = X.rerank(_vectors(spark, d, 50, 0.0), (F.col("id") * 37) % 101, 50, "score")
    return X.blend(h).select("query_id", "id", "blended")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0.3 WHEN doc_id % 3 = 1 AND doc_id % 2 = 0 THEN 0.3 ELSE doc_id / 10.0 END AS base FROM documents")
def r20_base_score(spark, d):
    s = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when((F.col("doc_id") % 3 == 1) & (F.col("doc_id") % 2 == 0), 0.0).otherwise(F.col("doc_id") / 10.0)
    return table(spark, d, "documents").select("doc_id", X.base_score(s).alias("base"))


_WORDS = f"list_distinct(list_filter(string_split_regex(trim(lower(q)), '\\s+'), lambda x: length(x) >= 4 AND x NOT IN ({', '.join(repr(w) for w in X.PLAIN_WORDS)})))"


@query(f"""WITH b AS (SELECT doc_id, 'Milloin RL ' || CAST(doc_id % 4 AS VARCHAR) || ':3 the 3 kohdan ' || left(text, 60) AS q, 'rl 2:3 ' || text AS t FROM documents), w AS (SELECT *, {_WORDS} AS w FROM b)
SELECT doc_id, round(CASE WHEN doc_id % 4 = 2 THEN 2.0 ELSE 1.0 END * 1.4 * CASE WHEN len(w) > 0 AND len(list_filter(w, lambda x: contains(lower(t), x))) / len(w) >= 0.5 THEN 1 + len(list_filter(w, lambda x: contains(lower(t), x))) / len(w) * 0.5 ELSE 1.0 END, 6) AS boost FROM w""")
def r22_exact_boost(spark, d):
    b = table(spark, d, "documents").selectExpr("doc_id", "concat('Milloin RL ', doc_id % 4, ':3 the 3 kohdan ', left(text, 60)) AS q", "concat('rl 2:3 ', text) AS t")
    return b.select("doc_id", F.round(X.exact_boost(F.col("q"), F.col("t"), F.lit(None).cast("string"), F.lit("reasoning"), F.lit("")), 6).alias("boost"))


@query(f"SELECT p_partkey, CASE WHEN n >= 3 THEN 1.6 WHEN n = 2 THEN 1.3 ELSE 1.0 END AS boost FROM (SELECT p_partkey, len(list_filter({_WORDS}, lambda x: length(x) >= 6 AND contains(lower(p_type), left(x, 6)))) AS n FROM (SELECT p_partkey, p_type, p_name || ' polished standard anodized burnished' AS q FROM part))")
def r23_title_boost(spark, d):
    words = X.query_words(F.concat("p_name", F.lit(" polished standard anodized burnished")))
    return table(spark, d, "part").select("p_partkey", X.title_boost(F.col("p_type"), words).alias("boost"))


@query("SELECT doc_id, round(doc_id * pow(1.5, CASE WHEN lang = 'en' THEN 1.5 WHEN lang = 'fr' THEN 1.0 ELSE 0.5 END), 6) AS s FROM documents")
def r24_boost_weights(spark, d):
    kind = F.when(F.col("lang") == "en", "statute_interpretation").when(F.col("lang") == "fr", "conditions").otherwise("general")
    return table(spark, d, "documents").select("doc_id", F.round(X.boosted(F.col("doc_id"), F.lit(1.5), kind), 6).alias("s"))


@query("""WITH h AS (SELECT lang AS query_id, doc_id AS id, source, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS p FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY p) AS nth FROM h),
k AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY p) AS pos FROM n WHERE p <= 2 OR nth <= 2 OR source = 'src3') SELECT * FROM k WHERE pos <= 15""")
def w6_diversity_cap(spark, d):
    h = table(spark, d, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), "source", "n_chars")
    return X.diversity_cap(h, [F.col("n_chars").desc(), F.col("id")], F.col("source"), 2, 15, F.col("source") == "src3").select("query_id", "id", "pos")


@query(f"WITH {VECTORS_SQL.format(t=0.3, k=3)}, r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM vec) SELECT query_id, string_agg('[' || CAST(pos AS VARCHAR) || '] v' || CAST(id AS VARCHAR) || chr(10) || left('text of ' || CAST(id AS VARCHAR), 1200), chr(10) || chr(10) ORDER BY pos) AS context FROM r GROUP BY query_id")
def r26_context_assembly(spark, d):
    h = X.ranked(_vectors(spark, d, 3, 0.3), rank="pos")
    return X.contexts(h, F.concat(F.lit("v"), F.col("id")), F.concat(F.lit("text of "), F.col("id")))


@query(f"WITH {QUERIES_SQL}, {TOKENS_SQL}, {AND_SQL} SELECT query_id, text FROM q WHERE query_id NOT IN (SELECT query_id FROM ands) AND query_id % 3 < 2")
def r27_retry_on_empty(spark, d):
    return X.retried(asked(spark, d), _and(spark, d), F.col("query_id") % 3)


@query()
def r15_approximate_vectors(spark, d):
    """The ten nearest vectors by a stored index of cells; at least 0.95 of all exact neighbours (tested as registered)."""
    index = kept_vectors(spark, f"{d}/embeddings.parquet", "vec_id", "embedding")
    return index.search(table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10, probes=PROBES)


@query(f"""WITH {QUERIES_SQL}, {TOKENS_SQL}, {OR_SQL}, {AND_SQL}, {RRF_SQL},
h AS (SELECT rrf.query_id, id, rrf_score, channel, q.text AS q, d.text AS t, source, lang FROM rrf JOIN q USING (query_id) JOIN documents d ON d.doc_id = id QUALIFY row_number() OVER (PARTITION BY rrf.query_id ORDER BY rrf_score DESC, id) <= 50),
s AS (SELECT *, len(list_filter(w, lambda x: contains(lower(t), x))) / nullif(len(w), 0) AS share FROM (SELECT *, {_WORDS} AS w FROM h)), r AS (SELECT *, coalesce(round(share, 6), 0.0) AS rerank_score FROM s),
b AS (SELECT *, round(1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, id)) + 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id)), 9) AS blended FROM r),
f AS (SELECT *, round(blended * pow(CASE WHEN share >= 0.5 THEN 1 + share * 0.5 ELSE 1.0 END, 0.5), 9) AS final FROM b), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, id) AS p FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY p) AS nth FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p) AS pos FROM n WHERE p <= 2 OR nth <= 3)
SELECT query_id, pos, id, source, lang, channel, rrf_score, rerank_score, final FROM k WHERE pos <= 10""")
def r25_hybrid_pipeline(spark, d):
    """All steps of retrieval: OR and AND channels fused, filtered, reranked by words in common, blended, boosted, capped."""
    q = asked(spark, d)
    fused = X.rrf(dict(zip(("or", "and"), _both(spark, d), strict=True)))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("doc_text"), "source", "lang")
    # At most 50 rows for each query are joined with texts.
    hits = L.top_per_key(fused, ["query_id"], [F.col("rrf_score").desc(), F.col("id")], 50)
    hits = hits.join(docs, "id").join(q, "query_id")
    hits = X.rerank(hits, X.overlap_score(X.query_words(F.col("text")), F.col("doc_text")), 50, "rrf_score")
    hits = X.blend(hits, prior="rrf_score")
    boost = X.exact_boost(F.col("text"), F.col("doc_text"), F.lit(None).cast("string"), F.lit(""), F.lit(""))
    hits = hits.withColumn("final", F.round(X.boosted(F.col("blended"), boost, S.query_type(F.col("text"))), 9))
    capped = X.diversity_cap(hits, [F.col("final").desc(), F.col("id")], F.col("source"), 3, 10)
    return capped.select("query_id", "pos", "id", "source", "lang", "channel", "rrf_score", "rerank_score", "final")


#: Words that tell the languages of the corpus apart.
LANGUAGE_WORDS = {"en": "the of and to in is that for was with", "fr": "le la de et les des est une dans que", "de": "der die und das von ist mit den ein zu", "es": "el la de que y en los las una por"}
_LANGS_SQL = "l AS (SELECT lang, unnest(string_split(words, ' ')) AS w FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in LANGUAGE_WORDS.items()) + ") t(lang, words))"


@query(f"WITH {TOKENS_SQL}, {_LANGS_SQL} SELECT id AS doc_id, arg_max(lang, (n, lang)) AS detected FROM (SELECT id, lang, count(*) AS n FROM (SELECT id, unnest(w) AS w FROM tok) JOIN l USING (w) GROUP BY 1, 2) GROUP BY 1")
def n4_language_detection(spark, d):
    words = [(lang, w) for lang, ws in LANGUAGE_WORDS.items() for w in ws.split()]
    known = F.broadcast(spark.createDataFrame(words, "lang string, w string"))  # 40 rows
    tok = table(spark, d, "documents").select("doc_id", F.explode(N.tokens(F.col("text"))).alias("w"))
    hits = tok.join(known, "w").groupBy("doc_id", "lang").agg(F.count("*").alias("n"))
    return hits.groupBy("doc_id").agg(F.max_by("lang", F.struct("n", "lang")).alias("detected"))


@query(r"""WITH d AS (SELECT doc_id, lang, ' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' ' AS t FROM documents), g AS (SELECT doc_id, lang, substr(t, i, 3) AS run, count(*) AS n FROM (SELECT doc_id, lang, t, unnest(range(1, length(t) - 1)) AS i FROM d) GROUP BY ALL),
c AS (SELECT lang, run, sum(n) AS n FROM g WHERE doc_id % 10 > 0 GROUP BY 1, 2), s AS (SELECT lang, sum(n) AS a, count(*) AS v FROM c GROUP BY 1),
m AS (SELECT lang, run, ln((n + 0.5) / (a + 0.5 * (v + 1))) AS w FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, run) <= 20000) JOIN s USING (lang)), f AS (SELECT lang, ln(0.5 / (a + 0.5 * (v + 1))) AS w FROM s),
p AS (SELECT doc_id, f.lang, sum(g.n * coalesce(m.w, f.w)) AS score FROM g CROSS JOIN f LEFT JOIN m ON m.lang = f.lang AND m.run = g.run GROUP BY 1, 2)
SELECT doc_id, d.lang, b.lang AS detected FROM d LEFT JOIN (SELECT doc_id, lang FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1) b USING (doc_id)""")
def n4_f41_language_model(spark, d):
    """Languages of all documents by a model that nine tenths of them have taught."""
    docs = table(spark, d, "documents")
    model = language_model(docs.where("doc_id % 10 > 0"))
    return with_language(docs.select("doc_id", "lang", "text"), model).drop("text")


@query(f"""WITH {QUERIES_SQL}, g AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS term, lower(split_part(p_name, ' ', 2)) AS fi FROM part), w AS (SELECT query_id, text, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM q),
e AS (SELECT query_id, list_sort(list_distinct(list(fi))) AS added FROM (SELECT query_id, w, unnest(list_distinct(w)) AS term FROM w) JOIN g USING (term) WHERE NOT list_contains(w, fi) GROUP BY 1)
SELECT query_id, concat_ws(' ', text, array_to_string(added, ' ')) AS text FROM w LEFT JOIN e USING (query_id)""")
def n5_u8_glossary_expansion(spark, d):
    """Words of parts' names as a glossary: the first word of a name adds the second."""
    glossary = table(spark, d, "part").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("term"), F.lower(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("fi")).distinct()
    q = asked(spark, d).withColumn("w", N.tokens(F.col("text")))
    added = q.select("query_id", "w", F.explode(F.array_distinct("w")).alias("term")).join(glossary.hint("merge"), "term").where(~F.array_contains("w", F.col("fi")))
    added = added.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("fi")), " ").alias("added"))
    return q.join(added.hint("merge"), "query_id", "left").select("query_id", F.concat_ws(" ", "text", "added").alias("text"))

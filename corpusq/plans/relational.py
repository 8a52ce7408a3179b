"""Queries of filters, joins, windows and set operations (§2.2, 2.3, 2.5-2.7 of the survey)."""

from __future__ import annotations

from corpusq.operators import filters as P
from corpusq.operators import relational as R
from corpusq.plans.registry import query, table
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TENANTS = "CASE WHEN doc_id % 5 = 0 THEN concat('t', CAST(doc_id % 3 AS STRING)) END"
SQL_TENANTS = TENANTS.replace("STRING", "VARCHAR")


def tenanted(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "source", F.expr(TENANTS).alias("tenant_id"))


@query(f"SELECT doc_id, tenant_id FROM (SELECT doc_id, {SQL_TENANTS} AS tenant_id FROM documents) WHERE tenant_id IS NULL OR tenant_id = 't1'")
def p1_tenant_visibility(spark, d):
    return tenanted(spark, d).where(P.visible_to(F.col("tenant_id"), "t1")).select("doc_id", "tenant_id")


@query(f"SELECT doc_id, tenant_id FROM (SELECT doc_id, {SQL_TENANTS} AS tenant_id FROM documents) WHERE tenant_id = 't2'")
def p2_owner_policy(spark, d):
    return P.owned_by(tenanted(spark, d), "tenant_id", "t2").select("doc_id", "tenant_id")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000")
def p3_optional_filters(spark, d):
    return P.optional_filters(table(spark, d, "orders"), equal={"o_orderstatus": "F", "o_orderpriority": None}, least={"o_totalprice": 1000.0}, most={"o_orderdate": None}).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING list_contains(list(DISTINCT role), 'assistant')")
def p4_array_membership(spark, d):
    roles = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"), F.count("*").alias("n"))
    return P.optional_filters(roles, contains={"roles": "assistant"}).select("conv_id", "n")


@query("""WITH h AS (SELECT source AS query_id, doc_id, lang FROM documents), k AS (SELECT *, lang IN ('de', 'es') AS keep, bool_or(lang IN ('de', 'es')) OVER (PARTITION BY query_id) AS any_kept FROM h)
SELECT query_id, doc_id, lang FROM k WHERE keep OR NOT any_kept""")
def p5_court_filter_fallback(spark, d):
    hits = table(spark, d, "documents").select(F.col("source").alias("query_id"), "doc_id", "lang")
    return P.by_court(hits, ["X"], "lang", aliases={"X": ["de", "es"]})


@query("""WITH h AS (SELECT source AS query_id, doc_id, string_split(lang || ',' || upper(lang), ',') AS keywords FROM documents), k AS (SELECT *, list_contains(keywords, 'fr') AS keep FROM h)
SELECT query_id, doc_id FROM (SELECT *, bool_or(keep) OVER (PARTITION BY query_id) AS any_kept FROM k) WHERE keep OR NOT any_kept""")
def p6_domain_filter_fallback(spark, d):
    hits = table(spark, d, "documents").select(F.col("source").alias("query_id"), "doc_id", F.array("lang", F.upper("lang")).alias("keywords"))
    return P.by_domain(hits, ["FR"]).select("query_id", "doc_id")


@query("""SELECT o_orderkey, y AS case_year FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN 'n/a' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS y FROM orders)
WHERE TRY_CAST(y AS INT) IS NULL OR TRY_CAST(y AS INT) BETWEEN 1994 AND 1996""")
def p7_year_filter(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN 'n/a' ELSE CAST(year(o_orderdate) AS STRING) END AS case_year")
    return P.by_years(o, 1994, 1996)


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%EA%'")
def p9_ilike(spark, d):
    return table(spark, d, "part").where(F.col("p_name").ilike("%EA%")).select("p_partkey", "p_name")


@query(r"SELECT page_id, regexp_replace(url, '[^A-Za-z0-9:/ \-]', '', 'g') AS pattern, regexp_matches(url, '^[a-zA-Z0-9_\-]+$') AS tenant_ok FROM pages")
def p10_sanitisers(spark, d):
    return table(spark, d, "pages").select("page_id", P.safe_pattern(F.col("url")).alias("pattern"), P.valid_tenant(F.col("url")).alias("tenant_ok"))


@query("SELECT doc_id FROM documents WHERE CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN NULL ELSE lang END IS NULL OR CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN NULL ELSE lang END = ''")
def p11_missing_fields(spark, d):
    lang = F.expr("CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN NULL ELSE lang END")
    return table(spark, d, "documents").where(P.missing(lang)).select("doc_id")


@query(r"SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%' AND regexp_matches(p_name, '(?i)^[a-m]') AND p_size BETWEEN 5 AND 40 AND p_brand <> 'Brand#11' AND p_size IN (7, 9, 11, 13, 21, 33, 40)")
def p12_string_predicates(spark, d):
    return table(spark, d, "part").where("p_type LIKE '%A%' AND p_name RLIKE '(?i)^[a-m]' AND p_size BETWEEN 5 AND 40 AND p_brand <> 'Brand#11' AND p_size IN (7, 9, 11, 13, 21, 33, 40)").select("p_partkey", "p_type")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS DISTINCT FROM l.toxic")
def p13_is_distinct_from(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.where(P.changed(F.col("quality"), F.col("toxic"))).select("doc_id")


@query("""SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN NOT l_returnflag IN ('A', 'N') THEN 'returnflag' END, CASE WHEN NOT l_discount <= 0.05 THEN 'discount' END], lambda x: x IS NOT NULL) AS reasons
FROM lineitem WHERE NOT (l_returnflag IN ('A', 'N') AND l_discount <= 0.05)""")
def p14_check_constraints(spark, d):
    _, bad = P.quarantined(table(spark, d, "lineitem"), {"returnflag": F.col("l_returnflag").isin("A", "N"), "discount": F.col("l_discount") <= 0.05})
    return bad.select("l_orderkey", "l_linenumber", "reasons")


@query("SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def p15_uniqueness(spark, d):
    return P.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"])


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def p16_foreign_keys(spark, d):
    return P.orphans(table(spark, d, "labels"), table(spark, d, "documents").where("lang = 'en'"), "doc_id", "doc_id").select("doc_id")


@query("""SELECT doc_id, length(trim(text)) >= 100 AND NOT (length(trim(text)) < 300 AND contains(lower(text), 'the') AND contains(lower(text), 'of')) AS meaningful FROM documents""")
def p17_meaningful(spark, d):
    return table(spark, d, "documents").select("doc_id", P.meaningful(F.col("text"), ["the", "of"]).alias("meaningful"))


@query("SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(CAST(l.toxic AS VARCHAR), '') AS toxic, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)")
def p18_default_projection(spark, d):
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").withColumn("labelled", F.lit(True)), "doc_id", "left")
    return j.select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce(F.col("toxic").cast("string"), F.lit("")).alias("toxic"), F.coalesce("labelled", F.lit(False)).alias("labelled"))


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END, ''), source) AS name FROM documents")
def p19_first_given(spark, d):
    return table(spark, d, "documents").select("doc_id", P.first_given(F.expr("CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END"), F.col("source")).alias("name"))


@query("SELECT doc_id, lang FROM documents")
def p20_language_hook(spark, d):
    """The language filter of retrieval, off by default: all rows."""
    return P.optional_filters(table(spark, d, "documents"), equal={"lang": None}).select("doc_id", "lang")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-06-01' - 400")
def p21_recent(spark, d):
    return P.recent(table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate")), "day", "1997-06-01", 400).select("o_orderkey")


@query("SELECT doc_id, CASE WHEN length(text) > 6000 THEN 'query_too_long' WHEN trim(text) = '' THEN 'empty_document' WHEN length(text) <= 200 THEN 'not_rendered' ELSE 'completed' END AS status FROM documents")
def p22_p23_p24_status_guards(spark, d):
    n = F.length("text")
    status = F.when(n > 6000, "query_too_long").when(F.trim("text") == "", "empty_document").when(n <= 200, "not_rendered").otherwise("completed")
    return table(spark, d, "documents").select("doc_id", status.alias("status"))


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def j1_inner_equi(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return c.join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT e.user_id, e.event_id, c.c_name FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE e.event_type = 'error' OR e.value > 90")
def j2_errors_and_tracking(spark, d):
    e = table(spark, d, "events").where("event_type = 'error' OR value > 90")
    return e.join(table(spark, d, "customer"), F.col("user_id") == F.col("c_custkey")).select("user_id", "event_id", "c_name")


_PLAN = "SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS y, CAST(count(*) AS BIGINT) + 2 AS total FROM orders GROUP BY 1, 2, 3"
_GAPS = f"WITH p AS ({_PLAN}), a AS (SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS y, count(*) AS n FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1, 2, 3) SELECT p.o_orderstatus, p.o_orderpriority, p.y, total AS expected, coalesce(n, 0) AS actual, total - coalesce(n, 0) AS difference FROM p LEFT JOIN a USING (o_orderstatus, o_orderpriority, y)"


def _gaps(spark, d):
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    keys = ["o_orderstatus", "o_orderpriority", "y"]
    plan = o.groupBy(*keys).agg((F.count("*") + 2).alias("total"))
    return R.expected_and_actual(plan, o.where("o_orderkey % 3 > 0"), keys, "total")


@query(_GAPS)
def j3_expected_and_actual(spark, d):
    return _gaps(spark, d)


@query(f"SELECT * FROM ({_GAPS}) WHERE difference > 2 ORDER BY difference DESC")
def j4_gaps_only(spark, d):
    return _gaps(spark, d).where("difference > 2").orderBy(F.col("difference").desc())


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'F')")
def j5_orphan_sections(spark, d):
    return P.orphans(table(spark, d, "lineitem"), table(spark, d, "orders").where("o_orderstatus <> 'F'"), "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def j6_cases_without_sections(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3))")
def j7_two_level_semi(spark, d):
    c = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, d, "orders").join(c, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(o, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = (SELECT min(c_custkey) FROM customer WHERE c_nationkey = 5)")
def j8_scalar_subquery(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("j8_customer")
    table(spark, d, "orders").createOrReplaceTempView("j8_orders")
    return spark.sql("SELECT o_orderkey FROM j8_orders WHERE o_custkey = (SELECT min(c_custkey) FROM j8_customer WHERE c_nationkey = 5)")


@query("SELECT d.doc_id, coalesce(nullif(CASE WHEN d.doc_id % 2 = 0 THEN '' ELSE d.lang END, ''), l.q) AS lang FROM documents d LEFT JOIN (SELECT doc_id, 'q' || CAST(quality AS VARCHAR) AS q FROM labels) l USING (doc_id)")
def j9_update_from(spark, d):
    base = table(spark, d, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END AS lang")
    return R.fill_missing(base, table(spark, d, "labels").selectExpr("doc_id", "concat('q', quality) AS lang"), "doc_id", ["lang"])


def cases(spark, d):
    """Pages as cases that cite each other: page n names pages n / 2 and 3 n modulo 199."""
    return table(spark, d, "pages").selectExpr("page_id AS case_id", "array(page_id div 2, (page_id * 3) % 199) AS cited_cases", "url")


@query("""WITH e AS (SELECT DISTINCT page_id AS s, unnest([page_id // 2, (page_id * 3) % 199]) AS r FROM pages), k AS (SELECT s, r FROM e WHERE s <> r AND r IN (SELECT page_id FROM pages))
SELECT s AS source, r AS related FROM k UNION SELECT r, s FROM k""")
def j10_r14_related_cases(spark, d):
    return R.related(cases(spark, d))


@query("SELECT doc_id, source || ':' || lang AS label FROM documents CROSS JOIN (SELECT 1 AS one)")
def j11_one_row_cross(spark, d):
    """A cross join with a single row, which is a literal."""
    return table(spark, d, "documents").select("doc_id", F.concat_ws(":", "source", "lang").alias("label"))


@query("SELECT page_id, x.head AS head, length(x.head) AS n FROM pages, LATERAL (SELECT substr(html, strpos(html, '<title>') + 7, 40) AS head) x")
def j12_lateral(spark, d):
    head = F.substring(F.col("html"), F.locate("<title>", F.col("html")) + 7, F.lit(40))
    return table(spark, d, "pages").select("page_id", head.alias("head"), F.length(head).alias("n"))


@query(r"""SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, 'href="/([^"]+)"', 1))) AS links FROM pages""")
def j13_lateral_distinct(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), F.lit(1)))).alias("links"))


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def j14_lateral_top_1(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return R.top_per_key(j, ["c_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("c_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders QUALIFY pos <= 5")
def j15_lateral_top_n(spark, d):
    return R.top_per_key(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 5, "pos").select("o_custkey", "o_orderkey", "pos")


@query("""WITH k AS (SELECT DISTINCT user_id AS id FROM events WHERE user_id % 2 = 0), a AS (SELECT id, s_suppkey AS found, 'supplier' AS via FROM k JOIN supplier ON s_suppkey = id), rest AS (SELECT id FROM k WHERE id NOT IN (SELECT s_suppkey FROM supplier))
SELECT id, found FROM a UNION ALL SELECT id, s_suppkey FROM rest JOIN supplier ON s_nationkey + 1000 = id""")
def j16_lookup_with_fallback(spark, d):
    keys = table(spark, d, "events").where("user_id % 2 = 0").select(F.col("user_id").alias("id")).distinct()
    rows = table(spark, d, "supplier").selectExpr("s_suppkey AS found", "s_suppkey AS first_id", "CAST(s_nationkey AS BIGINT) + 1000 AS second_id")
    return R.keyed_lookup(keys, rows, "id", ["first_id", "second_id"]).select("id", "found")


@query("SELECT doc_id FROM documents WHERE doc_id % 5 > 0 OR doc_id % 10 = 0")
def j17_hash_skip(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    stored = docs.where("doc_id % 5 = 0").withColumn("content_hash", F.when(F.col("doc_id") % 10 == 0, "other").otherwise(F.col("content_hash")))
    return R.unchanged_skipped(docs, stored, "doc_id").select("doc_id")


_EARLIER = """WITH o AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS y, o_totalprice FROM orders)
SELECT a.o_orderkey, list(b.o_orderkey ORDER BY b.y DESC, b.o_orderkey DESC)[1:5] AS earlier FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.y < a.y GROUP BY a.o_orderkey"""


@query(_EARLIER)
def j18_w14_earlier_cases(spark, d):
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    e = R.earlier(o, ["o_custkey"], "y", "o_orderkey", "o_totalprice")
    return e.where(F.size("earlier") > 0).select("o_orderkey", F.transform("earlier", lambda x: x["id"]).alias("earlier"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS y, o_totalprice AS v FROM orders), e AS (SELECT a.o_orderkey, a.v, list(b.v ORDER BY b.y DESC, b.o_orderkey DESC)[1:5] AS p FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND b.y < a.y GROUP BY a.o_orderkey, a.v)
SELECT o_orderkey, CASE WHEN len(list_filter(p, lambda x: x IS NOT NULL)) = 0 THEN '' WHEN v > list_avg(p) THEN 'stricter' WHEN v < list_avg(p) THEN 'more_lenient' ELSE 'stable' END AS trend FROM e""")
def e20_a18_trend_direction(spark, d):
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    e = R.earlier(o, ["o_custkey"], "y", "o_orderkey", "o_totalprice")
    n = F.size("earlier")
    mean = F.try_divide(F.aggregate("earlier", F.lit(0.0), lambda a, x: a + x["value"]), n)
    v = F.col("o_totalprice")
    return e.select("o_orderkey", F.when(n == 0, "").when(v > mean, "stricter").when(v < mean, "more_lenient").otherwise("stable").alias("trend"))


@query("SELECT d.doc_id, coalesce(a.n, 0) AS n_labels, coalesce(b.n, 0) AS n_vectors FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) a USING (doc_id) LEFT JOIN (SELECT vec_id % 100 AS doc_id, count(*) AS n FROM embeddings GROUP BY 1) b USING (doc_id)")
def j20_count_maps(spark, d):
    vectors = table(spark, d, "embeddings").select((F.col("vec_id") % 100).alias("doc_id"))
    return R.counts_of(table(spark, d, "documents").select("doc_id"), "doc_id", {"n_labels": table(spark, d, "labels"), "n_vectors": vectors})


@query("SELECT a.doc_id, b.doc_id AS variant FROM documents a JOIN documents b ON a.source = b.source AND a.n_chars = b.n_chars AND a.lang <> b.lang")
def j22_language_variants(spark, d):
    a = table(spark, d, "documents").select("doc_id", "source", "n_chars", "lang")
    b = a.select(F.col("doc_id").alias("variant"), "source", "n_chars", F.col("lang").alias("other"))
    return a.join(b, ["source", "n_chars"]).where("lang <> other").select("doc_id", "variant")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def j23_unresolved_ids(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, ''), n_name) AS c_mktsegment FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def j24_detail_merge(spark, d):
    base = table(spark, d, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS c_mktsegment")
    detail = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("c_mktsegment"))
    return R.fill_missing(base, detail, "c_custkey", ["c_mktsegment"])


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def w1_latest_chunk(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    return R.latest_by_key(e, ["user_id", "event_type"], F.struct("ts", "event_id")).drop("ts")


@query("SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1")
def w2_distinct_on(spark, d):
    return R.top_per_key(table(spark, d, "documents"), ["source"], [F.col("n_chars").desc(), F.col("doc_id")]).select("source", "doc_id", "n_chars")


@query("SELECT conv_id, min_by(text, turn) AS content FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def w3_w12_first_by_type(spark, d):
    return table(spark, d, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("content"))


@query("SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents")
def w4_rank_positions(spark, d):
    w = Window.partitionBy("lang").orderBy(F.col("n_chars").desc(), "doc_id")
    return table(spark, d, "documents").select("lang", "doc_id", F.row_number().over(w).alias("rank"))


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id % 7 = 0 DESC, doc_id) AS pos FROM documents")
def w7_mentioned_first(spark, d):
    w = Window.partitionBy("source").orderBy((F.col("doc_id") % 7 == 0).desc(), "doc_id")
    return table(spark, d, "documents").select("source", "doc_id", F.row_number().over(w).alias("pos"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) = 1) QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3")
def w13_first_occurrence(spark, d):
    first = R.top_per_key(table(spark, d, "documents"), ["source", "lang"], [F.col("doc_id")])
    return R.top_per_key(first, ["source"], [F.col("doc_id")], 3).select("source", "doc_id")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderpriority LIKE '1%' ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 100")
def t1_latest_precedents(spark, d):
    return table(spark, d, "orders").where("o_orderpriority LIKE '1%'").orderBy(F.col("o_orderdate").desc_nulls_first(), "o_orderkey").limit(100).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND year(o_orderdate) = 1996 ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 20")
def t2_r13_by_court(spark, d):
    o = P.optional_filters(table(spark, d, "orders").withColumn("y", F.year("o_orderdate")), equal={"o_orderstatus": "O", "y": 1996})
    return o.orderBy(F.col("o_orderdate").desc_nulls_first(), "o_orderkey").limit(20).select("o_orderkey", "o_orderdate")


@query("SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 10")
def t3_top_k_per_query(spark, d):
    return R.top_per_key(table(spark, d, "documents"), ["source"], [F.col("n_chars").desc(), F.col("doc_id")], 10).select("source", "doc_id", "n_chars")


@query("SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id ORDER BY last_turn DESC, conv_id DESC LIMIT 25")
def t6_newest_first(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn")).orderBy(F.col("last_turn").desc(), F.col("conv_id").desc()).limit(25)


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2 ORDER BY lang, n DESC, source")
def t7_mixed_order(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")).orderBy("lang", F.col("n").desc(), "source")


@query("SELECT conv_id, turn, text FROM conversations ORDER BY conv_id, turn")
def t8_chunks_in_order(spark, d):
    return table(spark, d, "conversations").orderBy("conv_id", "turn").select("conv_id", "turn", "text")


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'part', count(*) FROM part")
def u1_a22_union_of_counts(spark, d):
    parts = [table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("orders", "lineitem", "customer", "events", "part")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query("WITH a AS (SELECT doc_id, 0 AS list_no, doc_id AS pos FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 1, -doc_id FROM documents WHERE doc_id % 6 = 0) SELECT doc_id, list_no, pos FROM a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY list_no, pos) = 1")
def u2_priority_union(spark, d):
    docs = table(spark, d, "documents")
    return R.priority_union([docs.where("doc_id % 4 = 0").selectExpr("doc_id", "doc_id AS pos"), docs.where("doc_id % 6 = 0").selectExpr("doc_id", "-doc_id AS pos")], ["doc_id"], "pos")


@query("SELECT user_id, max(value) AS score FROM events GROUP BY user_id")
def u3_max_score(spark, d):
    return R.best_score(table(spark, d, "events").select("user_id", F.col("value").alias("score")), ["user_id"])


@query("SELECT lang FROM documents INTERSECT SELECT lang FROM documents WHERE doc_id % 2 = 0")
def u5_intersection(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("lang").intersect(docs.where("doc_id % 2 = 0").select("lang"))


@query("SELECT DISTINCT source, lang FROM documents")
def u7_distinct(spark, d):
    return table(spark, d, "documents").select("source", "lang").distinct()


@query("SELECT conv_id * 1000 + turn AS id, left(c.text, 40) AS text, source, lang, round(1.0 / (turn + 1), 6) AS score FROM conversations c JOIN documents d ON d.doc_id = c.conv_id")
def j21_hit_struct(spark, d):
    """Hits with the columns of their parent as one nested value."""
    parents = table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), F.struct("source", "lang").alias("metadata"))
    j = table(spark, d, "conversations").join(parents, "conv_id")
    hit = F.struct((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.left("text", F.lit(40)).alias("text"), "metadata", (F.lit(1.0) / (F.col("turn") + 1)).alias("score"))
    return j.select(hit.alias("hit")).select("hit.id", "hit.text", "hit.metadata.source", "hit.metadata.lang", F.round("hit.score", 6).alias("score"))


@query("SELECT p_partkey, list_filter(w, lambda x, i: list_position(w, x) = i) AS unique_words, list_filter(list_filter(w, lambda x, i: list_position(w, x) = i), lambda x: NOT list_contains(['small', 'large'], x)) AS rest FROM (SELECT p_partkey, string_split(p_name || ' ' || p_type || ' ' || p_name, ' ') AS w FROM part)")
def u4_u6_ordered_sets(spark, d):
    w = F.split(F.concat_ws(" ", "p_name", "p_type", "p_name"), " ")
    return table(spark, d, "part").select("p_partkey", F.array_distinct(w).alias("unique_words"), F.array_except(w, F.array(F.lit("small"), F.lit("large"))).alias("rest"))

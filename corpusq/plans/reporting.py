"""Queries of reports (§2.4 of the survey)."""

from __future__ import annotations

from corpusq.operators import reporting as A
from corpusq.plans.registry import query, table
from pyspark.sql import functions as F


@query("SELECT o_orderstatus, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2")
def a1_counts_by_key(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS total, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year, count(*) FILTER (o_totalprice > 150000) AS precedents FROM orders GROUP BY 1, 2")
def a2_court_statistics(spark, d):
    return A.statistics(table(spark, d, "orders").withColumn("y", F.year("o_orderdate")), ["o_orderstatus", "o_orderpriority"], "y", F.col("o_totalprice") > 150000)


@query("SELECT year(o_orderdate) AS y, count(DISTINCT o_orderkey) AS parents, count(DISTINCT l_linenumber) AS children FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def a3_distinct_parent_child(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left").groupBy(F.year("o_orderdate").alias("y")).agg(F.count_distinct("o_orderkey").alias("parents"), F.count_distinct("l_linenumber").alias("children"))


@query("SELECT lang, count(*) AS total, count(*) FILTER (n_chars > 1000) AS long_text, count(*) FILTER (text <> '') AS with_text, count(*) FILTER (source IS NOT NULL) AS with_source FROM documents GROUP BY lang")
def a4_column_coverage(spark, d):
    return A.coverage(table(spark, d, "documents"), {"long_text": F.col("n_chars") > 1000, "with_text": F.col("text") != "", "with_source": F.col("source").isNotNull()}, ["lang"])


TRACKING = """SELECT o_custkey AS tracking_id, count(*) AS total, count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) AS processed, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS failed FROM orders GROUP BY o_custkey"""


def tracking(spark, d):
    """Orders of a customer as the documents of a tracking row: those of status P have failed."""
    s = F.col("o_orderstatus")
    t = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("tracking_id")).agg(F.count("*").alias("total"), F.count_if(s != "P").alias("processed"), F.count_if(s == "P").alias("failed"))
    return t.withColumn("status", F.when(F.col("failed") == 0, "completed").otherwise("partial"))


@query(f"""SELECT count(*) FILTER (failed = 0) AS completed, 0 AS in_progress, count(*) FILTER (failed > 0) AS partial, 0 AS pending, sum(total) AS documents, sum(failed) AS failed, sum(greatest(0, total - processed)) AS remaining FROM ({TRACKING})""")
def a5_health_summary(spark, d):
    return A.health(tracking(spark, d))


@query("SELECT user_id, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS types, count(*) AS n FROM events GROUP BY user_id")
def a6_string_agg_distinct(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(A.distinct_list("event_type").alias("types"), F.count("*").alias("n"))


@query(f"SELECT tracking_id, round(processed * 100.0 / nullif(total, 0), 2) AS done, CASE WHEN total > 4 THEN round(failed * 100.0 / total, 1) END AS bad FROM ({TRACKING})")
def a7_completion_percent(spark, d):
    return tracking(spark, d).select("tracking_id", A.percent(F.col("processed"), F.col("total"), 2).alias("done"), F.when(F.col("total") > 4, A.percent(F.col("failed"), F.col("total"), 1)).alias("bad"))


@query("SELECT max(year(o_orderdate)) AS last_year FROM orders WHERE o_orderstatus = 'F'")
def a8_last_ingested(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").agg(F.max(F.year("o_orderdate")).alias("last_year"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def a9_having(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


@query("SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND year(l_shipdate) = 1994")
def a10_exact_count(spark, d):
    return table(spark, d, "lineitem").where("l_returnflag = 'R' AND year(l_shipdate) = 1994").agg(F.count("*").alias("n"))


@query("SELECT conv_id, count(*) AS chunks, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def a11_document_stats(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("chunks"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query("SELECT DISTINCT trim(w) AS word FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE trim(w) <> ''")
def a12_distinct_elements(spark, d):
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).select(F.trim("w").alias("word")).where("word <> ''").distinct()


@query(r"""SELECT doc_id, term, n FROM (SELECT doc_id, term, len(list_filter(string_split_regex(text, '[^\p{L}]+'), lambda w: w = term)) AS n FROM documents, (SELECT unnest(['the', 'of', 'der', 'que', 'la']) AS term)) WHERE n > 0""")
def a13_term_counts(spark, d):
    return A.term_counts(table(spark, d, "documents"), "doc_id", "text", ["the", "of", "der", "que", "la"])


@query("""WITH s AS (SELECT o_orderkey, year(o_orderdate) AS y, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS n FROM orders)
SELECT y, count(*) AS total, count(*) FILTER (n = 0) AS without_lines FROM s GROUP BY y""")
def a14_incomplete_report(spark, d):
    li = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    s = table(spark, d, "orders").join(li, "o_orderkey", "left")
    return A.coverage(s.withColumn("y", F.year("o_orderdate")), {"without_lines": F.col("n").isNull()}, ["y"])


@query("SELECT source, count(*) AS total, count(*) FILTER (n_chars < 400) AS n_empty, list_sort(list(doc_id) FILTER (n_chars < 400)) AS ids FROM documents GROUP BY source HAVING n_empty > 0")
def a15_empty_text_report(spark, d):
    short = F.col("n_chars") < 400
    r = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("total"), F.count_if(short).alias("n_empty"), F.array_sort(F.collect_list(F.when(short, F.col("doc_id")))).alias("ids"))
    return r.where("n_empty > 0")


@query(r"SELECT regexp_extract(url, '^https?://([^/]+)/', 1) AS host, regexp_extract(url, '/([a-z]{2})/', 1) AS lang, count(*) AS n FROM pages GROUP BY 1, 2")
def a16_errors_by_parsed_key(spark, d):
    return table(spark, d, "pages").groupBy(F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("host"), F.regexp_extract("url", "/([a-z]{2})/", 1).alias("lang")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS successful, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus = 'F') AS skipped, round(count(*) FILTER (o_orderstatus = 'O') * 100.0 / nullif(count(*), 0), 2) AS success_rate FROM orders")
def a17_outcome_summary(spark, d):
    s = F.when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderstatus") == "P", "failed").otherwise("skipped")
    return A.outcome(table(spark, d, "orders").withColumn("status", s))


@query("SELECT year(l_shipdate) AS y, count(*) AS n FROM lineitem GROUP BY 1")
def a19_documents_per_year(spark, d):
    return table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("y")).agg(F.count("*").alias("n"))


@query("SELECT lang, count(DISTINCT source) AS n FROM documents GROUP BY lang")
def a20_glossary_size(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count_distinct("source").alias("n"))


@query("SELECT lang, count(*) FILTER (contains(text, 'password')) AS extracted, count(*) FILTER (NOT contains(text, 'password')) AS empty, round(avg(length(text)), 4) AS mean_length FROM documents GROUP BY lang")
def a21_extraction_quality(spark, d):
    hit = F.contains("text", F.lit("password"))
    return table(spark, d, "documents").groupBy("lang").agg(F.count_if(hit).alias("extracted"), F.count_if(~hit).alias("empty"), F.round(F.avg(F.length("text")), 4).alias("mean_length"))

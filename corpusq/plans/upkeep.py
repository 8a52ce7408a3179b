"""Queries of sinks, maintenance, tracking and streams (§2.1, 2.11 of the survey)."""

from __future__ import annotations

from corpusq.operators import filters as P
from corpusq.operators import relational as R
from corpusq.operators import upkeep as K
from corpusq.plans.registry import query, table
from corpusq.plans.reporting import tracking
from corpusq.sources import sinks as I
from corpusq.sources.index import TextIndex
from corpusq.sources.keyed import KeyedTable, counted, recounted, reindexed
from corpusq.sources.shared import shared_path as _folder
from corpusq.sources.shared import written
from corpusq.streaming import jobs as X
from pyspark.sql import functions as F


def _keyed(spark, rows, keys, by=None):
    """A stored table of the rows, as a change finds it."""
    return KeyedTable.create(spark, _folder(spark, "keyed"), rows, keys, by, buckets=8)


@query("SELECT doc_id, lang FROM documents WHERE lang = 'de' AND n_chars BETWEEN 500 AND 3000")
def s1_s2_scan(spark, d):
    return table(spark, d, "documents").where("lang = 'de' AND n_chars BETWEEN 500 AND 3000").select("doc_id", "lang")


@query("SELECT doc_id AS case_id, lang AS court_code, CAST(1990 + doc_id % 30 AS INT) AS case_year FROM documents")
def s3_s4_s5_json_year_files(spark, d):
    """Documents written as year files by court, type and year, and read back by their layout."""
    from corpusq.sources.readers import write_year_files

    docs = table(spark, d, "documents").selectExpr("doc_id AS case_id", "lang AS court_code", "CASE WHEN doc_id % 2 = 0 THEN 'precedent' ELSE 'x' END AS decision_type", "CAST(1990 + doc_id % 30 AS INT) AS case_year")
    path = _folder(spark, "year-files")
    write_year_files(docs, path)
    return spark.read.schema("case_id bigint, court_code string, decision_type string, case_year int, court string, subtype string, year int").json(path).select("case_id", "court_code", "case_year")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND length(trim(text)) >= 100 THEN 'new ' || text ELSE text END AS text FROM documents")
def s6_s17_merged_scrape(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    new = docs.where("doc_id % 2 = 0").withColumn("text", F.concat(F.lit("new "), "text"))
    return I.merged_scrape(docs, new, "doc_id", "text", P.meaningful(F.substring("text", 5, 10**9), ["no such words"]))


@query("SELECT doc_id, text FROM documents")
def s7_text_files(spark, d):
    """Texts as bytes in UTF-8 or, where every character allows it, Latin-1, decoded again."""
    from corpusq.sources.readers import text_of

    docs = table(spark, d, "documents")
    latin = ~F.col("text").rlike(r"[^\x00-\xFF]") & (F.col("doc_id") % 2 == 0)
    data = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return docs.select("doc_id", text_of(data).alias("text"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'U' ELSE o_orderstatus END AS s FROM orders UNION ALL SELECT -o_orderkey, 'N' FROM orders WHERE o_orderkey % 50 = 0 AND o_orderkey > 0")
def s11_upsert(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey", "o_orderstatus AS s")
    new = o.where("o_orderkey % 5 = 0").withColumn("s", F.lit("U")).unionByName(o.where("o_orderkey % 50 = 0 AND o_orderkey > 0").selectExpr("-o_orderkey AS o_orderkey", "'N' AS s"))
    return _keyed(spark, o, ["o_orderkey"]).upsert(new, F.col("s")).read()


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'new' ELSE l_returnflag END AS f FROM lineitem")
def s12_composite_upsert(spark, d):
    li = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_returnflag AS f")
    return I.upserted(li, li.where("l_linenumber = 1").withColumn("f", F.lit("new")), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 4 > 0 UNION ALL SELECT o_orderkey, 99 FROM orders WHERE o_orderkey % 4 = 0")
def s13_children_replaced(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    new = table(spark, d, "orders").where("o_orderkey % 4 = 0").selectExpr("o_orderkey AS l_orderkey", "99 AS l_linenumber")
    return _keyed(spark, li, ["l_orderkey", "l_linenumber"], ["l_orderkey"]).replace_children(new).read()


@query("SELECT doc_id, CASE WHEN doc_id NOT IN (SELECT doc_id FROM labels) THEN 'insert' WHEN doc_id % 3 = 0 THEN 'replace' ELSE 'skip' END AS action FROM documents")
def s14_ingest_plan(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 3 = 0 THEN 'MODIFIED' ELSE 'NEW' END AS status")
    return I.ingest_plan(docs, table(spark, d, "labels"), "doc_id").select("doc_id", "action")


@query("SELECT doc_id FROM documents WHERE trim(text) <> '' AND doc_id % 3 > 0")
def s15_export(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("name"), "text", F.sha2("text", 256).alias("content_hash"))
    return I.export_new(docs, docs.where("doc_id % 3 = 0")).select("doc_id")


@query("SELECT count(*) FILTER (e AND doc_id % 2 = 0) AS filled, count(*) FILTER (e AND doc_id % 2 > 0) AS failed FROM (SELECT doc_id, doc_id % 5 = 0 AS e FROM documents)")
def s18_fill_empty(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS text", "text AS fetched")
    new = docs.where("doc_id % 2 = 0").select("doc_id", F.col("fetched").alias("text"))
    after = R.fill_missing(docs.select("doc_id", "text"), new, "doc_id", ["text"]).join(docs.select("doc_id", (F.col("text") == "").alias("was")), "doc_id")
    empty = F.coalesce(F.col("text"), F.lit("")) == ""
    return after.agg(F.count_if(F.col("was") & ~empty).alias("filled"), F.count_if(F.col("was") & empty).alias("failed"))


def _scope(spark, d):
    tables = {t: table(spark, d, t) for t in ("orders", "lineitem")}
    gone = tables["orders"].where("year(o_orderdate) = 1995")
    return tables, gone, {"orders": ("o_orderkey", "o_orderkey"), "lineitem": ("l_orderkey", "o_orderkey")}


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1995)")
def d1_cascaded_delete(spark, d):
    """Orders of a year go from both tables; only buckets that hold some are written."""
    gone = table(spark, d, "orders").where("year(o_orderdate) = 1995").select(F.col("o_orderkey").alias("l_orderkey"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return _keyed(spark, li, ["l_orderkey", "l_linenumber"], ["l_orderkey"]).delete(gone, ["l_orderkey"]).read()


_AFTER = "SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 11 > 0 UNION ALL SELECT -c_custkey, c_nationkey, 5.0 FROM customer WHERE c_custkey % 100 = 0 AND c_custkey > 0"


@query(f"SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 4) AS c_acctbal FROM ({_AFTER}) GROUP BY 1")
def d9_kept_counts(spark, d):
    """Numbers and balances of customers by nation, kept up by what an update, an insert and a delete have changed."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    stored = _keyed(spark, c, ["c_custkey"])
    counts = counted(stored, ["c_nationkey"], ["c_acctbal"])
    new = c.where("c_custkey % 7 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1).unionByName(c.where("c_custkey % 100 = 0 AND c_custkey > 0").selectExpr("-c_custkey AS c_custkey", "c_nationkey", "5.0D AS c_acctbal"))
    counts = written(counts, "kept-counts")
    counts = recounted(counts, stored.upsert(new).changes(), ["c_nationkey"], ["c_acctbal"])
    counts = recounted(counts, stored.delete(c.where("c_custkey % 11 = 0")).changes(), ["c_nationkey"], ["c_acctbal"])
    return counts.select("c_nationkey", "n", F.round("c_acctbal", 4).alias("c_acctbal"))


@query(r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN text || ' revised ' || source ELSE text END AS text FROM documents WHERE doc_id % 6 > 0)
SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM t) GROUP BY 1""")
def d7_x1_kept_index(spark, d):
    """The dictionary of an index that follows a stored table: some texts are revised, some documents deleted; no other text is
    read again."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    stored = _keyed(spark, docs, ["doc_id"])
    index = TextIndex(spark, _folder(spark, "index")).add(docs, "doc_id", distinct_ids=True)
    revised = table(spark, d, "documents").where("doc_id % 4 = 1").select("doc_id", F.concat_ws(" revised ", "text", "source").alias("text"))
    reindexed(index, stored.upsert(revised).changes(), "doc_id", "text")
    return reindexed(index, stored.delete(docs.where("doc_id % 6 = 0")).changes(), "doc_id", "text").terms()


@query("SELECT 'orders' AS name, count(*) AS n FROM orders WHERE year(o_orderdate) = 1995 UNION ALL SELECT 'lineitem', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) = 1995")
def d2_delete_preview(spark, d):
    return I.cascade_counts(*_scope(spark, d))


@query("SELECT doc_id, CASE WHEN doc_id % 4 <> 1 THEN sha256(text) END AS content_hash FROM documents")
def d3_reset_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 1, F.sha2("text", 256)).alias("content_hash"))


@query("SELECT d.conv_id, coalesce(nullif(CASE WHEN d.conv_id % 2 = 0 THEN '' ELSE 'kept' END, ''), f.text) AS judgment FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1) f USING (conv_id)")
def d4_backfill_from_sections(spark, d):
    c = table(spark, d, "conversations")
    base = c.select("conv_id").distinct().withColumn("judgment", F.when(F.col("conv_id") % 2 == 0, "").otherwise("kept"))
    first = c.where("role = 'assistant'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("judgment"))
    return R.fill_missing(base, first, "conv_id", ["judgment"])


@query(r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN left(chr(10) || text || chr(10) || '. Ratkaisevaa oli ' || source || ' asiassa. Äänestys 4-1' || chr(10) || 'Tuomiolauselma' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'Valitus hylätään' ELSE 'Asia palautetaan' END || chr(10) || CASE WHEN doc_id % 4 IN (1, 2) THEN 'Eri mieltä: ' || lang WHEN doc_id % 4 = 3 THEN '(Ään.)' ELSE '' END, 2000) ELSE source END AS background, CASE WHEN doc_id % 3 = 0 THEN 'dismissed' WHEN doc_id % 3 = 1 THEN 'remanded' ELSE 'old' END AS outcome, doc_id % 4 > 0 AS dissent, CASE doc_id % 4 WHEN 1 THEN 'Eri mieltä: ' || lang WHEN 2 THEN 'own' WHEN 3 THEN '' ELSE '' END AS dissent_text,
CASE WHEN doc_id % 5 = 0 THEN 'kept' ELSE '4-1' END AS vote, 'Ratkaisevaa oli ' || source || ' asiassa.' AS facts FROM documents""")
def d5_d6_backfill_from_text(spark, d):
    """Background, outcome, dissent, vote and facts of decisions, filled where they are empty."""
    from corpusq.functions.scalars import outcome
    from corpusq.operators import extract as E

    tail = "CASE doc_id % 4 WHEN 1 THEN concat('Eri mieltä: ', lang) WHEN 2 THEN concat('Eri mieltä: ', lang) WHEN 3 THEN '(Ään.)' ELSE '' END"
    made = f"concat('Asian tausta\n', text, '\n. Ratkaisevaa oli ', source, ' asiassa. Äänestys 4-1\nTuomiolauselma\n', CASE WHEN doc_id % 3 = 0 THEN 'Valitus hylätään' ELSE 'Asia palautetaan' END, '\n', {tail}) AS full_text"
    stored = ["CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END AS background", "CASE WHEN doc_id % 3 = 2 THEN 'old' ELSE '' END AS outcome", "doc_id % 4 = 2 AS dissent", "CASE WHEN doc_id % 4 = 2 THEN 'own' ELSE '' END AS dissent_text", "CASE WHEN doc_id % 5 = 0 THEN 'kept' END AS vote", "'' AS facts"]
    docs = table(spark, d, "documents").selectExpr("doc_id", made, *stored)
    t = F.col("full_text")
    filled = K.backfilled(docs, {"background": E.background(t), "outcome": outcome(t), "vote": E.vote(t)["strength"], "facts": E.distinctive_facts(t)})
    filled = filled.withColumn("x", E.dissent(t, F.col("dissent"), F.col("dissent_text")))
    return filled.select("doc_id", "background", "outcome", F.col("x.flag").alias("dissent"), F.col("x.text").alias("dissent_text"), "vote", "facts")


@query("SELECT c_custkey, concat_ws(' ', c_name, c_mktsegment) AS doc FROM customer WHERE c_custkey % 3 = 0")
def d7_refresh_changed(spark, d):
    """Search texts that differ from those stored; those of every third customer are out of date."""
    doc = F.concat_ws(" ", "c_name", "c_mktsegment")
    c = table(spark, d, "customer").select("c_custkey", doc.alias("doc"), F.when(F.col("c_custkey") % 3 == 0, "old").otherwise(doc).alias("stored"))
    return c.where(P.changed(F.col("doc"), F.col("stored"))).select("c_custkey", "doc")


@query("SELECT p_partkey, CASE WHEN starts_with(p_name, 'a') THEN [p_brand, p_type] ELSE [p_brand || ', ' || p_type] END AS words FROM part")
def d8_keyword_arrays(spark, d):
    from corpusq.functions.scalars import split_keywords

    words = F.array(F.concat_ws(", ", "p_brand", "p_type"))
    return table(spark, d, "part").select("p_partkey", F.when(F.col("p_name").startswith("a"), split_keywords(words)).otherwise(words).alias("words"))


@query("SELECT conv_id, turn, length(text) AS content_length, len(string_split(text, ' ')) AS n_tokens FROM conversations")
def d9_derived_columns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("content_length"), F.size(F.split("text", " ")).alias("n_tokens"))


_EVENTS = "SELECT user_id AS tracking_id, count(*) FILTER (event_type <> 'error' AND value > 30) AS processed, count(*) FILTER (NOT (event_type <> 'error' AND value > 30)) AS failed FROM events GROUP BY 1"


@query(f"""SELECT t.tracking_id, total, coalesce(e.processed, 0) AS processed, coalesce(e.failed, 0) AS failed, greatest(0, total - coalesce(e.processed, 0)) AS remaining,
CASE WHEN coalesce(e.processed + e.failed, 0) = 0 THEN 'pending' WHEN e.processed + e.failed < total THEN 'in_progress' WHEN e.failed = 0 THEN 'completed' ELSE 'partial' END AS status
FROM (SELECT o_custkey AS tracking_id, count(*) AS total FROM orders GROUP BY 1) t LEFT JOIN ({_EVENTS}) e USING (tracking_id)""")
def k1_k4_progress(spark, d):
    log = table(spark, d, "events").selectExpr("user_id AS tracking_id", "CASE WHEN event_type <> 'error' AND value > 30 THEN 'processed' ELSE 'failed' END AS kind", "ts AS at")
    return K.progress(tracking(spark, d).select("tracking_id", "total"), log).select("tracking_id", "total", "processed", "failed", "remaining", "status")


@query("SELECT c_custkey AS tracking_id, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS stored FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'P') = 0)")
def k2_resume(spark, d):
    work = table(spark, d, "customer").select(F.col("c_custkey").alias("tracking_id"))
    return K.resume(work, tracking(spark, d), table(spark, d, "events").select(F.col("user_id").alias("tracking_id")), ["tracking_id"])


@query("""WITH t AS (SELECT o_custkey AS id, count(*) FILTER (o_orderstatus <> 'P') AS processed FROM orders GROUP BY 1), e AS (SELECT user_id AS id, count(*) AS stored FROM events GROUP BY 1)
SELECT coalesce(t.id, e.id) AS tracking_id, coalesce(processed, 0) AS processed, coalesce(stored, 0) AS stored, CASE WHEN coalesce(processed, 0) = coalesce(stored, 0) THEN 'ok' WHEN coalesce(processed, 0) > coalesce(stored, 0) THEN 'missing' ELSE 'untracked' END AS state FROM t FULL JOIN e ON t.id = e.id""")
def k3_reconcile(spark, d):
    return K.reconciled(tracking(spark, d).select("tracking_id", "processed"), table(spark, d, "events").select(F.col("user_id").alias("tracking_id")), ["tracking_id"])


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'empty_full_text' WHEN doc_id % 5 = 1 THEN 'storage_error' WHEN doc_id % 5 = 2 THEN 'fetch_failed' WHEN doc_id % 5 = 3 THEN 'extraction_error' END AS reason FROM documents WHERE doc_id % 5 < 4")
def k5_f46_error_reasons(spark, d):
    k = F.col("doc_id") % 5
    error = F.when(k == 1, "insert refused").when(k == 2, "HTTP 500").when(k == 3, "bad header")
    docs = table(spark, d, "documents").select("doc_id", K.failure_reason(F.when(k != 0, F.concat(F.lit("x"), "text")), error).alias("reason"))
    return docs.where("reason IS NOT NULL")


@query("""WITH n AS (SELECT user_id, count(*) AS c FROM events WHERE event_type = 'error' OR value < 10 GROUP BY 1), s AS (SELECT user_id, 2 AS r FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 3 = 0))
SELECT user_id, r + c AS retry_count, r + c < 5 AS retry FROM (SELECT coalesce(n.user_id, s.user_id) AS user_id, CASE WHEN s.user_id IS NOT NULL THEN 2 ELSE -1 END AS r, coalesce(c, 0) AS c FROM n FULL JOIN s ON n.user_id = s.user_id) WHERE user_id % 7 > 0""")
def k6_failed_documents(spark, d):
    e = table(spark, d, "events")
    stored = e.where("user_id % 3 = 0").select("user_id", F.lit(2).alias("retry_count")).distinct()
    return K.failures(stored, e.where("event_type = 'error' OR value < 10").select("user_id"), e.where("user_id % 7 = 0"), "user_id", 5)


@query("SELECT o_custkey, max(year(o_orderdate)) AS resume_after FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def k7_resume_page(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max(F.year("o_orderdate")).alias("resume_after"))


@query("SELECT y AS year, s AS subtype FROM (SELECT unnest(range(min(year(o_orderdate)), max(year(o_orderdate)) + 1)) AS y FROM orders), (SELECT DISTINCT o_orderstatus AS s FROM orders)")
def k8_work_list(spark, d):
    first, last, kinds = table(spark, d, "orders").agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate")), F.collect_set("o_orderstatus")).first()
    return K.work_list(spark, first, last, sorted(kinds))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'already_exists' WHEN n_chars < 300 THEN 'no_chunks' ELSE 'completed' END AS status FROM documents")
def k9_tenant_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("content_hash"))
    changed = R.unchanged_skipped(docs, docs.where("doc_id % 4 = 0"), "doc_id").select("doc_id", F.lit(True).alias("new"))
    status = F.when(F.col("new").isNull(), "already_exists").when(F.col("n_chars") < 300, "no_chunks").otherwise("completed")
    return docs.join(changed, "doc_id", "left").select("doc_id", status.alias("status"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE n_chars > 200")
def x1_x4_incremental_ingest(spark, d):
    """Documents as a stream of files into a table that is a log; short ones are its errors."""
    base = _folder(spark, "stream")
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    docs.repartition(3).write.parquet(f"{base}/in")
    stream = X.landed(spark, f"{base}/in", docs.schema, files=1)
    q = X.ingest(stream, f"{base}/table", f"{base}/errors", f"{base}/checkpoint", "doc_id", lambda b: (b.where("n_chars > 200"), b.where("n_chars <= 200")))
    q.awaitTermination()
    X.compacted(spark, f"{base}/table", "doc_id", most=2)
    return X.current(spark, f"{base}/table", "doc_id")


def _stream(spark, d, make, keys: str):
    """What a streaming query leaves in a table of its own after all events have come, in files of a third each."""
    base = _folder(spark, "events")
    events = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    events.repartition(3).write.parquet(f"{base}/in")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    made = make(X.landed(spark, f"{base}/in", events.schema, files=1))
    made.writeStream.outputMode(keys).foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema.add("batch", "integer")).parquet(f"{base}/out")


@query("SELECT DISTINCT user_id, event_type FROM events")
def x2_streaming_unique(spark, d):
    return _stream(spark, d, lambda s: X.unique(s.select("user_id", "event_type"), ["user_id", "event_type"]), "append").select("user_id", "event_type")


@query("SELECT user_id, count(*) FILTER (value > 30) AS processed, count(*) FILTER (value <= 30) AS failed FROM events GROUP BY 1")
def x3_streaming_counters(spark, d):
    made = _stream(spark, d, lambda s: X.counters(s.withColumn("kind", F.when(F.col("value") > 30, "processed").otherwise("failed")), "user_id", "kind"), "update")
    return made.groupBy("user_id").agg(F.max_by("processed", "batch").alias("processed"), F.max_by("failed", "batch").alias("failed"))

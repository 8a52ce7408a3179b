"""Queries of column functions (§2.8 of the survey) over texts made from the tables' rows."""

from __future__ import annotations

from corpusq.functions import scalars as S
from corpusq.plans.registry import query, table
from pyspark.sql import functions as F


def _made(spark, d, expression: str, name: str = "documents", key: str = "doc_id", more: str = ""):
    return table(spark, d, name).selectExpr(key, f"{expression} AS t", *([more] if more else []))


@query("SELECT doc_id, substr(text, strpos(text, '. ') + 2, 40) AS a, left(text, 12) AS b, split_part(text, ' ', 2) AS c, trim(left(text, 8)) AS e, length(text) AS n FROM documents")
def f1_substring_functions(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.substring(t, F.locate(". ", t) + 2, F.lit(40)).alias("a"), F.left(t, F.lit(12)).alias("b"), F.split_part(t, F.lit(" "), F.lit(2)).alias("c"), F.trim(F.left(t, F.lit(8))).alias("e"), F.length(t).alias("n"))


@query("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS s, least(o_totalprice, 1000.0) AS low, greatest(o_totalprice, 1000.0) AS high, CASE WHEN o_totalprice > 5000 THEN 'a' ELSE 'b' END AS k FROM orders")
def f2_conditionals(spark, d):
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.nullif("o_orderstatus", F.lit("F")), F.lit("none")).alias("s"), F.least(p, F.lit(1000.0)).alias("low"), F.greatest(p, F.lit(1000.0)).alias("high"), F.when(p > 5000, "a").otherwise("b").alias("k"))


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS first, len(string_split(p_name, ' ')) AS n, array_to_string(string_split(p_name, ' '), '|') AS joined FROM part")
def f3_array_functions(spark, d):
    a = F.split("p_name", " ")
    return table(spark, d, "part").select("p_partkey", F.element_at(a, 1).alias("first"), F.size(a).alias("n"), F.array_join(a, "|").alias("joined"))


@query(r"SELECT page_id, regexp_extract_all(html, '<h1>([^<]*)</h1>', 1) AS heads FROM pages")
def f4_regexp_matches(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract_all("html", F.lit("<h1>([^<]*)</h1>"), F.lit(1)).alias("heads"))


@query("SELECT c_custkey, concat_ws(' ', c_name, c_mktsegment, n_name) AS doc FROM customer JOIN nation ON c_nationkey = n_nationkey")
def f5_search_text(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select("c_custkey", S.search_text(F.col("c_name"), F.col("c_mktsegment"), F.col("n_name")).alias("doc"))


_DATES = "CASE o_orderkey % 6 WHEN 0 THEN date_format(o_orderdate, 'd.M.yyyy') WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 2 THEN concat(' 31.2.', o_orderkey % 90 + 10) WHEN 3 THEN '-' WHEN 4 THEN '' ELSE 'May 1' END"
_SQL_DATES = "CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%-d.%-m.%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN ' 31.2.' || CAST(o_orderkey % 90 + 10 AS VARCHAR) WHEN 3 THEN '-' WHEN 4 THEN '' ELSE 'May 1' END"


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1) THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 6 = 2 THEN CAST(o_orderkey % 90 + 10 + CASE WHEN o_orderkey % 90 + 10 <= 30 THEN 2000 ELSE 1900 END AS VARCHAR) || '-02-31' END AS iso,
CASE WHEN o_orderkey % 6 IN (0, 1) THEN true ELSE false END AS valid FROM (SELECT o_orderkey, o_orderdate, {_SQL_DATES} AS t FROM orders)""")
def f6_date_normaliser(spark, d):
    iso = S.iso_date(F.col("t"))
    return _made(spark, d, _DATES, "orders", "o_orderkey").select("o_orderkey", iso.alias("iso"), F.coalesce(S.valid_date(iso), F.lit(False)).alias("valid"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE t END AS t FROM (SELECT o_orderkey, o_orderdate, {_SQL_DATES} AS t FROM orders)")
def f7_finnish_date(spark, d):
    return _made(spark, d, _DATES, "orders", "o_orderkey").select("o_orderkey", S.finnish_date(F.col("t")).alias("t"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders")
def f8_english_date(spark, d):
    t = _made(spark, d, "CASE WHEN o_orderkey % 3 > 0 THEN concat('Issued ', date_format(o_orderdate, 'MMMM d, yyyy')) ELSE 'May' END", "orders", "o_orderkey")
    return t.select("o_orderkey", S.english_date(F.col("t")).alias("iso"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 100 >= 50 THEN 1900 ELSE 2000 END + o_orderkey % 100 AS y FROM orders")
def f9_two_digit_years(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.full_year(F.col("o_orderkey") % 100, 50).alias("y"))


_IDS = "CASE WHEN doc_id % 3 = 0 THEN concat('KKO:', 1980 + doc_id % 40, ':', doc_id % 97) WHEN doc_id % 3 = 1 THEN concat('kho ', 1980 + doc_id % 40, '-II-', doc_id % 97) ELSE concat('C-', doc_id, '/', 10 + doc_id % 85) END"


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'KKO' WHEN 1 THEN 'KHO' END AS court, CASE WHEN doc_id % 3 < 2 THEN 1980 + doc_id % 40 END AS year, CASE WHEN doc_id % 3 < 2 THEN doc_id % 97 END AS number FROM documents")
def f10_id_parts(spark, d):
    return _made(spark, d, _IDS).select("doc_id", S.id_parts(F.col("t")).alias("p")).select("doc_id", "p.*")


@query("""SELECT doc_id, CASE WHEN k = 0 THEN least(a, b) WHEN k = 1 AND a BETWEEN 1900 AND 2100 THEN a WHEN k = 2 AND a BETWEEN 1900 AND 2100 THEN a WHEN k = 3 THEN least(a, b) END AS first,
CASE WHEN k = 0 THEN greatest(a, b) WHEN k = 1 AND a BETWEEN 1900 AND 2100 THEN a WHEN k = 2 AND a BETWEEN 1900 AND 2100 THEN a WHEN k = 3 THEN greatest(a, b) END AS last
FROM (SELECT doc_id, doc_id % 5 AS k, 1890 + doc_id % 230 AS a, 1900 + doc_id % 120 AS b FROM documents)""")
def f11_year_range(spark, d):
    t = _made(spark, d, "CASE doc_id % 5 WHEN 0 THEN concat('from ', 1890 + doc_id % 230, ' TO ', 1900 + doc_id % 120) WHEN 1 THEN concat('cases in ', 1890 + doc_id % 230) WHEN 2 THEN concat(1890 + doc_id % 230, '') WHEN 3 THEN concat('x ', 1890 + doc_id % 230, ' - ', 1900 + doc_id % 120, ' y') ELSE '2024-76' END")
    return t.select("doc_id", S.year_range(F.col("t")).alias("r")).select("doc_id", "r.*")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1950 + doc_id % 60 END AS first, CASE WHEN doc_id % 2 = 0 THEN 1950 + doc_id % 60 END AS last FROM documents")
def f12_year_reply(spark, d):
    t = _made(spark, d, "CASE WHEN doc_id % 2 = 0 THEN concat('', 1950 + doc_id % 60) ELSE ' Kaikki ' END")
    return t.select("doc_id", S.year_reply(F.col("t")).alias("r")).select("doc_id", "r.*")


@query("""SELECT doc_id, [ 'KKO:' || CAST(1990 + doc_id % 30 AS VARCHAR) || ':' || CAST(doc_id % 90 AS VARCHAR), 'KHO:' || CAST(1970 + doc_id % 9 AS VARCHAR) || ':' || CAST(doc_id % 50 AS VARCHAR),
 'KHO:' || CAST(1970 + doc_id % 9 AS VARCHAR) || '-II-' || CAST(doc_id % 50 AS VARCHAR), 'ECLI:EU:C:2019:' || CAST(doc_id AS VARCHAR), 'C-' || CAST(doc_id AS VARCHAR) || '/18', CAST(doc_id AS VARCHAR) || '/06' ] AS ids FROM documents""")
def f13_case_ids(spark, d):
    t = _made(spark, d, "concat('Application no. ', doc_id, '/06; C-', doc_id, '/18 and ECLI:EU:C:2019:', doc_id, ', kko ', 1990 + doc_id % 30, ' : ', doc_id % 90, '; KHO:', 1970 + doc_id % 9, '-II-', doc_id % 50, ', C-', doc_id, '/18')")
    return t.select("doc_id", S.case_ids(F.col("t")).alias("ids"))


_EU = "CASE doc_id % 5 WHEN 0 THEN concat('C-', doc_id, '/', 10 + doc_id % 85) WHEN 1 THEN concat('case T-', doc_id, '/2011') WHEN 2 THEN concat('ECLI:EU:T:2012:', doc_id) WHEN 3 THEN concat('Application No ', doc_id, '/98') ELSE 'none' END"


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'cjeu' WHEN 1 THEN 'general_court' WHEN 2 THEN 'general_court' WHEN 3 THEN 'echr' END AS court_type, CASE doc_id % 5 WHEN 0 THEN 'C-' || CAST(doc_id AS VARCHAR) || '/' || CAST(10 + doc_id % 85 AS VARCHAR)
 WHEN 1 THEN 'T-' || CAST(doc_id AS VARCHAR) || '/2011' WHEN 2 THEN 'ECLI:EU:T:2012:' || CAST(doc_id AS VARCHAR) WHEN 3 THEN CAST(doc_id AS VARCHAR) || '/98' END AS case_number, CASE WHEN doc_id % 5 = 2 THEN 'ECLI:EU:T:2012:' || CAST(doc_id AS VARCHAR) END AS ecli FROM documents""")
def f14_eu_case(spark, d):
    return _made(spark, d, _EU).select("doc_id", S.eu_case(F.col("t")).alias("c")).select("doc_id", "c.court_type", "c.case_number", "c.ecli")


@query("""SELECT doc_id, '6' || CAST(y AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN 'CJ' ELSE 'TJ' END || CASE WHEN doc_id < 1000 THEN lpad(CAST(doc_id AS VARCHAR), 4, '0') ELSE CAST(doc_id AS VARCHAR) END AS celex
FROM (SELECT doc_id, CASE WHEN doc_id % 100 < 10 THEN NULL WHEN doc_id % 100 >= 50 THEN 1900 + doc_id % 100 ELSE 2000 + doc_id % 100 END AS y FROM documents)""")
def f15_celex(spark, d):
    return _made(spark, d, "concat(CASE WHEN doc_id % 2 = 0 THEN 'C-' ELSE 'T-' END, doc_id, '/', doc_id % 100)").select("doc_id", S.celex(F.col("t")).alias("celex"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:6' || CAST(doc_id AS VARCHAR) WHEN 1 THEN 'https://curia.europa.eu/juris/liste.jsf?num=' || CAST(doc_id AS VARCHAR) || '&language=en'
 WHEN 2 THEN 'https://hudoc.echr.coe.int/eng?i=' || CAST(doc_id AS VARCHAR) ELSE '' END AS url FROM documents""")
def f16_canonical_urls(spark, d):
    k, number = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    court = F.when(k < 2, "cjeu").when(k == 2, "echr").otherwise("district")
    return table(spark, d, "documents").select("doc_id", S.eu_url(court, number, F.when(k == 0, F.concat(F.lit("6"), number))).alias("url"))


@query("SELECT doc_id, 'act' AS category, 'statute' AS type, 1990 + doc_id % 30 AS year, CAST(doc_id AS VARCHAR) AS number, lang AS language FROM documents")
def f17_statute_uri(spark, d):
    t = _made(spark, d, "concat('https://x.org/akn/fi/act/statute/', 1990 + doc_id % 30, '/', doc_id, '/', lang, '@')")
    return t.select("doc_id", S.statute_uri(F.col("t")).alias("u")).select("doc_id", "u.*")


@query("SELECT doc_id, sha256(CAST(doc_id AS VARCHAR) || text) AS hash, sha256(text) AS file_hash FROM documents")
def f18_f19_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", S.content_hash(F.col("doc_id").cast("string"), F.col("text")).alias("hash"), F.sha2("text", 256).alias("file_hash"))


@query(r"SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '\"'), '&apos;', '''') AS t FROM pages".replace('\\"', '"'))
def f20_tag_strip(spark, d):
    return table(spark, d, "pages").select("page_id", S.without_tags(F.col("html")).alias("t"))


@query(r"SELECT doc_id, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 200) AS t FROM documents")
def f21_collapse(spark, d):
    return table(spark, d, "documents").select("doc_id", S.collapsed(F.col("text"), 200).alias("t"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'statute_interpretation' WHEN 1 THEN 'statute_interpretation' WHEN 2 THEN 'conditions' WHEN 3 THEN 'jurisdiction' WHEN 4 THEN 'liability' ELSE 'general' END AS kind FROM documents")
def f22_query_type(spark, d):
    t = _made(spark, d, "CASE doc_id % 6 WHEN 0 THEN concat('mitä rl ', doc_id, ':3 tarkoittaa') WHEN 1 THEN concat(doc_id, ' luvun 3 §') WHEN 2 THEN 'Edellytyksiä' WHEN 3 THEN 'Toimivalta' WHEN 4 THEN 'korvaus' ELSE 'muu' END")
    return t.select("doc_id", S.query_type(F.col("t")).alias("kind"))


@query("SELECT conv_id, turn, contains(lower(text), 'the ') OR contains(lower(text), 'and,') AS legal, length(text) < 20 AS greeting, (contains(lower(text), 'ones')) OR (length(text) < 180 AND contains(text, '?')) AS asks_back FROM conversations")
def f23_f24_f25_message_predicates(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", S.any_of(t, ["the ", "and,"]).alias("legal"), (F.length(t) < 20).alias("greeting"), S.clarification(t, ["ones"]).alias("asks_back"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'kko') THEN 'kko' WHEN contains(lower(text), 'erst') THEN 'erst' WHEN contains(lower(text), 'tion') THEN 'tion' ELSE 'legal_search' END AS intent FROM documents")
def f26_f27_intent(spark, d):
    return table(spark, d, "documents").select("doc_id", S.intent(F.col("text"), ["kko", "erst", "tion"], "legal_search").alias("intent"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'overturned_and_remanded' WHEN 1 THEN 'not_changed' WHEN 2 THEN 'dismissed' WHEN 3 THEN 'modified' END AS outcome FROM documents")
def f28_f29_outcome(spark, d):
    t = _made(spark, d, "concat(left(text, 30), CASE doc_id % 5 WHEN 0 THEN ' Tuomiolauselma\nTuomio KUMOTAAN ja asia palautetaan' WHEN 1 THEN ' Päätöslauselma\nRatkaisua ei muuteta' WHEN 2 THEN ' Tuomiolauselma\nValitus hylätään' WHEN 3 THEN ' Päätöslauselma\nmuutos' ELSE ' hylätään' END)")
    return t.select("doc_id", S.outcome(F.col("t")).alias("outcome"))


@query("SELECT p_partkey, list_filter(list_transform(string_split(p_name || ' - ab - ' || p_type, ' - '), lambda x: trim(x)), lambda x: length(x) > 2) AS words FROM part")
def f30_f31_title_keywords(spark, d):
    return table(spark, d, "part").select("p_partkey", S.title_keywords(F.concat("p_name", F.lit(" - ab - "), "p_type")).alias("words"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN [p_brand, p_type] ELSE [p_name] END AS words FROM part")
def f32_split_keywords(spark, d):
    words = F.when(F.col("p_partkey") % 2 == 0, F.array(F.concat("p_brand", F.lit(", "), "p_type"))).otherwise(F.array("p_name"))
    return table(spark, d, "part").select("p_partkey", S.split_keywords(words).alias("words"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._\-]+', '_', 'g'), '^_+|_+$', '', 'g') AS name, CASE WHEN contains(url, '.') THEN lower(regexp_extract(url, '([^.]*)$', 1)) ELSE '' END AS ext FROM pages")
def f33_file_names(spark, d):
    return table(spark, d, "pages").select("page_id", S.safe_name(F.col("url")).alias("name"), S.extension(F.col("url")).alias("ext"))


@query("SELECT doc_id, ['A' || lang, 'B'] AS titles, [source, 'x'] AS bodies FROM documents")
def f34_answer_sections(spark, d):
    t = _made(spark, d, "concat('## A', lang, '\n', source, '\n## B\n x')")
    parts = S.header_parts(F.col("t"))
    return t.select("doc_id", F.transform(parts, lambda p: p["title"]).alias("titles"), F.transform(parts, lambda p: p["body"]).alias("bodies"))


@query(r"SELECT doc_id, CASE WHEN length(text) <= 1400 THEN text ELSE regexp_replace(left(text, 1400), '\s+\S*$', '') END AS t FROM documents")
def f35_compaction(spark, d):
    return table(spark, d, "documents").select("doc_id", S.compacted(F.col("text")).alias("t"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 8 >= 4 THEN 'green' WHEN o_orderkey % 8 >= 3 THEN 'yellow' ELSE 'red' END AS light FROM orders")
def f36_score_light(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.score_light(F.col("o_orderkey") % 8).alias("light"))


@query("SELECT event_type, CAST(props->>'k' AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def f37_json_counts(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, round(least(n_chars / (greatest(doc_id % 9, 1) * 350), 1.0), 4) AS confidence FROM documents")
def f39_confidence(spark, d):
    return table(spark, d, "documents").select("doc_id", S.confidence(F.col("n_chars"), F.col("doc_id") % 9).alias("confidence"))


@query(r"""SELECT doc_id, list_sort(list_distinct(regexp_extract_all(t, '\d{1,2}\.\d{1,2}\.\d{4}'))) AS dates, list_sort(list_distinct(regexp_extract_all(t, '€\s?\d[\d.,]*'))) AS amounts, list_sort(list_distinct(regexp_extract_all(t, '[A-Z][a-z]+ [A-Z][a-z]+')))[1:10] AS phrases
FROM (SELECT doc_id, text || ' 1.2.2003 € 5,00 €7' AS t FROM documents)""")
def f40_mini_metadata(spark, d):
    return _made(spark, d, "concat(text, ' 1.2.2003 € 5,00 €7')").select("doc_id", S.mini_metadata(F.col("t")).alias("m")).select("doc_id", "m.*")


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'en' ELSE 'fi' END AS lang FROM documents")
def f41_f44_language(spark, d):
    return table(spark, d, "documents").select("doc_id", S.text_language(F.col("lang")).alias("lang"))


@query("SELECT doc_id, CAST(sign((CASE WHEN contains(lower(text), 'erst') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'password') THEN 1 ELSE 0 END) - CASE WHEN contains(lower(text), 'tion') THEN 1 ELSE 0 END) AS INT) AS s FROM documents")
def f42_strictness(spark, d):
    return table(spark, d, "documents").select("doc_id", S.strictness(F.col("text"), ["erst", "password"], ["tion"]).alias("s"))


@query("SELECT o_orderkey, greatest(year(o_orderdate) - 60, CASE WHEN o_orderstatus = 'O' THEN 1946 ELSE 1926 END) AS first, least(year(o_orderdate), 1996) AS last FROM orders")
def f43_year_clamp(spark, d):
    y = F.year("o_orderdate")
    court = F.when(F.col("o_orderstatus") == "O", "KHO").otherwise("KKO")
    return table(spark, d, "orders").select("o_orderkey", S.clamped_years(y - 60, y, court, 1996).alias("r")).select("o_orderkey", "r.*")


@query("SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '(?i)^the')), chr(10)) AS t FROM documents")
def f45_drop_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", S.without_lines(F.col("text"), "(?i)^the").alias("t"))


@query(r"SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y') AS INT) AS y FROM orders")
def f47_year_of_slashed_date(spark, d):
    t = _made(spark, d, "date_format(o_orderdate, 'dd/MM/yyyy')", "orders", "o_orderkey")
    return t.select("o_orderkey", F.regexp_extract("t", r"^\d{2}/\d{2}/(\d{4})$", 1).cast("int").alias("y"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'KKO' WHEN 1 THEN 'KHO' END AS scope FROM documents")
def f26_court_scope(spark, d):
    t = _made(spark, d, "CASE doc_id % 4 WHEN 0 THEN concat('mitä KKO sanoo ', source) WHEN 1 THEN 'korkein hallinto-oikeus' WHEN 2 THEN 'kko ja kho' ELSE source END")
    return t.select("doc_id", S.court_scope(F.col("t")).alias("scope"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 < 2 AND lang IN ('en', 'de') THEN 'https://x.org/' || CASE doc_id % 3 WHEN 0 THEN 'kko' ELSE 'kho' END || '/' || CASE lang WHEN 'en' THEN 'precedents' ELSE 'rulings' END || '/' || CAST(1980 + doc_id % 40 AS VARCHAR) || '/' || CAST(doc_id % 97 AS VARCHAR) END AS url FROM documents")
def f48_case_page(spark, d):
    t = _made(spark, d, _IDS, more="lang")
    return t.select("doc_id", S.case_page(F.col("t"), "https://x.org", {"en": "precedents", "de": "rulings"}, F.col("lang")).alias("url"))

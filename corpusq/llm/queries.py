"""The queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm.counts import token_counts
from corpusq.llm.decontaminate import contamination
from corpusq.llm.divergence import divergence
from corpusq.llm.lines import line_dedup
from corpusq.llm.lm import lm_scores
from corpusq.llm.minhash import near_duplicates
from corpusq.llm.pieces import encode_decode
from corpusq.llm.quality import quality_rules
from corpusq.llm.secrets import secret_scan
from corpusq.llm.sharding import shard
from corpusq.llm.simhash import simhash_duplicates
from corpusq.llm.trie import grafted_trie
from corpusq.llm.warc import warc_round_trip

#: Tokenizer files; another place is given by calling the operators.
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "at", F.sha2("value", 256).alias("value_sha256"), "kind", "probability", "is_secret")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), PIECES)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard(table(spark, sf_dir, "documents"), shards=8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))[0]


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), WORDS).select("doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars", "prefixes_sha256")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages")).drop("url")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grafted_trie(table(spark, sf_dir, "conversations"))


ALL = (
    op1_minhash_near_dedup, op2_secret_scans, op3_sentencepiece, op4_sharding, op5_lm_scoring, op6_token_counts, op7_quality_rules, op8_warc, op9_line_dedup, op10_decontamination,
    op11_source_divergence, op12_simhash_near_dedup, op13_conversation_trie,
)


def queries() -> dict:
    return {f.__name__: f for f in ALL}


#: The words [^\x20\x09-\x0D]+ of a lower-cased text. DuckDB's lower() reaches beyond A-Z, so A-Z are translated.
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^ \t\n\x0b\f\r]+') w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i+4]) END)) g FROM d),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
h AS (SELECT doc_id, md5_number(array_to_string(g, chr(1))) g FROM s),
c AS (SELECT x.doc_id a, y.doc_id b, count(*) i FROM h x JOIN h y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.root AS component_id, m.root = documents.doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) root FROM r GROUP BY 1) m USING (doc_id)
"""

OP7 = r"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') host, coalesce(text, '') text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^ \t\n\x0b\f\r]+') w, string_split(text, chr(10)) ls FROM d),
t AS (SELECT doc_id, i p, array_to_string(w[i:i+2], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) i FROM w)),
g AS (SELECT doc_id, p FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT q) n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) q FROM g) GROUP BY 1),
l AS (SELECT doc_id, host, translate(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k FROM (SELECT doc_id, host, unnest(ls) x FROM w)),
common AS (SELECT host, k FROM l WHERE length(k) >= 10 GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > 10),
lost AS (SELECT doc_id, sum(len(regexp_extract_all(k, '[^ \t\n\x0b\f\r]+'))) n FROM l JOIN common USING (host, k) GROUP BY 1),
m AS (SELECT doc_id, len(w)::BIGINT n_words, length(array_to_string(w, ''))::BIGINT word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT n_symbols,
 (len(list_filter(ls, lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')))))::BIGINT n_dup_lines,
 coalesce(rep.n, 0)::BIGINT n_repeat_words, coalesce(lost.n, 0)::BIGINT n_common_words FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_common_words >= n_words * 0.3 AS kept FROM m
"""

OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') html, sha1(coalesce(html, '')) h, max(page_id) OVER (PARTITION BY coalesce(html, '')) top FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(8), lambda i: list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (5 * i + 1)::INT, 5))::INT >> s::INT) & 31) + 1)::INT, 1)).array_to_string('')), '') d FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN top IS DISTINCT FROM page_id THEN top END AS refers_to FROM b
"""

OP9 = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) p FROM documents),
k AS (SELECT *, translate(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {AZ}) k FROM l),
f AS (SELECT k, min(doc_id) first_id FROM k WHERE length(k) >= 10 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.*, f.first_id IS NOT NULL AND f.first_id <> doc_id AS gone FROM k LEFT JOIN f USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(x, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY 1
"""

OP10 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') w FROM benchmark WHERE item_id IS NOT NULL),
v AS (SELECT DISTINCT item_id, len(u) n, array_to_string(u, ' ') g FROM (SELECT item_id, CASE WHEN len(w) < 10 THEN w ELSE w[i:i+9] END u FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) i FROM b WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM v),
p AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM d, sizes)),
m AS (SELECT doc_id, item_id, i, n FROM p JOIN v USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT q) n FROM (SELECT doc_id, unnest(range(i, i + n)) q FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) s FROM m GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(t.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP11 = f"""
WITH d AS (SELECT row_number() OVER () i, coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[a-z\\x{{80}}-\\x{{10FFFF}}]+') w FROM documents),
t AS (SELECT i, lang, source, unnest(w) term FROM d),
k AS (SELECT lang, term, count(*) n FROM t GROUP BY 1, 2 HAVING count(DISTINCT i) >= 10),
v AS (SELECT lang, count(*) v, sum(n) n FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) n FROM t SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce(sum(c.n), 0) n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT lang, g.source, term, coalesce(c.n, 0) n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT) // (g.n + 2 * v) p, 1 + (1000000000 * (k.n + 2)::HUGEINT) // (v.n + 2 * v) q
 FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT x.lang, x.source, y.source item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) s FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
r AS (SELECT x.lang, x.source, 'pair' part, y.source item, coalesce(s, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
 UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM r QUALIFY part = 'pair' OR rank <= 10
"""

#: CRC32 of a conversation's decimal digits, bit by bit; nodes are told apart by the numbers of their turns.
CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"

OP13 = f"""
WITH t AS (SELECT conv_id c, dense_rank() OVER (ORDER BY coalesce(role, ''), coalesce(text, '')) k, length(coalesce(text, '')) chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 p FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, c - c % 100 base, {CRC} % 6 h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT s.c, k, chars, 0 part, p FROM s JOIN t ON t.c = base AND p < h UNION ALL SELECT s.c, k, chars, 1, p FROM s JOIN t ON t.c = s.c AND p >= h),
x AS (SELECT c, row_number() OVER w AS d, array_to_string(list(k) OVER w, ',') k, array_to_string((list(k) OVER w)[:-2], ',') pk, chars FROM r WINDOW w AS (PARTITION BY c ORDER BY part, p) UNION ALL SELECT c, 0, '', NULL, 0 FROM s),
n AS (SELECT d, k, any_value(pk) pk, min(c) c, count(*) n, (count(*) - 1) * any_value(chars) own FROM x GROUP BY 1, 2),
ch AS (SELECT d - 1 d, pk k, count(*) n FROM n WHERE d > 0 GROUP BY 1, 2),
v AS (SELECT n.*, coalesce(ch.n, 0) children FROM n LEFT JOIN ch USING (d, k)),
u AS (SELECT x.d, x.k, count(*) FILTER (children = 0) leaves, sum(own) saved FROM v JOIN x ON x.c = v.c AND x.d <= v.d GROUP BY 1, 2),
e AS (SELECT d, k, string_agg(c::VARCHAR, ',' ORDER BY c) ids FROM x JOIN (SELECT c, max(d) d FROM x GROUP BY 1) USING (c, d) GROUP BY 1, 2)
SELECT v.c AS conv_id, v.d AS depth, q.c AS parent_conv_id, v.n AS n_convs, v.children AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM v JOIN u USING (d, k) LEFT JOIN e USING (d, k) LEFT JOIN n q ON q.d = v.d - 1 AND q.k = v.pk
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": OP1, "op7_quality_rules": OP7, "op8_warc": OP8, "op9_line_dedup": OP9, "op10_decontamination": OP10, "op11_source_divergence": OP11, "op13_conversation_trie": OP13}

"""Secrets in documents: candidates by form, and a random forest that removes false positives."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.llm.storage import written

#: A value by its form: three dotted parts (JWT and the like), or at least 12 letters, digits and joining signs.
VALUE = r"[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{5,}\.[A-Za-z0-9_\-]{16,}|SG\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}|[A-Za-z0-9+/_\-]{12,}"
#: One of them must have a digit, or change from small to capital letters three times.
MIXED = r"[0-9]|[a-z][A-Z].*[a-z][A-Z].*[a-z][A-Z]"
#: A value by its form with the name and sign of assignment right before it.
FORM = rf"(?:[A-Za-z0-9_\-]+[\"'`\]]*[=:]+>?[\"'`(]*)?(?:{VALUE})"
#: Names before a value that say that it is secret, and the form of cloud access keys.
NAMES = r"(?i)(passw(or)?d|passphrase|secret|token|api[_-]?key|access[_-]?key|credential|bearer)"
ACCESS_KEY = r"^(AKIA|ASIA)[A-Z0-9]{16}$"
#: A name and what assigns to it; after it in the same word, a value of any characters up to its quote or the word's end.
ASSIGNS = rf"{NAMES}[A-Za-z0-9_\-]*[\"'`\])]*(?:=>|[=:])+"
ASSIGNED = rf"{ASSIGNS}(?:\"[^\"]+|'[^']+|`[^`]+|[^\"'`]+)"
#: Words before that assign the whole next word, and an assignment whose quote a later word closes.
BEFORE = rf"(?:{ASSIGNS}|{NAMES}[A-Za-z0-9_\-]*[\"'`\])]* (?:=>|:=|[=:]+)|(?i)\bbearer)$"
OPEN = rf"{ASSIGNS}(\"[^\"]*|'[^']*|`[^`]*)$"
QUOTES = {"double": '"', "single": "'", "back": "`"}
QUOTED = "^(\"[^\"]+\"|'[^']+'|`[^`]+`)"
#: Words in a value or path that say that it is none.
PLACEHOLDER = r"(?i)(example|sample|dummy|test|xxxx|placeholder|changeme|0{8}|1234567)"

FEATURES = [
    "length", "digits", "uppers", "transitions", "distinct", "hex", "only_digits", "longest_letters", "coverage",
    "path_test", "path_length", "named", "assigned", "quoted", "name_before", "placeholder", "words_after",
]


def candidates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, path, at (the word's place in the text), lead, value, before, after: each value of each word, with what
    names it in the word (lead) and the words around.

    Values are all matches of ``VALUE`` that are ``MIXED``, and whatever is assigned to a name of ``NAMES``: of any
    characters and length, in the word itself, the next word, or between quotes over several words. A value assigned
    without quotes counts up to the end of the word and up to the first of ``& , ;`` as well. A value that one word
    holds several times counts once there.
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = docs.select("doc_id", "path", "text", F.filter(F.split(F.translate("text", "\t\n\x0b\f\r", "     "), " "), lambda w: w != "").alias("words"))
    around = lambda i: F.concat_ws(" ", F.get("words", i - 2), F.get("words", i - 1))  # noqa: E731  a place beyond the words is null
    holds = lambda w: (F.length(w) >= 12) & w.rlike(MIXED) & w.rlike(VALUE)
    # What BEFORE and ASSIGNS can't do without is looked for first, as patterns on every word are slow.
    last = lambda i: F.when(i > 0, F.get("words", F.greatest(i - 1, F.lit(0)))).otherwise("")
    ends = lambda w: w.endswith("=") | w.endswith(":") | w.endswith(">") | (F.lower(F.right(w, F.lit(6))) == "bearer")
    named = lambda w, i: ((w.contains("=") | w.contains(":")) & w.rlike(ASSIGNS)) | (ends(last(i)) & around(i).rlike(BEFORE))
    # Where a quote is open, the words up to the next one that has such a quote are joined. For each word, ``close`` has the
    # place of the first such word from there on: each place of a quote fills the places since the one before.
    def next_quotes(q: str) -> Column:
        at = F.filter(F.transform("words", lambda w, i: F.when(F.contains(w, F.lit(q)), i)), lambda i: i.isNotNull())
        spans = F.arrays_zip(F.concat(F.array(F.lit(-1)), at).alias("before"), at.alias("at"))
        filled = F.flatten(F.transform(F.filter(spans, lambda x: x["at"].isNotNull()), lambda x: F.array_repeat(x["at"], x["at"] - x["before"])))
        return F.when(F.contains("text", F.lit(q)), filled).otherwise(F.array().cast("array<int>"))

    words = words.withColumn("close", F.arrays_zip(*[next_quotes(q).alias(name) for name, q in QUOTES.items()]))
    close = lambda q, i: F.get("close", i + 1)[next(n for n, x in QUOTES.items() if x == q)]
    joined = lambda i, until: F.when(until.isNotNull(), F.array_join(F.slice("words", i + 2, until - i), " "))

    def rest(w: Column, i: Column) -> Column:
        opened = F.when(w.rlike(OPEN), F.left(F.regexp_extract(w, OPEN, 3), F.lit(1)))
        starts = F.when(w.rlike("^(?:\"[^\"]*|'[^']*|`[^`]*)$") & around(i).rlike(BEFORE), F.left(w, F.lit(1)))
        quote, until = F.coalesce(opened, starts), F.lit(None).cast("int")
        for q in QUOTES.values():
            until = F.when(quote == q, close(q, i)).otherwise(until)
        return F.when(F.regexp_count(w, F.lit("[\"'`]")) > 0, joined(i, until))

    found = F.filter(
        F.transform("words", lambda w, i: F.when(holds(w) | named(w, i), F.struct(i.alias("at"), w.alias("word"), around(i).alias("before"), F.coalesce(F.get("words", i + 1), F.lit("")).alias("after"), rest(w, i).alias("rest")))),
        lambda x: x.isNotNull(),
    )
    rows = words.select("doc_id", "path", F.explode(found).alias("x")).select("doc_id", "path", "x.*")
    whole = F.concat_ws(" ", "word", "rest")
    pair = lambda lead, value: F.struct(lead.alias("lead"), value.alias("value"))
    split = lambda m, form: pair(F.regexp_extract(m, f"^(.*?)(?:{form})$", 1), F.regexp_extract(m, f"({form})$", 1))
    forms = F.filter(F.transform(F.regexp_extract_all("word", F.lit(FORM), F.lit(0)), lambda m: split(m, VALUE)), lambda x: x["value"].rlike(MIXED))
    assigned = F.transform(
        F.regexp_extract_all("word", F.lit(ASSIGNED), F.lit(0)),
        lambda m: pair(F.regexp_extract(m, f"^({ASSIGNS}[\"'`]?)", 1), F.regexp_replace(m, f"^{ASSIGNS}[\"'`]?", "")),
    )
    cut = F.transform(F.filter(assigned, lambda x: ~x["lead"].rlike("[\"'`]$")), lambda x: pair(x["lead"], F.regexp_extract(x["value"], "^([^&,;]*)", 1)))
    follows = F.col("before").rlike(BEFORE)
    empty = F.expr("cast(array() as array<struct<lead:string,value:string>>)")
    quoted = F.when(F.col("rest").isNotNull() & F.col("word").rlike(OPEN), F.regexp_extract(F.regexp_replace(whole, f"^.*?{ASSIGNS}(?=[\"'`])", ""), QUOTED, 1)).when(follows, F.regexp_extract(whole, QUOTED, 1)).otherwise("")
    quoted = F.when(F.length(quoted) > 2, F.array(pair(F.left(quoted, F.lit(1)), F.substr(quoted, F.lit(2), F.length(quoted) - 2)))).otherwise(empty)
    bare = F.when(follows & ~F.col("word").rlike("^[\"'`]"), F.array(pair(F.lit(""), F.regexp_replace("word", "[\"'`,;]+$", "")))).otherwise(empty)
    values = F.filter(F.concat(quoted, assigned, cut, bare, forms), lambda x: F.length(x["value"]) > 0)
    # Once for each value: what names it comes first.
    rows = rows.withColumn("x", F.array_sort(F.transform(values, lambda x, i: F.struct(x["value"].alias("value"), i.alias("i"), x["lead"].alias("lead")))))
    once = F.filter("x", lambda x, i: (i == 0) | (F.get("x", F.greatest(i - 1, F.lit(0)))["value"] != x["value"]))
    return rows.select("doc_id", "path", "at", "before", "after", F.explode(once).alias("x")).select("doc_id", "path", "at", "x.lead", "x.value", "before", "after")


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.length(value)


def _parts(text: Column) -> Column:
    """Lower-cased runs of at least three letters."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) >= 3)


def dictionary(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part: the runs of letters that texts of at least two documents of the whole corpus hold."""
    words = documents.select(F.col(id_col).alias("doc_id"), F.explode(F.array_distinct(_parts(F.col(text_col)))).alias("part"))
    return written(words.groupBy("part").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a != b").select("part"), "dictionary")


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds FEATURES to candidates; ``coverage`` is the share of the value that runs of letters of ``words`` make up."""
    values = found.select("value").distinct()
    covered = values.select("value", F.explode(_parts(F.col("value"))).alias("part")).join(words.hint("merge"), "part").groupBy("value").agg(F.sum(F.length("part")).alias("covered"))
    x = found.join(covered.hint("merge"), "value", "left")
    v = F.col("value")
    flag = lambda c: c.cast("double")
    columns = {
        "length": F.length(v), "digits": _share(v, "[0-9]"), "uppers": _share(v, "[A-Z]"),
        "transitions": _share(v, r"(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"), "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.length(v),
        "hex": flag(v.rlike("^[0-9a-f]+$")), "only_digits": flag(v.rlike("^[0-9]+$")), "longest_letters": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(v, F.lit("([A-Za-z]+)")), F.length)), F.lit(0)),
        "coverage": F.coalesce(F.col("covered"), F.lit(0)) / F.length(v), "path_test": flag(F.col("path").rlike(PLACEHOLDER)), "path_length": F.length("path"),
        "named": flag(F.col("lead").rlike(NAMES)), "assigned": flag(F.col("lead").rlike("[=:]") | F.col("before").rlike("[=:]$")), "quoted": flag(F.col("lead").rlike("[\"'`]$")),
        "name_before": flag(F.col("before").rlike(NAMES)), "placeholder": flag(v.rlike(PLACEHOLDER)), "words_after": F.length("after"),
    }
    return x.withColumns({k: c.cast("double") for k, c in columns.items()}).drop("covered")


def _least(rows: DataFrame, most: int, n: int) -> DataFrame:
    """The ``most`` rows of least hash ``h`` of about ``n``. Only those below a bound that some four times as many meet
    are sorted, so that no task gets more than these."""
    share = min(1.0, 4 * most / max(n, 1))
    return rows.where(F.pmod("h", F.lit(1 << 31)) < int(share * (1 << 31))).orderBy(F.pmod("h", F.lit(1 << 31)), *rows.columns).limit(most)


def generated_findings(documents: DataFrame, most_rows: int = 20_000, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Labelled findings whose truth is known because they are made: doc_id (of a text of its own), text, source, value,
    label. Each of a seeded sample of documents (as many as give ``most_rows`` findings at most) lends its path and words
    of its text to one finding of each kind, true or false; characters of values are drawn from hashes.

    True ones are keys, tokens, passwords and passphrases, with names that differ, some of letters alone and some with no name.
    False ones are what rules on names and forms get wrong: digests, identifiers, paths, placeholders, variables,
    and words of prose after a name."""
    docs = documents.select(F.col(id_col).alias("i"), F.coalesce(F.col(path_col), F.lit("")).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    docs = _least(docs.select("source", F.xxhash64(F.lit(seed), "i", "t").alias("h"), "i", "t"), max(1, most_rows // 20), documents.count())
    docs = docs.select("h", "source", F.regexp_extract_all("t", F.lit(r"(\p{L}{3,12})")).alias("words"))
    drawn = lambda n: F.sha2(F.concat_ws(" ", F.lit(n), F.col("h")), 256)
    mixed = lambda n, k: F.left(F.translate(F.concat(F.base64(F.unhex(drawn(n))), F.base64(F.unhex(drawn(n + 50)))), "+/=\r\n", "xY"), F.lit(k))
    hexed = lambda n, k: F.left(drawn(n), F.lit(k))
    digits = lambda n, k: F.left(F.translate(drawn(n), "abcdef", "012345"), F.lit(k))
    letters = lambda n, k: F.left(F.translate(drawn(n), "0123456789", "ghijklmnop"), F.lit(k))
    word = lambda n: F.coalesce(F.get("words", F.pmod(F.xxhash64(F.lit(n), "h"), F.greatest(F.size("words"), F.lit(1))).cast("int")), F.lit("word"))
    one = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64(F.lit(n), "h"), F.lit(len(xs))) + 1).cast("int"))
    name = lambda n: one(n, "password", "passwd", "secret", "token", "api_key", "API_KEY", "access-key", "apikey", "client_secret")
    sign = lambda n: one(n, "=", ": ", " = ", ":")
    kinds = [  # what stands before, the value, what stands after, label
        (F.concat(name(1), sign(2)), mixed(1, 14), "", 1), (F.concat(F.lit('"'), name(3), F.lit('": "')), mixed(2, 32), '"', 1), ("", F.concat(one(4, "AKIA", "ASIA"), F.upper(mixed(3, 16))), "", 1),
        ("", F.concat(one(5, "ghp_", "glpat-", "sk_live_", "npm_"), mixed(4, 36)), "", 1), (F.concat(name(6), sign(7)), hexed(5, 40), "", 1), (F.concat(one(8, "passphrase", "password"), F.lit(' = "')), F.concat_ws(" ", word(9), word(10), word(11), word(12)), '"', 1),
        ("Authorization: Bearer ", mixed(6, 40), "", 1), (F.concat(name(13), sign(14)), letters(7, 11), "", 1), ("key ", mixed(8, 44), "", 1), (F.concat(name(15), F.lit("=")), F.concat(mixed(9, 5), F.lit("!"), mixed(10, 4)), "", 1),
        (one(16, "commit ", "build ", "rev "), hexed(11, 40), "", 0), (one(17, "sha256:", "digest ", "checksum="), hexed(12, 64), "", 0), (one(18, "id ", "order ", "card ", "id="), digits(13, 16), "", 0),
        (F.concat(name(19), sign(20)), one(21, "changeme123", "your-api-key-here1", "example1234567", "xxxxxxxxxxxx1", "test-token-000000"), "", 0), ("id=", F.concat_ws("-", hexed(14, 8), hexed(15, 4), hexed(16, 4), hexed(17, 12)), "", 0),
        ("", F.concat_ws("/", F.lit("docs"), F.lower(word(22)), F.concat(F.lower(word(23)), digits(18, 2))), ".html", 0), (F.concat(name(24), F.lit(": ")), F.lower(word(25)), "", 0), (F.concat(name(26), F.lit("=")), F.concat(F.lit("${"), F.upper(word(27)), F.lit("}")), "", 0),
        ("data:image/png;base64,", mixed(19, 60), "", 0), ("", F.concat_ws("-", F.lower(word(28)), F.lower(word(29)), digits(20, 4)), "", 0),
    ]
    column = lambda x: F.lit(x) if isinstance(x, str) else x
    made = F.array(*[F.struct(F.xxhash64("h", F.lit(k)).alias("doc_id"), column(a).alias("lead"), v.alias("value"), column(z).alias("tail"), F.lit(float(y)).alias("label")) for k, (a, v, z, y) in enumerate(kinds)])
    made = docs.select("source", F.concat_ws(" ", word(30), word(31)).alias("before"), word(32).alias("after"), F.explode(made).alias("x"))
    text = F.concat(F.col("before"), F.lit(" "), F.col("x.lead"), F.col("x.value"), F.col("x.tail"), F.lit(" "), F.col("after"))
    return written(made.select("x.doc_id", text.alias("text"), "source", "x.value", "x.label"), "made-findings")


def train(labelled: DataFrame, trees: int = 30, depth: int = 6, most_rows: int = 20_000, seed: int = 11) -> PipelineModel | None:
    """A forest from ``labelled`` (FEATURES, label). Of more than ``most_rows`` labelled rows, those of least seeded
    hash are taken; that bound keeps the one task that fits them small. None if not both labels occur."""
    rows = written(labelled.where("label IS NOT NULL").select(*FEATURES, "label", F.xxhash64(F.lit(seed), "value", "doc_id", "at").alias("h")), "labelled-findings")
    rows = written(_least(rows, most_rows, rows.count()).drop("h"), "fitted-findings")
    if rows.select("label").distinct().count() < 2:
        return None
    # One sorted partition, so that the forest is the same in each run.
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.coalesce(1).sortWithinPartitions(*FEATURES, "label"))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label").fit(rows)
    return PipelineModel([VectorAssembler(inputCols=FEATURES, outputCol="features"), model])


def secret_scan(documents: DataFrame, labels: DataFrame | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", most_rows: int = 20_000) -> DataFrame:
    """Findings in all documents: doc_id, at, value, kind, probability, is_secret.

    Each value of ``candidates`` is a finding; a word may have several. The forest is trained on ``labels`` (doc_id,
    value, label 0 or 1: reviewed findings of these documents); without them, or where they hold one kind only, on
    ``generated_findings``. At most ``most_rows`` labelled rows are fitted. A probability of exactly ``threshold`` is a
    secret.

    Null and empty texts have no findings; a null path counts as empty; rows with null or repeated ids are scanned
    like others; a value that occurs again is found again. Tables without candidates give an empty table. Further
    columns are not looked at, whatever they are called.
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(path_col).alias("source"))
    words = dictionary(docs)
    # Written, as features read candidates twice.
    found = written(features(written(candidates(docs), "candidates"), words), "findings")
    model = None
    if labels is not None:
        known = labels.select("doc_id", "value", F.col("label").cast("double").alias("label")).dropDuplicates(["doc_id", "value"])
        model = train(found.join(known.hint("merge"), ["doc_id", "value"]), most_rows=most_rows)
    if model is None:
        made = generated_findings(docs, most_rows)
        known = made.select("doc_id", "value", "label")
        model = train(features(written(candidates(made), "made-candidates"), words).join(known.hint("merge"), ["doc_id", "value"]), most_rows=most_rows)
    if model is None:  # no document, so nothing to scan
        scored = found.withColumn("probability", F.lit(0.0))
    else:
        scored = model.transform(found).withColumn("probability", F.round(vector_to_array("probability")[1], 6))
    kind = F.when(F.col("value").rlike(ACCESS_KEY), "access_key").when(F.col("named") + F.col("name_before") > 0, "named_value").otherwise("value")
    return scored.select("doc_id", F.col("at").cast("long").alias("at"), "value", kind.alias("kind"), "probability", (F.col("probability") >= threshold).alias("is_secret"))

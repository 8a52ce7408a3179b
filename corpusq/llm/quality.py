"""Quality rules on documents and on the lines that documents of one host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.llm.storage import quoted, written

BLANKS = " \t\n\x0b\f\r"
#: [\x20\x09-\x0D] in the syntax of Java's patterns.
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _replaced(text: Column, characters: str, by: str) -> Column:
    """Each of a few characters replaced; a search for each is quicker than translate, which looks every character up."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def _words(text: Column) -> Column:
    return F.array_remove(F.split(_replaced(text, "\t\n\x0b\f\r", " "), " "), "")


def _lowered(line: Column) -> Column:
    """A-Z lower-cased; lines of ASCII alone take the quicker function."""
    return F.when(F.length(line) == F.octet_length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def text_measures(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of ``text_col`` (null: no words).

    Repeated windows of three words are found per row: where not all 64-bit hashes of windows differ, they are sorted
    with their places; a window equal to its neighbour is a repeat, and the words of all repeats are the union of
    stretches of three.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        documents.withColumn("_words", _words(text))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(_replaced(text, BLANKS, "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(_replaced(text, "#*$%&|<>", ""))).cast("long"))
        .withColumn("_lines", F.filter(F.split(text, "\n", -1), lambda x: F.length(F.trim(x, F.lit(BLANKS))) > 0))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
        .withColumn(
            "_plain",
            F.when(F.size("_hashes") < 3, F.expr("cast(array() as array<bigint>)")).otherwise(
                F.transform(F.slice("_hashes", 1, F.greatest(F.size("_hashes") - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get("_hashes", i + 1), F.get("_hashes", i + 2)))
            ),
        )
        .withColumn(
            "_windows",
            F.when(F.size(F.array_distinct("_plain")) == F.size("_plain"), F.expr("cast(array() as array<struct<h:bigint,p:int>>)")).otherwise(
                F.sort_array(F.transform("_plain", lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("p"))))
            ),
        )
        .withColumn("_repeats", F.filter("_windows", lambda w, i: (w["h"] == F.get("_windows", i + 1)["h"]) | ((i > 0) & (w["h"] == F.get("_windows", F.greatest(i - 1, F.lit(0)))["h"]))))
        .withColumn("_places", F.sort_array(F.transform("_repeats", lambda w: w["p"])))
        .withColumn(
            "n_repeat_words",
            F.aggregate("_places", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"]),
        )
        .drop("_words", "_lines", "_hashes", "_plain", "_windows", "_repeats", "_places")
    )


def _hashed(line: Column) -> list[Column]:
    """128 bits of a line's key."""
    key = _lowered(F.trim(line, F.lit(BLANKS)))
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b")]


def common_lines(lines: DataFrame, line_limit: int, by_text: bool, first_keeps: bool) -> DataFrame:
    """host, a, b and first_id (null unless ``first_keeps``) of lines in more than ``line_limit`` documents of a host."""
    counted = lines.where("a IS NOT NULL").groupBy("host", "a", "b").agg(F.count_distinct("t" if by_text else "doc_id").alias("n"), F.min("doc_id").alias("first_id"))
    first = F.col("first_id") if first_keeps else F.lit(None).cast("long").alias("first_id")
    return written(counted.where(F.col("n") > line_limit).select("host", "a", "b", first), "common-lines")


def _verdicts(docs: DataFrame, min_words: int, max_repeat_share: int, line_limit: int, min_line_chars: int, min_left: float, by_text: bool, first_keeps: bool) -> DataFrame:
    """The measures and verdict of each row of ``docs`` (doc_id, host, text), with the hashes row and row2 that name it
    and ``gone``, the lines that it loses (null: none)."""
    docs = _named(docs).withColumn("t", F.xxhash64(F.lit(3), "text"))
    # The null line stands for the row itself: its words count how often the very same row occurs.
    lines = F.transform(F.filter(F.split("text", "\n", -1), lambda x: F.length(F.trim(x, F.lit(BLANKS))) >= min_line_chars), lambda x: F.struct(*_hashed(x), F.size(_words(x)).alias("n")))
    own = F.struct(*(F.lit(None).cast("long").alias(c) for c in "ab"), F.lit(1).alias("n"))
    lines = docs.select("doc_id", "host", "t", "row", "row2", F.explode(F.concat(F.array(own), lines)).alias("x"))
    # One row for each document and line, with the words that all its occurrences hold.
    lines = written(lines.groupBy("doc_id", "host", "t", "row", "row2", "x.a", "x.b").agg(F.sum("x.n").alias("words")), "host-lines")
    rows = lines.where("a IS NULL").select("row", "row2", F.col("words").alias("copies"))
    common = common_lines(lines, line_limit, by_text, first_keeps)
    lost = lines.join(common, ["host", "a", "b"]).where("first_id IS NULL OR doc_id IS NULL OR doc_id != first_id")
    lost = lost.groupBy("row", "row2").agg(F.sum("words").alias("lost"), F.collect_set(F.struct("a", "b")).alias("gone"))
    lost = lost.join(rows.hint("merge"), ["row", "row2"]).select("row", "row2", F.expr("lost div copies").alias("lost"), "gone")
    # Written, so that no filter on what follows is unfolded through all the steps of the measures.
    measured = written(text_measures(docs).drop("text", "host", "t"), "measures")
    out = measured.join(lost.hint("merge"), ["row", "row2"], "left").withColumn("n_common_words", F.coalesce("lost", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_share)
    left = F.col("n_words") - F.col("n_common_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (left >= F.col("n_words") * min_left))


def _named(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"row": F.xxhash64("doc_id", "host", "text"), "row2": F.xxhash64(F.lit(7), "doc_id", "host", "text")})


def _docs(documents: DataFrame, id_col: str, text_col: str, host_col: str) -> list[Column]:
    host = F.coalesce(F.concat(F.lit("="), host_col), F.lit(""))
    return [documents[id_col].cast("long").alias("doc_id"), host.alias("host"), F.coalesce(documents[text_col], F.lit("")).alias("text")]


def quality_rules(
    documents: DataFrame,
    min_words: int = 50,
    max_repeat_share: int = 50,
    line_limit: int = 10,
    min_line_chars: int = 10,
    min_left: float = 0.3,
    by_text: bool = False,
    first_keeps: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """Measures documents, finds the lines that many documents of a host share, and rejects what is left depleted.

    A line's key is the line without blanks at its ends, A-Z lower-cased. A line is common to a host (null is a host
    of its own) if its key has ``min_line_chars`` code points and stands in more than ``line_limit`` documents (distinct
    ids) of the host; that limit is the same for hosts of all sizes. Common lines are lost in all documents of the host.
    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_share`` per cent of the words stand in
    3-word windows found twice or more. ``kept``: not base_failed, and at least the share ``min_left`` of the
    document's words stands in lines that it keeps; a document of which less is its own is depleted.

    Two deviations, both off: ``by_text`` counts distinct texts instead of ids, so that copies alone make no line common;
    ``first_keeps`` leaves a common line in the document of least id that has it.

    Null and empty texts have no words and fail. Rows that share an id count once for a line, those without an id not
    at all; each row gets its own verdict. Returns a row for each row: doc_id, the measures, n_common_words, base_failed,
    kept. An empty table gives an empty table. Columns besides the three named are not looked at.

    Lines are shuffled as hashes, one per document and line, and summed per task first. A host or line with a third
    of all rows is a partial sum per task there, and on the way back a join that Spark can split.
    """
    out = _verdicts(documents.select(*_docs(documents, id_col, text_col, host_col)), min_words, max_repeat_share, line_limit, min_line_chars, min_left, by_text, first_keeps)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_common_words", "base_failed", "kept")


def quality_rows(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", only_kept: bool = True, **rules) -> DataFrame:
    """The rows of ``documents`` that ``quality_rules`` keeps (or all), with all their columns, and with texts that have
    lost their common lines; a text that loses none is left as it is."""
    named = documents.select(*[F.col(quoted(c)).alias(f"_{i}") for i, c in enumerate(documents.columns)], F.struct(*_docs(documents, id_col, text_col, host_col)).alias("_doc"))
    named = _named(named.select("*", "_doc.*")).drop("_doc", "doc_id", "host", "text")
    defaults = {"min_words": 50, "max_repeat_share": 50, "line_limit": 10, "min_line_chars": 10, "min_left": 0.3, "by_text": False, "first_keeps": False}
    verdicts = _verdicts(documents.select(*_docs(documents, id_col, text_col, host_col)), **(defaults | rules))
    verdicts = verdicts.where("kept" if only_kept else "true").select("row", "row2", "gone")
    verdicts = written(verdicts.groupBy("row", "row2").agg(F.first("gone").alias("gone")), "verdicts")
    joined = named.join(verdicts.hint("merge"), ["row", "row2"])
    own = F.col(f"_{documents.columns.index(text_col)}")
    stays = lambda x: ~F.array_contains("gone", F.struct(*_hashed(x)))
    text = F.when(F.col("gone").isNull() | own.isNull(), own).otherwise(F.array_join(F.filter(F.split(own, "\n", -1), stays), "\n"))
    return joined.select(*[(text if c == text_col else F.col(f"_{i}")).alias(c) for i, c in enumerate(documents.columns)])

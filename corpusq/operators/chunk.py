"""Chunks of texts: by paragraphs, word windows and numbered sections; their embedding."""

from __future__ import annotations

from corpusq.operators.extract import _mapped
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def paragraph_chunks(text: str | None, limit: int = 2000, overlap: int = 200) -> list[str]:
    """Paragraphs gathered up to ``limit`` characters; the last ones of a chunk that fit in ``overlap`` begin the next.
    A longer paragraph stays whole (C1)."""
    if text is None or len(text) <= limit:
        return [text or ""]
    out, held, size = [], [], 0
    for p in text.split("\n\n"):
        if held and size + len(p) + 2 > limit:
            out.append("\n\n".join(held))
            keep, size = 0, 0
            while keep < len(held) and size + len(held[-keep - 1]) + 2 <= overlap:
                size += len(held[-keep - 1]) + 2
                keep += 1
            held = held[len(held) - keep :]
        held.append(p)
        size += len(p) + 2
    return [*out, "\n\n".join(held)]


def sub_chunks(df: DataFrame, text_col: str, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """Adds ``chunks``."""
    return _mapped(df, [text_col], "chunks", T.ArrayType(T.StringType()), lambda t: paragraph_chunks(t, limit, overlap))


def word_windows(df: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 50) -> DataFrame:
    """id, chunk, text: windows of ``size`` words, each beginning ``size - overlap`` behind the last; the last may be all
    overlap (C4). A text is split once; each word goes to the windows that it is in, by its place."""
    step = size - overlap
    words = df.select(id_col, F.array_remove(F.split(F.regexp_replace(text_col, r"\s+", " "), " "), "").alias("_w")).withColumn("_n", F.size("_w"))
    starts = words.where("_n > 0").select(id_col, "_w", F.posexplode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(step))).alias("chunk", "_s"))
    return starts.select(id_col, "chunk", F.array_join(F.slice("_w", F.col("_s") + 1, size), " ").alias("text"))


def numbered_sections(text: Column) -> Column:
    """number and text of the parts that lines like ``§ 3`` begin; what stands before is a preamble without a number."""
    parts = F.transform(F.split(text, r"(?m)(?=^\s*§\s*\d+)"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.struct(F.nullif(F.regexp_extract(p, r"^§\s*(\d+)", 1), F.lit("")).alias("number"), p.alias("text")))


def sized_sections(parts: list[dict], most: int, least: int, overlap: int) -> list[dict]:
    """Sections of over ``most`` words in windows, those of under ``least`` words joined to the one before."""
    out: list[dict] = []
    for part in parts:
        words = part["text"].split()
        if len(words) > most:
            for k, i in enumerate(range(0, len(words), most - overlap)):
                out.append({"number": f"{part['number']} (part {k + 1})", "text": " ".join(words[i : i + most]), "merged": []})
        elif len(words) < least and out:
            out[-1] = out[-1] | {"text": out[-1]["text"] + "\n\n" + part["text"], "merged": [*out[-1]["merged"], part["number"] or ""]}
        else:
            out.append({"number": part["number"], "text": part["text"], "merged": []})
    return out


CHUNK = T.ArrayType(T.StructType().add("number", "string").add("text", "string").add("merged", T.ArrayType(T.StringType())))


def section_chunks(df: DataFrame, sections_col: str, most: int = 1000, least: int = 100, overlap: int = 50) -> DataFrame:
    """Adds ``chunks`` from an array of number and text."""
    return _mapped(df, [sections_col], "chunks", CHUNK, lambda parts: sized_sections(parts or [], most, least, overlap))


def section_rows(df: DataFrame, id_col: str, title: Column, sections_col: str, text_col: str, keywords: Column | None = None, courts: Column | None = None, laws: Column | None = None, limit: int = 2000) -> DataFrame:
    """Rows of the section table, numbered within the case (C2): parts of the sections with content, each under a header
    that names the case, the section, its keywords, the courts before and 15 cited laws at most. Cases without such sections
    have the parts of their whole text, of medium priority. keywords and laws are arrays; courts is text, null or empty
    where there is none."""
    none = F.array().cast("array<string>")
    keywords, laws, courts = (x if x is not None else y for x, y in ((keywords, none), (laws, none), (courts, F.lit(""))))
    line = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value, F.lit("\n"))).otherwise("")
    head = F.concat(F.lit("["), F.col(id_col).cast("string"), F.lit("] "), F.coalesce(title, F.lit("")), F.lit("\n"))
    tail = F.concat(F.lit("Keywords: "), F.array_join(keywords, ", "), F.lit("\n"), line("Jurisdiction", courts), line("Cited laws/regulations", F.array_join(F.slice(laws, 1, 15), ", ")), F.lit("\n"))
    kept = F.filter(sections_col, lambda x: F.trim(x["content"]) != "")
    whole = F.transform(F.filter(F.array(F.coalesce(F.col(text_col), F.lit(""))), lambda t: t != ""), lambda t: F.struct(F.lit("reasoning").alias("type"), F.lit(None).cast("string").alias("title"), t.alias("content")))
    each = df.select(id_col, head.alias("_h"), tail.alias("_t"), F.posexplode(F.when(F.size(kept) > 0, kept).otherwise(whole)).alias("no", "s")).select(id_col, "_h", "_t", "no", "s.*")
    parts = sub_chunks(each, "content", limit).select(id_col, "_h", "_t", "no", "type", "title", F.size("chunks").alias("n"), F.posexplode("chunks").alias("part", "text"))
    of = F.concat((F.col("part") + 1).cast("string"), F.lit("/"), F.col("n").cast("string"))
    name = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Section"))
    label = F.when(F.col("title").isNull(), F.concat(F.lit("Full Text Part "), of)).otherwise(F.when(F.col("n") > 1, F.concat(name, F.lit(" (Part "), of, F.lit(")"))).otherwise(name))
    heading = F.when(F.col("title").isNull(), "").otherwise(F.concat(F.lit("Section: "), name, F.lit("\n")))
    number = F.row_number().over(Window.partitionBy(id_col).orderBy("no", "part"))
    return parts.select(
        id_col, number.alias("section_number"), F.coalesce(F.nullif(F.trim("type"), F.lit("")), F.lit("other")).alias("section_type"), label.alias("section_title"),
        F.when(F.col("title").isNull(), "medium").otherwise("high").alias("priority"), F.concat("_h", heading, "_t", "text").alias("content"),
    )


def hashed_embedding(df: DataFrame, text_col: str, dims: int = 64, most: int = 8000) -> DataFrame:
    """Adds ``embedding``, the hashed words of the first ``most`` characters as a vector of unit length; null where
    there are none. A model's own column takes its place where there is one (C7)."""
    words = F.filter(F.split(F.lower(F.left(text_col, F.lit(most))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    counts = F.aggregate(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int")), F.array_repeat(F.lit(0.0), dims), lambda a, i: F.transform(a, lambda x, j: F.when(j == i, x + 1).otherwise(x)))
    norm = F.sqrt(F.aggregate("_c", F.lit(0.0), lambda a, x: a + x * x))
    return df.withColumn("_c", counts).withColumn("embedding", F.when(norm > 0, F.transform("_c", lambda x: (x / norm).cast("float")))).drop("_c")

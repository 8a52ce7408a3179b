"""Readers of documents: year files of JSON, binary files, pages and XML."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.parsers.expat import ExpatError, ParserCreate

import pyarrow as pa
from corpusq.sources.shared import small
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: The directory of each decision type; other types go to ``other``. Fixed values.
TYPE_DIRECTORIES = {"precedent": "precedents", "leave_to_appeal": "leaves_to_appeal", "ruling": "rulings", "other_decision": "other"}

REFERENCE = T.StructType().add("ref_id", "string").add("ref_type", "string")
_TEXTS = "case_id court_type court_code decision_type decision_date diary_number ecli title full_text url judges vote_strength"
_NUMBERS = "case_year judges_total judges_dissenting"
_LISTS = "legal_domains cited_laws cited_cases cited_eu_cases cited_regulations"
#: A court decision in the JSON files.
CASE = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXTS.split()] + [T.StructField(c, T.IntegerType()) for c in _NUMBERS.split()]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in _LISTS.split()] + [T.StructField("is_precedent", T.BooleanType()), T.StructField("references", T.ArrayType(REFERENCE))]
)


def year_files(spark: SparkSession, path: str, schema: T.StructType = CASE) -> DataFrame:
    """Documents of JSON files that each hold one array; rows that don't parse, or have no case id, are left out (S3)."""
    read = spark.read.schema(T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", True).json(path)
    return read.where("_bad IS NULL AND case_id IS NOT NULL").drop("_bad")


def write_year_files(docs: DataFrame, path: str) -> None:
    """JSON lines by court, type directory and year."""
    directory = F.coalesce(F.create_map(*[F.lit(x) for kv in TYPE_DIRECTORIES.items() for x in kv])[F.col("decision_type")], F.lit("other"))
    docs.withColumns({"court": F.lower("court_code"), "subtype": directory, "year": F.col("case_year")}).write.mode("append").partitionBy("court", "subtype", "year").json(path)


def text_of(content: Column) -> Column:
    """Bytes as UTF-8 where they are, as Latin-1 otherwise."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", text_of(F.col("content")).alias("text"))


class _Text(HTMLParser):
    """Text outside scripts and styles; blocks end lines."""

    SKIPPED, BLOCKS = {"script", "style"}, {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "title", "article", "nav", "ul", "table"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skipped = [], 0

    def handle_starttag(self, tag, attrs):
        self.skipped += tag in self.SKIPPED
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.skipped = max(0, self.skipped - (tag in self.SKIPPED))
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skipped:
            self.out.append(data)


def _plain(html: str | None) -> str:
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return "".join(parser.out)


def html_text(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, text: pages as plain text, runs of three and more line ends as two."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_plain(x) for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    plain = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(rows, f"id {kind}, text string")
    return plain.select(F.col("id").alias(id_col), F.trim(F.regexp_replace("text", r"\n{3,}", "\n\n")).alias("text"))


def links(pages: DataFrame, id_col: str, html_col: str, marker: str, base: str) -> DataFrame:
    """id, link: distinct absolute links that hold ``marker``."""
    href = F.explode(F.array_distinct(F.regexp_extract_all(html_col, F.lit('href="([^"]+)"'), F.lit(1))))
    found = pages.select(id_col, href.alias("link")).where(F.contains("link", F.lit(marker)))
    return found.select(id_col, F.when(F.col("link").startswith("/"), F.concat(F.lit(base.rstrip("/")), "link")).otherwise(F.col("link")).alias("link")).distinct()


def result_cells(cells: Column) -> Column:
    """A row of a result table by what its cells look like: number, date, ecli and title."""
    like = lambda p: F.get(F.filter(cells, lambda c: c.rlike(p)), F.lit(0))
    number, date, ecli = like(r"^[CT]-\d+/\d{2}"), like(r"^\d{2}/\d{2}/\d{4}$"), like("^ECLI:")
    title = F.get(F.filter(cells, lambda c: ~c.rlike(r"^[CT]-\d+/\d{2}|^\d{2}/\d{2}/\d{4}$|^ECLI:") & (F.length(c) > 10)), F.lit(0))
    return F.struct(number.alias("number"), date.alias("date"), ecli.alias("ecli"), F.coalesce(title, number).alias("title"))


def main_block(blocks: Column) -> Column:
    """The longest of several text blocks, the first of equals."""
    best = F.array_max(F.transform(blocks, lambda b, i: F.struct(F.length(b).alias("n"), (-i).alias("i"), b.alias("b"))))
    return best["b"]


ELEMENTS = T.ArrayType(
    T.StructType().add("no", "integer").add("last", "integer").add("depth", "integer").add("parent", "integer").add("name", "string").add("attributes", T.MapType(T.StringType(), T.StringType())).add("head", "string").add("begin", "integer").add("end", "integer")
)


def _parsed(xml: str | None) -> tuple[list, list] | None:
    """Elements in the order of their beginnings and pieces of text in the order of the document; None for what isn't XML."""
    elements, texts, open_, pieces = [], [], [], []

    def flush() -> None:
        piece = "".join(pieces)
        pieces.clear()
        if piece.strip():
            if open_ and open_[-1]["no"] == len(elements) - 1 and open_[-1]["begin"] == len(texts):
                open_[-1]["head"] = piece.strip()
            texts.append(piece.strip())

    def begin(name: str, attributes: dict[str, str]) -> None:
        flush()
        own = {"no": len(elements), "last": 0, "depth": len(open_), "parent": open_[-1]["no"] if open_ else -1, "name": name.rpartition(":")[2], "head": "", "begin": len(texts), "end": 0}
        own["attributes"] = [(k.rpartition(":")[2], v) for k, v in {k.rpartition(":")[2]: v for k, v in attributes.items() if not k.startswith("xmlns")}.items()]
        elements.append(own)
        open_.append(own)

    def end(name: str) -> None:
        flush()
        own = open_.pop()
        own["last"], own["end"] = len(elements) - 1, len(texts)

    parser = ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = begin, end, pieces.append
    try:
        parser.Parse((xml or "").strip(), True)
    except ExpatError:
        return None
    return elements, texts


def xml_elements(docs: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """id, elements, texts of XML, both null for what isn't well formed: an element has its number (from 0, in the order of
    beginnings), the number of the last one within it, depth, parent, name and attributes without prefixes, the text before
    its first child (head), and where its pieces of text begin and end in ``texts``. Comments are left out; CDATA is text.

    An element's descendants stand behind it up to ``last``, however they are nested."""
    kind = T.StructType([docs.schema[id_col], T.StructField("elements", ELEMENTS), T.StructField("texts", T.ArrayType(T.StringType()))])
    arrow = to_arrow_schema(kind)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            made = [_parsed(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m and m[0] for m in made], arrow.field(1).type), pa.array([m and m[1] for m in made], arrow.field(2).type)], arrow.names)

    return docs.select(id_col, xml_col).mapInArrow(rows, kind)


def _text(x: Column) -> Column:
    """All text of an element, white space squeezed."""
    joined = F.array_join(F.slice("texts", x["begin"] + 1, x["end"] - x["begin"]), " ")
    return F.coalesce(F.trim(F.regexp_replace(joined, r"\s+", " ")), F.lit(""))


def _within(x: Column | None, name: str, test: Callable[[Column], Column] | None = None) -> Column:
    """The elements of a name within ``x``, or of the whole document."""
    rows = F.col("elements") if x is None else F.slice("elements", x["no"] + 2, x["last"] - x["no"])
    return F.filter(rows, lambda y: (y["name"] == name) & (test(y) if test else F.lit(True)))


def _first(rows: Column) -> Column:
    return F.get(rows, F.lit(0))


def _is(key: str, *values: str) -> Callable[[Column], Column]:
    return lambda y: F.coalesce(y["attributes"][key].isin(*values), F.lit(False))


def _present(texts: Column) -> Column:
    return F.filter(texts, lambda t: t != "")


def _table_or_text(x: Column) -> Column:
    """The rows of a table as lines of cells, or the text of a paragraph."""
    rows = F.transform(_within(x, "tr"), lambda r: F.array_join(_present(F.transform(_within(r, "td"), _text)), " | "))
    return F.when(x["name"] == "table", F.array_join(_present(rows), "\n")).otherwise(_text(x))


def statutes(docs: DataFrame, id_col: str, xml_col: str, language: str = "fin") -> DataFrame:
    """id and what statute XML holds (S10, E23-E25): title, text, sections (number, heading, content), attachments (heading,
    content), pdf_links, definitions (section, text), references (statute, uri, type), scope (issued, published, in_force,
    entry_into_force) and amendments (insertions, repeals, substitutions, modifications).

    Names are matched without their prefix and namespace. The title is that of the language, for others than Finnish the
    Finnish one, else the one in the preface or header. A section without a number is left out; one within another stands
    for itself too. What isn't well formed gives null columns."""
    docs = xml_elements(docs, id_col, xml_col)
    some = lambda t: F.nullif(t, F.lit(""))
    spoken = lambda *codes: lambda y: _is("lang", *codes)(y) | _is("language", *codes)(y)
    titled = lambda *codes: some(_text(_first(_within(None, "title", spoken(*codes)))))
    named = lambda place: some(_text(_first(_within(_first(_within(None, place)), "docTitle"))))
    title = F.coalesce(titled(*(("eng", "en") if language == "eng" else (language,))), titled("fin"), named("preface"), named("header"), F.lit("Untitled Document"))
    text = F.array_join(_present(F.array(*[F.coalesce(_text(_first(_within(None, n))), F.lit("")) for n in ("preface", "preamble", "body", "conclusions", "judgmentBody")])), " ")

    def section(s: Column) -> Column:
        # The pieces of text of children that are neither number nor heading, and those between them.
        own = F.filter(F.slice("elements", s["no"] + 2, s["last"] - s["no"]), lambda y: (y["parent"] == s["no"]) & y["name"].isin("num", "heading"))
        kept = F.filter(F.transform(F.slice("texts", s["begin"] + 1, s["end"] - s["begin"]), lambda t, i: F.struct(t.alias("t"), (i + s["begin"]).alias("i"))), lambda p: ~F.exists(own, lambda y: (p["i"] >= y["begin"]) & (p["i"] < y["end"])))
        content = F.trim(F.regexp_replace(F.array_join(F.transform(kept, lambda p: p["t"]), " "), r"\s+", " "))
        return F.struct(F.coalesce(_first(_within(s, "num"))["head"], F.lit("")).alias("number"), some(_text(_first(_within(s, "heading")))).alias("heading"), content.alias("content"))

    body = _first(_within(None, "body"))
    sections = F.filter(F.transform(F.when(body.isNotNull(), _within(body, "section")).otherwise(_within(None, "section")), section), lambda s: s["number"] != "")
    attached = F.flatten(F.transform(_within(None, "hcontainer", _is("name", "attachments")), lambda c: _within(c, "hcontainer", _is("name", "attachment"))))

    def attachment(a: Column) -> Column:
        content = _first(_within(a, "content"))
        parts = F.filter(F.slice("elements", content["no"] + 2, content["last"] - content["no"]), lambda y: (y["parent"] == content["no"]) & y["name"].isin("table", "p"))
        return F.struct(F.coalesce(some(_text(_first(_within(a, "heading")))), F.lit("Liite")).alias("heading"), F.coalesce(F.array_join(_present(F.transform(parts, _table_or_text)), "\n\n"), F.lit("")).alias("content"))

    attachments = F.filter(F.transform(attached, attachment), lambda a: a["content"] != "")
    defining = F.filter(_within(None, "section"), lambda s: F.lower(_text(_first(_within(s, "heading")))).rlike("määritel|definition"))
    terms = lambda s: F.transform(_present(F.transform(_within(s, "p"), _text)), lambda t: F.struct(F.coalesce(some(_first(_within(s, "num"))["head"]), F.lit("?")).alias("section"), t.alias("text")))
    others = F.filter(_within(None, "affectedDocument"), lambda y: F.coalesce(y["attributes"]["href"], F.lit("")) != "")
    references = F.transform(others, lambda y: F.struct(y["head"].alias("statute"), y["attributes"]["href"].alias("uri"), F.when(F.lower(y["head"]).contains("muutossäädös"), "amending").otherwise("referenced").alias("type")))
    work, force = _first(_within(None, "FRBRWork")), _first(_within(None, "isInForce"))
    dated = lambda name: some(F.try_element_at(_within(work, "FRBRdate", _is("name", name)), F.lit(-1))["attributes"]["date"])
    scope = F.struct(
        dated("dateIssued").alias("issued"), dated("datePublished").alias("published"), F.when(force.isNotNull(), F.lower(F.coalesce(force["attributes"]["value"], F.lit(""))) == "true").alias("in_force"),
        some(_text(_first(_within(None, "entryIntoForce")))).alias("entry_into_force"),
    )
    amendments = F.struct(*[_present(F.transform(_within(None, "block", _is("name", n)), _text)).alias(n) for n in ("insertions", "repeals", "substitutions", "modifications")])
    anchors = lambda x: F.when(F.size(_within(x, "a")) > 0, _within(x, "a"))
    links = F.coalesce(anchors(body), anchors(_first(_within(None, "judgmentBody"))), _within(None, "a"))
    links = F.array_distinct(F.filter(F.transform(links, lambda y: F.coalesce(y["attributes"]["href"], F.lit(""))), lambda h: F.lower(h).endswith(".pdf")))
    columns = {
        "title": title, "text": text, "sections": sections, "attachments": attachments, "pdf_links": links, "definitions": F.flatten(F.transform(defining, terms)),
        "references": references, "scope": scope, "amendments": amendments,
    }
    return docs.select(id_col, *[F.when(F.col("elements").isNotNull(), c).alias(n) for n, c in columns.items()])

"""Column functions over identifiers, dates, years and texts of court decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

#: Ranges of years in a query, in the order in which they are tried. Fixed values.
YEAR_RANGES = [r"(?i)from\s+(\d{4})\s+to\s+(\d{4})", r"(\d{4})\s*[-–]\s*(\d{4})", r"(?i)between\s+(\d{4})\s+and\s+(\d{4})", r"(?i)years?\s+(\d{4})\s+to\s+(\d{4})", r"(\d{4})\s+to\s+(\d{4})"]
SINGLE_YEARS = [r"(?i)(?:^|from|year|in)\s+(\d{4})\b", r"^(\d{4})$"]
NO_YEARS = ["all", "any", "no filter", "none", "kaikki", "ei rajoitusta", "ingen begränsning"]

#: Identifiers of decisions, in the order in which they are listed. Fixed values.
FINNISH_ID = r"(?i)\b(?:KKO|KHO)\s*[:\-/\s]\s*\d{4}\s*[:\-/\s]\s*(?:(?:II|I)\s*[:\-/\s]\s*)?\d+\b"
FINNISH_PARTS = r"(?i)^(KKO|KHO)\s*[:\-/\s]\s*(\d{4})\s*[:\-/\s]\s*(?:(?:II|I)\s*[:\-/\s]\s*)?(\d+)$"
VOLUME_ID = r"(?i)\b(?:KKO|KHO)\s*[:\s]\s*\d{4}\s*-\s*I{1,2}\s*-\s*\d+\b"
VOLUME_PARTS = r"(?i)^(KKO|KHO)\s*[:\s]\s*(\d{4})\s*-\s*(I{1,2})\s*-\s*(\d+)$"
ECLI_EU = r"\b(ECLI:EU:[CT]:\d{4}:\d+)\b"
EU_NUMBER = r"\b([CT]-\d+/\d{2,4})\b"
ECHR_NUMBER = r"(?i)\bapplication\s+no\.?\s*(\d+/\d{2,4})\b"

#: Outcomes after the heading of a judgment, in the order in which they are tried. Fixed values.
OUTCOMES = [
    ("not_changed", "ei muuteta|ei muutettu|jää pysyväksi", None),
    ("overturned_and_remanded", "kumotaan|kumottiin", "palautetaan|palauttaa"),
    ("overturned", "kumotaan|kumottiin", None),
    ("modified", "muutetaan|muutettu|muutos", None),
    ("dismissed", "hylätään|hylättiin", None),
    ("not_examined", "jätetään tutkimatta", None),
    ("remanded", "palautetaan|palautettiin|palauttaa", None),
]
JUDGMENT_HEADINGS = ["Tuomiolauselma", "Päätöslauselma"]

#: What a query asks about, in the order in which it is tried. Fixed values.
STATUTE = r"(?i)\b(OYL|RL|OK|VML|SOL|SotOikL)\s*\d+:\d+"
CHAPTER_SECTION = r"\d+\s+luvun\s+\d+\s*§"
QUERY_WORDS = [("conditions", ["milloin", "missä tapauksessa", "edellyty"]), ("jurisdiction", ["toimivalta", "tuomioistuin", "käsittelee", "menettely"]), ("liability", ["vastuu", "vastuussa", "korvaus", "vahingonkorvaus"])]

#: Entities in the order in which they are decoded. Fixed values.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'")]


def _group(c: Column, pattern: str, n: int = 1) -> Column:
    """The group, or null where the pattern isn't found."""
    return F.nullif(F.regexp_extract(c, pattern, n), F.lit(""))


def _day(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))


def iso_date(value: Column) -> Column:
    """ISO dates as they are, d.m.yyyy and d.m.yy (to 30 in this century) as ISO, else null; days aren't checked."""
    v = F.regexp_replace(value, r"^\s+|\s+$", "")
    long, short = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", r"^(\d{1,2})\.(\d{1,2})\.(\d{2})$"
    yy = _group(v, short, 3).cast("int")
    century = F.when(yy <= 30, yy + 2000).otherwise(yy + 1900).cast("string")
    return F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), v).when(v.rlike(long), _day(_group(v, long, 3), _group(v, long, 2), _group(v, long, 1))).when(v.rlike(short), _day(century, _group(v, short, 2), _group(v, short, 1)))


def valid_date(iso: Column) -> Column:
    """Whether an ISO date names a day of the calendar."""
    return F.try_to_date(iso, "yyyy-MM-dd").isNotNull()


def finnish_date(value: Column) -> Column:
    """d.m.yyyy as ISO, other texts unchanged."""
    p = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$"
    return F.when(value.rlike(p), _day(_group(value, p, 3), _group(value, p, 2), _group(value, p, 1))).otherwise(value)


def english_date(value: Column) -> Column:
    """``January 7, 2026`` as ISO, null where it's no such date (F8)."""
    p = r"(?i)(" + "|".join(MONTHS) + r")\s+(\d{1,2}),?\s+(\d{4})"
    number = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(_group(value, p, 1))).cast("string")
    return F.when(value.rlike(p), _day(_group(value, p, 3), number, _group(value, p, 2)))


def full_year(yy: Column, pivot: int) -> Column:
    """Two-digit years: from ``pivot`` on in the last century."""
    return F.when(yy >= pivot, yy + 1900).otherwise(yy + 2000)


def id_parts(case_id: Column) -> Column:
    """court, year and number of ids like KHO:2000:48."""
    p = r"^([A-Za-z]+)[:\-\s]+(\d{4})[:\-\s]+(?:I{1,2}[:\-\s]+)?(\d+)$"
    return F.struct(F.upper(_group(case_id, p, 1)).alias("court"), _group(case_id, p, 2).cast("int").alias("year"), _group(case_id, p, 3).cast("int").alias("number"))


def year_range(text: Column) -> Column:
    """first and last year named in a text, both null without one (F11). Single years count from 1900 to 2100."""
    t = F.trim(text)
    found = F.lit(None).cast("struct<a:int,b:int>")
    options = [F.when(t.rlike(p), F.struct(_group(t, p, 1).cast("int").alias("a"), _group(t, p, 2).cast("int").alias("b"))) for p in YEAR_RANGES]
    singles = []
    for p in SINGLE_YEARS:
        y = _group(t, p, 1).cast("int")
        singles.append(F.when(y.between(1900, 2100), F.struct(y.alias("a"), y.alias("b"))))
    found = F.coalesce(*options, *singles)
    return F.struct(F.least(found["a"], found["b"]).alias("first"), F.greatest(found["a"], found["b"]).alias("last"))


def year_reply(text: Column) -> Column:
    """The same for a reply to a question for years; replies like "all" name none."""
    none = F.lower(F.trim(text)).isin(NO_YEARS)
    r = year_range(text)
    return F.struct(F.when(~none, r["first"]).alias("first"), F.when(~none, r["last"]).alias("last"))


def clamped_years(first: Column, last: Column, court: Column, as_of: int) -> Column:
    """Years within a court's time: KHO from 1946, others from 1926."""
    start = F.when(court == "KHO", 1946).otherwise(1926)
    return F.struct(F.greatest(first, start).alias("first"), F.least(last, F.lit(as_of)).alias("last"))


def case_ids(text: Column) -> Column:
    """All identifiers named in a text in one spelling: Finnish ones, those with volumes, ECLI, EU and ECHR."""
    grab = lambda p, g=0: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    part = lambda x, p, n: F.upper(F.regexp_extract(x, p, n))
    finnish = F.transform(grab(FINNISH_ID), lambda x: F.concat_ws(":", part(x, FINNISH_PARTS, 1), part(x, FINNISH_PARTS, 2), part(x, FINNISH_PARTS, 3)))
    volumes = F.transform(grab(VOLUME_ID), lambda x: F.concat(part(x, VOLUME_PARTS, 1), F.lit(":"), part(x, VOLUME_PARTS, 2), F.lit("-"), part(x, VOLUME_PARTS, 3), F.lit("-"), part(x, VOLUME_PARTS, 4)))
    return F.coalesce(F.array_distinct(F.concat(finnish, volumes, grab(ECLI_EU, 1), grab(EU_NUMBER, 1), grab(ECHR_NUMBER, 1))), F.array().cast("array<string>"))


def eu_case(raw: Column) -> Column:
    """court_type, case_number and ecli of an EU identifier, null where it is none."""
    ecli, echr = _group(raw, r"\b(ECLI:EU:[CT]:\d{4}:\d+)\b"), _group(raw, ECHR_NUMBER)
    c, t = _group(raw, r"\b(C-\d+/\d{2,4})\b"), _group(raw, r"\b(T-\d+/\d{2,4})\b")
    made = lambda court, number, e: F.struct(court.alias("court_type"), number.alias("case_number"), e.alias("ecli"))
    none = F.lit(None).cast("string")
    court = F.when(F.contains(ecli, F.lit("EU:C:")), "cjeu").otherwise("general_court")
    return F.when(ecli.isNotNull(), made(court, ecli, ecli)).when(c.isNotNull(), made(F.lit("cjeu"), c, none)).when(t.isNotNull(), made(F.lit("general_court"), t, none)).when(echr.isNotNull(), made(F.lit("echr"), echr, none))


def celex(number: Column) -> Column:
    """C-311/18 as 62018CJ0311; years of two digits turn at 50."""
    p = r"^([CT])-(\d+)/(\d{2,4})"
    y = _group(number, p, 3)
    year = F.when(F.length(y) == 2, full_year(y.cast("int"), 50)).otherwise(y.cast("int")).cast("string")
    code = F.when(_group(number, p, 1) == "C", "CJ").otherwise("TJ")
    n = _group(number, p, 2)
    return F.when(number.rlike(p), F.concat(F.lit("6"), year, code, F.when(F.length(n) < 4, F.lpad(n, 4, "0")).otherwise(n)))


def eu_url(court: Column, number: Column, celex_id: Column) -> Column:
    """The public page of an EU decision (F16)."""
    curia = F.concat(F.lit("https://curia.europa.eu/juris/liste.jsf?num="), number, F.lit("&language=en"))
    lex = F.concat(F.lit("https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:"), celex_id)
    return F.coalesce(F.when(court.isin("cjeu", "general_court"), F.coalesce(lex, curia)).when(court == "echr", F.concat(F.lit("https://hudoc.echr.coe.int/eng?i="), number)), F.lit(""))


def statute_uri(uri: Column) -> Column:
    """category, type, year, number and language of a statute's URI."""
    parts = F.split(uri, "/")
    at = F.array_position(parts, F.lit("akn")).cast("int")
    p = lambda k: F.get(parts, at + k)  # noqa: E731  the parts behind akn / fi
    return F.struct(p(1).alias("category"), p(2).alias("type"), p(3).cast("int").alias("year"), p(4).alias("number"), _group(uri, r"/([a-z]{2,3})@").alias("language"))


def content_hash(case_id: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(case_id, F.lit("")), F.coalesce(text, F.lit(""))), 256)


def without_tags(text: Column) -> Column:
    """Text without tags, six entities decoded in order."""
    out = F.regexp_replace(text, "<[^>]+>", "")
    for a, b in ENTITIES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def collapsed(text: Column, n: int) -> Column:
    return F.left(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(n))


def query_type(text: Column) -> Column:
    """What a query asks about."""
    low = F.lower(text)
    out = F.when(text.rlike(STATUTE) | low.rlike(CHAPTER_SECTION), "statute_interpretation")
    for name, words in QUERY_WORDS:
        out = out.when(low.rlike("|".join(words)), name)
    return F.coalesce(out, F.lit("general"))


def any_of(text: Column, words: list[str]) -> Column:
    """Whether one of the words is a part of the text, regardless of case."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w))


def clarification(text: Column, markers: list[str]) -> Column:
    """A message that asks back: it has a marker, or is short and has a question mark."""
    return any_of(text, markers) | ((F.length(text) < 180) & F.contains(text, F.lit("?")))


def intent(label: Column, labels: list[str], default: str) -> Column:
    """The first of ``labels`` that a noisy answer holds."""
    out = F.lit(default)
    for x in reversed(labels):
        out = F.when(F.contains(F.lower(label), F.lit(x)), x).otherwise(out)
    return out


def outcome(text: Column) -> Column:
    """The outcome by the 500 characters behind the judgment's heading."""
    first, second = (F.locate(h, text) for h in JUDGMENT_HEADINGS)
    at = F.when(first > 0, first).otherwise(second)
    part = F.substring(text, at + 15, F.lit(500))
    out = None
    for name, a, b in OUTCOMES:
        test = part.rlike(f"(?iu){a}") & (part.rlike(f"(?iu){b}") if b else F.lit(True))
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.when(at > 0, out)


def title_keywords(title: Column) -> Column:
    return F.filter(F.transform(F.split(title, " - "), lambda x: F.trim(x)), lambda x: F.length(x) > 2)


def split_keywords(words: Column) -> Column:
    """An array whose only element is a list of words, as those words (F32)."""
    only = F.get(words, F.lit(0))
    return F.when((F.size(words) == 1) & F.contains(only, F.lit(",")), F.split(only, ", ")).otherwise(words)


def safe_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._\-]+", "_"), r"^_+|_+$", "")


def extension(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def compacted(text: Column, n: int = 1400) -> Column:
    """The first characters, cut behind a whole word."""
    return F.when(F.length(text) <= n, text).otherwise(F.regexp_replace(F.left(text, F.lit(n)), r"\s+\S*\z", ""))


def score_light(score: Column) -> Column:
    """A score from 1 to 5 as a traffic light."""
    s = F.least(F.greatest(score, F.lit(1)), F.lit(5))
    return F.when(s >= 4, "green").when(s >= 3, "yellow").otherwise("red")


def confidence(n_chars: Column, pages: Column) -> Column:
    """How complete a document's text is: characters by 350 a page, at most 1."""
    return F.round(F.least(n_chars / (F.greatest(pages, F.lit(1)) * 350), F.lit(1.0)), 4)


def mini_metadata(text: Column) -> Column:
    """Dates, amounts in euro and up to ten capitalised phrases, sorted."""
    grab = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0))))
    return F.struct(grab(r"\d{1,2}\.\d{1,2}\.\d{4}").alias("dates"), grab(r"€\s?\d[\d.,]*").alias("amounts"), F.slice(grab(r"[A-Z][a-z]+ [A-Z][a-z]+"), 1, 10).alias("phrases"))


def text_language(code: Column) -> Column:
    """A detected language as one of those written: et as fi, no and da as sv, others fi."""
    return F.when(code.isin("en", "fi", "sv"), code).when(code.isin("no", "da"), "sv").otherwise("fi")


def strictness(text: Column, strict: list[str], lenient: list[str]) -> Column:
    """1, 0 or -1: whether strict or lenient words are more."""
    n = lambda words: sum((F.contains(F.lower(text), F.lit(w)).cast("int") for w in words), F.lit(0))
    return F.signum(n(strict) - n(lenient)).cast("int")


def without_lines(text: Column, pattern: str) -> Column:
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike(pattern)), "\n")


def header_parts(answer: Column) -> Column:
    """The ``##`` sections of an answer: title and body."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), answer), r"\n##\s+"), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, "\n", 1).alias("title"), F.trim(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).alias("body")))


def search_text(*columns: Column) -> Column:
    """The text that metadata search looks at."""
    return F.concat_ws(" ", *columns)


def court_scope(text: Column) -> Column:
    """The court that a question is limited to: KKO or KHO where it names only one of them."""
    kko, kho = text.rlike(r"(?i)\bKKO\b|korkein oikeus|supreme court"), text.rlike(r"(?i)\bKHO\b|korkein hallinto-oikeus|supreme administrative court")
    return F.when(kko & ~kho, "KKO").when(kho & ~kko, "KHO")


def case_page(case_id: Column, base: str, directories: dict[str, str], subtype: Column) -> Column:
    """The page of a decision: null unless its id has court, year and number and its subtype a directory."""
    p = id_parts(case_id)
    directory = F.create_map(*[F.lit(x) for kv in directories.items() for x in kv])[subtype]
    # Concatenation gives null where a part is missing.
    return F.concat(F.lit(base + "/"), F.lower(p["court"]), F.lit("/"), directory, F.lit("/"), p["year"].cast("string"), F.lit("/"), p["number"].cast("string"))

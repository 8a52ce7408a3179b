"""Extraction from the texts of decisions: header fields, votes, citations, sections and provisions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from corpusq.functions import legal as P
from corpusq.functions import scalars as S
from corpusq.sources.shared import small
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Headings that begin a section, by its type, in the order of the types. Fixed values.
HEADINGS = [
    ("lower_court", "Hearing of the case in lower courts|Asian käsittely alemmissa oikeuksissa|Previous handling of the case|Asian käsittely"),
    ("appeal_court", "Appeal to the Supreme Court|Muutoksenhaku Korkeimmassa oikeudessa|Additional appeal to the Supreme Court"),
    ("supreme_decision", "Supreme Court decision|Korkeimman oikeuden ratkaisu"),
    ("reasoning", "Reasoning|Perustelut|Pääasiaratkaisun perustelut|Korkeimman oikeuden kannanotot|Johtopäätös"),
    ("background", "Background of the matter|Asian tausta|Asian tausta ja kysymyksenasettelu"),
    ("legislation", "Legislation|Lainsäädäntö|Sovellettava (?:lainsäädäntö|säännös)|Applicable (?:law|provision)"),
    ("question", "Question(?:ing)? (?:in the Supreme Court|before the court)?|Kysymyksenasettelu (?:Korkeimmassa oikeudessa)?"),
    ("judgment", "Judgment|Tuomiolauselma|Päätöslauselma|Päätös"),
    ("dissenting", "Statement of (?:a )?dissenting member|Eri mieltä olevan jäsenen lausunto|Eri mieltä olevien jäsenten lausunnot"),
]
#: Section types that are stored; the others become ``other``. Fixed values.
STORED_TYPES = ["background", "lower_court", "appeal_court", "reasoning", "judgment", "other"]
#: Headings that end the block of keywords. Fixed values.
KEYWORDS_END = "Case year|Tapausvuosi|Date of issue|Antopäivä|Language versions|Kieliversiot|Kausi|Päiväkirjanumero"
#: Citations in the body of a decision. Fixed values.
KKO_CITE, EU_CITE = r"(?i)KKO\s+(\d{4})\s*:\s*(\d+)", r"\b(C-\d+/\d+)\b"
CRIMINAL_CODE = r"(?i)(?:RL|Rikoslaki)\s+(?:Chapter\s+)?(\d+)\s*(?:Section\s+)?(\d+)"
LAW_CHAPTER = r"(?i)(?:Chapter|Luku)\s+(\d+)\s*,?\s*(?:Section|§)\s*(\d+[a-z]?)"
EU_REGULATION = r"(?i)(Council\s+Regulation\s+\(EU\)\s+No\s+\d+/\d+(?:\s+[^.]*?)?(?=\s*[,.]|$)|Regulation\s+\(EU\)\s+(?:No\s+)?\d+/\d+)"
SECTION = T.ArrayType(T.StructType().add("type", "string").add("title", "string").add("content", "string"))


def _mapped(df: DataFrame, columns: Sequence[str], out: str, kind: T.DataType, f: Callable) -> DataFrame:
    """Adds ``out``, made by ``f`` from the values of ``columns``, a small slice of a batch at once."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])
    at = [df.columns.index(c) for c in columns]
    arrow = pa_type(kind)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            made = [f(*x) for x in zip(*(b.column(i).to_pylist() for i in at), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, arrow)], [*b.schema.names, out])

    return df.mapInArrow(rows, schema)


def pa_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def split_text(text: str | None, mode: str = "position", empty: bool = False) -> list[dict]:
    """Sections by their headings. With mode ``position`` a section ends where the next heading stands; with
    ``reference`` only headings of later types in the list end it, so sections may overlap. Headings without content
    make no section, unless ``empty``."""
    text = text or ""
    found = []
    for kind, words in HEADINGS:
        if m := re.search(rf"^(?:{words})\s*$", text, re.IGNORECASE | re.MULTILINE):
            found.append((m.start(), m.end(), kind, m.group().strip()))
    out = []
    for i, (start, end, kind, title) in enumerate(found):
        after = [s for s, *_ in found if s > start] if mode == "position" else [start + 1 + m.start() for _, words in HEADINGS[[k for k, _ in HEADINGS].index(kind) + 1 :] if (m := re.search(rf"^(?:{words})\s*$", text[start + 1 :], re.IGNORECASE | re.MULTILINE))]
        content = text[end : min(after, default=len(text))].strip()
        if content or empty:
            out.append((i, start, {"type": kind, "title": title, "content": content}))
    return [x for *_, x in sorted(out, key=lambda x: x[1] if mode == "position" else x[0])]


def sections(df: DataFrame, text_col: str, mode: str = "position", empty: bool = False) -> DataFrame:
    """Adds ``sections`` (E9, E10), with ``empty`` also those without content. A text without headings of their own lines, but
    with a reasoning and a judgment among others, has the reasoning between the two; else it is one section ``other`` of
    50,000 characters at most."""
    inner = [re.compile(rf"\n\s*(?:{w})\s*\n", re.IGNORECASE) for w in ("Reasoning|Perustelut|Pääasiaratkaisun perustelut|Johtopäätös", "Judgment|Tuomiolauselma|Päätöslauselma|Päätös")]

    def made(text):
        found = split_text(text, mode, empty)
        if found or not (text or "").strip():
            return found
        begin, end = (p.search(text) for p in inner)
        if begin and end and text[begin.end() : end.start()].strip():
            return [{"type": "reasoning", "title": "Reasoning", "content": text[begin.end() : end.start()].strip()}]
        return [{"type": "other", "title": "Full text", "content": text.strip()[:50_000]}]

    return _mapped(df, [text_col], "sections", SECTION, made)


def marked_sections(df: DataFrame, text_col: str, markers: Sequence[tuple[str, str]]) -> DataFrame:
    """Adds ``sections`` cut at the markers found, in their order in the text; what stands before the first is a
    ``background`` if it has over 100 characters; without markers all is ``reasoning`` (E12)."""

    def made(text):
        text = text or ""
        at = sorted((m.start(), kind, m.group()) for kind, p in markers if (m := re.search(p, text, re.IGNORECASE | re.MULTILINE)))
        if not at:
            return [{"type": "reasoning", "title": "", "content": text.strip()}] if text.strip() else []
        out = [{"type": "background", "title": "", "content": text[: at[0][0]].strip()}] if len(text[: at[0][0]].strip()) > 100 else []
        for (start, kind, title), end in zip(at, [*(a[0] for a in at[1:]), len(text)], strict=True):
            out.append({"type": kind, "title": title.strip(), "content": text[start + len(title) : end].strip()})
        return out

    return _mapped(df, [text_col], "sections", SECTION, made)


def sufficient(sections_col: str, text_col: str) -> Column:
    """Whether sections cover nine tenths of the text and none is empty."""
    n = F.aggregate(sections_col, F.lit(0), lambda a, s: a + F.length(s["content"]))
    return (F.size(sections_col) > 0) & (n >= 0.9 * F.length(text_col)) & F.forall(sections_col, lambda s: F.trim(s["content"]) != "")


def stored_sections(sections_col: str) -> Column:
    """Sections with types that the table stores."""
    return F.transform(sections_col, lambda s: F.struct(F.when(s["type"].isin(STORED_TYPES), s["type"]).otherwise("other").alias("type"), s["title"].alias("title"), s["content"].alias("content")))


def judges(text: Column) -> Column:
    """names and rapporteur of the closing line."""
    p = r"(?is)(?:The case has been resolved|The matter has been resolved|Asian on käsitellyt)\s+by\s+(.+?)\s*\.\s*Rapporteur\s+([A-Za-zäöåÄÖÅ\- ]+)"
    names = F.transform(F.split(F.regexp_extract(text, p, 1), r"\s+and\s+|\s*,\s*"), lambda n: F.trim(F.regexp_replace(n, "legal advisors|Legal Counselors|President", "")))
    last = F.coalesce(F.nullif(F.trim(F.regexp_extract(text, p, 2)), F.lit("")), F.trim(F.regexp_extract(F.right(text, F.lit(2000)), r"(?im)Rapporteur\s+([A-Za-zäöåÄÖÅ\- ]+)\s*\.?\s*$", 1)))
    return F.struct(F.filter(names, lambda n: F.length(n) > 2).alias("names"), last.alias("rapporteur"))


def _named_vote(text: Column, pattern: str) -> Column:
    a, b, c = (F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("int") for i in (1, 2, 3))
    third = F.nullif(c, F.lit(0))
    strength = F.concat_ws("-", a.cast("string"), b.cast("string"), third.cast("string"))
    return F.when(a.isNotNull(), F.struct((a + b + F.coalesce(third, F.lit(0))).alias("total"), b.alias("dissenting"), strength.alias("strength")))


def _counted_vote(n: Column, d: Column) -> Column:
    return F.when(n > 0, F.struct(n.alias("total"), d.alias("dissenting"), F.concat_ws("-", (n - d).cast("string"), d.cast("string")).alias("strength")))


def vote(text: Column) -> Column:
    """total, dissenting and strength (E4): from the vote that the text names, else from its line of judges with those of
    another mind, else from an older line with the members whose opinions follow, else from the judges who are named and
    whether a dissenting section is there."""
    members = lambda p, cut, least: F.filter(F.transform(F.split(F.regexp_extract(text, p, 1), cut), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.length(x) >= least)
    line = F.filter(members(P.JUDGES_LINE, r",\s*|\s+ja\s+", 4), lambda x: ~x.rlike(P.NO_JUDGE))
    short = lambda p: F.length(F.regexp_extract(text, p, 1)) <= 2000
    lined = F.when(short(P.JUDGES_LINE), _counted_vote(F.size(line), F.size(F.filter(line, lambda x: x.rlike(P.OTHER_MIND)))))
    n = F.size(members(P.OLD_JUDGES_LINE, r",\s*|\s+(?:ja|sekä)\s+", 3))
    d = F.when(text.rlike(P.DISSENTERS), F.greatest(F.lit(1), F.regexp_count(text, F.lit(P.DISSENT_NAMED)))).otherwise(0)
    old = F.when(short(P.OLD_JUDGES_LINE), _counted_vote(n, F.when(n - d < 1, 0).otherwise(d)))
    named = F.size(judges(text)["names"])
    return F.coalesce(*[_named_vote(text, p) for p in P.VOTES], lined, old, _counted_vote(named, F.when(text.rlike(P.DISSENT_SECTION), 1).otherwise(0)))


def outcome(text: Column) -> Column:
    """The outcome that a decision's text names."""
    found = None
    for name, pattern in P.OUTCOMES:
        found = F.when(text.rlike(pattern), name) if found is None else found.when(text.rlike(pattern), name)
    return found.otherwise(P.NO_OUTCOME)


def _court(text: Column, pattern: str) -> Column:
    """name (what stands in the line before), date and number. The name is taken from what precedes the match: a pattern that
    began with any characters would try each place of a long line with each other."""
    g = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    before = F.left(text, F.regexp_instr(text, F.lit(pattern)) - 1)
    line = F.element_at(F.split(F.regexp_replace(before, r"\s+$", ""), "\n"), -1)
    return F.struct(F.when(g(1).isNotNull() & before.rlike(r"\s\z"), F.nullif(line, F.lit(""))).alias("name"), g(1).alias("date"), g(2).alias("number"))


def lower_court(text: Column) -> Column:
    """name, date and number of the first court's judgment (E5)."""
    return _court(text, P.DISTRICT_COURT)


def appeal_court(text: Column) -> Column:
    """name, date and number of the court of appeal's judgment (E5)."""
    return _court(text, P.APPEAL_COURT)


def citations(text: Column, own: Column | None = None) -> Column:
    """cases, eu_cases, laws (100 at most), regulations (30 at most) and articles of regulations, each once, in the order of
    the text (E6). A text is looked through once for each pattern; parts are taken from what was found."""
    grab = lambda p, i=0: F.regexp_extract_all(text, F.lit(p), F.lit(i))
    pair = lambda p, a, b: F.transform(grab(p), lambda x: F.concat(F.lit(a), F.regexp_extract(x, p, 1), F.lit(b), F.regexp_extract(x, p, 2)))
    cases = F.array_distinct(pair(KKO_CITE, "KKO:", ":"))
    if own is not None:
        cases = F.filter(cases, lambda c: c != own)
    laws = F.slice(F.array_distinct(F.concat(pair(CRIMINAL_CODE, "RL ", ":"), pair(LAW_CHAPTER, "Chapter ", " Section "))), 1, 100)
    part = lambda x, i: F.regexp_extract(x, P.REGULATION_ARTICLE, i)
    articles = F.array_distinct(F.transform(grab(P.REGULATION_ARTICLE), lambda x: F.concat(F.lit("Article "), part(x, 1), F.when(part(x, 2) != "", F.concat(F.lit("("), part(x, 2), F.lit(")"))).otherwise(""))))
    return F.struct(cases.alias("cases"), F.array_distinct(grab(EU_CITE, 1)).alias("eu_cases"), laws.alias("laws"), F.slice(F.array_distinct(grab(EU_REGULATION, 1)), 1, 30).alias("regulations"), articles.alias("articles"))


def header_laws(text: Column, most: int = 2000) -> Column:
    """The lines of the first ``most`` characters that name a section of a law, each once."""
    lines = F.transform(F.split(F.left(text, F.lit(most)), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_distinct(F.filter(lines, lambda x: x.contains("§")))


def reference_edges(df: DataFrame, id_col: str, cited: str) -> DataFrame:
    """source, referenced_id, reference_type: each citation once."""
    kinds = [("cases", "cited_case"), ("eu_cases", "eu_case"), ("laws", "cited_law"), ("regulations", "cited_regulation")]
    each = [F.transform(F.col(cited)[c], (lambda k: lambda x: F.struct(x.alias("referenced_id"), F.lit(k).alias("reference_type")))(k)) for c, k in kinds]
    return df.select(F.col(id_col).alias("source"), F.explode(F.concat(*each)).alias("e")).select("source", "e.*").distinct()


#: Letters besides the two cases that are equal to a letter where a pattern ignores case.
FOLDED = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}


def begins(pairs: Mapping[str, str]) -> str:
    """A look ahead at two letters, a first one to all its second ones, in any case. It is compared by sets of characters, which
    is many times faster than letters whose case is ignored."""
    of = lambda letters: "[" + "".join(c.lower() + c.upper() + FOLDED.get(c, "") for c in letters) + "]"
    return f"(?-iu:(?={of(pairs)})(?={'|'.join(of(a) + of(b) for a, b in pairs.items())}))"


def phrases(text: Column, patterns: Sequence[str], least: int, budget: int, joined: str = " | ", begin: Mapping[str, str] | None = None) -> Column:
    """Distinct matches of at least ``least`` characters in the order of the text, as many as fit in ``budget``
    characters with what joins them (E13, E14). ``begin``: the letters that all patterns begin with, for ``begins``."""
    pattern = "(?isu)" + (begins(begin) if begin else "") + "(?:" + "|".join(f"({p})" for p in patterns) + ")"
    every = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    kept = F.filter(F.array_distinct(every), lambda x: F.length(x) >= least)
    empty = F.struct(F.array().cast("array<string>").alias("a"), F.lit(0).alias("n"), F.lit(False).alias("full"))
    size = lambda x: F.length(x) + len(joined)
    step = lambda s, x: F.when(s["full"] | (s["n"] + size(x) > budget), F.struct(s["a"].alias("a"), s["n"].alias("n"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(s["a"], F.array(x)).alias("a"), (s["n"] + size(x)).alias("n"), F.lit(False).alias("full")))
    return F.array_join(F.aggregate(kept, empty, step, lambda s: s["a"]), joined)


def exceptions(text: Column) -> Column:
    """Sentences that except or limit."""
    return phrases(text, P.EXCEPTIONS, 20, 2000, begin=P.EXCEPTIONS_BEGIN)


def distinctive_facts(text: Column) -> Column:
    """Sentences that name what decided."""
    return phrases(text, P.FACTS, 15, 1500, begin=P.FACTS_BEGIN)


def _section_text(text: Column, kind: str) -> Column:
    """What stands behind the first heading of a kind up to the first of any other kind; null without one."""
    own = dict(HEADINGS)[kind]
    others = "|".join(w for k, w in HEADINGS if k != kind)
    heading = rf"(?imu)^(?:{own})\s*$"
    return F.when(text.rlike(heading), F.regexp_extract(text, rf"(?imsu)^(?:{own})\s*?$(.*?)(?=^(?:{others})\s*?$|\z)", 1))


def _squeezed(text: Column, most: int) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " "), F.lit(most))


def reasoning_excerpt(text: Column, most: int = 1500) -> Column:
    """The beginning of the reasoning section, else of what stands for it in older decisions, if over 40 characters."""
    out = _squeezed(_section_text(text, "reasoning"), most)
    for p in P.OLD_REASONING:
        flags, body = p[: p.index(")") + 1].replace(")", "s)"), p[p.index(")") + 1 :]
        part = _squeezed(F.regexp_extract(text, rf"{flags}(?:{body})(.*?)(?={P.OLD_REASONING_END.removeprefix('(?iu)')}|\z)", 1), most)
        out = F.coalesce(out, F.when(F.length(part) > 40, part))
    return F.coalesce(out, F.lit(""))


def ruling_instruction(text: Column, most: int = 600) -> Column:
    """The beginning of the judgment section, else an abstract of over 30 characters, else the first paragraph behind the
    keywords of over 40 (E16)."""
    abstract = _squeezed(F.regexp_extract(text, P.ABSTRACT, 1), most)
    behind = F.regexp_extract(text, rf"(?imsu)^\s*(?:{KEYWORDS_END})\s*$(.*)", 1)
    paragraphs = F.transform(F.split(behind, r"\n\s*\n", 6), lambda x: _squeezed(x, 10**6))
    first = F.get(F.filter(paragraphs, lambda x: (F.length(x) > 40) & ~x.rlike(P.NO_ABSTRACT)), F.lit(0))
    return F.coalesce(_squeezed(_section_text(text, "judgment"), most), F.when(F.length(abstract) > 30, abstract), F.left(first, F.lit(most)), F.lit(""))


def excerpt(text: Column, heading: str, end: str, most: int) -> Column:
    """The text behind a heading up to the next one, ``most`` characters of it."""
    part = F.regexp_replace(F.regexp_extract(text, rf"(?ims)^(?:{heading})\s*$(.+?)(?=^(?:{end})\s*$|\Z)", 1), r"^\s+|\s+$", "")
    return F.nullif(F.left(part, F.lit(most)), F.lit(""))


def near_digits(text: Column) -> Column:
    """A text in which, of each eight or more words in a row without a digit, only the first three and the last four are
    sure to stay; a sign that no pattern has stands for the others. References to provisions that have a digit have at most
    three words before it and one behind, so they are found there as in the whole text, in the same order."""
    word = r"[^\d\s]++\s++"
    # Stretches are bounded, as repeated groups take stack.
    return F.regexp_replace(text, rf"((?:{word}){{3}})(?:{word}){{1,200}}(?=(?:{word}){{4}})", "$1\u0001 ")


def provisions(text: Column, most: int = 30) -> Column:
    """References to provisions in their common form, pattern by pattern, each once."""
    return F.get(F.transform(F.array(near_digits(text)), lambda t: _provisions(t, most)), F.lit(0))


def _provisions(text: Column, most: int) -> Column:
    grab = []
    for pattern, form in P.PROVISIONS:
        groups = sorted({int(n) for n in re.findall(r"\{(\d)\}", form)})
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        found = F.transform(whole, (lambda pattern, groups: lambda x: F.struct(*[F.regexp_extract(x, pattern, n).alias(f"g{n}") for n in groups]))(pattern, groups))
        filled = lambda x, form: F.concat(*[x[f"g{part[1]}"] if part.startswith("{") else F.lit(part) for part in re.split(r"(\{\d\})", form) if part])
        whole, _, bare = form.partition("|")
        # Where the second group is empty, the form without it holds.
        grab.append(F.transform(found, (lambda whole, bare: lambda x: F.when(x["g2"] == "", filled(x, bare)).otherwise(filled(x, whole)) if bare else filled(x, whole))(whole, bare)))
    return F.slice(F.array_distinct(F.concat(*grab)), 1, most)


def applied_provisions(text: Column, most: int = 800) -> Column:
    """The references of the reasoning section (else of what follows the court's name, else of the text), joined."""
    old = F.when(text.rlike(P.OLD_PROVISIONS), F.regexp_extract(text, P.OLD_PROVISIONS.replace("(?imu)", "(?imsu)") + "(.*)", 1))
    block = F.coalesce(_section_text(text, "reasoning"), old, text)
    return F.left(F.array_join(provisions(block), ", "), F.lit(most))


def provision_report(text: Column) -> Column:
    """provisions (as they stand, sorted), statutes (sorted) and confidence: a tenth for each provision, up to 1, with
    0.15 at most for statutes (E18)."""
    # Only conventions are named without a digit.
    named = F.regexp_extract_all(text, F.lit(P.ANY_PROVISION[-1]), F.lit(0))
    return F.get(F.transform(F.array(F.struct(near_digits(text).alias("near"), named.alias("named"))), lambda x: _report(x["near"], x["named"])), F.lit(0))


def _report(text: Column, named: Column) -> Column:
    grab = lambda p, i: F.regexp_extract_all(text, F.lit(p), F.lit(i))
    sections = F.zip_with(grab(P.STATUTE_SECTION, 1), grab(P.STATUTE_SECTION, 2), lambda a, b: F.concat(a, F.lit(" § "), b))
    found = F.array_sort(F.array_distinct(F.concat(*[grab(p, 0) for p in P.ANY_PROVISION[:-1]], named, sections)))
    statutes = F.array_sort(F.array_distinct(grab(P.STATUTE_SECTION, 1)))
    n = F.least(F.size(found) / F.lit(10), F.lit(1.0)) + F.least(F.size(statutes) / F.lit(5), F.lit(0.15))
    return F.struct(found.alias("provisions"), statutes.alias("statutes"), F.when(F.size(found) == 0, 0.0).otherwise(F.round(F.least(n, F.lit(1.0)), 4)).alias("confidence"))


CONTEXT = T.ArrayType(T.StructType().add("position", "integer").add("provision", "string").add("context", "string"))


def provision_contexts(df: DataFrame, text_col: str, around: int = 150) -> DataFrame:
    """Adds ``contexts``: each reference with its place and the text around it."""

    def made(text):
        text = text or ""
        at = {(m.start(), m.group()) for p in P.ANY_PROVISION for m in re.finditer(p, text)}
        return [{"position": s, "provision": g, "context": text[max(0, s - around) : s + len(g) + around]} for s, g in sorted(at)]

    return _mapped(df, [text_col], "contexts", CONTEXT, made)


def header(text: Column) -> Column:
    """ecli, diary, volume, year, date and keywords from the first 4,000 characters, and the outcome from all of the text
    (E1, E2)."""
    head = F.left(text, F.lit(4000))
    grab = lambda p: F.nullif(F.trim(F.regexp_extract(head, p, 1)), F.lit(""))
    block = F.regexp_extract(head, r"(?ims)^\s*(?:Keywords|Asiasanat)\s*$(.{0,800}?)(?=^\s*(?:" + KEYWORDS_END + r")\s*$|\Z)", 1)
    words = F.slice(F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, 50)
    english = S.english_date(grab(r"(?i)(?:Date of issue|Antopäivä)\s*\n\s*([A-Z][a-z]+\s+\d{1,2},?\s+\d{4})"))
    numeric = S.iso_date(grab(r"(?i)(?:Date of issue|Antopäivä)\s*\n\s*(\d{1,2}\.\d{1,2}\.\d{4})"))
    return F.struct(
        grab(r"(?i)(ECLI\s*:\s*FI\s*:\s*KKO\s*:\s*\d{4}\s*:\s*\d+)").alias("ecli"), grab(r"(?i)(?:Diary number|Päiväkirjanumero|Dnro)\s*\n\s*([A-Z]?\s*\d+/\d+(?:/\d+)?)").alias("diary"),
        grab(r"(?i)(?:Volume|Taltio)\s*\n\s*([^\n]+)").alias("volume"), grab(r"(?i)(?:Case year|Kausi)\s*\n\s*(\d{4})").cast("int").alias("year"), F.coalesce(english, numeric).alias("date"), words.alias("keywords"), outcome(text).alias("outcome"),
    )


def line_kinds(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line, kind: what each line of a text is."""
    lines = df.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("line", "t"))
    t = F.trim("t")
    heading = t.rlike("(?i)^(?:" + "|".join(w for _, w in HEADINGS) + ")$")
    kind = F.when(t == "", "blank").when(heading, "section_heading").when(t.rlike("(?i)^asian ovat ratkaisseet|^the (?:case|matter) has been resolved"), "judge_line").when(t.rlike(r"^\d+\.\s"), "numbered").when(t.rlike(r"\d+\s*§|" + S.STATUTE), "law_ref")
    return lines.select(id_col, "line", kind.when((F.length(t) < 60) & ~t.rlike(r"[.;:,]$"), "sub_heading").otherwise("body").alias("kind"))


def merged_extraction(df: DataFrame, extracted: str, overwrite: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """Columns from the struct ``extracted``: some replace what is there where they have a value, others fill what is empty."""
    new = {c: F.coalesce(F.nullif(F.col(extracted)[c], F.lit("")), F.col(c)) for c in overwrite}
    new |= {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(extracted)[c]) for c in fill}
    return df.withColumns(new).drop(extracted)


def derived_case_id(title: Column, url: Column, text: Column) -> Column:
    """A decision's id: from its title, else its URL, else its text, else a hash of the URL."""
    first = lambda c: F.get(S.case_ids(c), F.lit(0))
    p = r"/(kko|kho)/(\d{4})/(\d+)"
    by_url = F.when(url.rlike(p), F.concat_ws(":", F.upper(F.regexp_extract(url, p, 1)), F.regexp_extract(url, p, 2), F.regexp_extract(url, p, 3)))
    return F.coalesce(first(title), by_url, first(F.left(text, F.lit(500))), F.concat(F.lit("URL:"), F.left(F.sha2(url, 256), F.lit(16))))


def decision_type(url: Column) -> Column:
    """A decision's type by its URL."""
    found = None
    for kind, pattern in P.URL_TYPES:
        found = F.when(url.rlike(pattern), kind) if found is None else found.when(url.rlike(pattern), kind)
    return found.otherwise("precedent")


def cjeu_sections(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``sections`` of judgments of the Court of Justice."""
    return marked_sections(df, text_col, P.CJEU_MARKERS)


def echr_sections(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``sections`` of judgments of the Court of Human Rights."""
    return marked_sections(df, text_col, P.ECHR_MARKERS)


def background(text: Column, most: int = 2000) -> Column:
    """The text behind the heading of the background, null without one."""
    found = None
    for heading, skip in P.BACKGROUNDS:
        part = F.substring(text, F.locate(heading, text) + skip, F.lit(most))
        found = F.when(text.contains(heading), part) if found is None else found.when(text.contains(heading), part)
    return found


def dissent(text: Column, flag: Column, own: Column, most: int = 2000) -> Column:
    """flag and text of a dissent (D5): both from its section; the flag alone from a mark of the vote; the text of cases
    that are flagged already from the section."""
    section = text.contains(P.OTHER_MIND_SECTION)
    part = F.when(section, F.substring(text, F.locate(P.OTHER_MIND_SECTION, text), F.lit(most)))
    marked = F.lit(False)
    for m in P.OTHER_MIND_MARKS:
        marked = marked | text.contains(m)
    was = F.coalesce(flag, F.lit(False))
    return F.struct((was | section | marked).alias("flag"), F.when(~was & section, part).otherwise(F.coalesce(F.nullif(own, F.lit("")), F.when(was, part), own)).alias("text"))


def eu_document(df: DataFrame) -> DataFrame:
    """case_id, court_type, year and language label of an EU document by celex, ecli, date and lang."""
    court = F.when(F.col("celex").rlike("^6\\d{4}CJ"), "cjeu").when(F.col("celex").rlike("^6\\d{4}TJ"), "general_court")
    return df.withColumns({"court_type": court, "case_year": F.left("date", F.lit(4)).cast("int"), "case_id": F.coalesce(F.nullif("ecli", F.lit("")), F.concat_ws("_", "celex", "lang"))})

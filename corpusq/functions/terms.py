"""Query texts as terms: analysis, key terms, and the OR, AND and prefix forms of a query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that queries are searched without. Fixed values.
STOP_WORDS = (
    "onko voiko oliko miksi miten milloin missä mitä kuka minne mistä mikä kumpi voidaan pitää täytyy saako tuleeko "
    "ja tai vai sekä että mutta kun jos eli niin myös joka kuin koska vaikka siis kuitenkin eikä vain "
    "mukaan kanssa ennen jälkeen yli alle vuoksi perusteella nojalla lisäksi välillä "
    "tämä tuo sen tämän nämä nuo sitä siitä hän hänen he heidän minä sinä me te näiden niiden muun "
    "olla ole ollut oleva ollaan olisi ovat luvun pykälän kohdan momentin kyllä aina jo "
    "tell about what how does the this that which when where please"
).split()
#: Terms longer than this get prefixes, at these shares of their length. Fixed values.
LONG_TERM, PREFIX_SHARES, LEAST_PREFIX = 10, (0.50, 0.65, 0.80), 6


def tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-cased runs of letters and digits (N1); a stemmed column may take their place."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.filter(words, lambda w: ~w.isin(stop_words)) if stop_words else words


def longest_first(words: Column, n: int) -> Column:
    """The ``n`` longest words; among equally long ones those that come first (T5)."""
    keyed = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    return F.slice(F.transform(keyed, lambda x: x["w"]), 1, n)


def key_terms(text: Column, n: int = 5) -> Column:
    """The longest words of a query without stop words, numbers and words of one or two letters."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")
    return longest_first(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS) & ~w.rlike(r"^\p{N}+$")), n)


def or_query(text: Column) -> Column:
    return F.array_join(key_terms(text), " OR ")


def and_terms(text: Column) -> Column:
    """The three longest key terms; none where there are fewer than two."""
    terms = key_terms(text)
    return F.when(F.size(terms) >= 2, F.slice(terms, 1, 3)).otherwise(F.array().cast("array<string>"))


def prefixes(term: Column) -> Column:
    """A term's prefixes at PREFIX_SHARES of its length, six letters at least and three shorter than it at least."""
    lengths = F.array(*[F.greatest(F.lit(LEAST_PREFIX), F.floor(F.length(term) * F.lit(s)).cast("int")) for s in PREFIX_SHARES])
    return F.array_distinct(F.transform(F.filter(lengths, lambda n: n < F.length(term) - 2), lambda n: F.left(term, n)))


def prefix_patterns(text: Column) -> Column:
    """The prefix form of a query as rows (group, pattern, is_prefix).

    Groups 1 and 2 hold the two longest long terms with their prefixes; all must match. Group 0 holds the other terms,
    each of which is a match by itself, as OR binds less than AND."""
    terms = key_terms(text)
    long = F.slice(F.filter(terms, lambda w: F.length(w) > LONG_TERM), 1, 2)
    row = lambda g, p, x: F.struct(g.cast("int").alias("group"), p.alias("pattern"), F.lit(x).alias("is_prefix"))
    groups = F.transform(long, lambda w, i: F.concat(F.array(row(i + 1, w, False)), F.transform(prefixes(w), lambda p: row(i + 1, p, True))))
    rest = F.transform(F.array_except(terms, long), lambda w: row(F.lit(0), w, False))
    return F.concat(F.flatten(groups), rest)


def prefix_query(text: Column) -> Column:
    """The same as one line of text."""
    terms = key_terms(text)
    long = F.slice(F.filter(terms, lambda w: F.length(w) > LONG_TERM), 1, 2)
    one = lambda w: F.concat_ws(" | ", F.array(w), F.transform(prefixes(w), lambda p: F.concat(p, F.lit(":*"))))
    groups = F.transform(long, lambda w: F.when(F.size(prefixes(w)) > 0, F.concat(F.lit("( "), one(w), F.lit(" )"))).otherwise(w))
    core = F.array_join(groups, " & ")
    return F.concat_ws(" | ", F.nullif(core, F.lit("")), F.nullif(F.array_join(F.array_except(terms, long), " | "), F.lit("")))

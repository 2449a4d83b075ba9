"""Names, records and numbers as text. Native column functions; only marks of other scripts and string similarity need Arrow batches."""

from __future__ import annotations

import difflib
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Abbreviations, in the order in which they apply (only before a word character, as a boundary must follow the dot),
#: aliases of whole names, and generational suffixes.
ABBREVIATIONS = (
    ("st.", "state"), ("ga.", "georgia"), ("fla.", "florida"), ("calif.", "california"), ("caro.", "carolina"), ("mich.", "michigan"), ("minn.", "minnesota"),
    ("miss.", "mississippi"), ("tenn.", "tennessee"), ("ky.", "kentucky"), ("la.", "louisiana"), ("colo.", "colorado"), ("wash.", "washington"), ("ore.", "oregon"),
    ("ariz.", "arizona"), ("tex.", "texas"), ("okla.", "oklahoma"), ("ill.", "illinois"), ("ind.", "indiana"), ("conn.", "connecticut"), ("mass.", "massachusetts"),
    ("pa.", "pennsylvania"), ("va.", "virginia"), ("wis.", "wisconsin"), ("neb.", "nebraska"), ("ark.", "arkansas"), ("ala.", "alabama"), ("md.", "maryland"), ("mo.", "missouri"),
    ("n.c.", "north carolina"), ("s.c.", "south carolina"), ("n.m.", "new mexico"), ("n.y.", "new york"), ("northern colo.", "northern colorado"),
)
ALIASES = {"new orleans": "lsu new orleans"}
SUFFIX = r"\b(jr|sr|ii|iii|iv|v)\.?$"
MEDIA = r"(?i)\s+(photo|headshot|image|picture)$"


def norm(name: Column) -> Column:
    """Comparable form of a name: null is empty; lower case, & as and, no apostrophes, other marks as single spaces."""
    x = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), "&", " and ")
    x = F.regexp_replace(x, "'", "")
    for short, long in ABBREVIATIONS:
        x = F.regexp_replace(x, abbreviation(short), long)
    x = F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in ALIASES.items() for v in pair]), x), x)


def abbreviation(short: str) -> str:
    """Pattern of an abbreviation, dots and all."""
    return r"\b" + short.replace(".", r"\.") + r"\b"


def record(text: Column) -> tuple[Column, Column]:
    """Wins and losses of the first '33-1' in a text, null if there is none."""
    part = lambda i: F.regexp_extract(text, r"(\d+)\s*-\s*(\d+)", i).try_cast("int")
    return part(1), part(2)


def number_or_zero(text: Column) -> Column:
    return F.coalesce(F.trim(text).try_cast("int"), F.lit(0))


def number_or_null(text: Column) -> Column:
    """Commas are dropped and fractions cut off; '-' and what is no number give null."""
    x = F.trim(F.regexp_replace(text, ",", ""))
    return F.coalesce(x.try_cast("int"), x.try_cast("double").try_cast("int"))


@F.pandas_udf(StringType())
def strip_accents(text: pd.Series) -> pd.Series:
    """text without combining marks, after compatibility decomposition."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _folds() -> tuple[str, str, str, dict[str, str]]:
    """Characters whose compatibility form without marks is one ASCII character, those characters, marks, and the longer forms that have letters."""
    one, to, marks, more = [], [], [], {}
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1)]):
        if unicodedata.combining(c):
            marks.append(c)
        elif unicodedata.decomposition(c):
            bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if bare.isascii() and len(bare) == 1:
                one.append(c)
                to.append(bare)
            elif bare.isascii() and any("a" <= x <= "z" for x in bare) and " " not in bare:
                more[c] = bare
    return "".join(one), "".join(to), "".join(marks), more


FOLDED, FOLDED_TO, MARKS, LIGATURES = _folds()


def fold(text: Column) -> Column:
    """Lower case without accents, null as empty: the compatibility form without combining marks wherever that is ASCII.

    Native: ligatures and the like are replaced one by one, in texts that have any; one translation does the rest and drops the marks.
    """
    x = F.lower(F.coalesce(text, F.lit("")))
    pairs = F.split(F.lit(" ".join(f"{k}={v}" for k, v in LIGATURES.items())), " ")
    apart = F.aggregate(pairs, x, lambda t, p: F.replace(t, F.left(p, F.lit(1)), F.substr(p, F.lit(3))))
    return F.translate(F.when(x.rlike("[" + "".join(LIGATURES) + "]"), apart).otherwise(x), FOLDED + MARKS, FOLDED_TO)


def letters(text: Column) -> Column:
    return F.regexp_replace(fold(text), "[^a-z]", "")


def without_suffix(folded: Column) -> Column:
    return F.regexp_replace(folded, SUFFIX, "")


def whole_key(first: Column, last: Column) -> Column:
    """Letters of the whole name, wherever it is split, less a generational suffix."""
    return F.regexp_replace(without_suffix(fold(F.concat_ws(" ", first, last))), "[^a-z]", "")


def narrow_key(first: Column, last: Column) -> Column:
    """Letters of both names, a suffix stripped from the last only."""
    return F.concat_ws("|", letters(first), F.regexp_replace(without_suffix(fold(last)), "[^a-z]", ""))


def tokens(text: Column) -> Column:
    """Words of letters, less a generational suffix at the end."""
    return F.filter(F.split(without_suffix(fold(text)), "[^a-z]+"), lambda t: t != "")


def without_media(text: Column) -> Column:
    return F.regexp_replace(text, MEDIA, "")


def first_and_rest(name: Column) -> tuple[Column, Column]:
    """The first word and the rest; empty is null."""
    x = F.trim(name)
    return F.nullif(F.substring_index(x, " ", 1), F.lit("")), F.nullif(F.trim(F.regexp_replace(x, r"^\S*", "")), F.lit(""))


def freshman(year: Column) -> Column:
    return F.lower(F.coalesce(year, F.lit(""))).rlike("^(fr|redshirt fr|r-fr)")


def mechanism(text: Column, tournament: str, season: str) -> Column:
    """TOURNAMENT, REGULAR_SEASON or AMBIGUOUS by two patterns, null if neither fits."""
    t, s = text.rlike(tournament), text.rlike(season)
    return F.when(t & s, "AMBIGUOUS").when(t, "TOURNAMENT").when(s, "REGULAR_SEASON")


def platform(html: Column, marks: tuple[tuple[str, str], ...]) -> Column:
    """The name of the first mark, a substring, that the page has."""
    return F.coalesce(*[F.when(html.contains(m), name) for m, name in marks], F.lit("unknown"))


def utc_date(epoch: Column) -> Column:
    return F.to_date(F.timestamp_seconds(epoch.try_cast("bigint")))


def script_safe(json: Column) -> Column:
    """JSON text that may stand in a script element."""
    return F.replace(json, F.lit("</"), F.lit("<\\/"))


def content_name(body: Column) -> Column:
    """The first 12 hex digits of the content's SHA-1."""
    return F.substring(F.sha1(body.cast("binary")), 1, 12)


def title_case(text: Column, acronyms: tuple[str, ...] = ()) -> Column:
    out = F.initcap(text)
    for a in acronyms:
        out = F.regexp_replace(out, rf"\b{a.capitalize()}\b", a)
    return out

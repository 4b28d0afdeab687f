"""Text columns: folding, slugs, identifiers, dates and hashes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens of club names that carry no identity; fixed values.
CLUB_TOKENS = ("fc", "cf", "afc", "sc", "the")


@F.pandas_udf(T.StringType())
def strip_accents(text: pd.Series) -> pd.Series:
    """Compatibility-decomposed text without combining marks; there is no built-in for it."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def normalize(text: Column, drop: tuple[str, ...] = CLUB_TOKENS, ampersand: bool = True, fold: bool = True) -> Column:
    """Lower-case words of letters and digits, accents folded, "&" as "and", ``drop`` tokens left out."""
    out = F.lower(strip_accents(text) if fold else text)
    out = F.replace(out, F.lit("&"), F.lit(" and ")) if ampersand else out
    words = F.split(F.trim(F.regexp_replace(out, "[^a-z0-9]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*drop)) if drop else words, " ")


def ascii_key(text: Column) -> Column:
    """ASCII letters and digits alone, in lower case."""
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits with single dashes between."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def simple_slug(text: Column) -> Column:
    return F.translate(F.lower(F.trim(text)), " /", "--")


def reason_slug(text: Column) -> Column:
    """A reason as lower-case words joined by underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_|_$", "")


def run_id(text: Column) -> Column:
    """A run id in which only letters, digits, dash and underscore remain."""
    return F.regexp_replace(text, "[^A-Za-z0-9_-]", "-")


def alias(text: Column, aliases: dict[str, str]) -> Column:
    """The canonical name of a trimmed, lower-case name, or the trimmed name."""
    if not aliases:
        return F.trim(text)
    known = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(text))), F.trim(text))


def iso_date(text: Column, pivot: int | None = 70) -> Column:
    """YYYY-MM-DD from ISO, d/m/y or d-m-y; two-digit years below ``pivot`` are 20yy (all if None), else 19yy.

    Days 1 to 31 and months 1 to 12 are taken as they are, others are null.
    """
    part = F.split(F.trim(text), "[-/]")
    at = lambda i: F.get(part, F.lit(i))
    iso = F.length(at(0)) == 4
    day, month, year = F.when(iso, at(2)).otherwise(at(0)), at(1), F.when(iso, at(0)).otherwise(at(2))
    number = lambda c: c.try_cast("int")
    century = F.lit(2000) if pivot is None else F.when(number(year) < pivot, 2000).otherwise(1900)
    full = F.when(F.length(year) == 2, number(year) + century).otherwise(number(year))
    fine = (F.size(part) == 3) & number(day).between(1, 31) & number(month).between(1, 12) & F.length(year).isin(2, 4)
    return F.when(fine, F.concat_ws("-", F.lpad(full.cast("string"), 4, "0"), F.lpad(number(month).cast("string"), 2, "0"), F.lpad(number(day).cast("string"), 2, "0")))


def looks_utc(text: Column) -> Column:
    """Whether a text has the shape of a UTC time: 20 characters or more, a T within, a Z last."""
    return F.coalesce((F.length(text) >= 20) & F.contains(text, F.lit("T")) & F.endswith(text, F.lit("Z")), F.lit(False))


def instant(text: Column) -> Column:
    """A UTC timestamp from ISO text, null if it is none."""
    return F.try_to_timestamp(text)


def row_hash(*cells: Column) -> Column:
    """sha256 of the cells, each followed by U+001F; null cells are empty."""
    unit = F.lit("\u001f")
    return F.sha2(F.concat(*(x for c in cells for x in (F.coalesce(c.cast("string"), F.lit("")), unit))), 256)


def identifier(*parts: Column) -> Column:
    """Parts joined by ":", nulls left out."""
    return F.concat_ws(":", *(p.cast("string") for p in parts))


def percent(text: Column) -> Column:
    """A number from text with an optional percent sign."""
    return F.regexp_replace(F.trim(text), "%$", "").try_cast("double")

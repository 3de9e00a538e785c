"""String, code and date expressions. All JVM-side column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions.numeric import lookup

MISSING = "<MISSING>"


def normalise_key(value: Column) -> Column:
    """Upper case, every run of other characters to one space, trimmed."""
    spaced = F.regexp_replace(F.upper(value.cast("string")), "[^A-Z0-9]+", " ")
    return F.trim(spaced)


def normalise_or_missing(value: Column) -> Column:
    """Normalised key; a null or blank value becomes the missing token."""
    text = value.cast("string")
    blank = text.isNull() | (F.trim(text) == "") | (text == MISSING)
    return F.when(blank, F.lit(MISSING)).otherwise(normalise_key(text))


def fold_key(value: Column) -> Column:
    """Case and trim insensitive lookup key."""
    return F.upper(F.trim(value.cast("string")))


def pad_code(value: Column, width: int = 2) -> Column:
    """Integer code to a zero-padded string; text that is no integer is null."""
    digits = value.cast("string").try_cast("double").cast("int")
    return F.lpad(digits.cast("string"), width, "0")


def zone_label(code: Column, labels: Mapping[str, str], whole: str = "Statewide") -> Column:
    """Display name of a zone code; the empty or missing code is the whole area, a code
    that is not shown is null."""
    return F.when(F.coalesce(code, F.lit("")) == "", F.lit(whole)).otherwise(
        lookup(code, labels))


def code_prefix(value: Column, width: int = 8) -> Column:
    """Leading characters of a code; shorter codes give null."""
    text = F.trim(value.cast("string"))
    return F.when(F.length(text) >= width, F.substring(text, 1, width))


def slug(value: Column) -> Column:
    """Runs of other characters to one underscore, none at the ends."""
    text = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")),
                            "[^A-Za-z0-9]+", "_")
    return F.regexp_replace(text, "^_+|_+$", "")


def run_id(pairing: Column, outcome: Column, transform: Column,
           stratum: Column, zone: Column, zone_prefix: str = "eco") -> Column:
    """``pairing-outcome-transform-stratum-zone`` with words for the pooled."""
    s, z = slug(stratum), slug(zone)
    return F.concat_ws(
        "-", pairing, outcome, transform,
        F.when(s == "", "all").otherwise(s),
        F.when(z == "", "statewide").otherwise(F.concat(F.lit(zone_prefix), z)))


def digits_year(value: Column) -> Column:
    """Year from a date of unknown encoding: its first four digits."""
    digits = F.regexp_replace(value.cast("string"), "[^0-9]", "")
    return F.when(F.length(digits) >= 4,
                  F.substring(digits, 1, 4).try_cast("int"))


def bounded(value: Column, low: int, high: int) -> Column:
    return F.when(value.between(low, high), value)


def resolve_event_year(date: Column | None, year: Column | None,
                       placeholder: str | None = None) -> Column:
    """Year of a record: a completion date first, a plan year second.

    A date equal to ``placeholder`` (or, when the placeholder is a year, in
    that year) is no date. Dates count within 1900-2100, plan years within
    1800-2100.
    """
    parts = []
    if date is not None:
        text = F.trim(date.cast("string"))
        y = F.year(text.try_cast("date"))
        if placeholder is not None:
            null_hit = text == placeholder
            if placeholder.isdigit():
                null_hit = null_hit | (y == int(placeholder))
            y = F.when(~F.coalesce(null_hit, F.lit(False)), y)
        parts.append(bounded(y, 1900, 2100))
    if year is not None:
        parts.append(bounded(F.trim(year.cast("string")).try_cast("int"),
                             1800, 2100))
    return F.coalesce(*parts) if parts else F.lit(None).cast("int")


def year_from_path(path: Column, first: int, last: int) -> Column:
    """The one four-digit number of a file name inside the valid years.

    No or several distinct candidates give null, so a caller can reject them.
    """
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    found = F.array_distinct(F.transform(
        F.regexp_extract_all(name, F.lit(r"(\d{4})"), 1),
        lambda x: x.cast("int")))
    valid = F.filter(found, lambda y: y.between(first, last))
    return F.when(F.size(valid) == 1, F.element_at(valid, 1))

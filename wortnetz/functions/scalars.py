"""Recodings, coordinates, scales and frequency measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import is_in

#: Answers that mean an unknown word or no further answer.
UNKNOWN_WORD = ("Unbekanntes Wort", "Unbekannest Wort", "Unknown Word")
NO_FURTHER = ("Keine Eingaben mehr", "keine Antowrt", "keine antowrt", "keine Anwort", "keine anwort", "?", "-")
#: Codes of the survey and what they mean.
GENDER = {"Fe": "female", "v": "female", "Ma": "male", "m": "male", "X": "other"}
EDUCATION = {1: 1, 2: 2, 6: 3, 7: 4, 5: 5}
EDUCATION_LABEL = {1: "no degree", 2: "elementary_school", 3: "secondary_school_diploma", 4: "high_school_diploma", 5: "higher_education_degree"}
NATIVE_LANGUAGE = {
    "DEU": "German (Germany)",
    "OST": "German (Austria)",
    "SCH": "German (Switzerland / Lichtenstein)",
    "LUX": "German (Luxembourg)",
    "BE": "German (Belgium)",
    "TR": "German (Italy)",
}
SECTIONS = {"set_2011": 1, "set2": 2, "set3": 3, "set4": 4}
#: Ends of each rating scale, by source kind.
SCALES = {"ten": (0.0, 10.0), "four": (0.0, 4.0), "twenty": (1.0, 20.0)}


def recode(column: Column, mapping: dict) -> Column:
    """The mapped value; null for a null and for a value that is not listed."""
    return F.coalesce(*(F.when(column == k, F.lit(v)) for k, v in mapping.items()))


def native_language(column: Column) -> Column:
    """The upper-cased code where it is listed."""
    return F.when(is_in(F.upper(column), NATIVE_LANGUAGE), F.upper(column))


def unknown_word(column: Column) -> Column:
    return is_in(column, UNKNOWN_WORD)


def no_further(column: Column) -> Column:
    return is_in(column, NO_FURTHER)


def coordinate_key(column: Column, digits: int = 2) -> Column:
    """A whole number to join rounded coordinates on; doubles are never compared."""
    return F.round(column * 10**digits).cast("long")


def geo_fields(a: Column) -> Column:
    """struct(locality, region, country): the first field of each hierarchy that is there (fixed orders)."""
    return F.struct(
        F.coalesce(*(a[k] for k in ("city", "town", "village", "municipality", "hamlet"))).alias("locality"),
        F.coalesce(*(a[k] for k in ("state", "county", "province", "city"))).alias("region"),
        a["country"].alias("country"),
    )


def rescaled(column: Column, low: float, high: float) -> Column:
    return (column - low) / (high - low)


def zipf_value(count: Column, total: Column, types: Column) -> Column:
    """Log frequency per thousand million words, smoothed by one."""
    return F.log10((count + 1) / (total / 1e6 + types / 1e6)) + 3


def zipf_mandelbrot(rank: Column) -> Column:
    """The curve with fixed offset 2.7 and exponent 0.47."""
    return 1 / F.pow(rank + 2.7, F.lit(0.47))


def or_missing_date(ts: Column, sentinel: str, fallback: Column) -> Column:
    """A timestamp, unless null or the sentinel; else the day of the fallback."""
    return F.coalesce(F.nullif(ts, F.lit(sentinel).cast("timestamp")), F.date_trunc("day", fallback))


def decimal_comma(column: Column) -> Column:
    """A number written with a decimal comma."""
    return F.replace(column, F.lit(","), F.lit(".")).try_cast("double")

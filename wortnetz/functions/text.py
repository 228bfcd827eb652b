"""Text correction rules and spelling variants."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordered (pattern, replacement) rules of the character clean-up (fixed values).
CHARACTER_RULES = (
    ("#", ""),
    ("¨", ""),
    (r"\$", ""),
    ("^´", ""),
    ("´$", ""),
    ("´", "'"),
    (r"\^", ""),
    ("`", ""),
    (">", ""),
    ("<", ""),
    ("~", ""),
    (r"\?", ""),
    ("!", ""),
    ('"', ""),
    ("&", ""),
    ("^/$", ""),
    (r"^\.+$", ""),
    (r"^\.{2,}", ""),
)
#: A quoted single word loses its quotes after all other rules (fixed value).
QUOTED = r"^'[\p{L}\p{Nd}]*'$"
#: Digraphs and the letters they stand for (fixed values).
UMLAUTS = (("ae", "ä"), ("Ae", "Ä"), ("oe", "ö"), ("Oe", "Ö"), ("ue", "ü"), ("Ue", "Ü"))


def apply_rules(column: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """All replacements in order, as one expression."""
    for pattern, by in rules:
        column = F.regexp_replace(column, pattern, by)
    return column


def clean_characters(column: Column) -> Column:
    column = apply_rules(column, CHARACTER_RULES)
    return F.when(column.rlike(QUOTED), F.replace(column, F.lit("'"), F.lit(""))).otherwise(column)


def squish(column: Column) -> Column:
    """Trimmed, with inner white space as single spaces."""
    return F.trim(F.regexp_replace(column, r"\s+", " "))


def blank_to_null(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def compound(column: Column, cue: Column) -> Column:
    """``-tisch`` becomes cue and ``tisch``, ``Haus-`` becomes ``Haus`` and the lower-cased cue, other leading hyphens go.

    A leading hyphen takes what follows along once; text after the first word is not repeated.
    """
    column = F.when(column.rlike(r"^-\p{Ll}"), F.concat(cue, F.substr(column, F.lit(2)))).otherwise(F.regexp_replace(column, "^-", ""))
    return F.when(column.rlike(r"\p{Ll}-$"), F.concat(F.regexp_replace(column, "^([^-]*)-", "$1"), F.lower(cue))).otherwise(column)


def word_count(column: Column) -> Column:
    """Words between single spaces; one trailing empty piece does not count, leading ones do; no words in an empty text."""
    return F.when(column == "", 0).otherwise(F.size(F.split(column, " ", -1)) - column.endswith(" ").cast("int"))


def sentence_case(column: Column) -> Column:
    return F.concat(F.upper(F.substring(column, 1, 1)), F.lower(F.substr(column, F.lit(2))))


def sz_variants(column: Column) -> Column:
    """The word, with ss as ß but for a leading ss, and with ß as ss; distinct, in this order."""
    return F.array_distinct(F.array(column, F.regexp_replace(column, "(?<!^)ss", "ß"), F.replace(column, F.lit("ß"), F.lit("ss"))))


def umlaut_variants(column: Column) -> Column:
    """The word, and for each digraph the word with that digraph as its letter; distinct, in this order."""
    return F.array_distinct(F.array(column, *(F.replace(column, F.lit(a), F.lit(b)) for a, b in UMLAUTS)))


def casing_variants(column: Column) -> Column:
    return F.array_distinct(F.array(column, sentence_case(column), F.lower(column), F.upper(column)))


def spelling_variants(column: Column) -> Column:
    """All combinations of the three kinds, in the order in which they arise."""
    out = sz_variants(column)
    for kind in (umlaut_variants, casing_variants):
        out = F.array_distinct(F.flatten(F.transform(out, kind)))
    return out


def casings(column: Column) -> Column:
    """The five casings of the lenient dictionary check."""
    return F.array_distinct(F.array(column, F.lower(column), F.upper(column), sentence_case(column), F.initcap(column)))


def parse_number(column: Column) -> Column:
    """The first whole number in a text such as ``17 Jahre``."""
    return F.try_to_number(F.regexp_extract(column, r"-?\d+", 0), F.lit("S99999999999999999")).cast("long")


def remove_first(column: Column, literal: str) -> Column:
    """The text without the first occurrence of a literal."""
    at = F.instr(column, literal)
    return F.when(at == 0, column).otherwise(F.concat(F.substr(column, F.lit(1), at - 1), F.substr(column, at + len(literal))))


def osa(a: str, b: str) -> int:
    """Optimal string alignment: edits and swaps of neighbours, no part of a text edited twice."""
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        before, last = last, row
    return last[-1]


def osa_distance(a: Column, b: Column) -> Column:
    """Needs Python: no built-in function counts a swap as one edit."""

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b)], dtype="Int32")

    return distance(a, b)

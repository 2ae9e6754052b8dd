"""Scalar functions on text and numbers: join keys, guarded casts, column names."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that become two; the rest lose their marks.
UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "ae", "Ö": "oe", "Ü": "ue", "ß": "ss"}


def _bare() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by Unicode decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii() and b.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def normalize_key(key: Column) -> Column:
    """A join key: umlauts expanded, marks stripped, lower case, letters and digits only, no leading zeros in a number.

    A missing key becomes the text ``none``, so that missing keys match each other.
    """
    k = F.coalesce(key.cast("string"), F.lit("none"))
    for a, b in UMLAUTS.items():
        k = F.replace(k, F.lit(a), F.lit(b))
    k = F.lower(F.translate(k, *_bare()))
    k = F.regexp_replace(k, r"[^\p{L}\p{N}]", "")
    return F.when(k.rlike("^0+$"), F.lit("0")).otherwise(F.when(k.rlike("^[0-9]+$"), F.regexp_replace(k, "^0+", "")).otherwise(k))


def to_double(text: Column) -> Column:
    """The number that a text spells, null if it spells none (no type suffixes, nothing non-finite)."""
    t = F.trim(text.cast("string"))
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def to_long(text: Column) -> Column:
    """The whole number that a text spells exactly; fractions and what does not fit are null."""
    t = F.trim(text.cast("string"))
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("long")).otherwise(F.when(t.rlike(r"^[+-]?[0-9]+\.0*$"), F.regexp_replace(t, r"\..*$", "").try_cast("long")))


def to_boolean(text: Column) -> Column:
    t = F.lower(F.trim(text.cast("string")))
    return F.when(t.isin("true", "yes", "1"), True).when(t.isin("false", "no", "0"), False)


CASTS = {"integer": to_long, "float": to_double, "string": lambda c: c.cast("string"), "boolean": to_boolean}


def finite(value: Column) -> Column:
    """value as double, null where it is not a finite number."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def column_name(value: str) -> str:
    """A group value as part of a column name."""
    return "".join("_" if c in " :-/.," else c for c in value)

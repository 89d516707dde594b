"""Readers that turn text into typed values, null where the text isn't readable as the type.

All are built-in expressions: a regular expression fixes the accepted form, ``try_cast`` the value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space around a value.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
_DIGITS = r"(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)"
TYPES = {"string": "string", "bigint": "bigint", "double": "double", "boolean": "boolean", "date": "date", "timestamp": "timestamp_ntz"}


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(BLANKS))


def is_blank(value: Column) -> Column:
    """True for null, empty and white space only; never null."""
    return F.coalesce(strip(value) == "", F.lit(True))


def same_name(name: Column) -> Column:
    """Names agree if they agree without case, white space, hyphens and underscores."""
    return F.lower(F.regexp_replace(name, r"(?U)[\s\-_​﻿‐‑]+", ""))


def read_bigint(value: Column) -> Column:
    v = strip(value)
    return F.when(v.rlike(rf"^[+-]?{_DIGITS}$"), F.replace(v, F.lit(","), F.lit("")).try_cast("bigint"))


def read_double(value: Column) -> Column:
    v = strip(value)
    number = F.replace(v, F.lit(","), F.lit("")).try_cast("double")
    shape = rf"^[+-]?(?:{_DIGITS}(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
    return F.when(v.rlike(shape), F.when(F.abs(number) < F.lit(float("inf")), number))


def read_boolean(value: Column) -> Column:
    v = F.lower(strip(value))
    return F.when(v.isin("true", "yes", "y", "t", "1"), F.lit(True)).when(v.isin("false", "no", "n", "f", "0"), F.lit(False))


def read_date(value: Column) -> Column:
    v = strip(value)
    iso = F.when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), v)
    slash = F.when(v.rlike(r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$"), F.replace(v, F.lit("/"), F.lit("-")))
    dotted = F.when(v.rlike(r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$"), F.concat_ws("-", F.substring(v, 7, 4), F.substring(v, 4, 2), F.substring(v, 1, 2)))
    day = F.coalesce(iso, slash, dotted)
    return F.when(~day.startswith("0000"), day.try_cast("date"))


def read_timestamp(value: Column) -> Column:
    v = strip(value)
    shape = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T](?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z?$"
    text = F.concat_ws(" ", F.substring(v, 1, 10), F.substring(v, 12, 8))
    return F.when(v.rlike(shape) & ~v.startswith("0000"), text.try_cast("timestamp_ntz"))


def read_as(value: Column, value_type: str) -> Column:
    """``value`` read as one of the six declared types; blank values give null, strings keep their text stripped."""
    if value_type == "string":
        return F.when(~is_blank(value), strip(value))
    readers = {"bigint": read_bigint, "double": read_double, "boolean": read_boolean, "date": read_date, "timestamp": read_timestamp}
    return readers[value_type](value)

"""Values that a database sends as text, decoded into columns by the name of their type.

Native expressions throughout. A text that its type cannot read gives null. Times become milliseconds: of
a date or a timestamp since 1970 in UTC, of a time since midnight. Whole numbers keep all 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: names of types by what they decode to
WHOLE = ("int2", "int4", "int8", "smallint", "integer", "bigint", "oid")
REAL = ("float4", "float8", "real", "double precision")
TIMES = ("time", "timetz", "time without time zone", "time with time zone")
STAMPS = ("timestamp", "timestamptz", "timestamp without time zone", "timestamp with time zone")
DAY = 86_400_000_000

_DATE = r"(\d{1,7})-(\d{1,2})-(\d{1,2})"
_TIME = r"(\d{1,2}):(\d{1,2}):(\d{1,2})(?:\.(\d+))?"
_ZONE = r"(?:([+-])(\d{1,2}):?(\d{2})?(?::\d{2})?)?"
_ERA = r"( BC)?"


def _part(text: Column, pattern: str, n: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def _number(text: Column, pattern: str, n: int) -> Column:
    return _part(text, pattern, n).try_cast("bigint")


def _days(text: Column, pattern: str, era: int) -> Column:
    """Days since 1970 of year, month and day in the first groups, years before 1 by their era."""
    y, m, d = (_number(text, pattern, n) for n in (1, 2, 3))
    y = F.when(_part(text, pattern, era).isNotNull(), 1 - y).otherwise(y)
    # months counted from March, so that the leap day is the last of a year
    year = y - F.when(m <= 2, 1).otherwise(0)
    month = F.pmod(m + 9, F.lit(12))
    leap = F.floor(year / 4) - F.floor(year / 100) + F.floor(year / 400)
    days = 365 * year + leap + F.floor((153 * month + 2) / 5) + d - 719_469
    return F.when(m.between(1, 12) & d.between(1, 31), days)


def _micros(text: Column, pattern: str, first: int) -> Column:
    """Microseconds since midnight of the time whose hour is group `first`."""
    h, m, s = (_number(text, pattern, first + n) for n in range(3))
    part = F.rpad(F.substring(F.coalesce(_part(text, pattern, first + 3), F.lit("0")), 1, 6), 6, "0").try_cast("bigint")
    return F.when((h <= 24) & (m <= 59) & (s <= 60), ((h * 60 + m) * 60 + s) * 1_000_000 + part)


def _offset(text: Column, pattern: str, first: int) -> Column:
    """Microseconds that the zone, whose sign is group `first`, is ahead of UTC."""
    h, m = _number(text, pattern, first + 1), F.coalesce(_number(text, pattern, first + 2), F.lit(0))
    ahead = (h * 60 + m) * 60_000_000
    return F.coalesce(F.when(_part(text, pattern, first) == "-", -ahead).otherwise(ahead), F.lit(0))


def date_millis(text: Column) -> Column:
    pattern = f"^{_DATE}{_ERA}$"
    return (_days(F.trim(text), pattern, 4) * (DAY // 1000)).cast("double")


def timestamp_millis(text: Column) -> Column:
    pattern, text = f"^{_DATE}[ T]{_TIME}{_ZONE}{_ERA}$", F.trim(text)
    return (_days(text, pattern, 11) * DAY + _micros(text, pattern, 4) - _offset(text, pattern, 8)) / 1000.0


def time_millis(text: Column) -> Column:
    pattern, text = f"^{_TIME}{_ZONE}$", F.trim(text)
    return (_micros(text, pattern, 1) - _offset(text, pattern, 5)) / 1000.0


_TOKEN = r'("(?:[^"\\]|\\.)*"|[{},]|[^{},"]+)'


def array_json(text: Column, element: str) -> Column:
    """An array's text, nested ones too, as JSON; elements as their type decodes them, NULL as null."""
    bare = F.regexp_replace(F.trim(text), r"^\[[^=]*=", "")
    quoted = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)

    def value(x: Column) -> Column:
        if element in WHOLE:
            return F.coalesce(x.try_cast("bigint").cast("string"), quoted(x))
        if element in REAL or element in ("numeric", "decimal"):
            return F.when(x.try_cast("double").isNotNull() & x.rlike(r"^-?\d"), x).otherwise(quoted(x))
        if element in ("bool", "boolean"):
            return F.when(x.isin("t", "true"), F.lit("true")).otherwise(F.lit("false"))
        if element == "date" or element in TIMES + STAMPS:
            return F.coalesce(decoded(x, element).cast("decimal(30,3)").cast("string"), quoted(x))
        return quoted(x)

    def token(x: Column) -> Column:
        inner = F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"(?s)\\(.)", "$1")
        return (
            F.when(x == "{", F.lit("[")).when(x == "}", F.lit("]")).when(x == ",", F.lit(",")).when(x.startswith('"'), value(inner)).when(x == "NULL", F.lit("null")).otherwise(value(x))
        )

    out = F.array_join(F.transform(F.regexp_extract_all(bare, F.lit(_TOKEN), 1), token), "")
    return F.when(bare.startswith("{") & F.json_array_length(out).isNotNull(), out)


def decoded(text: Column, kind: str) -> Column:
    """The value of a text of a database type; `kind` of an array ends in []. Unknown types stay texts."""
    kind = kind.lower()
    if kind.endswith("[]"):
        return array_json(text, kind[:-2])
    if kind in ("bool", "boolean"):
        return F.when(text.isNotNull(), text.isin("t", "true"))
    if kind in WHOLE:
        return text.try_cast("bigint")
    if kind in REAL:
        return text.try_cast("double")
    if kind in ("numeric", "decimal"):
        return text.try_cast("double")
    if kind == "date":
        return date_millis(text)
    if kind in STAMPS:
        return timestamp_millis(text)
    if kind in TIMES:
        return time_millis(text)
    return text


def spark_type(kind: str) -> str:
    """The type of the column that `decoded` gives."""
    kind = kind.lower()
    if kind in ("bool", "boolean"):
        return "boolean"
    if kind in WHOLE:
        return "bigint"
    return "double" if kind in REAL + TIMES + STAMPS + ("numeric", "decimal", "date") else "string"

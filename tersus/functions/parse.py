"""Coercing parsers K1-K4.

All are pure Column expressions (codegen-friendly, no Python UDF). They take
the column's Spark type so that a typed column is not needlessly re-parsed.
"""

from __future__ import annotations

import re
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The strings that count as a missing value (exact, case-sensitive
# match, no trimming), in the order the reference lists them.
NULL_MARKERS = ("N/A", "n/a", "null", "NULL", "None", "none", "missing", "", "NaN", "nan")

# Ordered timestamp formats tried by K2. Day-first for slashed dates, as the
# dirty generators write them. The later ones are the other ISO 8601 forms; any of
# them may end in an offset (``Z``, ``+02:00``), which moves the result to UTC.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "yyyy-MM-dd'T'HH:mm:ss",
                "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss.SSSSSS",
                "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
_OFFSET = r"(?<=:\d{2}|\.\d{1,6})(Z|[+-]\d{2}(:?\d{2})?)$"
_SHIFTED = r"(:\d{2}|\.\d{1,6})(Z|[+-]\d{2}(:?\d{2})?)$"  # strings in which _OFFSET finds one, told sooner

# Shape of a number both Spark's cast and a strict numeric parser accept: optional
# sign, decimal digits with optional fraction and exponent, or inf/infinity/nan,
# with surrounding white space. It rejects what only Java's parser takes (a type
# suffix "1d", hex literals "0x1p3") and lets the cast skip hopeless strings.
_NUMBER_SHAPE = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"

# Pattern letters of a datetime format -> the digits they match (used to test a
# string's shape before parsing it).
_FORMAT_TOKENS = {"yyyy": r"\d{4}", "MM": r"\d{2}", "dd": r"\d{2}", "HH": r"\d{2}", "mm": r"\d{2}",
                  "ss": r"\d{2}", "SSSSSS": r"\d{1,6}", "'T'": "T"}

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def is_string(dt) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def is_integral(dt) -> bool:
    return isinstance(dt, _INTEGRAL)


def is_numeric(dt) -> bool:
    return isinstance(dt, _INTEGRAL + _FRACTIONAL)


def is_floating(dt) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def is_temporal(dt) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _c(c) -> Column:
    return col(c) if isinstance(c, str) else c


def missing(df, name: str) -> Column:
    """NULL, or NaN in a floating column."""
    c = col(name)
    return c.isNull() | F.isnan(c) if is_floating(df.schema[name].dataType) else c.isNull()


def std_nulls(c, dt) -> Column:
    """K3: marker strings -> NULL; for floating columns NaN -> NULL (one null only)."""
    c = _c(c)
    if is_string(dt):
        return F.when(~c.isin(*NULL_MARKERS), c)
    if is_floating(dt):
        return F.when(~F.isnan(c), c)
    return c


def to_double(c, dt) -> Column:
    """K1: numeric parse, anything unparseable -> NULL, NaN -> NULL."""
    c = _c(c)
    if is_string(dt):
        v = c.try_cast("double")
        return F.when(c.rlike(_NUMBER_SHAPE), F.when(~F.isnan(v), v))
    if is_floating(dt):
        v = c.cast("double")
        return F.when(~F.isnan(v), v)
    if is_numeric(dt) or isinstance(dt, T.BooleanType):
        return c.cast("double")
    return F.lit(None).cast("double")


def _has_time(fmt: str) -> bool:
    return any(ch in fmt for ch in "HhmsSa")


def format_shape(fmt: str) -> str | None:
    """Regex of the strings ``fmt`` can parse, or None when the format uses
    pattern letters we do not translate (then every string is tried)."""
    out, i = [], 0
    while i < len(fmt):
        for tok, rx in _FORMAT_TOKENS.items():
            if fmt.startswith(tok, i):
                out.append(rx)
                i += len(tok)
                break
        else:
            ch = fmt[i]
            if ch.isalpha() or ch == "'":
                return None
            out.append(re.escape(ch))
            i += 1
    return "^" + "".join(out) + "$"


#: Formats whose strings a cast reads, several times as fast as the formatter, and how it gets them in ISO form. No
#: string has the shape of two of them.
_AS_IT_IS, _SLASHED, _DAY_FIRST = range(3)
_ISO = {"yyyy-MM-dd HH:mm:ss": _AS_IT_IS, "yyyy-MM-dd": _AS_IT_IS, "yyyy-MM-dd'T'HH:mm:ss": _AS_IT_IS,
        "yyyy-MM-dd HH:mm": _AS_IT_IS, "yyyy-MM-dd'T'HH:mm": _AS_IT_IS, "yyyy-MM-dd HH:mm:ss.SSSSSS": _AS_IT_IS,
        "yyyy-MM-dd'T'HH:mm:ss.SSSSSS": _AS_IT_IS, "yyyy/MM/dd": _SLASHED, "dd/MM/yyyy": _DAY_FIRST}


def _cast_iso(c: Column, formats) -> Column:
    """Strings of formats in ``_ISO``, by one cast."""
    texts = {_AS_IT_IS: c, _SLASHED: F.translate(c, "/", "-"),
             _DAY_FIRST: F.concat(c.substr(7, 4), F.lit("-"), c.substr(4, 2), F.lit("-"), c.substr(1, 2))}
    iso = F
    for form in sorted({_ISO[f] for f in formats}):
        shapes = "|".join(format_shape(f)[1:-1] for f in formats if _ISO[f] == form)
        iso = iso.when(c.rlike(rf"^(?:{shapes})\z"), texts[form])  # a line end after the text is no part of it
    return iso.try_cast("timestamp_ntz")


def to_timestamp(c, dt, formats=DATE_FORMATS) -> Column:
    """K2: timestamp parse over an ordered format list, bad value -> NULL.

    Result is ``timestamp_ntz``. Formats in ``_ISO`` are cast. Of the others, date-only formats go through ``try_to_date``
    and formats with a time part through ``to_timestamp_ntz`` guarded by ``try_to_timestamp``, so no session time zone (or
    DST gap) is involved.
    """
    c = _c(c)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp_ntz")
    if not is_string(dt):
        return F.lit(None).cast("timestamp_ntz")
    # the offset of a time, in minutes; "" (no offset) and "Z" are none
    shifted = c.rlike(_SHIFTED)
    offset = F.regexp_extract(c, _OFFSET, 1)
    digits = F.rpad(F.regexp_replace(offset, r"\D", ""), 4, "0").try_cast("int")
    minutes = F.when(shifted & (F.length(offset) > 1), (F.floor(digits / 100) * 60 + digits % 100)
                     * F.when(offset.startswith("-"), -1).otherwise(1)).otherwise(0)
    c = F.when(shifted, F.regexp_replace(c, _OFFSET, "")).otherwise(c)
    parts = []
    for iso, group in groupby(formats, _ISO.__contains__):
        if iso:
            parts.append(_cast_iso(c, list(group)))
            continue
        for fmt in group:
            f = F.lit(fmt)
            if _has_time(fmt):
                p = F.when(F.try_to_timestamp(c, f).isNotNull(), F.to_timestamp_ntz(c, f))
            else:
                p = F.try_to_date(c, fmt).cast("timestamp_ntz")
            shape = format_shape(fmt)
            # only strings of the right shape are parsed: failed parses are costly
            parts.append(F.when(c.rlike(shape), p) if shape else p)
    local = parts[0] if len(parts) == 1 else F.coalesce(*parts)
    return local - F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"), F.lit(0))


def to_bigint(c, dt) -> Column:
    """Whole numbers exactly, fractions truncated, anything else (or out of range) NULL. Integers
    and strings of integer shape never pass through a double, which is exact only to 2^53."""
    c = _c(c)
    if is_integral(dt) or isinstance(dt, (T.BooleanType, T.DecimalType)):
        return c.try_cast("bigint")
    num = to_double(c, dt)
    # 2^63 as a double: the first value beyond the range
    fraction = F.when((num >= F.lit(-2.0 ** 63)) & (num < F.lit(2.0 ** 63)), num.cast("bigint"))
    if is_string(dt):
        whole = F.regexp_replace(c, r"^\s*\+?|\s+$", "").try_cast("bigint")
        return F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), whole).otherwise(fraction)
    return fraction


def is_mostly_numeric(numeric_count, non_null_count) -> bool:
    """K4 on fitted counts: numeric count strictly above half the non-null count."""
    return numeric_count > 0.5 * non_null_count

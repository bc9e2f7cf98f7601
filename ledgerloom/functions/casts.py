"""Casts from raw text that give NULL on bad input, whatever the ANSI setting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Wide enough for any id or amount before it is rounded to its column.
_WIDE = T.DecimalType(38, 10)

_DIGITS = r"^-?[0-9]{1,18}$"
_ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}([ T].*)?$"
_CLOCK = r"^([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d)?$"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def is_blank(c: Column) -> Column:
    """NULL, empty or spaces only; never NULL itself."""
    return F.coalesce(F.length(F.trim(c)), F.lit(0)) == 0


def to_decimal(c: Column, dtype: T.DecimalType) -> Column:
    """Rounds half up to the scale; NULL when the digits do not fit."""
    return F.trim(c).try_cast(dtype)


def to_whole(c: Column, dtype: T.DataType) -> Column:
    """Whole number from text such as ``7``, ``7.0`` or ``7.5`` (rounded, not cut)."""
    text = F.trim(c)
    # A failed cast of text straight to an integer costs an exception, a hundred
    # times the price of the way through decimals; digits alone cannot fail.
    plain = text.try_cast(T.LongType()).try_cast(dtype)
    return F.when(text.rlike(_DIGITS), plain).otherwise(F.round(text.try_cast(_WIDE), 0).try_cast(dtype))


def to_date(c: Column) -> Column:
    text = F.trim(c)
    return F.when(text.rlike(_ISO_DATE), text.try_cast(T.DateType()))


def to_clock(c: Column) -> Column:
    """``HH:mm:ss`` text, NULL unless it is a time of day."""
    text = F.trim(c)
    padded = F.when(F.instr(text, ":") == 2, F.concat(F.lit("0"), text)).otherwise(text)
    whole = F.when(F.length(padded) == 5, F.concat(padded, F.lit(":00"))).otherwise(padded)
    return F.when(text.rlike(_CLOCK), whole)


def digits(c: Column) -> Column:
    """The digits of a code as an int; NULL without digits or past the int range."""
    return F.nullif(F.regexp_replace(c, r"\D", ""), F.lit("")).try_cast(T.IntegerType())

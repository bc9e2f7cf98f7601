"""Labels and display formats."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.casts import blank_to_null
from ledgerloom.model.labels import WEEKDAYS

CENTS = T.DecimalType(38, 2)


@dataclass(frozen=True)
class NumberStyle:
    symbol: str = ""
    group: str = ","
    point: str = "."


# Fixed values
PLAIN = NumberStyle()
REAIS = NumberStyle(symbol="R$ ", group=".", point=",")


def day(c: Column) -> Column:
    return F.date_format(c, "dd/MM/yyyy")


def money(c: Column, style: NumberStyle = REAIS, symbol: bool = True) -> Column:
    # format_number rounds half to even, so round half up first.
    text = F.format_number(F.round(c.cast(T.DecimalType(38, 7)), 2), 2)
    text = F.translate(text, ",.", style.group + style.point)
    return F.concat(F.lit(style.symbol), text) if symbol and style.symbol else text


def code_and_text(code: Column, text: Column) -> Column:
    """``code - text``; the code alone when the text is missing or blank."""
    return F.concat_ws(" - ", code, blank_to_null(text))


def weekday(c: Column, language: str = "en") -> Column:
    names = F.array(*[F.lit(n) for n in WEEKDAYS[language]])
    return F.element_at(names, F.dayofweek(c))


def to_cents(c: Column) -> Column:
    return F.round(c, 2).cast(CENTS)

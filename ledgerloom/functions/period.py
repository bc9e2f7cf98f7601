"""Half-open date ranges: the raw date column stays bare, so the filter reaches the scan."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.model.labels import MONTHS


@dataclass(frozen=True)
class Period:
    start: date
    end: date  # first day after the period

    @staticmethod
    def month(year: int, month: int, count: int = 1) -> Period:
        last = year * 12 + month - 1 + count
        return Period(date(year, month, 1), date(last // 12, last % 12 + 1, 1))

    def holds(self, c: Column | str) -> Column:
        c = F.col(c) if isinstance(c, str) else c
        return (c >= F.lit(self.start)) & (c < F.lit(self.end))

    @property
    def title(self) -> str:
        first = f"{MONTHS[self.start.month - 1]}/{self.start.year}"
        last_month = (self.end.year * 12 + self.end.month - 2)
        last = f"{MONTHS[last_month % 12]}/{last_month // 12}"
        return first if first == last else f"{first} a {last}"

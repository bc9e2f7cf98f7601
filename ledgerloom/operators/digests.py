"""Order-free digests of groups of rows: equal multisets of rows give equal digests.

A row's values, as text, give two whole numbers below 2^60; a group's digest is
their two sums and the number of rows. Sums are folded before the shuffle and
merge in any order. Changes that cancel out in sums of values, as two amounts that
change places, do not cancel out here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: A row's numbers are added up in two halves of this many bits, as longs: far cheaper than
#: decimals of thirty digits, and exact for groups of up to 2^33 rows.
_HALF = 30

#: Columns of a row's two numbers, and of the sums of their halves.
_NUMBERS = "_first", "_second"
SUMS = [f"{n}_{half}" for n in _NUMBERS for half in ("high", "low")]


def _number(digest: Column, start: int) -> Column:
    """Fifteen hexadecimal digits as a number."""
    # Bytes are cut at once, characters are walked through.
    return F.conv(F.substring(digest.cast("binary"), start, 15).cast("string"), 16, 10).cast("long")


def row_text(values: Sequence[Column]) -> Column:
    """The values as one text, a missing one told from an empty one."""
    return F.concat_ws("|", *[F.coalesce(v.cast("string"), F.lit("?")) for v in values])


def row_digest(values: Sequence[Column]) -> Column:
    return F.md5(row_text(values).cast("binary"))


def with_numbers(rows: DataFrame, digest: str) -> DataFrame:
    """``rows`` with the two numbers of the :func:`row_digest` in column ``digest`` in its place."""
    others = [c for c in rows.columns if c != digest]
    return rows.select(*others, *[_number(F.col(digest), at).alias(n) for n, at in zip(_NUMBERS, (1, 16))])


def digest_sums() -> list[Column]:
    """Aggregates over the numbers of rows: :data:`SUMS`, equal where the digests of groups are."""
    mask = F.lit((1 << _HALF) - 1)
    halves = [h for n in _NUMBERS for h in (F.shiftright(n, _HALF), F.col(n).bitwiseAND(mask))]
    return [F.sum(h).alias(name) for h, name in zip(halves, SUMS)]


def digest_text(sums: Sequence[Column]) -> Column:
    """A group's digest from its :data:`SUMS`."""
    high_low = zip(sums[::2], sums[1::2])
    half = F.lit(1 << _HALF).cast("decimal(10,0)")
    return F.concat_ws(":", *[(high.cast("decimal(19,0)") * half + low.cast("decimal(19,0)")).cast("string") for high, low in high_low])


def digests(rows: DataFrame, by: Sequence[Column], digest: Column, count: str) -> DataFrame:
    """Per group its number of rows and the :data:`SUMS` of their ``digest``, a :func:`row_digest`."""
    marked = with_numbers(rows.select(*by, digest.alias("_digest")), "_digest")
    names = [c for c in marked.columns if c not in _NUMBERS]
    return marked.groupBy(*names).agg(F.count("*").alias(count), *digest_sums())


def bucket_of(key: Sequence[Column], buckets: int) -> Column:
    """A number below ``buckets`` that depends on the key alone."""
    digest = F.md5(row_text(key).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(buckets)).cast("int")

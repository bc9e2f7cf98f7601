"""Lookup joins that keep working when one key holds a large share of the rows.

A shuffle join sends every row of a key to one task. ``lookup_join`` counts the
rows per bucket of keys (a hash of them, one of ``BUCKETS``) as part of its own
plan: folded before the shuffle, so that no task passes on more than that many
counts. A bucket with more rows than one task should take is dealt over as many
tasks as it needs: its left rows get a part number, its right rows are repeated
once per part. All other buckets have the one part 0. A crowded key makes its
bucket crowded; the few other keys of that bucket are dealt with it.

Nothing runs while the plan is built. The list of such buckets is broadcast; it
has at most one entry per ``ROWS_PER_TASK`` left rows, and at most ``BUCKETS``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Left rows of one key that a task should take at most.
ROWS_PER_TASK = 1_000_000

#: Hashes of keys that rows are counted by.
BUCKETS = 1 << 16

PART = "_part"
_PARTS, _ROWS, _BUCKET = "_parts", "_rows", "_bucket"


def crowded_keys(counts: DataFrame, keys: Sequence[str], rows_per_task: int | None = None) -> DataFrame:
    """Keys of ``counts`` (keys, _rows) with too many rows for a task, and their number of parts."""
    limit = F.lit(rows_per_task or ROWS_PER_TASK)
    return counts.where(F.col(_ROWS) > limit).select(
        *[F.col(k).alias(f"_crowded_{k}") for k in keys], F.ceil(F.col(_ROWS) / limit).cast("int").alias(_PARTS)
    )


def count_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(_ROWS))


def _bucket(keys: Sequence[str], types: dict[str, T.DataType]) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast(types[k]) for k in keys]), F.lit(BUCKETS)).cast("int").alias(_BUCKET)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    counts: DataFrame | None = None,
    rows_per_task: int | None = None,
    tasks: int | None = None,
    together: Sequence[str] | None = None,
) -> DataFrame:
    """Join on equally named ``keys``; ``right`` holds about one row per key.

    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``. Pass ``counts``
    (keys and ``_rows``, which are added up) where they are to be had more cheaply
    than from ``left``. Rows that agree in every column go to the same part. NULL
    keys, which match nothing, are dealt out too. ``tasks``: over how many tasks, if
    not the session's own number.

    ``together``: rows that agree in the keys and in these columns of ``left`` go to
    the same part, which the result names (``PART``): they can be grouped by all of
    these and need not be moved again.
    """
    keys = list(keys)
    types = {f.name: f.dataType for f in left.schema}
    right = right.withColumns({k: F.col(k).cast(types[k]) for k in keys})
    seen = left.select(*keys, F.lit(1).alias(_ROWS)) if counts is None else counts
    per_bucket = seen.select(_bucket(keys, types), _ROWS).groupBy(_BUCKET).agg(F.sum(_ROWS).alias(_ROWS))
    crowded = F.broadcast(crowded_keys(per_bucket, [_BUCKET], rows_per_task).withColumnRenamed(f"_crowded_{_BUCKET}", _BUCKET))

    def numbered(side: DataFrame) -> DataFrame:
        met = side.withColumn(_BUCKET, _bucket(keys, types)).join(crowded, _BUCKET, "left").drop(_BUCKET)
        return met.withColumn(_PARTS, F.coalesce(_PARTS, F.lit(1)))

    others = [c for c in (left.columns if together is None else together) if c not in keys] or keys
    part = F.when(F.col(_PARTS) > 1, F.pmod(F.xxhash64(*others), F.col(_PARTS)).cast("int")).otherwise(0)
    dealt = numbered(left).withColumn(PART, part).drop(_PARTS)
    repeated = numbered(right).withColumn(PART, F.explode(F.sequence(F.lit(0), F.col(_PARTS) - 1))).drop(_PARTS)
    if tasks is not None:
        repeated = repeated.repartition(tasks, *keys, PART)
    joined = dealt.join(repeated, [*keys, PART], how)
    return joined.drop(PART) if together is None else joined

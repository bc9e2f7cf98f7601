"""Mixing sources to target weights by entropy balancing.

Method: of all document rates that give each source its target of words and lie
between 0 and ``most``, those closest in relative entropy to taking every
document once are wanted. They are exponential tilts, rate = exp(lambda * size /
mean size of the source), held at ``most``, with one multiplier per source: the
minimiser of a convex dual. Its gradient and curvature are sums over the corpus,
so Newton's iteration runs as Spark jobs over counts per source and size, which
are made once; a bracket guards each step. Rates then become whole copies.

Rounding: within a slice of a source, from the largest document to the smallest,
what rounding leaves over is carried on to the next one, so a slice misses its
share by about half of its smallest document. Slices hold ``SLICE`` documents on
average, however large the source.

Reruns agree: sums that steer the iteration are of whole numbers (millionths of
a word), which do not depend on the order of tasks.

Defined results: null text has size 0 and is never taken; a null source is a
source, ordered last; documents of equal size are ordered by id, and such that
repeat id and size are interchangeable; a source without words has target 0; an
empty table gives an empty one; other columns are not read. Sources are few
enough to be listed on the driver, as their weights are; no document is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, digest, empty_if_null, pinned, row_key, rows_of, unused

#: What counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents per rounding slice, on average.
SLICE = 2000
#: Newton's iteration ends when every source is this close to its target.
TOLERANCE = 1e-9

_MILLIONTHS = "decimal(38,0)"
_DDL = "doc_id long, size long, source_size long, target double, taken long, copies int, rate double, _digest binary"
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("size", pa.int64()), ("source_size", pa.int64()), ("target", pa.float64()),
     ("taken", pa.int64()), ("copies", pa.int32()), ("rate", pa.float64()), ("_digest", pa.binary())]
)


def in_order(sources: list[str | None]) -> list[str | None]:
    """By code point, null last."""
    return sorted((s for s in sources if s is not None)) + [None] * (None in sources)


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], most: int = 3) -> dict[str | None, float]:
    """Words per source: shares of all words by weight, none above ``most`` times its source.

    What a source cannot take is shared by weight among those that still can.
    """
    found: dict[str | None, float] = {}
    rest, open_ = float(sum(sizes.values())), set(sizes)
    while open_:
        share = rest / sum(weights[s] for s in open_)
        full = [s for s in in_order(list(open_)) if share * weights[s] > most * sizes[s]]
        if not full:
            return found | {s: share * weights[s] for s in open_}
        for s in full:
            found[s] = float(most * sizes[s])
            rest -= found[s]
            open_.remove(s)
    return found


def _sizes(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    text = empty_if_null(F.col(text_column))
    return pinned(
        docs.select(
            F.col(id_column).cast("long").alias("doc_id"),
            F.col(source_column).cast("string").alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            digest(text).alias("_digest"),
        ),
        "sizes",
    )


def _rate(multiplier: Column, scaled: Column, most: int) -> Column:
    return F.exp(F.least(multiplier * scaled, F.lit(math.log(most))))


def _solve(cells: DataFrame, sizes: dict, counts: dict, wanted: dict, most: int) -> dict[str | None, float]:
    """The multiplier of each source, by Newton's iteration on the dual over (source, size, n)."""
    spark = cells.sparkSession
    multiplier = {s: 0.0 for s in wanted if 0 < wanted[s] < most * sizes[s]}
    bracket = {s: [-math.inf, math.inf] for s in multiplier}
    open_ = set(multiplier)
    # Where Newton's step leaves the bracket it is halved, so every source gets there.
    while open_:
        state = spark.createDataFrame(
            [(s, multiplier[s], sizes[s] / counts[s]) for s in in_order(list(open_))], "_source string, _multiplier double, _mean double"
        )
        scaled = F.col("size") / F.col("_mean")
        rate = _rate(F.col("_multiplier"), scaled, most)
        words = F.col("n") * F.col("size") * rate
        slope = F.when(rate < most, words * scaled).otherwise(F.lit(0.0))
        whole = lambda x: F.sum(F.round(x * 1e6).cast(_MILLIONTHS))
        sums = (
            cells.join(state, cells["source"].eqNullSafe(state["_source"]))
            .groupBy("source")
            .agg(whole(words).alias("words"), whole(slope).alias("slope"))
            .collect()
        )
        for row in sums:
            s, over, slope = row["source"], float(row["words"]) / 1e6 - wanted[row["source"]], float(row["slope"]) / 1e6
            if abs(over) <= TOLERANCE * wanted[s] + 1e-5:
                open_.discard(s)
                continue
            at, (low, high) = multiplier[s], bracket[s]
            low, high = (low, at) if over > 0 else (at, high)
            bracket[s] = [low, high]
            step = at - over / slope if slope > 0 else math.nan
            if not low < step < high:
                # Outside what is known to hold the solution: halve it, or widen it.
                step = (low + high) / 2 if math.isfinite(low + high) else at * 2 - 1 if over > 0 else at * 2 + 1
            multiplier[s] = step
            if math.isfinite(low + high) and high - low <= 1e-15 * max(1.0, abs(low)):
                open_.discard(s)
    return multiplier


def mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    most: int = 3,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken; and copies, rate, _digest.

    ``weights`` has a weight for each source; without it they are 1, 2, 3, and so
    on again, in the order of the sources.
    """
    spark = docs.sparkSession
    rows = _sizes(docs, id_column, text_column, source_column)
    cells = pinned(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    listed = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("n")).collect()
    sizes, counts = {r["source"]: r["words"] for r in listed}, {r["source"]: r["n"] for r in listed}
    if weights is None:
        weights = {s: 1.0 + i % 3 for i, s in enumerate(in_order(list(sizes)))}
    wanted = targets(sizes, weights, most)
    multiplier = _solve(cells, sizes, counts, wanted, most)
    plan = []
    for s in in_order(list(sizes)):
        # Without a multiplier the source is taken not at all or as often as may be.
        fixed = None if s in multiplier else float(most) if wanted[s] > 0 else 0.0
        plan.append((s, sizes[s], wanted[s], multiplier.get(s, 0.0), sizes[s] / counts[s], fixed, -(-counts[s] // SLICE)))
    plan_table = spark.createDataFrame(
        plan, "_source string, source_size long, target double, _multiplier double, _mean double, _fixed double, _slices long"
    )
    rate = F.coalesce("_fixed", _rate(F.col("_multiplier"), F.col("size") / F.col("_mean"), most))
    rated = rows.join(plan_table, rows["source"].eqNullSafe(plan_table["_source"])).select(
        "doc_id", "size", "source_size", "target", rate.alias("rate"), "_digest",
        F.xxhash64(F.col("source").isNull(), "source", F.pmod(F.xxhash64("_digest", "doc_id"), F.col("_slices"))).alias("_slice"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(_rounded(batches, most), _SCHEMA)

    ordered = rated.repartition("_slice").sortWithinPartitions("_slice", F.desc("size"), "doc_id", "_digest")
    return ordered.mapInArrow(run, _DDL)


def _rounded(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple]:
    at, carry = None, 0.0
    for slice_, doc_id, size, source_size, target, rate, digest_ in rows_of(
        batches, "_slice", "doc_id", "size", "source_size", "target", "rate", "_digest"
    ):
        if slice_ != at:
            at, carry = slice_, 0.0
        copies = min(most, max(0, math.floor(rate + carry / size + 0.5))) if size else 0
        carry += (rate - copies) * size
        yield doc_id, size, source_size, target, copies * size, copies, rate, digest_


def take(docs: DataFrame, weights: dict[str | None, float] | None = None, most: int = 3, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The mixed rows with all their columns, each as often as it is taken."""
    taken = mix(docs, weights, most, id_column, text_column, source_column).where("copies > 0")
    at, times, n = (unused(docs.columns, name) for name in ("_row", "_time", "_copies"))
    key = row_key(F.col("doc_id"), F.col("_digest")).alias(at)
    copies = taken.groupBy(key).agg(F.sum("copies").cast("int").alias(n))
    left = docs.withColumn(at, row_key(F.col(id_column).cast("long"), digest(F.col(text_column))))
    met = left.join(copies, at).dropDuplicates([at])
    return met.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*(left[c] for c in docs.columns))

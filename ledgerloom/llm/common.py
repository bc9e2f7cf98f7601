"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import pinned, scratch_path

__all__ = ["batches_of", "bounded_sample", "digest", "empty_if_null", "keep_rows", "map_side", "pinned", "read", "row_key", "rows_of", "scratch_path", "unused"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    # Workers of a local session find this package where the driver has it.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(columns: Sequence[str], base: str) -> str:
    """``base``, lengthened until it clashes with no column, in any case of its letters."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def empty_if_null(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def digest(text: Column) -> Column:
    """128 bits of a whole text; null counts as empty."""
    return F.unhex(F.md5(empty_if_null(text).cast("binary")))


#: Rows of a written table that a join may broadcast.
FEW_ROWS = 500_000


def map_side(table: DataFrame) -> DataFrame:
    """A narrow written table, to be broadcast if it has at most ``FEW_ROWS`` rows.

    The count comes from the files' footers. A larger table is joined by a
    shuffle, with the same result.
    """
    return F.broadcast(table) if table.count() <= FEW_ROWS else table


def bounded_sample(table: DataFrame, id_: str, size: int) -> DataFrame:
    """At most ``size`` rows, those with the smallest id hashes.

    A first cut by hash leaves about four times as many over all partitions, so
    what is ordered does not grow with the number of partitions.
    """
    mark = F.pmod(F.xxhash64(id_), F.lit(1 << 40))
    share = min(1.0, 4 * size / max(1, table.count()))
    return table.where(mark <= F.lit(int(share * (1 << 40)))).orderBy(mark, id_).limit(size)


def row_key(id_: Column, digest_: Column) -> Column:
    """128 bits of a row's id, which may be null, and of its text's digest."""
    name = F.coalesce(id_.cast("string"), F.lit("null"))
    return F.unhex(F.md5(F.concat(name, F.lit(":"), F.hex(digest_)).cast("binary")))


def keep_rows(docs: DataFrame, keys: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows of ``docs`` whose id and text digest are in ``keys`` (id, digest), each once.

    Both columns take part, so rows that share an id but not a text stay apart,
    and null ids match one another. Rows that repeat id and text come out once.
    """
    # One key, never null, for the join and for dropping repeats: texts move once.
    at = unused(docs.columns, "_row")
    left = docs.withColumn(at, row_key(F.col(id_column).cast("long"), digest(F.col(text_column))))
    right = keys.toDF("_id", "_digest").select(row_key(F.col("_id"), F.col("_digest")).alias(at))
    return left.join(right, at, "left_semi").dropDuplicates([at]).drop(at)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples of the named columns."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches from rows, cut by rows and by bytes of their binary and text cells."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if len(held) >= size or weight >= most_bytes:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

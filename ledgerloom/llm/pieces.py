"""Documents as numbered token pieces, and their placing in sequences by a plan over lengths.

A packing plan depends on the lengths alone, and there are at most as many
lengths as a sequence has tokens. So the histogram, of bounded size, is planned
on the driver; the pieces themselves stay where they are and find their place by
their number among those of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import batches_of, empty_if_null, pinned, rows_of

#: Ends every document.
END = 0

_FIELDS = [
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("slice", pa.int32()), ("number", pa.int64()),
]
_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, slice int, number long"


class Slot(NamedTuple):
    """Where the pieces of one length numbered from ``first`` to before ``end`` go.

    ``each`` of them lie side by side from ``offset`` on in every sequence, from
    sequence ``sequence`` on.
    """

    length: int
    first: int
    end: int
    sequence: int
    each: int
    offset: int


def cut(docs: DataFrame, seq_len: int, vocabulary: str | None = None, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of all documents, written once.

    A document is the ids of its whole text and then 0; null text counts as empty.
    One that is longer than ``seq_len`` is cut from its end into whole pieces, the
    first of which may be shorter. ``number`` counts the pieces of a length within
    a slice, which is what one task wrote. With ``with_ids`` the ids themselves
    come along, as :func:`unpacked` reads them: they are most of what is written
    and shuffled then, so they are compressed.
    """
    path = vocabulary or bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(_FIELDS + [("ids", pa.binary())] * with_ids)
        return batches_of(_pieces(batches, path, seq_len, with_ids), schema)

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), empty_if_null(F.col(text_column)).alias("text"))
    return pinned(texts.mapInArrow(run, _DDL + ", ids binary" * with_ids), "pieces")


def id_type(vocab: bpe.Vocabulary) -> np.dtype:
    most = max([END, *vocab.ids.values(), *vocab.specials.values()])
    return np.dtype("<u2") if most < 1 << 16 else np.dtype("<u4")


def unpacked(ids: list[bytes]) -> list[bytes]:
    """Little-endian ids, of the vocabulary's :func:`id_type`."""
    read = zstandard.ZstdDecompressor().decompress
    return [read(x) for x in ids]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, seq_len: int, with_ids: bool) -> Iterator[tuple]:
    vocab, numbers = bpe.vocabulary(path), {}
    place, stored = TaskContext.get().partitionId(), id_type(vocab)
    pack = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
    for doc_id, text in rows_of(batches, "doc_id", "text"):
        ids = np.append(bpe.text_ids(vocab, text), np.uint32(END)).astype("<u4")
        first = len(ids) % seq_len
        ends = [*([first] if first else []), *range(first + seq_len, len(ids) + 1, seq_len)]
        start = 0
        for piece, end in enumerate(ends):
            part = ids[start:end]
            number = numbers[end - start] = numbers.get(end - start, -1) + 1
            row = doc_id, piece, start, end - start, zlib.crc32(part), place, number
            yield (*row, pack(part.astype(stored).tobytes())) if with_ids else row
            start = end


def lengths(pieces: DataFrame) -> dict[int, int]:
    """Pieces per length: at most one entry for each length up to a sequence's."""
    return {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}


def place(pieces: DataFrame, plan: Callable[[dict[int, int]], list[Slot]]) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` as ``plan`` has them.

    The pieces of a length are numbered through by adding, to the number within
    its slice, how many the slices before it have: one row per slice and length
    is shuffled for that.
    """
    spark = pieces.sparkSession
    slots = plan(lengths(pieces))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        pieces.groupBy("slice", "length")
        .agg((F.max("number") + 1).alias("n"))
        .select("slice", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    )
    table = spark.createDataFrame(
        slots or [Slot(0, 0, 0, 0, 1, 0)],
        "_length long, _first long, _end long, _sequence long, _each long, _offset long",
    )
    numbered = pieces.join(firsts, ["slice", "length"]).withColumn("_number", F.col("number") + F.col("_before"))
    mine = (F.col("length") == F.col("_length")) & F.col("_number").between(F.col("_first"), F.col("_end") - 1)
    # At most one slot per length and run of equal sequences: bounded by the plan.
    placed = numbered.join(F.broadcast(table), mine)
    return placed.withColumns(
        {
            "sequence_id": F.expr("_sequence + (_number - _first) div _each"),
            "offset": F.expr("_offset + ((_number - _first) % _each) * length"),
        }
    ).drop("_before", "_number", "_length", "_first", "_end", "_sequence", "_each", "_offset", "slice", "number")

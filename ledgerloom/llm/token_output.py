"""Packed token ids as rows of a matrix, for a trainer to read without tokenizing.

Method: best-fit decreasing. Pieces, the longest first, go each into the fullest
sequence that still has room, which a segment tree over the room left finds. As
in ``packing`` the plan is made over counts per length: equal pieces that meet
equal rooms are placed at once, so its size depends on the sequence's length and
not on the corpus. Documents that are too long are cut, nothing is lost.

A row of the result is a row of the id matrix (``input_ids``, little-endian,
filled up with 0) with its cumulative segment lengths, its positions, which
start anew at each segment, and what each segment is: document, piece, start.

Defined results: null text counts as empty, and an empty document is the single
id 0; repeated rows are packed each; equal lengths are interchangeable and taken
in the order in which they were written; an empty table gives an empty one;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row

from . import bpe
from .common import batches_of, rows_of
from .pieces import END, Slot, cut, id_type, place, unpacked


class RoomTree:
    """Which amounts of room are left somewhere: a segment tree over 0 .. capacity."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, room: int, there: bool) -> None:
        node = self.size + room
        self.any[node] = there
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def least_from(self, room: int) -> int | None:
        """The smallest amount of at least ``room``."""
        node = self.size + room
        while not self.any[node]:
            while node % 2:
                if node == 1:
                    return None
                node //= 2
            node += 1
        while node < self.size:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.size


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Slot]:
    """A place for every piece, given how many there are of each length."""
    slots: list[Slot] = []
    tree, groups = RoomTree(capacity), {}
    sequences = 0

    def leave(room: int, first: int, count: int) -> None:
        if count and room:
            groups.setdefault(room, []).append((first, count))
            tree.set(room, True)

    for length, pieces in sorted(counts.items(), reverse=True):
        taken = 0
        while taken < pieces:
            room = tree.least_from(length)
            if room is None:
                each = capacity // length
                # As many new sequences as these pieces need.
                room, first, count = capacity, sequences, -(-(pieces - taken) // each)
                sequences += count
            else:
                first, count = groups[room].pop(0)
                if not groups[room]:
                    tree.set(room, False)
            # Best fit stays with a sequence as long as it has room for another.
            each = room // length
            full = min(count, (pieces - taken) // each)
            if full:
                slots.append(Slot(length, taken, taken + full * each, first, each, capacity - room))
                taken += full * each
                leave(room - each * length, first, full)
            rest = min(pieces - taken, each) if full < count else 0
            if rest:
                slots.append(Slot(length, taken, taken + rest, first + full, rest, capacity - room))
                taken += rest
                leave(room - rest * length, first + full, 1)
            leave(room, first + full + (rest > 0), count - full - (rest > 0))
    return slots


_DDL = "sequence_id long, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, pieces array<int>, starts array<long>"
_SCHEMA = pa.schema(
    [("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("input_ids", pa.binary()), ("position_ids", pa.binary()),
     ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64()))]
)


def matrix_rows(docs: DataFrame, seq_len: int = 2048, vocabulary: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per sequence: ids, positions, cumulative segment lengths, and what the segments are."""
    stored = id_type(bpe.vocabulary(vocabulary or bpe.default_path()))
    pieces = cut(docs, seq_len, vocabulary, id_column, text_column, with_ids=True)
    placed = place(pieces, lambda counts: best_fit_decreasing(counts, seq_len))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(_assembled(batches, seq_len, stored), _SCHEMA)

    columns = placed.select("sequence_id", "offset", "doc_id", "piece", "start", "ids")
    return columns.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset").mapInArrow(run, _DDL)


def _assembled(batches: Iterator[pa.RecordBatch], seq_len: int, stored: np.dtype) -> Iterator[tuple]:
    at, held = None, []
    for row in rows_of(batches, "sequence_id", "doc_id", "piece", "start", "ids"):
        if row[0] != at and held:
            yield _sequence(at, held, seq_len, stored)
            held = []
        at = row[0]
        held.append(row[1:])
    if held:
        yield _sequence(at, held, seq_len, stored)


def _sequence(at: int, segments: list[tuple], seq_len: int, stored: np.dtype) -> tuple:
    doc_ids, pieces, starts, packed = zip(*segments)
    ids = unpacked(packed)
    lengths = [len(x) // stored.itemsize for x in ids]
    ends = np.cumsum([0, *lengths])
    used = int(ends[-1])
    row = np.full(seq_len, END, stored)
    row[:used] = np.frombuffer(b"".join(ids), stored)
    positions = np.zeros(seq_len, np.dtype("<u4"))
    positions[:used] = np.arange(used) - np.repeat(ends[:-1], lengths)
    return at, used, row.tobytes(), positions.astype("<u2" if seq_len <= 1 << 16 else "<u4").tobytes(), ends.tolist(), list(doc_ids), list(pieces), list(starts)


def write(docs: DataFrame, path: str, seq_len: int = 2048, vocabulary: str | None = None) -> None:
    """Write the matrix as Parquet, its rows in shards as Spark's tasks make them."""
    matrix_rows(docs, seq_len, vocabulary).write.mode("overwrite").parquet(path)


def segments(row: Row, bytes_per_id: int = 2) -> list[tuple[int, int, int, np.ndarray]]:
    """(document, piece, start, ids) of the segments of one row."""
    ids = np.frombuffer(bytes(row["input_ids"]), f"<u{bytes_per_id}")
    ends = row["cu_seqlens"]
    return [
        (doc, piece, start, ids[a:b])
        for doc, piece, start, a, b in zip(row["doc_ids"], row["pieces"], row["starts"], ends, ends[1:])
    ]

"""Vectors as short codes: one codebook a part, trained and applied in integers.

Method: equal-average search. The entries of a codebook are sorted by the sum of
their components. From where the sum of a vector's part would stand, the search
goes outward in both directions; as (difference of sums)^2 / positions is never
above the squared distance, it ends when that strictly exceeds the best distance
found. Ties go to the entry with the lower index.

Training: every part's codebook starts as that part of the vectors with the
smallest ids. A round assigns all vectors and replaces each entry by the floor
of the mean of what it got; an entry that got nothing stays. A task adds up its
vectors per entry and position, so a round moves sums only, and the codebooks,
of ``parts * entries`` vectors' parts whatever the input, are all that the driver
and the tasks exchange.

Defined results: a component x counts as floor(scale * x), taken as double. Rows
whose vector is null or holds null or non-finite components are dropped. A vector
that is shorter than the longest counts as followed by zeros, up to a multiple of
``parts``. Rows that repeat come out as often; codebooks start from distinct ids,
null last, and of rows that share an id from the smallest vector. With fewer ids
than entries, codebooks are smaller. An empty table gives an empty one. Null
labels count as one label; columns other than id, vector and label are not read.
Squared distances or sums beyond 64 bits are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pinned, unused

_SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("position", pa.int32()), ("total", pa.int64()), ("n", pa.int64())])
_SUMS_DDL = "part int, entry int, position int, total long, n long"
_FIRST_DDL = "vec_id long, v array<long>"
#: Rows that a task searches at once.
ROWS = 16_384


def compress(
    vectors: DataFrame,
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row per vector that is kept."""
    if entries > 256:
        raise ValueError("two hex digits name 256 entries at most")
    rows = pinned(_integers(vectors, scale, id_column, vector_column, label_column), "integers")
    books = train(rows, parts, entries, rounds)
    if books is None:
        return _coded(rows, np.zeros((parts, 1, 1), np.int64)).select("vec_id", "code", "error", F.lit(None).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = pinned(_coded(rows, books), "codes")
    label_error = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    joined = coded.join(label_error, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components, by part, entry and position, with commas between them."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def train(rows: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray | None:
    """The codebooks as (part, entry, position), from whole-number rows (vec_id, v); None without rows."""
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None
    width = max(1, -(-longest // parts))
    first = rows.mapInArrow(_smallest(entries), _FIRST_DDL).groupBy("vec_id").agg(F.min("v").alias("v"))
    seeds = first.orderBy(F.asc_nulls_last("vec_id")).limit(entries).collect()
    books = _cut([r.v for r in seeds], parts, width)
    for _ in range(rounds):
        sums = rows.select("v").mapInArrow(_summed(books), _SUMS_DDL)
        sums = sums.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        new = books.copy()
        for r in sums.collect():
            new[r.part, r.entry, r.position] = r.total // r.n
        books = new
    return books


def _integers(vectors: DataFrame, scale: int, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    v = F.col(vector_column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    kept = vectors.where(v.isNotNull() & finite)
    return kept.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).alias("label"), whole.alias("v"))


def _smallest(entries: int):
    """The vectors with the ``entries`` smallest ids of a task, the smallest vector of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int | None, list[int]] = {}
        for batch in batches:
            ids, valid = batch.column("vec_id").fill_null(0).to_numpy(), batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
            # Only rows that may be among the smallest become Python values.
            order = np.lexsort((ids, ~valid))
            distinct = np.r_[True, (np.diff(ids[order]) != 0) | (valid[order][1:] != valid[order][:-1])]
            taken = order[np.cumsum(distinct) <= entries]
            few = batch.take(pa.array(taken))
            for id_, v in zip(few.column("vec_id").to_pylist(), few.column("v").to_pylist()):
                held[id_] = min(held.get(id_, v), v)
            for id_ in sorted(held, key=lambda i: (i is None, i or 0))[entries:]:
                del held[id_]
        schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64()))])
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), schema.field("v").type)], schema=schema)

    return run


# ---- within a task ------------------------------------------------------------


def _cut(vectors: list[list[int]], parts: int, width: int) -> np.ndarray:
    """(part, row, position) of vectors that are filled up with zeros."""
    filled = np.zeros((len(vectors), parts * width), np.int64)
    for row, v in zip(filled, vectors):
        row[: len(v)] = v
    return np.ascontiguousarray(filled.reshape(len(vectors), parts, width).swapaxes(0, 1))


def _parts_of(batch: pa.RecordBatch, books: np.ndarray) -> np.ndarray:
    parts, _, width = books.shape
    column = batch.column("v")
    lengths = column.value_lengths().to_numpy()
    filled = np.zeros((len(lengths), parts * width), np.int64)
    filled[np.arange(parts * width) < lengths[:, None]] = column.flatten().to_numpy()
    return np.ascontiguousarray(filled.reshape(-1, parts, width).swapaxes(0, 1))


class EqualAverageSearch:
    """The nearest entry of one codebook, by sums of components."""

    def __init__(self, book: np.ndarray) -> None:
        sums = book.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")
        self.sums, self.book, self.width = sums[self.order], book[self.order], book.shape[1]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each vector's nearest entry, and the squared distance to it."""
        sums = vectors.sum(axis=1)
        best = np.full(len(vectors), np.iinfo(np.int64).max)
        index = np.full(len(vectors), len(self.book))
        up = np.searchsorted(self.sums, sums)
        down = up - 1
        left = np.arange(len(vectors))
        while len(left):
            # The nearer of the two sums that come next; none is left beyond the ends.
            below = np.where(down[left] >= 0, sums[left] - self.sums[down[left]], -1)
            above = np.where(up[left] < len(self.sums), self.sums[np.minimum(up[left], len(self.sums) - 1)] - sums[left], -1)
            goes_down = (below >= 0) & ((above < 0) | (below <= above))
            gap = np.where(goes_down, below, above)
            # All further sums lie at least as far off, on either side.
            open_ = (gap >= 0) & ~self._out_of_reach(gap, best[left])
            left, goes_down = left[open_], goes_down[open_]
            at = np.where(goes_down, down[left], up[left])
            distance = ((vectors[left] - self.book[at]) ** 2).sum(axis=1)
            entry = self.order[at]
            better = (distance < best[left]) | ((distance == best[left]) & (entry < index[left]))
            best[left[better]], index[left[better]] = distance[better], entry[better]
            down[left[goes_down]] -= 1
            up[left[~goes_down]] += 1
        return index, best

    def _out_of_reach(self, gap: np.ndarray, best: np.ndarray) -> np.ndarray:
        """gap^2 / width > best, without leaving whole numbers."""
        return -(-gap * gap // self.width) > best


def _fits(vectors: np.ndarray, books: np.ndarray) -> None:
    most = float(np.abs(vectors.astype(np.float64)).max(initial=0)) + float(np.abs(books.astype(np.float64)).max(initial=0))
    # Of a squared distance, and of the square of a difference of sums.
    if most * most * books.shape[2] ** 2 * books.shape[0] >= float(1 << 62):
        raise OverflowError("a squared distance may not fit into 64 bits")


def _assigned(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches, their vectors by part, and per part and row the index and the squared distance."""
    searches = [EqualAverageSearch(book) for book in books]
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            vectors = _parts_of(batch, books)
            _fits(vectors, books)
            found = [s.nearest(v) for s, v in zip(searches, vectors)]
            yield batch, vectors, np.array([f[0] for f in found]), np.array([f[1] for f in found])


def _summed(books: np.ndarray):
    """Per part, entry and position the sum of what the entry got, and how much it got."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for _, vectors, index, _ in _assigned(batches, books):
            for p in range(parts):
                np.add.at(totals[p], index[p], vectors[p])
                counts[p] += np.bincount(index[p], minlength=entries)
        part, entry, position = np.indices(books.shape).reshape(3, -1).astype(np.int32)
        n = np.repeat(counts.ravel(), width)
        got = n > 0
        columns = part[got], entry[got], position[got], totals.ravel()[got], n[got]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_SUMS)

    return run


def _coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of every row."""
    digits = np.array([f"{i:02x}" for i in range(256)])
    label = rows.schema["label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, index, distance in _assigned(batches, books):
            code = ["".join(r) for r in digits[index.T].tolist()]
            error = pa.array(distance.sum(axis=0), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), error], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"vec_id long, label {label.dataType.simpleString()}, code string, error long")

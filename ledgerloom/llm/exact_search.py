"""The k vectors with the largest integer inner products, exactly, for every query.

Method: three-phase uniform threshold. The positions of a vector are cut into
parts; the partial products of one part form the local score list of that part.
Phase 1 gathers the heads of all local lists, adds up what they name, and takes
the k-th best sum as a cutoff, which cannot be too high. Phase 2 gives every
query its cutoff: an entry that reaches it has at least one partial score of
cutoff / parts, rounded up, so entries below that in all lists are passed over.
Phase 3 adds the missing partial scores of what is left and ranks the sums.

Queries and candidates are dealt into blocks, and each place compares one block
with another: the local lists of a place meet without being moved. What leaves a
place is k entries a query at most. All pairs are scored, as an exact answer
over unrestricted vectors asks for, but none is written for being scored.

Defined results: a component x counts as floor(scale * x), taken as double. Rows
whose vector is null or holds null or non-finite components take no part. Only
vectors of one length are compared. A row with the query's id is the query's
own, repeated rows included; other rows that repeat are entries each. A query
that repeats id and vector is asked once; queries that share an id only are both
asked, and both answers stand under that id. Ties go to the smaller id, null ids
last. Queries without any candidate have no rows, an empty table gives an empty
one, and columns other than id and vector are not read. Sums beyond 64 bits are
an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pinned

#: Rows of a block, of queries or of candidates.
BLOCK = 8192
#: Candidates lie in so many blocks at least, so that few of them keep several tasks busy.
LEAST_BLOCKS = 16
#: Cells of a partial score matrix that a place holds at once.
CELLS = 2_000_000
#: Beyond it sums of products are no longer exact in double precision.
EXACT = float(1 << 53)

_PLACE = ("of_query", "of_candidate")
_SCORED = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_SCORED_DDL = "query long, query_id long, vec_id long, score long"


def top_products(
    vectors: DataFrame,
    k: int = 5,
    is_query: Callable[[Column], Column] = lambda id_: id_ % 50 == 0,
    scale: int = 256,
    parts: int = 2,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best candidates of every query, all if fewer.

    ``is_query`` says by its id whether a row is asked. ``parts`` is the number of
    local score lists of a query.
    """
    rows = pinned(_integers(vectors, scale, id_column, vector_column), "integers")
    asked = rows.where(is_query(F.col("vec_id"))).dropDuplicates(["vec_id", "v"])
    asked = pinned(asked.withColumn("query", F.monotonically_increasing_id()), "queries")
    n_queries = -(-asked.count() // BLOCK) or 1
    n_blocks = max(LEAST_BLOCKS, -(-rows.count() // BLOCK))

    first = _at_places(rows, asked.withColumn("cutoff", F.lit(None).cast("long")), n_queries, n_blocks)
    heads = _best(first.applyInArrow(_heads(k, parts), _SCORED_DDL), k)
    # The k-th best of what the local lists name; without k entries all must come.
    cutoffs = heads.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("cutoff"))
    second = _at_places(rows, asked.join(cutoffs, "query", "left"), n_queries, n_blocks)
    found = _best(second.applyInArrow(_above(k, parts), _SCORED_DDL), k)
    return found.select("query_id", "rank", "vec_id", "score")


def _integers(vectors: DataFrame, scale: int, id_column: str, vector_column: str) -> DataFrame:
    v = F.col(vector_column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    return vectors.where(v.isNotNull() & finite).select(F.col(id_column).cast("long").alias("vec_id"), whole.alias("v"))


def _at_places(rows: DataFrame, asked: DataFrame, n_queries: int, n_blocks: int):
    """Candidates and queries, each at all places of its block, grouped by place."""
    number = F.monotonically_increasing_id()
    none = F.lit(None).cast("long")
    candidates = rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias(_PLACE[0]),
        F.pmod(F.xxhash64(number), F.lit(n_blocks)).cast("int").alias(_PLACE[1]),
        none.alias("query"), none.alias("cutoff"), "vec_id", "v",
    )
    queries = asked.select(
        F.pmod(F.xxhash64("query"), F.lit(n_queries)).cast("int").alias(_PLACE[0]),
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias(_PLACE[1]),
        "query", "cutoff", "vec_id", "v",
    )
    return candidates.unionByName(queries).groupBy(*_PLACE)


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# ---- within a place -----------------------------------------------------------


class _Slice:
    """Some queries of a place against all its candidates: partial scores, part by part."""

    def __init__(self, queries: np.ndarray, candidates: np.ndarray, own: np.ndarray, parts: int) -> None:
        cuts = np.array_split(np.arange(candidates.shape[1]), parts)
        self.lists = [queries[:, c] @ candidates[:, c].T for c in cuts if len(c)] or [np.zeros(own.shape)]
        self.own = own

    def totals(self, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The whole scores of the entries named: the missing partial scores are added."""
        return sum(scores[at] for scores in self.lists).astype(np.int64)


def _heads(k: int, parts: int) -> Callable[[pa.Table], pa.Table]:
    """Phase 1: the heads of the local lists, with the sums of what they name."""

    def named(part: _Slice, cutoffs: np.ndarray) -> np.ndarray:
        mask = np.zeros(part.own.shape, bool)
        rows = np.arange(len(mask))[:, None]
        for scores in part.lists:
            # One more than k, as the query's own row may be among them.
            depth = min(k + 1, scores.shape[1])
            mask[rows, np.argpartition(scores, -depth, axis=1)[:, -depth:]] = True
        return mask

    return _scored(k, parts, named)


def _above(k: int, parts: int) -> Callable[[pa.Table], pa.Table]:
    """Phases 2 and 3: entries with a partial score of their share of the cutoff."""

    def named(part: _Slice, cutoffs: np.ndarray) -> np.ndarray:
        share = np.ceil(cutoffs / len(part.lists))[:, None]
        mask = part.lists[0] >= share
        for scores in part.lists[1:]:
            mask |= scores >= share
        return mask

    return _scored(k, parts, named)


def _scored(k: int, parts: int, named: Callable[[_Slice, np.ndarray], np.ndarray]) -> Callable[[pa.Table], pa.Table]:
    def at_place(place: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(_of_place(place, k, parts, named)), _SCORED)

    return at_place


def _of_place(place: pa.Table, k: int, parts: int, named) -> Iterator[pa.RecordBatch]:
    lengths = place.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        yield from _of_length(place.filter(pa.array(lengths == length)), int(length), k, parts, named)


def _of_length(place: pa.Table, length: int, k: int, parts: int, named) -> Iterator[pa.RecordBatch]:
    asked = place.column("query").is_valid().to_numpy()
    if not asked.any() or asked.all():
        return
    flat = place.column("v").combine_chunks().flatten().to_numpy().reshape(len(asked), length)
    exact = _numbers_for(flat[asked], flat[~asked])
    questions, candidates = flat[asked].astype(exact), flat[~asked].astype(exact)
    ids, known = _ids(place.column("vec_id"))
    query, cutoff = (place.column(c).filter(pa.array(asked)).to_pandas().to_numpy(np.float64) for c in ("query", "cutoff"))
    query = place.column("query").filter(pa.array(asked)).to_numpy()
    cutoff = np.where(np.isnan(cutoff), -np.inf, cutoff)
    of_query, of_candidate = (ids[asked], known[asked]), (ids[~asked], known[~asked])
    # Candidates in the order of their ids, null last: a stable order settles ties.
    order = np.lexsort((of_candidate[0], ~of_candidate[1]))
    candidates, names, has_name = candidates[order], of_candidate[0][order], of_candidate[1][order]
    step = max(1, CELLS // len(candidates))
    for start in range(0, len(questions), step):
        some = slice(start, start + step)
        own = (names == of_query[0][some, None]) & has_name & of_query[1][some, None]
        own |= ~has_name & ~of_query[1][some, None]
        part = _Slice(questions[some], candidates, own, parts)
        at = np.nonzero(named(part, cutoff[some]) & ~own)
        totals = part.totals(at)
        enough = totals >= cutoff[some][at[0]]
        yield _ranked(k, query[some], of_query[0][some], of_query[1][some], (at[0][enough], at[1][enough]), totals[enough], names, has_name)


def _ranked(k, query, query_id, has_query_id, at, totals, names, has_name) -> pa.RecordBatch:
    """At most ``k`` entries of each query, by score and then by the order of candidates."""
    order = np.lexsort((at[1], -totals, at[0]))
    rows, columns, totals = at[0][order], at[1][order], totals[order]
    first = np.searchsorted(rows, np.arange(len(query)))
    kept = np.arange(len(rows)) - first[rows] < k
    rows, columns, totals = rows[kept], columns[kept], totals[kept]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(query[rows], pa.int64()),
            pa.array(query_id[rows], pa.int64(), mask=~has_query_id[rows]),
            pa.array(names[columns], pa.int64(), mask=~has_name[columns]),
            pa.array(totals, pa.int64()),
        ],
        schema=_SCORED,
    )


def _ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy(), column.is_valid().to_numpy()


def _numbers_for(a: np.ndarray, b: np.ndarray) -> type:
    """Doubles where all sums of products are exact in them, 64-bit integers where those are needed."""
    most = max(1.0, np.abs(a.astype(np.float64)).max(initial=0)) * max(1.0, np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if most >= float(1 << 63):
        raise OverflowError("an inner product may not fit into 64 bits")
    return np.float64 if most < EXACT else np.int64

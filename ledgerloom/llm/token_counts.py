"""Token counts of whole texts, with the answers to budget questions.

Method: prefix dynamic programming (``bpe.PrefixCounts``). The count at a prefix
follows from those at shorter ones, so neither a total nor the longest prefix
that fits a budget needs a second encoding. ``prefix_table`` keeps the count at
every prefix of every document, compressed; ``fit_budgets`` and ``count_prefixes``
answer any number of later questions from it alone, without texts or vocabulary.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows
each come out; a null id stays null; an empty table gives an empty one; other
columns, whatever their names, are not read. Whole texts are counted, of any
length; a run without a cut (say a million letters) takes time in proportion.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import batches_of, empty_if_null, rows_of

_ROWS = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fitting_chars", pa.int64())]
)


def count_tokens(
    docs: DataFrame,
    limit: int = 1024,
    vocabulary: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: bytes, tokens, whether over ``limit``, code points that fit it.

    ``vocabulary`` is the path of a byte-level BPE file, the same on every machine.
    """
    path = vocabulary or bpe.default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(_counted(batches, path, limit), _ROWS)

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), empty_if_null(F.col(text_column)).alias("text"))
    return texts.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fitting_chars long")


def _counted(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[tuple]:
    counts = bpe.prefix_counts(path)
    for doc_id, text in rows_of(batches, "doc_id", "text"):
        tokens, fitting = counts.count_and_fit(text, limit)
        yield doc_id, len(text.encode()), tokens, tokens > limit, fitting


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("prefix_counts", pa.binary())])


def prefix_table(docs: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: code points, tokens, and the token counts of all its prefixes, compressed.

    The count of a prefix is what the library gives for that prefix alone; it may
    fall where a longer prefix merges more. Null text counts as empty.
    """
    path = vocabulary or bpe.default_path()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = bpe.prefix_counts(path)

        def rows() -> Iterator[tuple]:
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                at = counts.at_every_prefix(text)
                yield doc_id, len(text), int(at[-1]), zlib.compress(np.diff(at).astype("<i4").tobytes())

        return batches_of(rows(), _KEPT)

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), empty_if_null(F.col(text_column)).alias("text"))
    return texts.mapInArrow(keep, "doc_id long, n_chars long, n_tokens long, prefix_counts binary")


def _kept(prefix_counts: bytes) -> np.ndarray:
    return np.cumsum(np.append(0, np.frombuffer(zlib.decompress(prefix_counts), "<i4")))


def fit_budgets(table: DataFrame, budgets: Sequence[int]) -> DataFrame:
    """(doc_id, budget, fitting_chars, fitting_tokens) for each document and budget.

    The longest prefix of at most ``budget`` tokens, in code points; it may end inside a
    special string. A budget below 0 is taken as 0; no budgets give no rows.
    """
    wanted = [int(b) for b in budgets]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("budget", pa.int64()), ("fitting_chars", pa.int64()), ("fitting_tokens", pa.int64())])

        def rows() -> Iterator[tuple]:
            for doc_id, kept in rows_of(batches, "doc_id", "prefix_counts"):
                at = _kept(kept)
                # Least count from here on: it rises, so the longest prefix is found by bisection.
                ahead = np.minimum.accumulate(at[::-1])[::-1]
                for budget in wanted:
                    chars = int(np.searchsorted(ahead, max(0, budget), "right")) - 1
                    yield doc_id, budget, chars, int(at[chars])

        return batches_of(rows(), schema)

    return table.select("doc_id", "prefix_counts").mapInArrow(fit, "doc_id long, budget long, fitting_chars long, fitting_tokens long")


def count_prefixes(table: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """(doc_id, chars, n_tokens): tokens of each document cut to ``chars`` code points; shorter ones count whole."""
    wanted = [max(0, int(n)) for n in lengths]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("chars", pa.int64()), ("n_tokens", pa.int64())])

        def rows() -> Iterator[tuple]:
            for doc_id, kept in rows_of(batches, "doc_id", "prefix_counts"):
                at = _kept(kept)
                for chars in wanted:
                    yield doc_id, chars, int(at[min(chars, len(at) - 1)])

        return batches_of(rows(), schema)

    return table.select("doc_id", "prefix_counts").mapInArrow(count, "doc_id long, chars long, n_tokens long")

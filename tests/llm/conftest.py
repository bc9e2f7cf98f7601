import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pytest

#: Rows that every operator over documents must take: nulls, empties, ties, repeats.
AWKWARD = [
    (1, "the same words in the same order, twice over", "a"),
    (1, "the same words in the same order, twice over", "a"),
    (2, "the  same words in the\tsame order,\r\ntwice over", None),
    (3, None, "b"),
    (4, "", None),
    (5, " \t\n\x0b\x0c\r ", "b"),
    (None, "a text without an id, that is long enough to have shingles", "a"),
    (None, None, None),
    (6, "word " * 30_000, "a"),
    (7, "x" * 50_000, "c"),
    (8, "é 漢字 😀 <|endoftext|> it's  we'll", "c"),
]


@pytest.fixture
def awkward(spark):
    """Awkward rows, with extra columns whose names clash with those that operators add."""
    extra = "kept boolean, _digest string, SEQUENCE_ID int, _text int, uid string, size int, _parts int, _copies int, _row int"
    rows = [(*r, True, "d", 1, 2, "u", 3, 4, 5, 6) for r in AWKWARD]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {extra}")


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, kept boolean")

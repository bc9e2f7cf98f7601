"""Quality of documents by ordinal regression on graded ratings.

Method: a cumulative-link (proportional odds) model. One weight per hashed text
feature, shared by all grades, gives a score; ordered thresholds cut it, so that
P(grade >= k) = logistic(score - threshold k). Features are words, shapes of
words and immediate repetitions, each with the square root of its share of the
text. Expected grade and tail probability decide: a document is kept if
P(grade >= 1) is at least ``keep``.

Grades from ratings: 0 for low quality, 1 for good but toxic, 2 for good. The
model is fitted on the driver from at most ``sample`` labelled documents, those
with the smallest id hashes, which is the operator's only bound; the corpus is
scored whole, in place, with no shuffle.

Defined results: null text counts as empty, and a text without words gets the
score 0; labels without a document, without a rating or with a null id are
passed over, and of several labels of a document the lowest grade counts;
without labels every document has the same prior, grade 2; repeated rows are
scored each; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, empty_if_null, rows_of

GRADES = 3
#: Hashed features.
DIMENSIONS = 1 << 18
#: Labelled documents to fit on, at most.
SAMPLE = 8000
#: A feature takes part if so many documents of the sample have it and its amount
#: correlates with the grade by so many standard errors.
LEAST_DOCUMENTS, LEAST_Z = 5, 4.0
PENALTY, STEPS = 1e-3, 800
#: Words that a worker remembers.
REMEMBERED = 200_000

_REPEAT = 0


class Model(NamedTuple):
    """Weights by feature, and thresholds 1 .. GRADES - 1 in rising order."""

    weights: dict[int, float]
    thresholds: tuple[float, ...]


def shape(word: str) -> str:
    """Letters as a or A, digits as 9, runs of one sign as one."""
    out = []
    for c in word:
        c = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != c:
            out.append(c)
    return "".join(out)


class _Features(dict):
    """The features of a word: that of its letters and that of its shape."""

    def __missing__(self, word: str) -> tuple[int, int]:
        core = "".join(filter(str.isalnum, word)).lower()
        found = _hashed("w" + core), _hashed("s" + shape(word))
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found
        return found


def _hashed(feature: str) -> int:
    return 1 + xxhash.xxh3_64_intdigest(feature) % (DIMENSIONS - 1)


_features = _Features()


def vector(text: str) -> dict[int, float]:
    """The features of a whole text with their weights in it."""
    words = text.split()
    if not words:
        return {}
    counts: dict[int, int] = {}
    for word, n in Counter(words).items():
        letters, form = _features[word]
        counts[letters] = counts.get(letters, 0) + n
        counts[form] = counts.get(form, 0) + n
    repeats = sum(map(eq, words, islice(words, 1, None)))
    if repeats:
        counts[_REPEAT] = repeats
    return {i: math.sqrt(n / len(words)) for i, n in counts.items()}


def score(model: Model, text: str) -> float:
    """The sum over the text's features, of which only those with a weight are looked at closely."""
    words = text.split()
    if not words:
        return 0.0
    weights, counts = model.weights, {}
    for word, n in Counter(words).items():
        letters, form = _features[word]
        if letters in weights:
            counts[letters] = counts.get(letters, 0) + n
        if form in weights:
            counts[form] = counts.get(form, 0) + n
    if _REPEAT in weights:
        counts[_REPEAT] = sum(map(eq, words, islice(words, 1, None)))
    return sum(weights[i] * math.sqrt(n / len(words)) for i, n in sorted(counts.items()))


def tails(model: Model, value: float) -> list[float]:
    """P(grade >= k) for k = 1 .. GRADES - 1."""
    return [1 / (1 + math.exp(min(700.0, max(-700.0, t - value)))) for t in model.thresholds]


def _labelled(docs: DataFrame, labels: DataFrame, sample: int, id_column: str, text_column: str) -> list[tuple]:
    """(id, grade, features, values) of at most ``sample`` labelled documents."""
    grade = F.when(F.col("quality") < 1, 0).when(F.col("toxic") > 0, 1).otherwise(2)
    rated = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id"), grade.alias("grade"))
    rated = rated.groupBy("_id").agg(F.min("grade").alias("grade"))
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), empty_if_null(F.col(text_column)).alias("text"))
    # Ids that a document has: the sample is drawn after that join, on ids alone.
    known = rated.join(texts.select(F.col("doc_id").alias("_id")), "_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # At most ``sample`` rows of two numbers.
    rows = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["_id"]).select("doc_id", "grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("features", pa.binary()), ("amounts", pa.binary())])

        def found() -> Iterator[tuple]:
            for doc_id, grade, text in rows_of(batches, "doc_id", "grade", "text"):
                items = sorted(vector(text).items())
                yield doc_id, grade, np.array([i for i, _ in items], np.int32).tobytes(), np.array([x for _, x in items], np.float32).tobytes()

        return batches_of(found(), schema)

    got = rows.mapInArrow(run, "doc_id long, grade int, features binary, amounts binary").collect()
    # Rows that repeat a labelled id count once.
    return sorted({r["doc_id"]: (r["doc_id"], r["grade"], bytes(r["features"]), bytes(r["amounts"])) for r in sorted(got)}.values())


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text") -> Model:
    rows = _labelled(docs, labels, sample, id_column, text_column)
    grades = np.array([r[1] for r in rows], np.int64)
    if not len(rows):
        return Model({}, tuple(-2.0 + k / GRADES for k in range(1, GRADES)))
    features = [np.frombuffer(r[2], np.int32) for r in rows]
    amounts = np.concatenate([np.frombuffer(r[3], np.float32) for r in rows]).astype(np.float64)
    row = np.repeat(np.arange(len(rows)), [len(f) for f in features])
    column = np.concatenate(features)
    chosen = _telling(row, column, amounts, grades)
    at = np.full(DIMENSIONS, -1)
    at[chosen] = np.arange(len(chosen))
    used = at[column] >= 0
    row, column, amounts = row[used], at[column[used]], amounts[used]
    # In units of its usual amount where it occurs, a rare word weighs like a common shape.
    usual = np.sqrt(np.bincount(column, weights=amounts**2, minlength=len(chosen)) / np.bincount(column, minlength=len(chosen)))
    weights, thresholds = _maximise(row, column, amounts / usual[column], grades, len(chosen))
    weights = weights / usual
    return Model(dict(zip(chosen.tolist(), weights.tolist())), tuple(thresholds.tolist()))


def _telling(row: np.ndarray, column: np.ndarray, amounts: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """Features whose amount goes with the grade beyond chance."""
    sums = lambda x: np.bincount(column, weights=x, minlength=DIMENSIONS)
    n = np.bincount(column, minlength=DIMENSIONS)
    spread = np.sqrt(np.maximum(sums(amounts**2) - sums(amounts) ** 2 / len(grades), 1e-12)) * (grades.std() or 1.0)
    z = np.abs(sums(amounts * (grades - grades.mean())[row])) / spread
    return np.flatnonzero((n >= LEAST_DOCUMENTS) & (z >= LEAST_Z))


def _maximise(row: np.ndarray, column: np.ndarray, amounts: np.ndarray, grades: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Penalised likelihood of the cumulative-link model, by gradient steps of adapted length.

    Thresholds are a first one and the logarithms of the gaps above it, which
    keeps them in order.
    """
    n = len(grades)
    share = [np.clip((grades >= k).mean(), 0.5 / n, 1 - 0.5 / n) for k in range(1, GRADES)]
    first = [-math.log(s / (1 - s)) for s in share]
    state = np.concatenate([np.zeros(size), [first[0]], np.log(np.maximum(np.diff(first), 0.1))])
    mean, square = np.zeros_like(state), np.zeros_like(state)
    upper, lower = np.minimum(grades, GRADES - 2), np.maximum(grades - 1, 0)
    for step in range(1, STEPS + 1):
        weights, gaps = state[:size], np.exp(state[size + 1 :])
        thresholds = state[size] + np.concatenate([[0.0], np.cumsum(gaps)])
        scores = np.bincount(row, weights=weights[column] * amounts, minlength=n)
        tail = 1 / (1 + np.exp(np.clip(thresholds[None, :] - scores[:, None], -500, 500)))
        slope = tail * (1 - tail)
        one = np.arange(n)
        above = np.where(grades == GRADES - 1, 0.0, tail[one, upper])
        below = np.where(grades == 0, 1.0, tail[one, lower])
        chance = np.maximum(below - above, 1e-12)
        up = np.where(grades == GRADES - 1, 0.0, slope[one, upper]) / chance
        down = np.where(grades == 0, 0.0, slope[one, lower]) / chance
        by_score = (down - up) / n
        grad = np.zeros_like(state)
        grad[:size] = np.bincount(column, weights=by_score[row] * amounts, minlength=size) - PENALTY * weights
        by_threshold = (np.bincount(upper, weights=up * (grades < GRADES - 1), minlength=GRADES - 1) - np.bincount(lower, weights=down * (grades > 0), minlength=GRADES - 1)) / n
        grad[size] = by_threshold.sum()
        grad[size + 1 :] = gaps * by_threshold[::-1].cumsum()[::-1][1:]
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        rate = 0.3 * (1 - step / (STEPS + 1))
        state = state + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return state[:size], state[size] + np.concatenate([[0.0], np.cumsum(np.exp(state[size + 1 :]))])


_DDL = "doc_id long, grade int, expected_grade double, p_at_least_1 double, p_at_least_2 double, kept boolean"
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("grade", pa.int32()), ("expected_grade", pa.float64()), ("p_at_least_1", pa.float64()), ("p_at_least_2", pa.float64()), ("kept", pa.bool_())]
)


def grade_documents(docs: DataFrame, model: Model, keep: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: doc_id, most probable grade, expected grade, tail probabilities, kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(_graded(batches, model, keep), _SCHEMA)

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), empty_if_null(F.col(text_column)).alias("text"))
    return texts.mapInArrow(run, _DDL)


def _graded(batches: Iterator[pa.RecordBatch], model: Model, keep: float) -> Iterator[tuple]:
    for doc_id, text in rows_of(batches, "doc_id", "text"):
        least = tails(model, score(model, text))
        chances = [a - b for a, b in zip([1.0, *least], [*least, 0.0])]
        yield doc_id, chances.index(max(chances)), sum(least), least[0], least[1], least[0] >= keep


def select_documents(docs: DataFrame, model: Model, keep: float = 0.5, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""

    def kept(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([tails(model, score(model, t))[0] >= keep for t in batch], dtype=bool)

    kept.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.where(F.pandas_udf(kept, "boolean")(empty_if_null(F.col(text_column))))

"""Exact top-k search and vector codes against brute force."""

import hashlib
import math

import numpy as np
import pytest

from ledgerloom.llm import exact_search, vector_codes

AWKWARD = [
    (0, [1.0, 0.0]), (50, [0.5, -0.25]), (50, [0.5, -0.25]), (100, [2.0, 1.0]), (100, [-2.0, 1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]),
    (2, None), (3, [1.0, None]), (4, [float("nan"), 0.0]), (5, [float("-inf"), 0.0]), (150, None), (6, []), (200, []), (7, [1.0, 2.0, 3.0]),
    (250, [1.0, 2.0, 3.0]), (None, [9.0, 9.0]), (None, [0.0, 0.0]), (8, [-0.001, 0.001]), (300, [0.0, 0.0]), (350, [1.5] * 5),
]
_EXTRA = "rank int, query long, v string, score string, label_error int, entry int"


def frame(spark, rows, kind="double", partitions=3):
    full = [(*r, 1, 2, "v", "s", 3, 4) for r in rows]
    label = ", label int" if rows and len(rows[0]) == 3 else ""
    return spark.createDataFrame(full, f"vec_id long, embedding array<{kind}>{label}, {_EXTRA}").repartition(partitions)


def kept(rows, scale):
    return [(r[0], [math.floor(scale * x) for x in r[1]], *r[2:]) for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def best_by_hand(rows, k=5):
    vectors, found = kept(rows, 256), []
    asked = {(i, tuple(v)) for i, v in vectors if i is not None and i % 50 == 0}
    for id_, q in asked:
        scored = [(-sum(a * b for a, b in zip(q, v)), i is None, i or 0) for i, v in vectors if i != id_ and len(v) == len(q)]
        for rank, (score, null, i) in enumerate(sorted(scored)[:k], 1):
            found.append((id_, rank, None if null else i, -score))
    return sorted(found, key=str)


def best(df, **kw):
    return sorted((tuple(r) for r in exact_search.top_products(df, **kw).select("query_id", "rank", "vec_id", "score").collect()), key=str)


def test_awkward_vectors(spark):
    assert best(frame(spark, AWKWARD)) == best_by_hand(AWKWARD)
    assert best(frame(spark, AWKWARD[:1])) == []
    assert best(frame(spark, AWKWARD).where("false")) == []


@pytest.mark.parametrize("parts", [1, 2, 4])
def test_many_places_and_parts(spark, monkeypatch, parts):
    """A third of the rows are one vector, others lie close to it, and scores tie all over."""
    monkeypatch.setattr(exact_search, "BLOCK", 7)
    rng = np.random.default_rng(parts)
    middle = rng.normal(size=16)
    points = [middle] * 130 + [middle + 0.01 * rng.normal(size=16) for _ in range(70)] + list(rng.normal(size=(200, 16)))
    rows = [(int(i), [float(x) for x in np.float32(p)]) for i, p in zip(rng.permutation(400) * 5, points)]
    assert best(frame(spark, rows, "float"), parts=parts) == best_by_hand(rows)


def test_few_cells_at_once_and_large_numbers(spark):
    rng = np.random.default_rng(9)
    rows = [(10 * i, [float(x) for x in rng.integers(-(2**21), 2**21, 6)]) for i in range(60)]
    # Sums of products beyond 2^53 are kept exact.
    assert max(abs(r[3]) for r in best_by_hand(rows)) > 2**53
    assert best(frame(spark, rows)) == best_by_hand(rows)


def test_an_inner_product_beyond_64_bits_is_an_error(spark):
    with pytest.raises(Exception, match="64 bits"):
        best(frame(spark, [(0, [1e30, 1.0]), (1, [1e30, 2.0])]))


def test_slices_of_queries():
    rng = np.random.default_rng(2)
    q, c = rng.integers(-50, 50, (9, 6)).astype(float), rng.integers(-50, 50, (40, 6)).astype(float)
    part = exact_search._Slice(q, c, np.zeros((9, 40), bool), 3)
    at = np.nonzero(np.ones((9, 40), bool))
    assert (part.totals(at) == (q @ c.T).ravel()).all()


# ---- codes --------------------------------------------------------------------


def nearest_by_hand(book, part):
    distances = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in book]
    return distances.index(min(distances)), min(distances)


def codes_by_hand(rows, parts=8, entries=16, rounds=6):
    vectors = kept(rows, 4096)
    width = -(-max(len(r[1]) for r in vectors) // parts) or 1
    cut = [[(v + [0] * parts * width)[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in vectors]
    first = {}
    for (i, v, _), pieces in zip(vectors, cut):
        first[i] = min(first.get(i, (v, pieces)), (v, pieces))
    ids = sorted(first, key=lambda i: (i is None, i or 0))[:entries]
    books = [[first[i][1][p] for i in ids] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            got = [[] for _ in books[p]]
            for pieces in cut:
                got[nearest_by_hand(books[p], pieces[p])[0]].append(pieces[p])
            books[p] = [[sum(x) // len(g) for x in zip(*g)] if g else e for g, e in zip(got, books[p])]
    found = [[nearest_by_hand(books[p], pieces[p]) for p in range(parts)] for pieces in cut]
    errors = [sum(d for _, d in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(vectors, errors):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{n:02x}" for n, _ in f), e, by_label[label], digest) for (i, _, label), f, e in zip(vectors, found, errors)), key=str)


def codes(df, **kw):
    columns = "vec_id", "code", "error", "label_error", "codebooks_sha256"
    return sorted((tuple(r) for r in vector_codes.compress(df, **kw).select(*columns).collect()), key=str)


def test_codes_of_awkward_vectors(spark):
    rows = [(i, v, None if k % 3 == 0 else k % 2) for k, (i, v) in enumerate(AWKWARD)]
    assert codes(frame(spark, rows)) == codes_by_hand(rows)
    assert codes(frame(spark, rows[:1])) == codes_by_hand(rows[:1])
    assert codes(frame(spark, rows).where("false")) == []


@pytest.mark.parametrize("partitions", [1, 7])
def test_codes_of_many_vectors(spark, partitions):
    rng = np.random.default_rng(3)
    points = [*rng.normal(size=(150, 24)), *[np.full(24, 0.25)] * 80, *np.round(rng.normal(size=(80, 24)))]
    rows = [(int(i), [float(x) for x in np.float32(p)], int(k) % 4) for k, (i, p) in enumerate(zip(rng.permutation(310) - 20, points))]
    assert codes(frame(spark, rows, "float", partitions)) == codes_by_hand(rows)


def test_search_ends_where_it_may(monkeypatch):
    """The nearest entry, ties to the lower index, and fewer distances than entries."""
    rng = np.random.default_rng(4)
    book = rng.integers(-6, 7, (64, 4))
    book[10] = book[40]
    vectors = rng.integers(-6, 7, (3000, 4))
    search = vector_codes.EqualAverageSearch(book)
    seen = []
    monkeypatch.setattr(vector_codes.EqualAverageSearch, "_out_of_reach", lambda self, gap, best, real=vector_codes.EqualAverageSearch._out_of_reach: (seen.append(int((~(out := real(self, gap, best))).sum())), out)[1])
    index, distance = search.nearest(vectors)
    every = ((vectors[:, None] - book[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert sum(seen) < 0.5 * every.size


def test_distances_beyond_64_bits_are_an_error(spark):
    with pytest.raises(Exception, match="64 bits"):
        codes(frame(spark, [(0, [1e12, 1.0], 1), (1, [-1e12, 2.0], 1)]))

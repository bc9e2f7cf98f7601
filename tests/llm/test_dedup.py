"""Exact, near and embedding duplicates against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import rows_of

from ledgerloom.llm import components, embedding_dedup, exact_dedup, near_dedup, shingles
from llm.conftest import AWKWARD

WHITE = " \t\n\x0b\x0c\r"


def test_equal_texts_of_awkward_rows(awkward, nothing):
    got = exact_dedup.equal_texts(awkward).drop("_digest").collect()
    groups = {}
    for i, t, _ in AWKWARD:
        groups.setdefault((t or "").translate(dict.fromkeys(map(ord, WHITE))), []).append((-len(t or ""), i is None, i or 0))
    expected = []
    for norm, members in groups.items():
        best = min(members)
        keep = None if best[1] else best[2]
        for size, none, i in members:
            i = None if none else i
            expected.append((i, keep, len(members), i == keep and size == best[0], hashlib.sha256(norm.encode()).hexdigest()))
    assert Counter(map(tuple, got)) == Counter(expected)
    assert exact_dedup.equal_texts(nothing).isEmpty()


def test_dropping_copies_keeps_one_row_of_each_text(awkward, nothing):
    kept = exact_dedup.drop_copies(awkward)
    assert kept.columns == awkward.columns
    texts = ["".join((r.text or "").split()) for r in kept.collect()]
    assert sorted(texts) == sorted({(t or "").translate(dict.fromkeys(map(ord, WHITE))) for _, t, _ in AWKWARD})
    assert exact_dedup.drop_copies(nothing).isEmpty()


def test_a_hash_collision_is_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "aa"), (2, "a a"), (3, "bb"), (4, "c")], "doc_id long, text string")
    monkeypatch.setattr(exact_dedup, "digest", lambda text: F.unhex(F.lit("00")) if "_norm" in str(text) or "_text" in str(text) else F.unhex(F.md5(text.cast("binary"))))
    got = rows_of(exact_dedup.equal_texts(docs), "doc_id", "keep_id", "group_size", "kept")
    assert got == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 4, 1, True)]


def test_only_texts_that_share_their_hash_are_compared(spark, monkeypatch):
    """One text with a third of the rows, pairs, and many texts that no other equals."""
    rows = [(i, "one text" if i % 3 == 0 else f"text {i // 2 if i % 7 == 1 else i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts = docs.select(exact_dedup.digest(exact_dedup.normalised(docs.text)).alias("_hash"), "text")
    counts = texts.groupBy("_hash").count()
    shared = counts.where("count > 1").withColumnRenamed("_hash", "_shared")
    met = Counter(r[0] for r in exact_dedup._perhaps_shared(texts, shared).select("text").collect())
    often = Counter(t for _, t in rows)
    assert {t: n for t, n in often.items() if n > 1}.items() <= met.items() and sum(met.values()) < 1800
    assert exact_dedup._perhaps_shared(texts, shared.where("false")).isEmpty()
    expected = rows_of(exact_dedup.equal_texts(docs))
    monkeypatch.setattr(exact_dedup, "ROWS_PER_SALT", 40)
    # With few bits most texts pass, to the same result.
    monkeypatch.setattr(exact_dedup, "FILTER_BITS", 8)
    assert rows_of(exact_dedup.equal_texts(docs)) == expected
    assert [r[2] for r in expected] == [often[t] for _, t in sorted(rows, key=lambda r: str(r[0]))]


def brute(rows, hundredths=75):
    sets = []
    for _, text in rows:
        words = shingles.words_of(text)
        grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
        sets.append(grams)
    groups = near_dedup.Union(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= hundredths * (len(a) + len(sets[j]) - both):
                groups.join(i, j)
    first = {}
    for i, (d, _) in enumerate(rows):
        first[groups.root(i)] = min(first.get(groups.root(i), (True, 0)), (d is None, d or 0))
    found = []
    for i, (d, _) in enumerate(rows):
        none, least = first[groups.root(i)]
        component = None if none else least
        found.append((d, len(sets[i]), component, d == component))
    return Counter(found)


def near(df, **kw):
    return Counter(map(tuple, near_dedup.similar_texts(df, **kw).select("doc_id", "n_shingles", "component_id", "kept").collect()))


def test_near_duplicates_of_the_small_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert near(docs) == brute(rows)
    assert near(docs, whole=6, block=3, depth=3) == brute(rows)


@pytest.fixture(scope="module")
def crowded(spark):
    """A large group of near copies, about as alike as the threshold, and a passage that many documents share."""
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(120)]
    passage = " ".join(f"p{i}" for i in range(40))
    rows = []
    for i in range(250):
        words = base[:]
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 99999)}"
        rows.append((i, " ".join(words)))
    for i in range(250, 400):
        before, after = ([f"{c}{rng.randint(0, 99999)}" for _ in range(rng.randint(0, n))] for c, n in (("y", 60), ("z", 40)))
        rows.append((i, " ".join([*before, passage, *after])))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"whole": 40, "block": 16, "depth": 3}, {"whole": 40, "block": 16, "depth": 1}])
def test_near_duplicates_in_crowded_nodes(spark, crowded, sizes):
    df = spark.createDataFrame(crowded, "doc_id long, text string").repartition(5)
    assert near(df, **sizes) == brute(crowded)


def test_near_duplicates_of_awkward_rows(awkward, nothing):
    rows = [(i, t) for i, t, _ in AWKWARD]
    got = near_dedup.similar_texts(awkward)
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id", "kept").collect())) == brute(rows)
    stays = near_dedup.drop_similar(awkward)
    assert stays.columns == awkward.columns
    # Of three equal sets one row stays; rows without words stay each, but for a repeated row.
    assert stays.count() == len(AWKWARD) - 2
    assert near_dedup.similar_texts(nothing).isEmpty()


def test_threshold_is_met_exactly():
    a = np.arange(100, dtype=np.uint64)
    for shared, found in ((86, True), (85, False)):
        b = np.concatenate([np.arange(shared), np.arange(1000, 1100 - shared)]).astype(np.uint64)
        assert shingles.jaccard_at_least(a, np.sort(b), 75) is (100 * shared >= 75 * (200 - shared))
        groups = near_dedup.linked([a, np.sort(b)], 75)
        assert (groups.root(1) == 0) is found


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(120)] + [(500, i) for i in range(501, 700)]
    above = near_dedup.Union(1000)
    for a, b in links:
        above.join(a, b)
    got = rows_of(components.connected_components(spark.createDataFrame(links, "a long, b long")))
    assert got == sorted(((i, above.root(i)) for i in {x for p in links for x in p if p[0] != p[1]}), key=lambda r: [str(v) for v in r])
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()


def links_of(rows, least=0.9):
    units = []
    for _, v in rows:
        good = v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        units.append(np.array(v) / np.linalg.norm(v) if good else None)
    groups, counts = near_dedup.Union(len(rows)), [0] * len(rows)
    for i, a in enumerate(units):
        for j, b in enumerate(units):
            if i != j and a is not None and b is not None and len(a) == len(b) and a @ b >= least:
                counts[i] += 1
                groups.join(i, j)
    first = {}
    for i, (v, _) in enumerate(rows):
        first[groups.root(i)] = min(first.get(groups.root(i), v), v)
    return sorted((v, counts[i], first[groups.root(i)], v == first[groups.root(i)]) for i, (v, _) in enumerate(rows))


def linked_vectors(df, **kw):
    return sorted(tuple(r) for r in embedding_dedup.similar_vectors(df, **kw).select("vec_id", "n_links", "component_id", "kept").collect())


def test_vectors_of_many_shards(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 60)
    monkeypatch.setattr(embedding_dedup, "PLACE", 50)
    rng = np.random.default_rng(5)
    points = list(rng.normal(size=(300, 16)))
    for centre, n in ((0, 120), (1, 5), (2, 1)):
        points += [points[centre] + 0.06 * rng.normal(size=16) for _ in range(n)]
    points += [points[3]] * 20
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, expected = linked_vectors(df), links_of(rows)
    assert got == expected


def test_a_crowd_of_distinct_vectors_in_more_shards_than_are_searched(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 20)
    monkeypatch.setattr(embedding_dedup, "WIDE", 150, raising=False)
    rng = np.random.default_rng(6)
    middle = rng.normal(size=16)
    points = [middle / np.linalg.norm(middle) + 0.085 * rng.normal(size=16) for _ in range(900)] + list(rng.normal(size=(300, 16)))
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(2000 + i, [1.0, float(i)]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    expected = links_of(rows)
    assert linked_vectors(df, probes=1, beam=1) == expected
    assert embedding_dedup.similar_vectors(df, probes=1, beam=1).first().audited_recall == 1.0


def test_shards_out_of_range_are_left_out():
    rng = np.random.default_rng(7)
    units = np.concatenate([c + 0.1 * rng.normal(size=(40, 8)) for c in 3 * np.eye(8)])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    centres = embedding_dedup._fit(units, 30)
    near = units @ centres.T
    home, angle = near.argmax(axis=1), np.arccos(np.minimum(1, near.max(axis=1)))
    shards = [(int(c), int((home == c).sum()), angle[home == c].min(), angle[home == c].max()) for c in np.unique(home)]
    reach = embedding_dedup._Reach(centres, shards, 0.98)
    reach.bundle = np.arange(len(centres))
    searched = [set(reach(u)[1]) for u in units]
    assert all(set(home[units @ u >= 0.98]) <= s for u, s in zip(units, searched))
    assert max(map(len, searched)) < 15


def test_awkward_vectors(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [1.0, None]),
        (8, [float("nan"), 1.0]), (9, [float("inf"), 0.0]), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (12, [1e-200, 0.0]), (13, [1e200, 1e199]),
    ]
    df = spark.createDataFrame([(i, v, True) for i, v in rows], "vec_id long, embedding array<double>, kept boolean")
    got = linked_vectors(df)
    linked = {1, 2, 3, 12, 13}
    assert got == [(i, 4 if i in linked else 0, 1 if i in linked else i, i == 1 or i not in linked) for i, _ in rows]
    assert embedding_dedup.similar_vectors(df.where("false")).isEmpty()


def test_connections_survive_without_all_pairs(spark):
    """A chain whose middle link joins two vectors that each have a smaller neighbour."""
    angles = {1: 0, 2: 60, 3: 20, 4: 40}
    rows = [(i, [float(np.cos(np.radians(a))), float(np.sin(np.radians(a)))]) for i, a in angles.items()]
    got = linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got == links_of(rows) and {r[2] for r in got} == {1}


@pytest.mark.parametrize("kind", ["sparse", "crowded", "both"])
def test_search_of_a_graph_finds_what_brute_force_finds(kind):
    rng = np.random.default_rng(9)
    middle = rng.normal(size=32)
    crowd, pairs = middle / np.linalg.norm(middle) + 0.05 * rng.normal(size=(900, 32)), rng.normal(size=(900, 32))
    pairs[1::3] = pairs[::3] + 0.2 * rng.normal(size=(300, 32))
    units = {"sparse": pairs, "crowded": crowd, "both": np.concatenate([crowd, pairs])}[kind]
    units = units / np.linalg.norm(units, axis=1, keepdims=True)
    lists = embedding_dedup.flat_graph(units)
    graph = np.full((len(units), max(map(len, lists))), -1)
    for i, near in enumerate(lists):
        graph[i, : len(near)] = near
    search = embedding_dedup.Search(units, graph)
    outside = rng.normal(size=(20, 32))
    queries = np.concatenate([units[::7], outside / np.linalg.norm(outside, axis=1, keepdims=True)])
    own = np.append(np.arange(0, len(units), 7), np.full(20, -1))
    query, member = search(queries, own, 0.9, 24)
    true = set(zip(*map(np.ndarray.tolist, np.nonzero(queries @ units.T >= 0.9))))
    assert set(zip(query.tolist(), member.tolist())) == true and len(query) == len(true)
    if kind == "sparse":
        assert search.computed < 0.75 * len(queries) * len(units)


def test_audit_sees_what_a_crowd_hides(spark, monkeypatch):
    """Links that are missing from a few vectors with one link each, beside a group that has all of its own."""
    rng = np.random.default_rng(10)
    middle = rng.normal(size=16)
    crowd = middle / np.linalg.norm(middle) + 0.02 * rng.normal(size=(1500, 16))
    pairs = rng.normal(size=(200, 16))
    pairs[1::2] = pairs[::2] + 0.01 * rng.normal(size=(100, 16))
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(np.concatenate([crowd, pairs]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    points = df.mapInArrow(embedding_dedup._points, embedding_dedup._POINT_DDL).selectExpr("uid", "vec_id", "dim", "unit", "1L AS copies")
    full = {r[0]: r[1] for r in links_of(rows)}
    whole = spark.createDataFrame([(i, n) for i, n in full.items() if n], "uid long, found long")
    assert embedding_dedup._audit(points, whole, 0.9) == 1.0
    assert embedding_dedup._audit(points, whole.where("uid < 1500"), 0.9) < 0.5

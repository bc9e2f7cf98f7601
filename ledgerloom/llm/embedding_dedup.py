"""Near duplicates among embeddings: links by cosine, found by searching a flat graph.

Method: centres are fitted on a bounded sample; every vector belongs to the
shards of its ``OVERLAP`` nearest centres. Each shard builds a flat graph whose
edges are robustly pruned (a neighbour is left out if one already taken is
clearly nearer to it), and the adjacency lists of a vector are united over its
shards. Every vector then searches the shards of its nearest centres: greedily
from their medoids, and from itself where it is a member; around each vector
found within range the search expands until nothing new is in range. Links are
verified by their cosine in double precision. An audit of ``AUDITED`` vectors
against all rows measures recall, by number of links, and takes the worst figure;
while it is below ``recall``, the search is repeated over twice as many shards and
with twice the beam. If that is not enough after ``ROUNDS`` rounds, every vector is compared with all members of every shard
that can hold a vector in range: shards are left out only where the angles of
their members to the centre, or the plane that parts two centres, rule it out.

Sizes: equal vectors are one from the start. A shard is split so that a place
holds at most ``PLACE`` members and ``PLACE`` searching vectors, so a third of
all rows may be near one vector. In a place a query keeps a beam and one mark per
member; where members in range have more edges than there are members, it is
compared with all of them, so it never costs much more than that. Links are counted where they are found and
leave as one row per vector and place. The sample, the centres and the
audited vectors have fixed bounds; only they reach the driver.

Defined results: a vector that is null, empty or zero, or holds null, infinite
or NaN components, links with nothing; nor do vectors of different length; rows
that repeat a vector link with each other; a group is named by its smallest id
(a null id only if there is no other); an empty table gives an empty one; other
columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, bounded_sample, pinned, rows_of
from .components import connected_components

#: Vectors that the centres are fitted on, and vectors per centre.
SAMPLE, SHARD = 20_000, 1000
#: Shards that a vector belongs to, and that it searches at first.
OVERLAP, PROBES = 2, 4
#: Edges per vector, candidates for them, the pruning factor, and edges to anywhere.
DEGREE, CANDIDATES, PRUNING, FAR = 24, 48, 1.2, 4
#: Members, and searching vectors, of one place.
PLACE = 4096
#: Vectors that a greedy search keeps at first; medoids that it starts from.
BEAM, MEDOIDS = 24, 8
AUDITED, RECALL, ROUNDS = 512, 0.99, 4
#: Links of a vector that count as few, and as not many, in the audit.
FEW, MANY = 5, 50
#: Members, and comparing vectors, of one place of a whole scan; allowance for rounding of angles.
WIDE, SLACK = 16_384, 1e-6

_POINT_DDL = "uid long, vec_id long, dim int, key binary, unit binary"
_POINT_SCHEMA = pa.schema([("uid", pa.int64()), ("vec_id", pa.int64()), ("dim", pa.int32()), ("key", pa.binary()), ("unit", pa.binary())])


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision; those that link with nothing have none."""

    def rows() -> Iterator[tuple]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            lists = batch.column("embedding")
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            start = 0
            for vec_id, end in zip(batch.column("vec_id").to_pylist(), ends):
                raw, start = values[start:end], end
                # Scaled first, so that no square is too large or too small.
                top = np.abs(raw).max() if len(raw) else 0.0
                if top > 0 and math.isfinite(top):
                    scaled = raw / top
                    unit = scaled / math.sqrt(float(scaled @ scaled))
                    yield uid, vec_id, len(raw), xxhash.xxh3_128_digest(raw + 0.0), unit.tobytes()
                else:
                    yield uid, vec_id, 0, b"", None
                uid += 1

    return batches_of(rows(), _POINT_SCHEMA)


def _units(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column)).reshape(len(column), -1)


def _centres(points: DataFrame) -> dict[int, np.ndarray]:
    """Centres by length of vector, from at most ``SAMPLE`` vectors."""
    rows = bounded_sample(points.select("uid", "dim", "unit"), "uid", SAMPLE).collect()
    # Lengths of which the sample has enough for two centres: at most one for 16 of its rows.
    often = [d for d, n in Counter(r["dim"] for r in rows).items() if d and n >= 16]
    sizes = {r["dim"]: r["n"] for r in points.where(F.col("dim").isin(often)).groupBy("dim").agg(F.count("*").alias("n")).collect()}
    found = {}
    for dim, n in sizes.items():
        sample = [bytes(r["unit"]) for r in rows if r["dim"] == dim]
        k = min(-(-n // SHARD), len(sample) // 8)
        if k > 1:
            found[dim] = _fit(_units(sample), k)
    return found


def _fit(units: np.ndarray, k: int, steps: int = 6) -> np.ndarray:
    """Directions that part the sample, by alternating assignment and mean."""
    centres = units[np.random.default_rng(8).choice(len(units), k, replace=False)]
    for _ in range(steps):
        nearest = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, units)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres)
    return centres


def _assigned(points: DataFrame, centres: dict[int, np.ndarray], probes: int) -> DataFrame:
    """(uid, region, rank): the nearest centres of each vector, the nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("uid", pa.int64()), ("regions", pa.list_(pa.int64()))])

        def rows() -> Iterator[tuple]:
            for uid, dim, unit in rows_of(batches, "uid", "dim", "unit"):
                if dim in centres:
                    near = centres[dim] @ np.frombuffer(unit)
                    nearest = np.argsort(-near, kind="stable")[:probes].tolist()
                else:
                    nearest = [0]
                yield uid, [(dim << 32) + c for c in nearest]

        return batches_of(rows(), schema)

    return points.select("uid", "dim", "unit").mapInArrow(run, "uid long, regions array<long>")


def _places(assigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uid, regions, region, part) of members, and (uid, regions, region, block) of searches, with the sizes that split them.

    A shard has ``parts`` parts of members and ``blocks`` blocks of searching
    vectors; its places are all pairs of a part and a block.
    """
    probed = assigned.select("uid", "regions", F.posexplode("regions").alias("rank", "region"))
    sizes = probed.groupBy("region").agg(
        F.ceil(F.sum((F.col("rank") < OVERLAP).cast("long")) / F.lit(PLACE)).cast("int").alias("parts"),
        F.ceil(F.count("*") / F.lit(PLACE)).cast("int").alias("blocks"),
    )
    sizes = pinned(sizes.withColumn("parts", F.greatest("parts", F.lit(1))), "regions")
    split = probed.join(sizes, "region")
    part = F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")
    block = F.pmod(F.xxhash64("uid", F.lit(1)), F.col("blocks")).cast("int")
    members = split.where(F.col("rank") < OVERLAP).withColumn("part", part)
    searches = split.withColumn("block", block)
    return members, searches


def _runs(batches: Iterator[pa.RecordBatch], key: str, names: tuple[str, ...]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Runs of equal ``key`` of sorted batches, each as an iterator over its rows."""
    for at, rows in groupby(rows_of(batches, key, *names), key=lambda r: r[0]):
        yield at, (r[1:] for r in rows)


def flat_graph(units: np.ndarray) -> list[np.ndarray]:
    """For each vector, the positions of its neighbours in the graph.

    Neighbours are chosen from the nearest by robust pruning; edges count both
    ways; a few more go anywhere, so that every part can be reached.
    """
    n = len(units)
    random = np.random.default_rng(n)
    neighbours: list[set[int]] = [set() for _ in range(n)]
    for i in range(0, n, 256):
        near = units[i : i + 256] @ units.T
        near[np.arange(len(near)), np.arange(i, i + len(near))] = -2
        many = min(CANDIDATES, n - 1)
        if many < 1:
            continue
        best = np.argpartition(-near, many - 1, axis=1)[:, :many]
        cosines = np.take_along_axis(near, best, axis=1)
        order = np.argsort(-cosines, axis=1, kind="stable")
        best, cosines = np.take_along_axis(best, order, axis=1), np.take_along_axis(cosines, order, axis=1)
        row, column = np.nonzero(_pruned(units[best], cosines))
        for r, j in zip((row + i).tolist(), best[row, column].tolist()):
            neighbours[r].add(j)
    for i, own in enumerate([list(x) for x in neighbours]):
        for j in own:
            if len(neighbours[j]) < 2 * DEGREE:
                neighbours[j].add(i)
    for i in range(n):
        neighbours[i].update(random.integers(0, n, FAR).tolist())
        neighbours[i].discard(i)
    return [np.array(sorted(x), np.int64) for x in neighbours]


def _pruned(candidates: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """Robust pruning of each row's candidates, nearest first: which of them are taken.

    A candidate goes if one taken is nearer to it by the factor.
    """
    distance = np.sqrt(np.maximum(0, 2 - 2 * cosines))
    among = np.sqrt(np.maximum(0, 2 - 2 * (candidates @ candidates.transpose(0, 2, 1))))
    open_, taken = np.ones(cosines.shape, bool), np.zeros(cosines.shape, bool)
    for j in range(cosines.shape[1]):
        taken[:, j] = open_[:, j] & (taken.sum(axis=1) < DEGREE)
        open_ &= ~taken[:, j, None] | (PRUNING * among[:, j] > distance)
    return taken


class Search:
    """Range search of a flat graph for many queries at once.

    A query keeps a beam of the best members that it has met, and a mark for each
    member that it has met. It expands the best of its beam until all of the beam
    are expanded, then every member in range until none in range is left. Where the
    members in range have more edges than there are members, the query is compared
    with all members outright, as that is less work and misses nothing.
    """

    def __init__(self, units: np.ndarray, graph: np.ndarray) -> None:
        #: ``graph`` has neighbours per member, padded with -1.
        self.units, self.graph = units, graph
        self.starts = sorted({int((units @ units[j::MEDOIDS].mean(axis=0)).argmax()) for j in range(min(MEDOIDS, len(units)))})
        self.computed = 0

    def __call__(self, queries: np.ndarray, own: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) pairs with a cosine of at least ``least`` that are found, sorted.

        ``own`` has the position of each query among the members, or -1.
        """
        n, m = len(self.units), len(queries)
        met = np.zeros((m, n), bool)
        found: list[np.ndarray] = []

        def visit(rows: np.ndarray, members: np.ndarray) -> np.ndarray:
            """Cosines of the members that a row has not met; -2 for the others, which may be -1."""
            at = np.flatnonzero((members >= 0) & ~met[rows[:, None], members])
            q, x = rows[at // members.shape[1]], members.ravel()[at]
            met[q, x] = True
            cosine = np.full(members.shape, -2.0)
            near = np.einsum("ij,ij->i", queries[q], self.units[x])
            cosine.ravel()[at] = near
            self.computed += len(at)
            hit = near >= least
            found.append(q[hit] * n + x[hit])
            return cosine

        everyone = np.arange(m)
        first = [np.full((m, 1), s) for s in self.starts] + [own[:, None]]
        at, cosine = np.hstack(first), np.hstack([visit(everyone, x) for x in first])
        open_ = cosine > -2
        done: list[np.ndarray] = []
        rows = everyone
        while True:
            best = np.where(open_, cosine, -2).argmax(axis=1)
            going = open_[np.arange(len(rows)), best]
            rows, at, cosine, open_, best = rows[going], at[going], cosine[going], open_[going], best[going]
            if not len(rows):
                break
            line = np.arange(len(rows))
            node = at[line, best]
            open_[line, best] = False
            done.append(rows * n + node)
            near = self.graph[node]
            new = visit(rows, near)
            at, cosine, open_ = np.hstack([at, near]), np.hstack([cosine, new]), np.hstack([open_, new > -2])
            if at.shape[1] > beam:
                kept = np.argpartition(-cosine, beam - 1, axis=1)[:, :beam]
                at, cosine, open_ = (np.take_along_axis(x, kept, axis=1) for x in (at, cosine, open_))
        expanded = np.unique(np.concatenate(done)) if done else np.array([], np.int64)
        frontier = np.setdiff1d(np.concatenate(found), expanded)
        edges = max(1, self.graph.shape[1])
        while len(frontier):
            q, x = np.divmod(frontier, n)
            crowded = np.bincount(q, minlength=m) * edges > n
            for at in np.array_split(np.flatnonzero(crowded), -(-int(crowded.sum()) // 64)) if crowded.any() else []:
                near = queries[at] @ self.units.T
                near[met[at]] = -2
                met[at] = True
                self.computed += near.size
                inside = near >= least
                # What is as near as rounding goes is told alike from both ends.
                row, member = np.nonzero(np.abs(near - least) < 1e-12)
                inside[row, member] = np.einsum("ij,ij->i", queries[at[row]], self.units[member]) >= least
                row, member = np.nonzero(inside)
                found.append(at[row] * n + member)
            # Of a query that has met all members nothing is left to expand.
            q, x = q[~crowded[q]], x[~crowded[q]]
            new_from = len(found)
            # One member of a query at a time, so that none is met twice at once.
            turn = np.arange(len(q)) - np.searchsorted(q, q)
            for t in range(int(turn.max()) + 1 if len(turn) else 0):
                visit(q[turn == t], self.graph[x[turn == t]])
            frontier = np.sort(np.concatenate(found[new_from:])) if len(found) > new_from else frontier[:0]
        return tuple(np.divmod(np.sort(np.concatenate(found)), n))


def _adjacency(members: DataFrame, points: DataFrame) -> DataFrame:
    """(uid, neighbours): the lists of all shards of a vector, united."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("uid", pa.int64()), ("neighbours", pa.list_(pa.int64()))])

        def rows() -> Iterator[tuple]:
            for _, run_ in _runs(batches, "place", ("uid", "unit")):
                uid, unit = zip(*run_)
                names = np.array(uid)
                for u, near in zip(uid, flat_graph(_units(list(unit)))):
                    yield u, names[near].tolist()

        return batches_of(rows(), schema)

    placed = members.select("uid", F.xxhash64("region", "part").alias("place")).join(points.select("uid", "unit"), "uid")
    lists = placed.repartition("place").sortWithinPartitions("place", "uid").mapInArrow(run, "uid long, neighbours array<long>")
    return lists.groupBy("uid").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))


def _found(members: DataFrame, searches: DataFrame, points: DataFrame, lists: DataFrame, least: float, beam: int) -> DataFrame:
    """(uid, found, other): links found in a place, copies included, and a vector that they connect it with.

    The last column connects whatever the links of the place connect.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(_searched(batches, least, beam), pa.schema([("uid", pa.int64()), ("found", pa.int64()), ("other", pa.int64())]))

    here = members.join(lists, "uid").select(
        "uid", "regions", "region", "neighbours", F.lit(True).alias("member"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "part"
    )
    there = searches.select(
        "uid", "regions", "region", F.lit(None).cast("array<long>").alias("neighbours"), F.lit(False).alias("member"), "block",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
    )
    both = here.unionByName(there).withColumn("place", F.xxhash64("region", "part", "block"))
    rows = both.join(points.select("uid", "unit", "copies"), "uid").select("place", "region", "member", "uid", "regions", "neighbours", "unit", "copies")
    return rows.repartition("place").sortWithinPartitions("place", F.desc("member"), "uid").mapInArrow(run, "uid long, found long, other long")


def _searched(batches: Iterator[pa.RecordBatch], least: float, beam: int) -> Iterator[tuple]:
    for _, rows in _runs(batches, "place", ("region", "member", "uid", "regions", "neighbours", "unit", "copies")):
        members, chunk, place = [], [], None
        for row in rows:
            if row[1]:
                members.append(row)
            elif members:
                place = place or _Place(members)
                chunk.append(row)
                if len(chunk) == 256:
                    place.take(chunk, least, beam)
                    chunk = []
        if chunk:
            place.take(chunk, least, beam)
        if place:
            yield from place.links()


class _Place:
    """The members of a place, and what has been found among them."""

    def __init__(self, members: list[tuple]) -> None:
        self.region, _, uid, regions, neighbours, units, copies = zip(*members)
        self.region = self.region[0]
        self.at = {u: i for i, u in enumerate(uid)}
        self.names, self.units, self.copies = np.array(uid), _units(list(units)), np.array(copies)
        self.homes = np.array([(r[:OVERLAP] * OVERLAP)[:OVERLAP] for r in regions])
        lists = [[self.at[v] for v in near if v in self.at] for near in neighbours]
        self.graph = np.full((len(uid), max(1, max(map(len, lists)))), -1, np.int64)
        for i, near in enumerate(lists):
            self.graph[i, : len(near)] = near
        self.search = Search(self.units, self.graph)
        #: Members joined by links, directly or through a searching vector.
        self.label = np.arange(len(uid))
        self.counted: list[tuple[int, int, int]] = []

    def take(self, chunk: list[tuple], least: float, beam: int) -> None:
        _, _, uid, regions, _, queries, _ = zip(*chunk)
        own = np.array([self.at.get(u, -1) for u in uid])
        query, member = self.search(_units(list(queries)), own, least, beam)
        ends = np.searchsorted(query, np.arange(len(uid) + 1))
        for q, u in enumerate(uid):
            met = member[ends[q] : ends[q + 1]]
            others = met[met != own[q]]
            if not len(others):
                continue
            joined = np.unique(self.label[met])
            if len(joined) > 1:
                self.label[np.isin(self.label, joined[1:])] = joined[0]
            # A link that several searched shards show counts in the first of them.
            earlier = regions[q][: regions[q].index(self.region)]
            first = others[~np.isin(self.homes[others], earlier).any(axis=1)] if earlier else others
            self.counted.append((u, int(self.copies[first].sum()), int(others[0])))

    def links(self) -> Iterator[tuple]:
        for u, found, x in self.counted:
            yield u, found, int(self.names[self.label[x]])
        for i in np.flatnonzero(self.label != np.arange(len(self.label))):
            yield int(self.names[i]), 0, int(self.names[self.label[i]])


def _homes(points: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """(uid, dim, region, angle): the nearest centre of each vector that has centres, and the angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("uid", pa.int64()), ("dim", pa.int32()), ("region", pa.int64()), ("angle", pa.float64())])

        def rows() -> Iterator[tuple]:
            for uid, dim, unit in rows_of(batches, "uid", "dim", "unit"):
                if dim in centres:
                    near = centres[dim] @ np.frombuffer(unit)
                    region = int(near.argmax())
                    yield uid, dim, region, math.acos(min(1.0, max(-1.0, float(near[region]))))

        return batches_of(rows(), schema)

    return points.select("uid", "dim", "unit").mapInArrow(run, "uid long, dim int, region long, angle double")


class _Reach:
    """The shards of vectors of one length: bundles of neighbouring ones, and which of them can hold a vector in range."""

    def __init__(self, centres: np.ndarray, shards: list[tuple[int, int, float, float]], least: float) -> None:
        self.centres, self.range = centres, math.acos(min(1.0, max(-1.0, least)))
        self.sine = math.sqrt(1 - least * least) if 0 < least <= 1 else math.inf
        #: Smallest and largest angle of members to their centre; shards without members reach nowhere.
        self.least, self.most = np.full(len(centres), np.inf), np.full(len(centres), -np.inf)
        counts = np.zeros(len(centres), np.int64)
        for region, n, low, high in shards:
            counts[region], self.least[region], self.most[region] = n, low, high
        self.bundle = np.zeros(len(centres), np.int64)
        left, at, bundle, held = np.ones(len(centres), bool), 0, 0, 0
        for _ in range(len(centres)):
            left[at] = False
            if held and held + counts[at] > WIDE:
                bundle, held = bundle + 1, 0
            self.bundle[at], held = bundle, held + counts[at]
            at = int(np.where(left, centres @ centres[at], -np.inf).argmax())

    def __call__(self, unit: np.ndarray) -> tuple[int, list[int]]:
        """The bundle that a vector is a member of, and those that it is compared with."""
        near = self.centres @ unit
        home = int(near.argmax())
        angle = np.arccos(np.clip(near, -1, 1))
        can = (angle - self.range <= self.most + SLACK) & (angle + self.range >= self.least - SLACK)
        apart = np.sqrt(np.maximum(0, 2 - 2 * self.centres @ self.centres[home]))
        can &= near[home] - near <= self.sine * apart + SLACK
        can[home] = True
        return int(self.bundle[home]), np.unique(self.bundle[can]).tolist()


def _scanned(points: DataFrame, centres: dict[int, np.ndarray], least: float) -> DataFrame:
    """(uid, found, other) like those of :func:`_found`, of all links.

    A vector is a member of one shard only, so that no link counts twice.
    """
    shards: dict[int, list[tuple]] = {}
    spread = _homes(points, centres).groupBy("dim", "region").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    # At most as many rows as there are centres.
    for r in spread.collect():
        shards.setdefault(r["dim"], []).append((r["region"], r["n"], r["low"], r["high"]))
    reach = {dim: _Reach(centres[dim], found, least) for dim, found in shards.items()}

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("uid", pa.int64()), ("home", pa.int64()), ("bundles", pa.list_(pa.int64()))])

        def rows() -> Iterator[tuple]:
            for uid, dim, unit in rows_of(batches, "uid", "dim", "unit"):
                home, others = reach[dim](np.frombuffer(unit)) if dim in reach else (0, [0])
                yield uid, (dim << 32) + home, [(dim << 32) + b for b in others]

        return batches_of(rows(), schema)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(_compared(batches, least), pa.schema([("uid", pa.int64()), ("found", pa.int64()), ("other", pa.int64())]))

    asked = pinned(points.select("uid", "dim", "unit").mapInArrow(bundles, "uid long, home long, bundles array<long>"), "bundles")
    asked = asked.select("uid", "home", F.explode("bundles").alias("bundle"))
    sizes = asked.groupBy("bundle").agg(
        F.ceil(F.count_if(F.col("bundle") == F.col("home")) / F.lit(WIDE)).cast("int").alias("parts"), F.ceil(F.count("*") / F.lit(WIDE)).cast("int").alias("blocks")
    )
    split = asked.join(pinned(sizes, "bundle_sizes"), "bundle")
    part, block = F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("uid", F.lit(1)), F.col("blocks")).cast("int")
    here = split.where("bundle = home").select("uid", "bundle", F.lit(True).alias("member"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), part.alias("part"))
    # A bundle of shards without members has nothing to compare with.
    there = split.where("parts > 0").select("uid", "bundle", F.lit(False).alias("member"), block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = here.unionByName(there).withColumn("place", F.xxhash64("bundle", "part", "block"))
    rows = both.join(points.select("uid", "unit", "copies"), "uid").select("place", "bundle", "part", "block", "member", "uid", "unit", "copies")
    order = "place", "bundle", "part", "block", F.desc("member"), "uid"
    return rows.repartition("place").sortWithinPartitions(*order).mapInArrow(compared, "uid long, found long, other long")


def _compared(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[tuple]:
    rows = rows_of(batches, "bundle", "part", "block", "member", "uid", "unit", "copies")
    for _, run in groupby(rows, key=lambda r: r[:3]):
        members, chunk, place = [], [], None
        for row in run:
            if row[3]:
                members.append(row[4:])
            elif members:
                place = place or _Whole(members)
                chunk.append(row[4:])
                if len(chunk) == 256:
                    place.take(chunk, least)
                    chunk = []
        if chunk:
            place.take(chunk, least)
        if place:
            yield from place.links()


class _Whole(_Place):
    """The members of a place, all of which are compared."""

    def __init__(self, members: list[tuple]) -> None:
        uid, units, copies = zip(*members)
        self.at = {u: i for i, u in enumerate(uid)}
        self.names, self.units, self.copies = np.array(uid), _units(list(units)), np.array(copies)
        self.label = np.arange(len(uid))
        self.counted = []

    def take(self, chunk: list[tuple], least: float) -> None:
        uid, units, _ = zip(*chunk)
        queries = _units(list(units))
        cosine = queries @ self.units.T
        near = cosine >= least
        # What is as near as rounding goes is told alike from both ends.
        q, x = np.nonzero(np.abs(cosine - least) < 1e-12)
        near[q, x] = np.einsum("ij,ij->i", queries[q], self.units[x]) >= least
        for q, u in enumerate(uid):
            own = self.at.get(u, -1)
            met = np.flatnonzero(near[q])
            others = met[met != own]
            if not len(others):
                continue
            labels = self.label[others] if own < 0 else self.label[np.append(others, own)]
            if (labels != labels[0]).any():
                self.label[np.isin(self.label, labels)] = labels.min()
            self.counted.append((u, int(self.copies[others].sum()), int(others[0])))


def _audit(points: DataFrame, counts: DataFrame, least: float) -> float:
    """The worst recall of a bounded set of vectors, by brute force over all rows.

    The set is drawn evenly from vectors with no link found, few, more and many, so
    that one large group does not speak for all. Measured are the share of their
    links that was found, and for vectors that truly have few, more and many links
    the mean share per vector, each vector standing for its part of the drawn rows.
    """
    ranked = points.join(counts, "uid", "left").withColumn("found", F.coalesce("found", F.lit(0))).where("dim > 0")
    ranked = pinned(ranked.select("uid", "dim", "unit", "found", _stratum(F.col("found")).alias("drawn")), "ranked")
    size = {r["drawn"]: r["n"] for r in ranked.groupBy("drawn").agg(F.count("*").alias("n")).collect()}
    asked, stands = {}, {}
    for drawn, n in size.items():
        chosen = bounded_sample(ranked.where(F.col("drawn") == drawn), "uid", AUDITED // 4).collect()
        for r in chosen:
            asked[r["uid"]], stands[r["uid"]] = (r["dim"], bytes(r["unit"])), (n / len(chosen), r["found"])
    if not asked:
        return 1.0
    by_dim = {d: sorted(u for u, (e, _) in asked.items() if e == d) for d in {d for d, _ in asked.values()}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, totals = pa.schema([("uid", pa.int64()), ("links", pa.int64())]), {}
        for batch in batches:
            dims, copies = np.array(batch.column("dim")), np.array(batch.column("copies"))
            units, uid = batch.column("unit").to_pylist(), np.array(batch.column("uid"))
            for d, names in by_dim.items():
                at = np.flatnonzero(dims == d)
                if len(at):
                    near = _units([asked[u][1] for u in names]) @ _units([units[i] for i in at]).T >= least
                    near &= np.array(names)[:, None] != uid[at][None]
                    for u, n in zip(names, near @ copies[at]):
                        totals[u] = totals.get(u, 0) + int(n)
        yield from batches_of(iter(totals.items()), schema)

    true = points.where("dim > 0").select("uid", "dim", "unit", "copies").mapInArrow(run, "uid long, links long")
    # At most AUDITED rows.
    true = true.groupBy("uid").agg(F.sum("links").alias("links")).where("links > 0")
    of, got = Counter(), Counter()
    for r in true.select("uid", "links", _stratum(F.col("links")).alias("stratum")).collect():
        weight, found = stands[r["uid"]]
        found = min(found, r["links"])
        of[r["stratum"]] += weight
        got[r["stratum"]] += weight * found / r["links"]
        of["all"] += weight * r["links"]
        got["all"] += weight * found
    return min((got[x] / of[x] for x in of), default=1.0)


def _stratum(links: Column) -> Column:
    return F.when(links == 0, 0).when(links <= FEW, 1).when(links <= MANY, 2).otherwise(3)


def similar_vectors(
    vectors: DataFrame, least: float = 0.9, recall: float = RECALL, id_column: str = "vec_id", vector_column: str = "embedding", probes: int = PROBES, beam: int = BEAM
) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept; and the recall that the audit measured."""
    read = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("embedding"))
    rows = pinned(read.mapInArrow(_points, _POINT_DDL), "vectors")
    classes = rows.where("dim > 0").groupBy("key").agg(F.min("uid").alias("uid"), F.count("*").alias("copies"))
    classes = pinned(classes, "classes")
    points = pinned(rows.join(classes.select("uid", "copies"), "uid").select("uid", "dim", "unit", "copies"), "points")
    centres = _centres(points)
    for attempt in range(ROUNDS):
        assigned = pinned(_assigned(points, centres, max(OVERLAP, probes)), "assigned")
        members, searches = _places(assigned)
        if not attempt:
            lists = pinned(_adjacency(members, points), "adjacency")
        links = pinned(_found(members, searches, points, lists, least, beam), "links")
        counts = pinned(links.groupBy("uid").agg(F.sum("found").alias("found")), "counts")
        measured = _audit(points, counts, least)
        if measured >= recall:
            break
        probes, beam = probes * 2, beam * 2
    else:
        links = pinned(_scanned(points, centres, least), "links")
        counts = pinned(links.groupBy("uid").agg(F.sum("found").alias("found")), "counts")
        measured = _audit(points, counts, least)
    groups = connected_components(links.select(F.col("uid").alias("a"), F.col("other").alias("b")))
    named = classes.join(counts, "uid", "left").join(groups.withColumnRenamed("id", "uid"), "uid", "left")
    named = named.select("key", (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "uid").alias("_label"))
    named = pinned(named, "named")
    labelled = rows.select("uid", "vec_id", "key").join(named, "key", "left")
    labelled = pinned(labelled.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("_label", "uid").alias("_label")), "labelled")
    firsts = pinned(labelled.groupBy("_label").agg(F.min("vec_id").alias("component_id")), "firsts")
    return labelled.join(firsts, "_label").select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(float(measured)).alias("audited_recall")
    )

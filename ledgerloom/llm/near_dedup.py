"""Near duplicates: documents linked by the Jaccard similarity of their word shingles.

Method: the chosen-path set similarity join. Every distinct shingle set gets a
signature of minwise values. Independent trees branch on some of its coordinates:
documents that agree there meet in a node. A node of bounded size is compared
exhaustively; a larger one branches on, on coordinates that its path chooses,
unless its documents are alike on average, when branching would not part them:
then it is compared in blocks. Candidate groups that the signatures suggest are
confirmed on the full sets, so every link is exact. The roots branch on enough
coordinates that a pair at the threshold escapes with a probability of 0.25^16.

Sizes: identical sets are one from the start, so a third of all rows may be one
text. Rows that move between tasks are signatures (160 bytes); full sets move
only for candidates. No pair is written: a group hands on at most one link per
document, which keeps its connections. Comparisons hold at most two blocks.

Defined results: null, empty and blank texts have no shingles and link with
nothing; a text under five words is one shingle; repeated rows are one set; a
group is named by its smallest id (a null id only if there is no other); an
empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import batches_of, digest, empty_if_null, keep_rows, map_side, pinned, rows_of
from .components import connected_components

#: Coordinates of a signature, and how many of them the roots branch on.
COORDINATES, ROOTS = 64, 16
#: Pairs that agree in fewer coordinates are not confirmed: five standard
#: deviations below the 48 that a pair at the threshold has on average.
LEAST_AGREEING = 30
#: Documents of one block; a node of up to ``WHOLE`` of them is compared exhaustively.
BLOCK, WHOLE = 1024, 4096
#: Children per node below the roots; depth at which nodes are compared as they are.
BRANCHES, DEPTH = 3, 4
#: Bits by which a scan tells documents that may be candidates, as a power of two.
FILTER_BITS = 26
#: From this average similarity on, branching does not part a node's documents.
ALIKE = 0.5

_FACTORS = shingles.multipliers(COORDINATES, seed=7)

_MARK_FIELDS = [
    ("uid", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("n_shingles", pa.int64()),
    ("key", pa.binary()), ("sig", pa.binary()),
]
_MARK_DDL = "uid long, doc_id long, digest binary, n_shingles long, key binary, sig binary"


def _set_key(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    uid = TaskContext.get().partitionId() << 40
    for doc_id, digest_, text in rows_of(batches, "doc_id", "digest", "text"):
        values = shingles.shingle_set(text)
        signature = _packed(shingles.minwise(values, _FACTORS)) if len(values) else None
        yield uid, doc_id, digest_, len(values), _set_key(values), signature
        uid += 1


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return batches_of(_marks(batches), pa.schema(_MARK_FIELDS))


def _mixed(path: np.ndarray | int, coordinate: np.ndarray | int, values: np.ndarray) -> np.ndarray:
    """The node to which a value at a coordinate leads from a path, as 64 bits."""
    with np.errstate(over="ignore"):
        at = np.asarray(path).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(coordinate).astype(np.uint64)
        x = (at * np.uint64(0xD6E8FEB86659FD93)) ^ values.astype(np.uint64)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(32))).view(np.int64)


def _packed(signature: np.ndarray) -> bytes:
    """A signature as stored: 32 bits where the roots branch, 16 elsewhere.

    Roots part the whole corpus. Elsewhere values are compared for two documents
    at a time or part one node, where one accidental match in 65536 does no harm.
    """
    return signature[:ROOTS].tobytes() + signature[ROOTS:].astype(np.uint16).tobytes()


def _signatures(stored: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(stored), np.uint8).reshape(len(stored), -1)
    roots = np.ascontiguousarray(raw[:, : 4 * ROOTS]).view(np.uint32)
    others = np.ascontiguousarray(raw[:, 4 * ROOTS :]).view(np.uint16)
    return np.concatenate([roots, others.astype(np.uint32)], axis=1)


def _node_batch(node: np.ndarray, parent: np.ndarray, coordinate: np.ndarray, uid: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(node), pa.array(parent), pa.array(coordinate.astype(np.int32)), pa.array(uid)]
    return pa.RecordBatch.from_arrays(arrays, names=["node", "parent", "coordinate", "uid"])


_NODE_DDL = "node long, parent long, coordinate int, uid long"


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            values, uid = _signatures(batch.column("sig").to_pylist()), batch.column("uid").to_numpy()
            for c in range(ROOTS):
                yield _node_batch(_mixed(0, c, values[:, c]), np.zeros(len(uid), np.int64), np.full(len(uid), c), uid)


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            values, uid = _signatures(batch.column("sig").to_pylist()), batch.column("uid").to_numpy()
            path = batch.column("node").to_numpy()
            for k in range(BRANCHES):
                # The path chooses; documents in one node choose alike.
                chosen = (_mixed(path, 1000 + k, path.view(np.uint64)).view(np.uint64) % np.uint64(COORDINATES)).astype(np.int64)
                yield _node_batch(_mixed(path, chosen + k * COORDINATES, values[np.arange(len(uid)), chosen]), path, np.full(len(uid), -1), uid)


def _sized(nodes: DataFrame, label: str) -> DataFrame:
    """(node, parent, n) of the nodes in which documents meet."""
    return pinned(nodes.groupBy("node").agg(F.count("*").alias("n"), F.min("parent").alias("parent")).where("n > 1"), label)


def _leaves(sets: DataFrame, whole: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """(node, coordinate, uid, n) to be compared, and (uid, open) for roots that branched on.

    ``open`` has a bit for each root coordinate at which the document's node was
    not compared itself.
    """
    spark = sets.sparkSession
    nodes = sets.mapInArrow(_roots, _NODE_DDL)
    sizes = _sized(nodes, "nodes")
    met = nodes.drop("parent").join(map_side(sizes.drop("parent")), "node")
    leaves = [met.where(F.col("n") <= whole)]
    opened = spark.createDataFrame([], "uid long, open long")
    large = sizes.where(F.col("n") > whole)
    if large.isEmpty():
        return leaves[0], opened
    frontier = pinned(met.where(F.col("n") > whole), "frontier")
    for level in range(1, depth + 1):
        below = frontier.join(sets, "uid").select("node", "uid", "sig").mapInArrow(_children, _NODE_DDL)
        sizes = _sized(below, "nodes")
        # The share of equal pairs at the chosen coordinates is the average similarity.
        alike = sizes.groupBy("parent").agg(F.sum(F.col("n").cast("double") ** 2).alias("squares")).withColumnRenamed("parent", "node")
        judged = frontier.select("node", "n").dropDuplicates().join(alike, "node", "left")
        judged = pinned(judged.withColumn("dense", F.coalesce("squares", F.lit(0.0)) >= ALIKE * BRANCHES * F.col("n").cast("double") ** 2), "judged")
        settled = frontier.join(judged.where("dense").select("node"), "node", "left_semi")
        leaves.append(settled)
        branched = judged.where("not dense").select(F.col("node").alias("parent"))
        if level == 1:
            went = frontier.join(branched.withColumnRenamed("parent", "node"), "node", "left_semi")
            opened = pinned(went.withColumn("_bit", F.expr("shiftleft(1L, coordinate)")).groupBy("uid").agg(F.bit_or("_bit").alias("open")), "open")
        kept = sizes.join(branched, "parent", "left_semi").select("node", "n")
        met = below.drop("parent").join(kept, "node")
        last = level == depth
        leaves.append(met if last else met.where(F.col("n") <= whole))
        if last or kept.where(F.col("n") > whole).isEmpty():
            break
        frontier = pinned(met.where(F.col("n") > whole), "frontier")
    found = leaves[0]
    for more in leaves[1:]:
        found = found.unionByName(more.select("node", "coordinate", "uid", "n"))
    return found, opened


def _in_blocks(leaves: DataFrame, block: int) -> DataFrame:
    """(place, coordinate, uid, side): every two blocks of a node meet in one place.

    side is -1 where all documents of a place are compared with each other, else
    the two sides 0 and 1 are compared with one another.
    """
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    cut = leaves.withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("uid", "node"), F.col("_blocks")).cast("int"))
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    side = F.when(F.col("_own") == F.col("_other"), F.lit(-1)).otherwise((F.col("_own") > F.col("_other")).cast("int"))
    return cut.select(F.xxhash64("node", low, high).alias("place"), "coordinate", "uid", side.alias("side"))


class Union:
    """Disjoint sets of 0 .. n-1."""

    def __init__(self, n: int) -> None:
        self.above = list(range(n))

    def root(self, i: int) -> int:
        while self.above[i] != i:
            self.above[i] = self.above[self.above[i]]
            i = self.above[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.above[max(i, j)] = min(i, j)


def _by(batches: Iterator[pa.RecordBatch], key: str, *names: str) -> Iterator[tuple[int, list[tuple]]]:
    """Runs of rows with equal ``key``, from batches sorted by it."""
    at, held = None, []
    for row in rows_of(batches, key, *names):
        if row[0] != at and held:
            yield at, held
            held = []
        at = row[0]
        held.append(row[1:])
    if held:
        yield at, held


def _suggest(batches: Iterator[pa.RecordBatch], least: int, hundredths: int) -> Iterator[pa.RecordBatch]:
    """(cluster, uid) of documents whose signatures suggest a link in a place."""
    return batches_of(_suggested(batches, least, hundredths), pa.schema([("cluster", pa.int64()), ("uid", pa.int64())]))


def _suggested(batches: Iterator[pa.RecordBatch], least: int, hundredths: int) -> Iterator[tuple]:
    for place, rows in _by(batches, "place", "uid", "coordinate", "side", "open", "n_shingles", "sig"):
        if len(rows) < 2:
            continue
        uid, coordinate, side, opened, sizes, signatures = zip(*rows)
        values = _signatures(list(signatures))
        size, side_, open_ = np.array(sizes), np.array(side), np.array(opened)
        groups, met = Union(len(rows)), set()
        bits = 1 << np.arange(ROOTS)
        for i in range(len(rows) - 1):
            same = values[i] == values[i + 1 :]
            good = same.sum(axis=1) >= least
            good &= 100 * np.minimum(size[i], size[i + 1 :]) >= hundredths * np.maximum(size[i], size[i + 1 :])
            if side_[i] >= 0:
                good &= side_[i] != side_[i + 1 :]
            if good.any() and coordinate[i] > 0:
                # The first root that compares both has seen the pair.
                before = same[:, : coordinate[i]] & ((open_[i] | open_[i + 1 :])[:, None] & bits[: coordinate[i]] == 0)
                good &= ~before.any(axis=1)
            for j in np.flatnonzero(good):
                groups.join(i, i + 1 + int(j))
                met.update((i, i + 1 + int(j)))
        for i in sorted(met):
            yield int(_mixed(place, 7, np.array([groups.root(i)], np.uint64))[0]), uid[i]


def _confirm(batches: Iterator[pa.RecordBatch], hundredths: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that hold a cluster's linked documents together, by their full sets."""
    return batches_of(_confirmed(batches, hundredths), pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _confirmed(batches: Iterator[pa.RecordBatch], hundredths: int) -> Iterator[tuple]:
    for _, rows in _by(batches, "cluster", "uid", "shingles"):
        sets = dict(rows)
        if len(sets) < 2:
            continue
        uid = sorted(sets)
        groups = linked([np.frombuffer(sets[u], np.uint64) for u in uid], hundredths)
        for i in range(len(uid)):
            if groups.root(i) != i:
                yield uid[groups.root(i)], uid[i]


def linked(sets: list[np.ndarray], hundredths: int) -> Union:
    """Groups of sets connected by 100 * |a and b| >= hundredths * |a or b|.

    Counts, for one set after the other, its common elements with all that follow;
    pairs already connected need no count.
    """
    groups = Union(len(sets))
    sizes = np.array([len(s) for s in sets])
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mine = np.zeros(int(place.max()) + 1, bool)
    for i in range(len(sets) - 1):
        later = [j for j in range(i + 1, len(sets)) if groups.root(j) != groups.root(i)]
        if not later:
            continue
        own = place[starts[i] : starts[i + 1]]
        mine[own] = True
        if len(later) == len(sets) - i - 1:
            both = np.add.reduceat(mine[place[starts[i + 1] :]].astype(np.int64), starts[i + 1 : -1] - starts[i + 1])
        else:
            both = np.array([np.count_nonzero(mine[place[starts[j] : starts[j + 1]]]) for j in later])
        mine[own] = False
        at = np.array(later)
        for j in at[100 * both >= hundredths * (sizes[i] + sizes[at] - both)]:
            groups.join(i, int(j))
    return groups


def _bit(doc_id: int | None) -> int:
    """The bit of an id in the filter; ids may share one."""
    return 0 if doc_id is None else xxhash.xxh3_64_intdigest(doc_id.to_bytes(8, "little", signed=True)) & ((1 << FILTER_BITS) - 1)


def _filter(ids: DataFrame) -> bytes:
    """2 ** FILTER_BITS bits (8 MB), in which those of ``ids`` (column _id) are set.

    However many ids there are, what comes to the driver is at most the bits.
    """

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.int32()), ("bit", pa.int32())])
        return batches_of(((b >> 13, b & 8191) for b in (_bit(i) for (i,) in rows_of(batches, "_id"))), schema)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for chunk, there in rows_of(batches, "chunk", "there"):
                held = np.zeros(8192, np.uint8)
                held[there] = 1
                yield chunk, np.packbits(held, bitorder="little").tobytes()

        return batches_of(rows(), pa.schema([("chunk", pa.int32()), ("held", pa.binary())]))

    chunks = ids.mapInArrow(bits, "chunk int, bit int").groupBy("chunk").agg(F.collect_set("bit").alias("there"))
    found = bytearray(1 << (FILTER_BITS - 3))
    for row in chunks.mapInArrow(packed, "chunk int, held binary").collect():
        found[row["chunk"] << 10 : (row["chunk"] + 1) << 10] = row["held"]
    return bytes(found)


def _full_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (cluster, uid, key, _id) with ``shingles``, from the texts.

    The scan passes over documents whose bit is not set, so few texts are looked
    at and none is shuffled; those that only share a bit go in the join behind.
    """
    wanted = map_side(pinned(wanted, "wanted"))
    held = texts.sparkSession.sparkContext.broadcast(_filter(wanted.select("_id").distinct()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = held.value

        def rows() -> Iterator[tuple]:
            for batch in batches:
                column = batch.column("text")
                for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                    bit = _bit(doc_id)
                    if there[bit >> 3] >> (bit & 7) & 1:
                        values = shingles.shingle_set(column[i].as_py())
                        yield doc_id, _set_key(values), values.tobytes()

        return batches_of(rows(), pa.schema([("doc_id", pa.int64()), ("found", pa.binary()), ("shingles", pa.binary())]), most_bytes=4 << 20)

    found = texts.select("doc_id", "text").mapInArrow(run, "doc_id long, found binary, shingles binary")
    return found.join(wanted, found["doc_id"].eqNullSafe(wanted["_id"]) & (found["found"] == wanted["key"])).select("cluster", "uid", "shingles")


def similar_texts(
    docs: DataFrame,
    hundredths: int = 75,
    id_column: str = "doc_id",
    text_column: str = "text",
    whole: int = WHOLE,
    block: int = BLOCK,
    depth: int = DEPTH,
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept; and _digest, _stays for one row of each group.

    ``hundredths`` is the least similarity, as a whole number of hundredths.
    """
    least = LEAST_AGREEING * hundredths // 75
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), empty_if_null(F.col(text_column)).alias("text"))
    marks = pinned(texts.select("doc_id", digest(F.col("text")).alias("digest"), "text").mapInArrow(_mark, _MARK_DDL), "marks")
    classes = pinned(marks.where("n_shingles > 0").groupBy("key").agg(F.min("uid").alias("uid")), "classes")
    sets = pinned(marks.join(map_side(classes.select("uid")), "uid", "left_semi").select("uid", "doc_id", "key", "n_shingles", "sig"), "sets")

    leaves, opened = _leaves(sets.select("uid", "sig"), whole, depth)
    signed = sets.select("uid", "n_shingles", "sig").join(opened, "uid", "left").withColumn("open", F.coalesce("open", F.lit(0)))
    places = _in_blocks(leaves, block).join(signed, "uid").select("place", "uid", "coordinate", "side", "open", "n_shingles", "sig")
    suggested = places.repartition("place").sortWithinPartitions("place").mapInArrow(
        lambda batches: _suggest(batches, least, hundredths), "cluster long, uid long"
    )
    clusters = pinned(suggested, "clusters")

    wanted = clusters.join(sets.select("uid", "key", F.col("doc_id").alias("_id")), "uid")
    links = _full_sets(texts, wanted).repartition("cluster").sortWithinPartitions("cluster").mapInArrow(
        lambda batches: _confirm(batches, hundredths), "a long, b long"
    )
    groups = connected_components(links)

    named = classes.join(groups.withColumnRenamed("id", "uid"), "uid", "left")
    named = pinned(named.select("key", F.coalesce("component", "uid").alias("_label")), "named")
    # Texts without shingles share a key but no class: each stays by itself.
    labelled = marks.select("uid", "doc_id", "digest", "n_shingles", "key").join(named, "key", "left")
    labelled = pinned(labelled.withColumn("_label", F.coalesce("_label", "uid")).drop("key"), "labelled")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "uid"))
    firsts = pinned(labelled.groupBy("_label").agg(first.alias("_first")), "firsts")
    return labelled.join(firsts, "_label").select(
        "doc_id",
        "n_shingles",
        F.col("_first.doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.col("_first.doc_id")).alias("kept"),
        F.col("digest").alias("_digest"),
        (F.col("uid") == F.col("_first.uid")).alias("_stays"),
    )


def drop_similar(docs: DataFrame, hundredths: int = 75, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of linked documents."""
    kept = similar_texts(docs, hundredths, id_column, text_column).where("_stays")
    return keep_rows(docs, kept.select("doc_id", "_digest"), id_column, text_column)

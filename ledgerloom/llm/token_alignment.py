"""Alignment of two tokenizers over a corpus, with corpus-wide counts of linked id pairs.

A text is encoded by a byte-level BPE (A) and by a sentencepiece model (B), both
over the bytes of a space and the text. Two token occurrences are linked if their
byte ranges overlap; the offsets where tokens of both end cut them into groups.

Method: minimal perfect hashing of distinct pairs. One pass aligns all texts; it
writes each text's links, and tallies of id pairs. The distinct pairs of each shard
of the pairs get a minimal perfect hash; each branch of tallies becomes a dense
vector of counts, indexed by the hash with the pairs compared, and the vectors are
summed in a tree. A second pass reads the links and looks their counts up.

Sizes: a shard cannot have more pairs than |A| * |B| / SHARDS, about. The most
frequent pairs, ``most_broadcast`` at most, go to all tasks as one hashed table.
What a text has of other pairs is shuffled to the shards, where their own hashes
answer; so all counts are exact at any size, and no task needs all pairs.

Between single spaces texts are aligned once a task and remembered: neither
tokenizer lets a token cross the beginning of a word behind one space.

Defined results: texts that are null or empty, or whose tokens' bytes of A or of
B differ from the bytes of space and text (as where the text has a U+2581), have
no tokens: zeros, and an empty digest. Special strings are plain text. Rows that
repeat count and come out as often; null ids stay null; an empty table gives an
empty one; columns other than id and text are not read. Whole texts of any length
are aligned; a text without spaces is aligned in one piece.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import empty_if_null, pinned
from .perfect_hash import CountTable, PerfectHash, in_places, mixed

#: The pairs are dealt over so many shards by a hash of the pair.
SHARDS = 512
#: Branches that a node of the summing tree adds up, and tasks of a branch.
FAN = 16
#: Remembered stretches of text and their tokens, beyond which a task starts afresh.
STRETCHES = 120_000
TOKENS = 2_000_000
#: Stretches of texts that are read before what is new is aligned, and letters that are aligned at once.
AHEAD = 100_000
AT_ONCE = 16_384
#: Texts that are Python strings at once.
TEXTS = 256
#: Links whose counts are looked up at once.
LINKS = 1 << 20
#: Distinct pairs that a task tallies before it hands them on.
TALLIED = 500_000
#: Occurrences of infrequent pairs that one task looks up in a shard.
LOOKED_UP = 4_000_000
#: Marks the end of a space-separated stretch that cannot stand alone.
_NOT_ALONE = -1
_SHARD_SEED = 1000

_TALLY = pa.schema([("branch", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_TALLY_DDL = "branch int, shard int, keys binary, counts binary"
_HASHED = pa.schema([("shard", pa.int32()), ("hash", pa.binary()), ("keys", pa.binary())])
_HASHED_DDL = "shard int, hash binary, keys binary"
_VECTOR = pa.schema([("shard", pa.int32()), ("branch", pa.int32()), ("counts", pa.binary())])
_VECTOR_DDL = "shard int, branch int, counts binary"
_FACTS = ("n_a", "n_b", "n_groups", "n_links")
#: What the first pass writes: a row per text, and rows of tallies, each without the columns of the other.
_FIRST = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in _FACTS), ("groups_sha256", pa.string())]
    + [("a_ids", pa.binary()), ("b_ids", pa.binary()), *_TALLY]
)
_FIRST_DDL = "row long, doc_id long, " + "".join(f"{c} long, " for c in _FACTS) + f"groups_sha256 string, a_ids binary, b_ids binary, {_TALLY_DDL}"
_KEPT = ("row", "doc_id", *_FACTS, "groups_sha256")
_ALIGNED = pa.schema(
    [*(_FIRST.field(c) for c in _KEPT), ("n_best", pa.int64()), ("count_sum", pa.int64())]
    + [("rare_shards", pa.list_(pa.int32())), ("rare_keys", pa.list_(pa.binary())), ("rare_times", pa.list_(pa.binary()))]
)
_ALIGNED_DDL = "row long, doc_id long, " + "".join(f"{c} long, " for c in _FACTS) + "groups_sha256 string, n_best long, count_sum long, rare_shards array<int>, rare_keys array<binary>, rare_times array<binary>"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def align(
    docs: DataFrame,
    vocabularies: tuple[str, str] | None = None,
    most_broadcast: int = 1 << 20,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: tokens, groups, links, and what the links count over the corpus.

    ``vocabularies`` are the paths of A's ``.json`` and B's ``.model``, the same on
    every machine. n_best is the number of links whose pair is counted as often as
    any pair of its B id; count_sum adds up the counts of the links' pairs.
    """
    paths = vocabularies or default_paths()
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), empty_if_null(F.col(text_column)).alias("text"))
    first = pinned(texts.mapInArrow(_linked(paths), _FIRST_DDL), "links")
    table = count_pairs(first.where("shard IS NOT NULL").select(*_TALLY.names))
    highest = _highest(table)
    frequent = _frequent(table, most_broadcast)
    shared = docs.sparkSession.sparkContext.broadcast((frequent, highest))
    links = first.where("row IS NOT NULL").select(*_KEPT, "a_ids", "b_ids")
    aligned = pinned(links.mapInArrow(_looked_up(shared), _ALIGNED_DDL), "aligned")
    rare = _rare_counts(aligned, table, shared)
    joined = aligned.join(rare, "row", "left")
    n_best, count_sum = (F.col(c) + F.coalesce(F.col(f"rare_{c}"), F.lit(0)) for c in ("n_best", "count_sum"))
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", n_best.alias("n_best"), count_sum.alias("count_sum"), "groups_sha256")


def count_pairs(tallies: DataFrame) -> DataFrame:
    """shard, hash, keys, counts: the corpus-wide counts of all linked pairs, a row per shard, from tallies that are stored.

    ``keys`` and ``counts`` are 64-bit numbers in the order of the hash; a key is
    the id of A times 2^32 and the id of B.
    """
    hashes = pinned(tallies.select("shard", "keys").groupBy("shard").applyInArrow(_hashed, _HASHED_DDL), "pair-hashes")
    branches = (tallies.agg(F.max("branch")).first()[0] or 0) + 1
    everywhere = hashes.withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(branches - 1))))
    place = "shard", "branch"
    vectors = tallies.groupBy(*place).cogroup(everywhere.groupBy(*place)).applyInArrow(_dense, _VECTOR_DDL)
    while branches > 1:
        vectors = vectors.withColumn("branch", F.floor(F.col("branch") / FAN).cast("int")).groupBy(*place).applyInArrow(_added, _VECTOR_DDL)
        branches = -(-branches // FAN)
    return pinned(hashes.join(vectors.drop("branch"), "shard"), "pair-counts")


# ---- counts -------------------------------------------------------------------


def _numbers(cell: bytes) -> np.ndarray:
    return np.frombuffer(cell, "<i8")


def _cell(numbers: np.ndarray) -> bytes:
    return numbers.astype("<i8").tobytes()


def _by_shard(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Shards with the positions of their keys."""
    shard = (mixed(keys, _SHARD_SEED) % np.uint64(SHARDS)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0]) if len(order) else []
    for start, end in zip(starts, [*starts[1:], len(order)]):
        yield int(shard[order[start]]), order[start:end]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The minimal perfect hash of a shard's distinct pairs."""
    distinct, waiting, shard = np.zeros(0, np.int64), [], None
    for batch in batches:
        shard = batch.column("shard")[0].as_py() if batch.num_rows else shard
        waiting += map(_numbers, batch.column("keys").to_pylist())
        if sum(map(len, waiting)) > TALLIED:
            distinct, waiting = np.unique(np.concatenate([distinct, *waiting])), []
    distinct = np.unique(np.concatenate([distinct, *waiting]))
    hash_ = PerfectHash.of(distinct)
    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([hash_.to_bytes()]), pa.array([_cell(in_places(hash_, distinct))])], schema=_HASHED)


def _dense(tallies: pa.Table, hashes: pa.Table) -> pa.Table:
    """The tallies of a shard's branch as a vector of counts, indexed by the hash."""
    if not tallies.num_rows:
        return _VECTOR.empty_table()
    row = hashes.to_pylist()[0]
    hash_, known = PerfectHash.from_bytes(row["hash"]), _numbers(row["keys"])
    counts = np.zeros(hash_.size, np.int64)
    for keys, times in zip(tallies.column("keys"), tallies.column("counts")):
        keys, times = _numbers(keys.as_py()), _numbers(times.as_py())
        at = hash_.places(keys)
        if not (known[at] == keys).all():
            raise ValueError("a tallied pair is missing from its hash")
        counts[at] += times
    return pa.table({"shard": [row["shard"]], "branch": [row["branch"]], "counts": [_cell(counts)]}, schema=_VECTOR)


def _added(vectors: pa.Table) -> pa.Table:
    total = sum(_numbers(c.as_py()) for c in vectors.column("counts"))
    place = vectors.slice(0, 1).to_pylist()[0]
    return pa.table({"shard": [place["shard"]], "branch": [place["branch"]], "counts": [_cell(total)]}, schema=_VECTOR)


def _rows_of(table: DataFrame, each, ddl: str) -> DataFrame:
    """``each(keys, counts)`` gives columns for a shard's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("keys"), batch.column("counts")):
                columns = each(_numbers(keys.as_py()), _numbers(counts.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    names = [c.split()[0] for c in ddl.split(", ")]
    return table.select("keys", "counts").mapInArrow(run, ddl)


def _highest(table: DataFrame) -> np.ndarray:
    """By id of B, the highest count of its pairs: as many numbers as B has ids, at most."""

    def each(keys: np.ndarray, counts: np.ndarray):
        ids, at = np.unique(keys & 0xFFFFFFFF, return_inverse=True)
        most = np.zeros(len(ids), np.int64)
        np.maximum.at(most, at, counts)
        return ids, most

    rows = _rows_of(table, each, "b long, most long").groupBy("b").agg(F.max("most").alias("most")).collect()
    highest = np.zeros(1 + max((r.b for r in rows), default=0), np.int64)
    for r in rows:
        highest[r.b] = r.most
    return highest


def _frequent(table: DataFrame, most: int) -> CountTable:
    """At most ``most`` pairs, from the most frequent down to a power of two."""

    def power(counts: np.ndarray) -> np.ndarray:
        return np.frexp(counts.astype(np.float64))[1].astype(np.int64)

    def histogram(keys: np.ndarray, counts: np.ndarray):
        return np.unique(power(counts), return_counts=True)

    pairs = dict(_rows_of(table, histogram, "power long, n long").groupBy("power").agg(F.sum("n")).collect())
    least, taken = 64, 0
    while least > 0 and taken + pairs.get(least - 1, 0) <= most:
        least -= 1
        taken += pairs.get(least, 0)

    def chosen(keys: np.ndarray, counts: np.ndarray):
        some = power(counts) >= least
        return [_cell(keys[some])], [_cell(counts[some])]

    rows = _rows_of(table, chosen, "keys binary, counts binary").collect()
    keys, counts = (np.concatenate([np.zeros(0, np.int64), *(_numbers(r[i]) for r in rows)]) for i in (0, 1))
    hash_ = PerfectHash.of(keys)
    by_place = np.zeros(len(keys), np.int64)
    by_place[hash_.places(keys)] = counts
    return CountTable(hash_, in_places(hash_, keys), by_place)


def _rare_counts(aligned: DataFrame, table: DataFrame, shared) -> DataFrame:
    """row, rare_n_best, rare_count_sum: what the shards say of pairs that are not broadcast."""
    asked = aligned.select("row", F.explode(F.arrays_zip("rare_shards", "rare_keys", "rare_times")).alias("r"))
    asked = asked.select("row", F.col("r.rare_shards").alias("shard"), F.col("r.rare_keys").alias("keys"), F.col("r.rare_times").alias("times"))
    volume = asked.agg(F.sum(F.length("keys"))).first()[0] or 0
    parts = 1 + volume // (8 * SHARDS * LOOKED_UP)
    asked = asked.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    wanted = table.join(asked.select("shard").distinct(), "shard", "left_semi")
    answers = wanted.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("part", F.col("part").cast("long"))
    place = "shard", "part"

    def answered(asked_: pa.Table, shard: pa.Table) -> pa.Table:
        rows, best, total = [], [], []
        if asked_.num_rows and shard.num_rows:
            row = shard.to_pylist()[0]
            counts_of = CountTable(PerfectHash.from_bytes(row["hash"]), _numbers(row["keys"]), _numbers(row["counts"]))
            _, highest = shared.value
            for id_, keys, times in zip(*(asked_.column(c).to_pylist() for c in ("row", "keys", "times"))):
                keys, times = _numbers(keys), _numbers(times)
                counts, known = counts_of.find(keys)
                if not known.all():
                    raise ValueError("a linked pair is missing from its shard")
                rows.append(id_)
                best.append(int(times[counts == highest[keys & 0xFFFFFFFF]].sum()))
                total.append(int((counts * times).sum()))
        return pa.table({"row": pa.array(rows, pa.int64()), "n_best": pa.array(best, pa.int64()), "count_sum": pa.array(total, pa.int64())})

    found = asked.groupBy(*place).cogroup(answers.groupBy(*place)).applyInArrow(answered, "row long, n_best long, count_sum long")
    return found.groupBy("row").agg(F.sum("n_best").alias("rare_n_best"), F.sum("count_sum").alias("rare_count_sum"))


# ---- alignment within a task ----------------------------------------------------


class Aligner:
    """Aligned stretches of text, numbered as they come; each worker keeps one for its tasks.

    New stretches wait until :meth:`align_waiting` encodes and aligns them together.
    """

    _CUT = re.compile(r"(?<=\S)(?= \S)")

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = bpe.vocabulary(a_path)
        self.a_library = Tokenizer.from_file(a_path)
        self.a_library.encode_special_tokens = True
        self.b = b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        n_a, n_b = max(self.a.ids.values()) + 1, b.get_piece_size()
        self.a_bytes = [b""] * n_a
        for token, i in self.a.ids.items():
            self.a_bytes[i] = token
        # No text holds the byte FF, so an unknown piece differs from any.
        self.b_bytes = [b"\xff" if b.is_unknown(i) else bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(n_b)]
        self.a_lengths, self.b_lengths = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.cuttable = not any("▁" in b.id_to_piece(i).lstrip("▁") for i in range(n_b))
        # Each id as text with what may stand behind it, in the order of the offsets below.
        self.written = [f"{i}{mark}" for mark, n in ((",", n_a), ("|", n_a), (",", n_b), (";", n_b), ("\n", n_b)) for i in range(n)]
        self.n_a, self.n_b = n_a, n_b
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbers(self)
        self.waiting: list[str] = []
        self.facts = np.zeros((4, 0), np.int64)
        self.links, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.groups: list[str] = []

    @property
    def full(self) -> bool:
        return len(self.groups) > STRETCHES or len(self.links) > TOKENS

    n_a_of, n_b_of, n_groups_of, valid = (property(lambda self, k=k: self.facts[k]) for k in range(4))

    def stretches(self, text: str) -> list[int]:
        """The numbers of a text's stretches, in order."""
        if not self.cuttable:
            return [self.numbers[" " + text]]
        found = list(map(self.numbers.__getitem__, text.split(" ")))
        if _NOT_ALONE in found:
            # With a space before each, they are told from those between single spaces.
            found = list(map(self.numbers.__getitem__, self._CUT.split(" " + text)))
        return found

    def align_waiting(self) -> None:
        """Align what is new, many stretches at once."""
        waiting, self.waiting = self.waiting, []
        found: list[tuple] = []
        at = 0
        while at < len(waiting):
            end, size = at, 0
            while end < len(waiting) and (size < AT_ONCE or end == at):
                size += len(waiting[end])
                end += 1
            found += self._each(waiting[at:end])
            at = end
        facts, links, ends = ([f[k] for f in found] for k in range(3))
        ahead = len(self.links) + np.cumsum([0, *map(len, links)])
        self.ends = np.concatenate([self.ends, *(e + n for e, n in zip(ends, ahead))])
        self.facts, self.links = np.concatenate([self.facts, *facts], axis=1), np.concatenate([self.links, *links])
        for f in found:
            self.groups += f[3]

    def _each(self, stretches: list[str]) -> list[tuple]:
        found = self._aligned(stretches)
        if found is not None:
            return [found]
        if len(stretches) == 1:
            return [(np.zeros((4, 1), np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), [""])]
        # One of them does not come back whole: each half by itself.
        half = len(stretches) // 2
        return self._each(stretches[:half]) + self._each(stretches[half:])

    def _aligned(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]] | None:
        """Facts, links and where they end, and groups of each stretch; None if any has no tokens.

        Tokens of stretches one behind another are those of each stretch, unless one
        ends in white space, as the last of a text may: there the encoding starts anew.
        """
        runs, start = [], 0
        for k, stretch in enumerate(stretches, 1):
            if stretch[-1].isspace() or k == len(stretches):
                runs.append("".join(stretches[start:k]))
                start = k
        whole = "".join(runs).encode()
        a = np.concatenate([self._ids(r) for r in runs])
        b = np.fromiter(chain.from_iterable(self.b.encode([r[1:] for r in runs], num_threads=1)), np.int64)
        for ids, tokens in ((a, self.a_bytes), (b, self.b_bytes)):
            if b"".join(map(tokens.__getitem__, ids.tolist())) != whole:
                return None
        a_ends, b_ends = np.cumsum(self.a_lengths[a]), np.cumsum(self.b_lengths[b])
        cuts = np.cumsum([len(x.encode()) for x in stretches])
        # Between two ends that follow one another lies the overlap of one token of each side.
        both = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
        ends = both[np.r_[both[1:] != both[:-1], True]]
        of_a, of_b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        common = ends[(a_ends[of_a] == ends) & (b_ends[of_b] == ends)]
        if not np.isin(cuts, common).all():
            raise ValueError("a token crosses the beginning of a word")
        per = [np.searchsorted(x, cuts, "right") for x in (a_ends, b_ends, common, ends)]
        facts = np.array([*(np.diff(x, prepend=0) for x in per[:3]), np.ones(len(cuts), np.int64)])
        return facts, a[of_a] << 32 | b[of_b], per[3], self._written(a, b, a_ends, b_ends, common, cuts)

    def _written(self, a, b, a_ends, b_ends, common, cuts) -> list[str]:
        """The groups of each stretch as text."""
        a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        last = np.isin(b_ends, cuts).astype(np.int64)
        codes = np.concatenate([a + self.n_a * (common[a_group] == a_ends), 2 * self.n_a + b + self.n_b * ((common[b_group] == b_ends) + last)])
        # A group's tokens of A, then its tokens of B.
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        return "".join(map(self.written.__getitem__, codes[order].tolist())).split("\n")[:-1]

    def _ids(self, text: str) -> np.ndarray:
        if self.a.fast is None or self.a.needs_library(text):
            return np.array(self.a_library.encode(text, add_special_tokens=False).ids, np.int64)
        return np.array(self.a.fast.encode_ordinary(text), np.int64)


class _Numbers(dict):
    """Numbers of stretches; one that is new waits to be aligned."""

    def __init__(self, aligner: Aligner) -> None:
        self.aligner = aligner

    def __missing__(self, stretch: str) -> int:
        known = self.aligner
        if stretch[:1] != " " and (stretch.strip() != stretch or not stretch):
            number = _NOT_ALONE
        else:
            number = len(known.groups) + len(known.waiting)
            known.waiting.append(stretch if stretch[:1] == " " else " " + stretch)
        self[stretch] = number
        return number


@lru_cache(maxsize=1)
def aligner(paths: tuple[str, str]) -> Aligner:
    return Aligner(*paths)


class _Tally:
    """Pair counts of a task, folded whenever many have come together."""

    def __init__(self) -> None:
        self.keys, self.times, self.waiting = [], [], 0

    def add(self, keys: np.ndarray, times: np.ndarray) -> None:
        self.keys.append(keys)
        self.times.append(times)
        self.waiting += len(keys)

    def fold(self) -> int:
        keys, at = np.unique(np.concatenate([np.zeros(0, np.int64), *self.keys]), return_inverse=True)
        times = np.zeros(len(keys), np.int64)
        np.add.at(times, at, np.concatenate([np.zeros(0, np.int64), *self.times]))
        self.keys, self.times, self.waiting = [keys], [times], 0
        return len(keys)

    def rows(self, branch: int) -> pa.RecordBatch:
        self.fold()
        (keys,), (times,) = self.keys, self.times
        cells = [(branch, shard, _cell(keys[at]), _cell(times[at])) for shard, at in _by_shard(keys)]
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*cells) if cells else [()] * 4, _TALLY)], schema=_TALLY)


def _texts(batches: Iterator[pa.RecordBatch], known: Aligner) -> Iterator[tuple[pa.RecordBatch, int, int, list[list[int]]]]:
    """Runs of rows with the stretches of their texts; behind a run the aligner may be cleared."""
    for batch in batches:
        start, held, n = 0, [], 0
        texts = batch.column("text")
        for text in chain.from_iterable(texts.slice(k, TEXTS).to_pylist() for k in range(0, len(texts), TEXTS)):
            held.append(known.stretches(text) if text else [])
            n += len(held[-1])
            if n > AHEAD:
                known.align_waiting()
                yield batch, start, start + len(held), held
                start, held, n = start + len(held), [], 0
                if known.full:
                    known.clear()
        if held:
            known.align_waiting()
            yield batch, start, start + len(held), held
            if known.full:
                known.clear()


def _flat(held: list[list[int]], known: Aligner) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of all texts that have tokens, and how many each text has; 0 for others."""
    lengths = np.array([len(x) for x in held], np.int64)
    flat = np.fromiter(chain.from_iterable(held), np.int64, int(lengths.sum()))
    owner = np.repeat(np.arange(len(held)), lengths)
    wrong = np.zeros(len(held), bool)
    wrong[owner[known.valid[flat] == 0]] = True
    return flat[~wrong[owner]], np.where(wrong, 0, lengths)


def _linked(paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tally = aligner(paths), _Tally()
        part = TaskContext.get().partitionId()
        branch, first = part // FAN, part << 36
        for batch, start, end, held in _texts(batches, known):
            flat, lengths = _flat(held, known)
            each = np.repeat(np.bincount(flat, minlength=len(known.groups)), np.diff(known.ends))
            tally.add(known.links[each > 0], each[each > 0])
            yield _text_rows(batch.column("doc_id").slice(start, end - start), held, flat, lengths, known, first)
            first += end - start
            if tally.waiting > 2 * TALLIED and tally.fold() > TALLIED:
                yield _filled(tally.rows(branch))
        yield _filled(tally.rows(branch))

    return run


def _filled(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of the first pass with NULL in the columns they do not have."""
    return pa.RecordBatch.from_arrays([rows.column(f.name) if f.name in rows.schema.names else pa.nulls(rows.num_rows, f.type) for f in _FIRST], schema=_FIRST)


def _text_rows(doc_ids: pa.Array, held: list[list[int]], flat: np.ndarray, lengths: np.ndarray, known: Aligner, first: int) -> pa.RecordBatch:
    """The texts' facts, and their links as ids of A and of B."""
    ends = np.r_[0, np.cumsum(lengths)]

    def per_text(fact: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(fact[flat])][ends])

    per_stretch = np.diff(known.ends)
    n_links = per_text(per_stretch)
    # Stretch by stretch, the places of its links.
    times = per_stretch[flat]
    before = np.cumsum(times) - times
    links = known.links[np.arange(int(times.sum())) + np.repeat(known.ends[flat] - before, times)]
    digests = [hashlib.sha256(";".join(map(known.groups.__getitem__, x)).encode()).hexdigest() if n else "" for x, n in zip(held, lengths.tolist())]
    width = "<u2" if max(known.n_a, known.n_b) <= 1 << 16 else "<u4"
    ids = [_cells(x.astype(width), n_links) for x in (links >> 32, links & 0xFFFFFFFF)]
    numbers = [per_text(f) for f in (known.n_a_of, known.n_b_of, known.n_groups_of)]
    columns = [pa.array(np.arange(first, first + len(held))), doc_ids, *map(pa.array, (*numbers, n_links)), pa.array(digests, pa.string()), *ids]
    return _filled(pa.RecordBatch.from_arrays(columns, names=_FIRST.names[: len(columns)]))


def _cells(numbers: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Numbers one behind another as a binary cell for each length."""
    offsets = np.r_[0, np.cumsum(lengths)] * numbers.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(numbers.tobytes())])


def _in_cells(cells: pa.Array, n: int) -> np.ndarray:
    """The ``n`` numbers of all cells, one behind another."""
    whole = b"".join(cells.to_pylist())
    return np.frombuffer(whole, f"<u{len(whole) // n}" if n else "<u2").astype(np.int64)


def _looked_up(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, highest = shared.value
        for batch in batches:
            n_links = batch.column("n_links").to_numpy()
            # Runs of rows of about as many links; a text with more is a run of its own.
            run_of = (np.cumsum(n_links) - n_links) // LINKS
            starts = np.flatnonzero(np.r_[True, run_of[1:] != run_of[:-1]]) if len(run_of) else []
            for start, end in zip(starts, [*starts[1:], len(run_of)]):
                yield _counted(batch.slice(start, end - start), n_links[start:end], frequent, highest)

    return run


def _counted(rows: pa.RecordBatch, n_links: np.ndarray, frequent: CountTable, highest: np.ndarray) -> pa.RecordBatch:
    """What the frequent pairs say of each text, and its other pairs by shard."""
    ends = np.r_[0, np.cumsum(n_links)]
    a, b = (_in_cells(rows.column(c), int(ends[-1])) for c in ("a_ids", "b_ids"))
    keys = a << 32 | b
    counts, found = frequent.find(keys)
    best = found & (counts == highest[np.minimum(b, len(highest) - 1)])
    n_best, count_sum, n_rare = (np.diff(np.r_[0, np.cumsum(x)][ends]) for x in (best, counts, ~found))
    rare = ([], [], [])
    for k, n in enumerate(n_rare.tolist()):
        cells = ([], [], [])
        if n:
            mine = slice(ends[k], ends[k + 1])
            some, times = np.unique(keys[mine][~found[mine]], return_counts=True)
            for shard, at in _by_shard(some):
                for cell, value in zip(cells, (shard, _cell(some[at]), _cell(times[at]))):
                    cell.append(value)
        for column, cell in zip(rare, cells):
            column.append(cell)
    columns = [*(rows.column(c) for c in _KEPT), n_best, count_sum, *rare]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _ALIGNED)], schema=_ALIGNED)

"""Token ids, prefix counts, pieces, packing and the id matrix."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, packing, token_counts, token_output
from llm.conftest import AWKWARD

PATH = bpe.default_path()
LIBRARY = Tokenizer.from_file(PATH)
LETTERS = [*"aabcdeehlrstv'' .,!\n\t 09é漢😀\x1c\x85࢏", "<|endoftext|>", "the", "ing", " the", "tion", "'ll"]
TEXTS = st.lists(st.sampled_from(LETTERS), max_size=30).map("".join)


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_ids_and_counts_are_the_librarys(text):
    assert list(bpe.text_ids(bpe.vocabulary(PATH), text)) == ids_of(text)
    assert bpe.prefix_counts(PATH).count(text) == len(ids_of(text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([x for x in LETTERS if x not in ("<|endoftext|>", "࢏")]), max_size=14).map("".join), st.integers(0, 9))
def test_longest_prefix_within_a_budget(text, budget):
    fitting = [i for i in range(len(text) + 1) if len(ids_of(text[:i])) <= budget]
    assert bpe.prefix_counts(PATH).longest_prefix(text, budget) == max(fitting)


def test_every_prefix_of_a_run():
    for run in ("therhaou", " retitioning", "aaaaaaaaaaaa", "....!!!!....", "123456789"):
        counts = bpe.prefix_counts(PATH).within_piece(run.encode())
        assert [counts[i] for i in range(1, len(run) + 1)] == [len(ids_of(run[:i])) for i in range(1, len(run) + 1)]


def test_letters_of_newer_unicode():
    for code in range(0x520, 0x110000, 97):
        if not 0xD800 <= code < 0xE000:
            text = f"we{chr(code)}the 1{chr(code)}2"
            assert bpe.prefix_counts(PATH).count(text) == len(ids_of(text))


def test_counts_of_awkward_rows(awkward, nothing):
    rows = token_counts.count_tokens(awkward, limit=20).collect()
    expected = [(i, len((t or "").encode()), len(ids_of(t or ""))) for i, t, _ in AWKWARD]
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == Counter(expected)
    assert all(r.over_limit == (r.n_tokens > 20) for r in rows)
    texts = {i: t or "" for i, t, _ in AWKWARD}
    for r in rows:
        if r.doc_id is not None and len(texts[r.doc_id]) < 1000:
            assert len(ids_of(texts[r.doc_id][: r.fitting_chars])) <= 20
    assert token_counts.count_tokens(nothing).isEmpty()


def naive_fullest(lengths, space):
    best = 0
    for mask in range(1 << len(lengths)):
        total = sum(x for i, x in enumerate(lengths) if mask >> i & 1)
        best = max(best, total if total <= space else 0)
    return best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9), st.integers(0, 40))
def test_fullest_combination(lengths, space):
    counts = Counter(lengths)
    used = packing.fullest(sorted(counts.items(), reverse=True), space)
    assert all(n <= counts[x] for x, n in used.items())
    assert sum(x * n for x, n in used.items()) == naive_fullest(lengths, space)


def laid_out(slots):
    """Sequences with their (offset, length), and the numbers that each length used."""
    sequences, numbers = {}, {}
    for s in slots:
        for number in range(s.first, s.end):
            at = s.sequence + (number - s.first) // s.each
            sequences.setdefault(at, []).append((s.offset + (number - s.first) % s.each * s.length, s.length))
            numbers.setdefault(s.length, []).append(number)
    return sequences, numbers


def check_plan(slots, counts, capacity):
    sequences, numbers = laid_out(slots)
    assert {x: sorted(n) for x, n in numbers.items()} == {x: list(range(n)) for x, n in counts.items()}
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 37), max_size=80))
def test_minimum_bin_slack_plan(lengths):
    counts = Counter(lengths)
    sequences = check_plan(packing.minimum_bin_slack(counts, 37), counts, 37)
    assert len(sequences) <= 1 + 1.3 * sum(lengths) / 37 + sum(x > 18 for x in lengths)


def naive_best_fit(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fitting = [b for b in range(len(bins)) if capacity - bins[b] >= x]
        if fitting:
            bins[max(fitting, key=lambda b: bins[b])] += x
        else:
            bins.append(x)
    return sorted(bins)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 37), max_size=80))
def test_best_fit_decreasing_plan(lengths):
    counts = Counter(lengths)
    sequences = check_plan(token_output.best_fit_decreasing(counts, 37), counts, 37)
    assert sorted(sum(n for _, n in held) for held in sequences.values()) == naive_best_fit(lengths, 37)


def test_room_tree():
    rng, tree, there = random.Random(1), token_output.RoomTree(100), set()
    for _ in range(500):
        room = rng.randint(0, 100)
        there ^= {room}
        tree.set(room, room in there)
        wanted = rng.randint(0, 100)
        assert tree.least_from(wanted) == min((x for x in there if x >= wanted), default=None)


def check_pieces(rows, seq_len):
    """Pieces of a document follow each other, and those of a sequence leave no gap."""
    assert all(r.length <= seq_len for r in rows)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for segments in held.values():
        at = 0
        for offset, length in sorted(segments):
            assert offset == at
            at += length
        assert at <= seq_len
    return held


def test_packing_awkward_rows(awkward, nothing):
    rows = packing.pack(awkward, seq_len=64).collect()
    held = check_pieces(rows, 64)
    total = sum(len(ids_of(t or "")) + 1 for _, t, _ in AWKWARD)
    assert sum(r.length for r in rows) == total
    assert len(held) == -(-total // 64)
    texts = {i: np.array([*ids_of(t or ""), 0], "<u4") for i, t, _ in AWKWARD if i not in (None, 1)}
    for doc_id, ids in texts.items():
        mine = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert all(r.length == 64 for r in mine[1:])
        assert sum(r.length for r in mine) == len(ids)
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert packing.pack(nothing).isEmpty()


def test_id_matrix_round_trip(awkward, nothing):
    rows = token_output.matrix_rows(awkward, seq_len=64).collect()
    found = {}
    for r in rows:
        assert len(r.input_ids) == len(r.position_ids) == 128 and r.cu_seqlens[-1] == r.n_tokens
        positions = np.frombuffer(bytes(r.position_ids), "<u2")
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert list(positions[a:b]) == list(range(b - a))
        for doc_id, _, start, ids in token_output.segments(r):
            found.setdefault(doc_id, []).append((start, list(ids)))
    for doc_id, text, _ in AWKWARD:
        if doc_id not in (None, 1):
            assert sum((ids for _, ids in sorted(found[doc_id])), []) == [*ids_of(text or ""), 0]
    assert sum(len(ids) for x in (1, None) for _, ids in found[x]) == sum(len(ids_of(t or "")) + 1 for i, t, _ in AWKWARD if i in (1, None))
    assert token_output.matrix_rows(nothing).isEmpty()


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        import public_tokenizers

        bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_counts_at_every_prefix_equal_the_library():
    counts = bpe.prefix_counts(bpe.default_path())
    odd = next(c for c in map(chr, range(0x530, 0xD800)) if counts.vocab._is_odd(c))
    parts = ["the", " cat", "s", " ", "  ", "\n", "\n\n", "\t", "'", "'t", "'ll", "!!", "<|", "12", " é", "漢字", "😀", "=", "x" * 70, " " * 70, "=!" * 40]
    rng = random.Random(3)
    for k in range(150):
        pool = [*parts, *counts.vocab.specials, *([odd] if k % 5 == 0 else [])]
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        expected = [len(counts.vocab.library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert counts.at_every_prefix(text).tolist() == expected, text


def test_budgets_and_lengths_are_answered_from_the_table(spark, awkward, nothing, tmp_path):
    token_counts.prefix_table(awkward).write.parquet(str(tmp_path / "table"))
    table = spark.read.parquet(str(tmp_path / "table"))
    library = bpe.vocabulary(bpe.default_path()).library

    def tokens(text):
        return len(library.encode(text, add_special_tokens=False).ids)

    texts = [(i, t or "") for i, t, _ in AWKWARD]
    assert rows_of(table, "doc_id", "n_chars", "n_tokens") == rows_of(spark.createDataFrame([(i, len(t), tokens(t)) for i, t in texts], "a long, b long, c long"))
    short = [(i, t) for i, t in texts if len(t) < 200]
    expected = [(i, b, *max((n, tokens(t[:n])) for n in range(len(t) + 1) if tokens(t[:n]) <= max(0, b))) for i, t in short for b in (-1, 0, 3, 9, 1000)]
    got = token_counts.fit_budgets(table.where("n_chars < 200"), (-1, 0, 3, 9, 1000))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))
    cut = token_counts.count_prefixes(table, (0, 7, 29_000))
    assert sorted(map(str, map(tuple, cut.collect()))) == sorted(str((i, n, tokens(t[:n]))) for i, t in texts for n in (0, 7, 29_000))
    empty = token_counts.prefix_table(nothing)
    assert empty.isEmpty() and token_counts.fit_budgets(empty, (5,)).isEmpty() and token_counts.fit_budgets(table, ()).isEmpty()

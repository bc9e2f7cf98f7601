"""Token alignment against a plain alignment of whole texts, and the hash behind it."""

import hashlib
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerloom.llm import token_alignment
from ledgerloom.llm.bpe import _byte_letters
from ledgerloom.llm.perfect_hash import CountTable, PerfectHash, in_places

A_PATH, B_PATH = token_alignment.default_paths()


def plainly(texts):
    """Every contract column of each text, from the libraries' tokens and all pairs of ranges."""
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    letters = _byte_letters()
    found = []
    for text in texts:
        ids, spans = [], []
        if text:
            whole = (" " + text).encode()
            a_ids = a.encode(" " + text, add_special_tokens=False).ids
            b_ids = b.encode(text)
            a_bytes = [bytes(letters[c] for c in a.id_to_token(i)) for i in a_ids]
            b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
            if b"".join(a_bytes) == whole == b"".join(b_bytes):
                ids = a_ids, b_ids
                for tokens in (a_bytes, b_bytes):
                    ends = np.cumsum([len(t) for t in tokens]).tolist()
                    spans.append(list(zip([0, *ends], ends)))
        found.append((ids, spans))
    counts, links = Counter(), []
    for ids, spans in found:
        here = []
        if ids:
            j0 = 0
            for i, (s, e) in enumerate(spans[0]):
                while spans[1][j0][1] <= s:
                    j0 += 1
                j = j0
                while j < len(spans[1]) and spans[1][j][0] < e:
                    here.append((ids[0][i], ids[1][j]))
                    j += 1
        links.append(here)
        counts.update(here)
    highest = Counter()
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    rows = []
    for (ids, spans), here in zip(found, links):
        groups = []
        if ids:
            cuts = {e for _, e in spans[0]} & {e for _, e in spans[1]}
            sides = []
            for x, y in zip(ids, spans):
                sides.append([[]])
                for i, (_, e) in zip(x, y):
                    sides[-1][-1].append(str(i))
                    if e in cuts:
                        sides[-1].append([])
            groups = [",".join(p) + "|" + ",".join(q) for p, q in zip(*sides)][:-1]
        best = sum(counts[p] == highest[p[1]] for p in here)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        n_a, n_b = (len(x) for x in ids) if ids else (0, 0)
        rows.append((n_a, n_b, len(groups), len(here), best, sum(counts[p] for p in here), digest))
    return rows


def aligned(df, **kw):
    got = [tuple(r) for r in token_alignment.align(df, **kw).collect()]
    return sorted(got, key=str)


def odd_texts(n, seed):
    draw = random.Random(seed)
    bits = ["the", " and", " ", "  ", "\n", "\t ", ".", ",", "don't", " we'll", "é", "漢字", "😀", "▁", "\x85", "\x00", "　", "᠎", "ﬁ", "Å"]
    bits += ["<s>", "<0x41>", "<|endoftext|>", " 1234", " Wörter", "antidisestablishment", "\r\n\r\n", "x" * 70, " naïve"]
    return ["".join(draw.choice(bits) for _ in range(draw.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("most_broadcast", [1 << 20, 40, 0])
def test_odd_texts(spark, most_broadcast):
    texts = odd_texts(120, 3) + [None, "", " ", "\n", "a", "a", "same words again and again " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    expected = sorted(((i, *r) for i, r in enumerate(plainly(texts))), key=str)
    assert aligned(df, most_broadcast=most_broadcast) == expected
    assert sum(r[1] == 0 for r in expected) > 2 and sum(r[1] > 0 for r in expected) > 60


def test_given_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect()
    expected = sorted(((r.doc_id, *x) for r, x in zip(rows, plainly([r.text for r in rows]))), key=str)
    assert aligned(spark.createDataFrame(rows)) == expected


def test_memory_that_is_full_changes_nothing(spark, monkeypatch):
    texts = odd_texts(60, 4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    paths = token_alignment.default_paths()

    def rows(stretches, tallied, ahead):
        for name, value in (("STRETCHES", stretches), ("TALLIED", tallied), ("AHEAD", ahead)):
            monkeypatch.setattr(token_alignment, name, value)
        tallies, known = token_alignment._Tally(), token_alignment.Aligner(*paths)
        batch = df.toArrow().to_batches()[0]
        facts = []
        for _, start, end, held in token_alignment._texts(iter([batch]), known):
            flat, lengths = token_alignment._flat(held, known)
            each = np.repeat(np.bincount(flat, minlength=len(known.groups)), np.diff(known.ends))
            tallies.add(known.links[each > 0], each[each > 0])
            facts += [(len(x) if n else 0) for x, n in zip(held, lengths)]
        tallies.fold()
        return facts, tallies.keys[0].tolist(), tallies.times[0].tolist()

    assert rows(3, 10, 30) == rows(10_000, 10**6, 10**6)


def test_awkward_rows(spark, awkward, nothing):
    got = aligned(awkward)
    rows = awkward.select("doc_id", "text").collect()
    expected = sorted(((r.doc_id, *x) for r, x in zip(rows, plainly([r.text for r in rows]))), key=str)
    assert got == expected
    assert aligned(nothing) == []


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 5000):
        keys = np.unique(rng.integers(-(2**62), 2**62, n))
        hash_ = PerfectHash.from_bytes(PerfectHash.of(keys).to_bytes())
        assert sorted(hash_.places(keys).tolist()) == list(range(len(keys)))
        table = CountTable(hash_, in_places(hash_, keys), np.arange(len(keys)))
        others = np.setdiff1d(rng.integers(-(2**62), 2**62, 1000), keys)
        assert not table.find(others)[1].any() and table.find(keys)[1].all()


def test_perfect_hash_with_keys_left_over(monkeypatch):
    from ledgerloom.llm import perfect_hash

    monkeypatch.setattr(perfect_hash, "LEVELS", 1)
    keys = np.arange(1000) * 7
    hash_ = PerfectHash.from_bytes(PerfectHash.of(keys).to_bytes())
    assert len(hash_.rest) > 50 and sorted(hash_.places(keys).tolist()) == list(range(1000))
    assert (hash_.places(np.array([3, -5])) < hash_.size).all()


def test_shards_and_tree_of_many_branches(spark, monkeypatch):
    """Tallies of more branches than one node adds up."""
    texts = ["one two three", "two three four five", "five"] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(40)
    monkeypatch.setattr(token_alignment, "FAN", 2)
    assert aligned(df) == sorted(((i, *r) for i, r in enumerate(plainly(texts))), key=str)


def test_links_are_counted_without_aligning_again(monkeypatch):
    """The second pass needs what the first one wrote, and neither texts nor vocabularies."""
    texts = odd_texts(40, 5)
    part = SimpleNamespace(partitionId=lambda: 0)
    monkeypatch.setattr(token_alignment, "TaskContext", SimpleNamespace(get=lambda: part))
    batch = pa.RecordBatch.from_pydict({"doc_id": range(40), "text": texts})
    first = pa.Table.from_batches(token_alignment._linked((A_PATH, B_PATH))(iter([batch])))
    tallied, links = (first.filter(first[c].is_valid()) for c in ("shard", "row"))
    keys, counts = (np.concatenate([np.frombuffer(x, "<i8") for x in tallied[c].to_pylist()]) for c in ("keys", "counts"))
    highest = np.zeros(1 << 16, np.int64)
    np.maximum.at(highest, keys & 0xFFFFFFFF, counts)
    hash_ = PerfectHash.of(keys)
    by_place = np.zeros(len(keys), np.int64)
    by_place[hash_.places(keys)] = counts
    table = CountTable(hash_, in_places(hash_, keys), by_place)
    monkeypatch.setattr(token_alignment, "aligner", None)
    expected = [(i, r[3], r[4], r[5], r[6]) for i, r in enumerate(plainly(texts))]
    for at_once in (7, 1 << 20):
        monkeypatch.setattr(token_alignment, "LINKS", at_once)
        found = pa.Table.from_batches(token_alignment._looked_up(SimpleNamespace(value=(table, highest)))(iter(links.to_batches())))
        columns = (found[c].to_pylist() for c in ("doc_id", "n_links", "n_best", "count_sum", "groups_sha256"))
        assert list(zip(*columns)) == expected

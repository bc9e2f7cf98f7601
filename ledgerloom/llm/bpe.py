"""Byte-level BPE vocabularies: whole-text ids, and token counts at every prefix.

The vocabulary is a ``.json`` file of the ``tokenizers`` library, named by its
path; each Python worker reads it once.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex

#: Fixed value: how byte-level BPE cuts a text before any merge.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Counts that a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 300_000
#: Bytes. A longer run of letters, digits or signs is not remembered.
LONG_PIECE = 64
_NEVER = 1 << 60


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """A byte-level BPE vocabulary: tokens as bytes, merges, special strings."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain_specials = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
        if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or spec.get("normalizer") or not plain_specials:
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        letters = _byte_letters()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in self.specials}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        as_bytes = [tuple(bytes(letters[c] for c in part) for part in m) for m in merges]
        self.ranks = {pair: rank for rank, pair in enumerate(as_bytes)}
        #: The pair that makes each token, with its rank; single bytes have none.
        self.made_by = {a + b: (a, b, rank) for rank, (a, b) in reversed(list(enumerate(as_bytes)))}
        self.special_split = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.split = regex.compile(SPLIT)
        self.path, self._library, self.odd = path, None, {}
        # With ids in the order of the merges, ranks by id give the library's own
        # result, and tiktoken applies them several times faster.
        order = [self.ids.get(a + b) for a, b in self.ranks]
        self.fast = None
        if None not in order and order == sorted(set(order)):
            import tiktoken

            self.fast = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=self.ids, special_tokens=self.specials)

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def needs_library(self, text: str) -> bool:
        """Whether the text has a character that the library cuts by another Unicode version's rule."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return any(self._is_odd(c) for c in set(text))
        return False

    def _is_odd(self, letter: str) -> bool:
        if letter < "\u0530":
            return False
        if letter not in self.odd:
            probe = f"a{letter}a 1{letter}1 !{letter}! {letter} "
            theirs = [span for _, span in self.library.pre_tokenizer.pre_tokenize_str(probe)]
            mine = [m.span() for m in self.split.finditer(probe)]
            same = theirs == mine and (self.fast is None or list(self.fast.encode(probe)) == self.library.encode(probe, add_special_tokens=False).ids)
            self.odd[letter] = not same
        return self.odd[letter]

    def segments(self, text: str) -> list[str]:
        """The stretches between special strings, which the library matches first."""
        return self.special_split.split(text) if self.special_split else [text]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def text_ids(vocab: Vocabulary, text: str) -> np.ndarray:
    """The ids of a whole text, as the library gives them."""
    if vocab.fast is None or vocab.needs_library(text):
        return np.array(vocab.library.encode(text, add_special_tokens=False).ids, np.uint32)
    return vocab.fast.encode_to_numpy(text, allowed_special="all")


class PrefixCounts:
    """Exact token counts at every prefix, by dynamic programming.

    The encoding of a prefix ends in one token only: the one that starts where
    another prefix ends and whose boundary no merge would have crossed. So the
    last token and the count of a prefix follow from those of a shorter prefix.
    Runs that the vocabulary's cut keeps apart are independent of each other.
    """

    def __init__(self, path: str) -> None:
        self.vocab = vocabulary(path)
        lengths: dict[bytes, set[int]] = {}
        for token in self.vocab.ids:
            lengths.setdefault(token[-2:], {1}).add(len(token))
        #: By its last two bytes, how long the last token of a prefix may be.
        self.lengths = {last: sorted(x, reverse=True) for last, x in lengths.items()}
        self.left: dict[bytes, list[tuple[bytes, int]]] = {}
        self.right: dict[bytes, list[tuple[bytes, int]]] = {}
        self.whole: dict[bytes, bool] = {}
        self.stays: dict[tuple[bytes, bytes], bool] = {}
        self.prefixes: dict[bytes, tuple[int, bytes]] = {}
        self.remembered = _Remembered(self)
        self.inside: dict[tuple[str, str], list[int]] = {}

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The tokens at one end of ``token`` as it grows, each with the rank of the merge that takes it in."""
        known = (self.left, self.right)[side]
        if token not in known:
            steps, taken_at, part = [], _NEVER, token
            while True:
                steps.append((part, taken_at))
                if part not in self.vocab.made_by:
                    break
                a, b, taken_at = self.vocab.made_by[part]
                part = (a, b)[side]
            known[token] = steps[::-1]
        return known[token]

    def _crossing(self, a: bytes, b: bytes) -> tuple[bytes, bytes] | None:
        """The first pair that merges across the boundary of ``a`` and ``b``, if any does."""
        ends, starts = self._spine(a, 1), self._spine(b, 0)
        i = j = 0
        while True:
            (x, x_taken), (y, y_taken) = ends[i], starts[j]
            rank = self.vocab.ranks.get((x, y), _NEVER)
            # Equal ranks are the same pair twice: the one further left goes first.
            if rank < x_taken and rank <= y_taken and rank < _NEVER:
                return x, y
            if x_taken == _NEVER and y_taken == _NEVER:
                return None
            # A merge inside ``a`` lies further left than an equal one inside ``b``.
            if x_taken <= y_taken:
                i += 1
            else:
                j += 1

    def _is_whole(self, token: bytes) -> bool:
        """Whether the token's own bytes encode to the token."""
        known = self.whole.get(token)
        if known is None:
            if token not in self.vocab.made_by:
                known = True
            else:
                a, b, _ = self.vocab.made_by[token]
                known = self._crossing(a, b) == (a, b) and self._is_whole(a) and self._is_whole(b)
            self.whole[token] = known
        return known

    def _may_follow(self, a: bytes, b: bytes) -> bool:
        known = self.stays.get((a, b))
        if known is None:
            if len(self.stays) > 4 * REMEMBERED:
                self.stays.clear()
            known = self.stays[a, b] = self._crossing(a, b) is None
        return known

    def prefix(self, piece: bytes) -> tuple[int, bytes]:
        """Token count and last token of a run that may be the start of many.

        What shorter prefixes have is remembered, so runs share their beginnings.
        """
        known = self.prefixes.get(piece)
        if known is None:
            ids, end = self.vocab.ids, len(piece)
            for length in self.lengths.get(piece[-2:], (1,)):
                if length > end:
                    continue
                token = piece[end - length :]
                if token not in ids or not self._is_whole(token):
                    continue
                if length == end:
                    known = 1, token
                    break
                count, last = self.prefix(piece[: end - length])
                if self._may_follow(last, token):
                    known = count + 1, token
                    break
            if len(self.prefixes) >= 2 * REMEMBERED:
                self.prefixes.clear()
            self.prefixes[piece] = known
        return known

    def within_piece(self, piece: bytes) -> list[int]:
        """Token counts of all prefixes of one run, from 0 bytes to all of them.

        In time proportional to the run's length, however long it is.
        """
        counts, last = [0] * (len(piece) + 1), [b""] * (len(piece) + 1)
        ids = self.vocab.ids
        for end in range(1, len(piece) + 1):
            for length in self.lengths.get(piece[max(0, end - 2) : end], (1,)):
                start = end - length
                if start < 0:
                    continue
                token = piece[start:end]
                if token in ids and self._is_whole(token) and (not start or self._may_follow(last[start], token)):
                    last[end], counts[end] = token, counts[start] + 1
                    break
        return counts

    def count(self, text: str) -> int:
        """Tokens of a whole text; a special string inside it is one token."""
        if self.vocab.needs_library(text):
            return len(self.vocab.library.encode(text, add_special_tokens=False).ids)
        segments = self.vocab.segments(text)
        known, cut = self.remembered.__getitem__, self.vocab.split.findall
        return len(segments) - 1 + sum(sum(map(known, cut(s))) for s in segments)

    def longest_prefix(self, text: str, budget: int) -> int:
        """Code points of the longest prefix that encodes to at most ``budget`` tokens."""
        return self.count_and_fit(text, budget)[1]

    def count_and_fit(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of the whole text, and code points of its longest prefix of at most ``budget`` tokens.

        A special string is kept whole or left out. A text that only the library
        can cut is kept up to the end of its last token within the budget.
        """
        if self.vocab.needs_library(text):
            spans = self.vocab.library.encode(text, add_special_tokens=False).offsets
            return len(spans), len(text) if len(spans) <= budget else spans[budget - 1][1] if budget > 0 else 0
        known, cut = self.remembered.__getitem__, self.vocab.split.findall
        total = done = 0
        fit = None if budget > 0 else 0
        specials = self.vocab.special_split.findall(text) if self.vocab.special_split else []
        for k, segment in enumerate(self.vocab.segments(text)):
            if k:
                if fit is None and total + 1 > budget:
                    fit = done
                total, done = total + 1, done + len(specials[k - 1])
            pieces = cut(segment)
            counts = list(map(known, pieces))
            here = sum(counts)
            if fit is None and total + here > budget:
                ahead = np.cumsum([total, *counts])
                starts = np.cumsum([0, *map(len, pieces)])
                full = int(np.searchsorted(ahead, budget, "right")) - 1
                fit = done + self._inside(pieces, ahead, starts, full, budget)
            total, done = total + here, done + len(segment)
        return total, done if fit is None else fit

    def at_every_prefix(self, text: str) -> np.ndarray:
        """Token counts of ``text[:0]``, ``text[:1]`` and so on to the whole text.

        Each is what the library gives for that prefix alone. What a run adds at each of
        its own prefixes depends on it and on white space right before it, and is remembered.
        """
        odd = self.vocab.needs_library(text)
        cut = self._library_cut if odd else self.vocab.split.findall
        specials = self.vocab.special_split.findall(text) if self.vocab.special_split else []
        counts, total, last, ahead = [0], 0, "", 0
        for k, segment in enumerate(self.vocab.segments(text)):
            if k:
                # The beginning of a special string is plain text, cut together with what stands before it.
                counts += [ahead + self.count(last + specials[k - 1][:end]) for end in range(1, len(specials[k - 1]))]
                total += 1
                counts.append(total)
                last, ahead = "", total
            pieces, before = cut(segment), ""
            for i, piece in enumerate(pieces):
                key = before if before.isspace() and piece[0].isspace() else "", piece
                added = None if odd else self.inside.get(key)
                if added is None:
                    added = self._added(*key, cut)
                    if not odd and len(piece) <= LONG_PIECE:
                        if len(self.inside) >= REMEMBERED:
                            self.inside.clear()
                        self.inside[key] = added
                if i == len(pieces) - 2:
                    last, ahead = "", total
                if i >= len(pieces) - 2:
                    last, ahead = last + piece, ahead if last else total
                counts += [total + n for n in added]
                total, before = total + self.remembered[piece], piece
        return np.array(counts, np.int32)

    def _added(self, space: str, piece: str, cut) -> list[int]:
        """What the prefixes of a run, from one code point to all, add to the count before it."""
        long, known = self._long_run(piece), self.remembered.__getitem__
        held, found = (known(space) if space else 0), []
        for end in range(1, len(piece) + 1):
            tail = piece[:end] if long is None or end == 1 else ""
            if space and tail.isspace():
                # White space joins white space, as nothing follows.
                found.append(sum(map(known, cut(space + tail))) - held)
            else:
                # A long run is of one kind, so its prefixes are runs as well.
                found.append(sum(map(known, cut(tail))) if tail else long[end])
        return found

    def _library_cut(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.vocab.library.pre_tokenizer.pre_tokenize_str(text)]

    def _inside(self, pieces: list[str], ahead: np.ndarray, starts: np.ndarray, full: int, budget: int) -> int:
        """The longest prefix that ends in run ``full`` or just behind it."""
        for k in range(min(full + 1, len(pieces) - 1), full - 1, -1):
            piece = pieces[k]
            first = k - 1 if k and pieces[k - 1].isspace() else k
            long = self._long_run(piece)
            for end in range(len(piece) - (k > full), 0, -1):
                if long is not None and end > 1:
                    # A long run is of one kind, so its prefixes are runs as well.
                    if ahead[k] + long[end] <= budget:
                        return int(starts[k]) + end
                    continue
                tail = piece[:end]
                # White space before it joins a tail of white space, as nothing follows.
                start = first if tail.isspace() else k
                joined = "".join(pieces[start:k]) + tail
                if ahead[start] + sum(map(self.remembered.__getitem__, self.vocab.split.findall(joined))) <= budget:
                    return int(starts[k]) + end
        return int(starts[full])

    def _long_run(self, piece: str) -> list[int] | None:
        """Token counts of all prefixes of a run that is too long to be remembered, by code points."""
        run = piece.encode()
        if len(run) <= LONG_PIECE:
            return None
        counts, at, found = self.within_piece(run), 0, [0]
        for letter in piece:
            at += len(letter.encode())
            found.append(counts[at])
        return found


class _Remembered(dict):
    """Token counts of runs; what is missing is worked out."""

    def __init__(self, counts: PrefixCounts) -> None:
        self.counts = counts

    def __missing__(self, piece: str) -> int:
        run = piece.encode()
        if len(run) > LONG_PIECE:
            return self.counts.within_piece(run)[-1]
        found = self.counts.prefix(run)[0]
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = found
        return found


@lru_cache(maxsize=4)
def prefix_counts(path: str) -> PrefixCounts:
    return PrefixCounts(path)

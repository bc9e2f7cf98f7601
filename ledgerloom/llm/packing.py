"""Packing documents into as few sequences as possible by minimum bin slack.

Method: the longest piece left opens a sequence; a subset-sum dynamic program
over the lengths still available, a bitset with one bit per sum, finds the
fullest combination that joins it. That combination is taken as often as the
pieces last before the next one is sought, which is what taking it again and
again would give. Each step leaves some length with fewer pieces than the
combination has of it, so the steps are bounded by the sequence's length (about
capacity * ln(capacity)), however many documents there are.

Defined results: null text counts as empty, and an empty document is the single
id 0; repeated rows are packed each; equal lengths are interchangeable and taken
in the order in which they were written; an empty table gives an empty one; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame

from .pieces import Slot, cut, place


def fullest(available: list[tuple[int, int]], space: int) -> dict[int, int]:
    """How many pieces of each length make the largest sum up to ``space``.

    ``available`` has (length, pieces), longest first; longer pieces are preferred.
    """
    reach, steps, mask = 1, [], (1 << (space + 1)) - 1
    for length, pieces in available:
        if length > space:
            continue
        left, chunk = min(pieces, space // length), 1
        while left and not reach >> space:
            take = min(chunk, left)
            steps.append((length, take, reach))
            reach |= (reach << take * length) & mask
            left, chunk = left - take, chunk * 2
        if reach >> space:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= take * length
    return used


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[Slot]:
    """A place for every piece, given how many there are of each length."""
    left = {length: n for length, n in counts.items() if n}
    order = sorted(left)
    taken = dict.fromkeys(left, 0)
    slots, sequence = [], 0
    while order:
        longest = order[-1]
        space = capacity - longest
        fitting = order[: bisect_right(order, space)]
        available = [(x, left[x] - (x == longest)) for x in reversed(fitting)]
        group = fullest([x for x in available if x[1]], space)
        group[longest] = group.get(longest, 0) + 1
        times = min(left[x] // n for x, n in group.items())
        offset = 0
        for length, n in sorted(group.items(), reverse=True):
            slots.append(Slot(length, taken[length], taken[length] + times * n, sequence, n, offset))
            taken[length] += times * n
            left[length] -= times * n
            offset += n * length
            if not left[length]:
                order.remove(length)
        sequence += times
    return slots


def pack(docs: DataFrame, seq_len: int = 2048, vocabulary: str | None = None, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents over ``seq_len`` are cut. ``with_ids`` adds each piece's ids.
    """
    pieces = cut(docs, seq_len, vocabulary, id_column, text_column, with_ids)
    return place(pieces, lambda counts: minimum_bin_slack(counts, seq_len))

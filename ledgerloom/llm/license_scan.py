"""Licence notices in documents, found paragraph by paragraph.

Method: a softmax regression over sparse word n-grams (one to three words, those
of the templates) tells licence families from ``unknown``. It is trained here: on
the templates whole, cut, with words lost and set among words of the corpus, and
on paragraphs of a bounded sample of documents that resemble no template. A
temperature and the probability from which a family is believed are set on rows
held out from training. A believed family is confirmed by comparing the paragraph
with the family's templates: it must hold most of the word pairs of one of them. Notices
that are wrapped are looked for in runs of adjacent lines with words: a stretch of
lines that together hold most of a template's pairs, within twice the template's
length, is judged like a paragraph.

A document is read whole, alone and in place; nothing is shuffled. The sample of
documents, fixed in size, is the only thing that reaches the driver: of two lines
from anywhere in each, read at full length, their n-grams and some of their words.

Defined results: a paragraph is a line with a word; a wrapped notice counts at its
first line, and its lines by themselves no more; null and empty texts have
none, and no licence; repeated rows come out each; among equally probable
families the first by name counts; an empty table gives an empty one; other
columns are not read.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, bounded_sample, empty_if_null, rows_of

UNKNOWN = "unknown"

# How the notices of well-known licences are worded.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-SA 3.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work, CC0 1.0 Universal public domain dedication.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright (c) 2020 by the authors. All rights reserved.",
        "No part of this publication may be reproduced or distributed in any form without the prior written permission of the publisher.",
    ),
}
#: Paragraphs that share words with notices and are none.
DECOYS = (
    "His driving license was taken away for a year.",
    "The general public was not let into the version of the work that was shown.",
    "All the rights of the people were reserved for a later version of the law.",
    "You may use this road under the terms of the city.",
    "The software of the library is in the public domain of common knowledge, creative and free.",
    "They were released under the bridge and all seats were reserved.",
    "The foundation published a copy of the work with permission of the author.",
)

#: Documents from which ordinary paragraphs are taken, and paragraphs of them.
SAMPLE, PARAGRAPHS = 2000, 4000
#: Word pairs of a template that a paragraph must hold to be confirmed.
HELD = 0.6
VARIANTS, STEPS, PENALTY = 60, 400, 1e-4

_WORD = re.compile(r"[a-z]+|[0-9]+")


def words_of(paragraph: str) -> list[str]:
    """Words in lower case, numbers as 0."""
    return ["0" if w[0].isdigit() else w for w in _WORD.findall(paragraph.lower())]


#: Words that open a comment line; other comment signs are no words.
_COMMENT = re.compile(r"\s*(?:rem|dnl)\s", re.IGNORECASE)


def _pairs(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:])) or {(w, "") for w in words}


_TEMPLATE_WORDS = [(family, words_of(t)) for family, ts in TEMPLATES.items() for t in ts]
_TEMPLATE_PAIRS = [(family, _pairs(w)) for family, w in _TEMPLATE_WORDS]
_FAMILIES = [*sorted(TEMPLATES), UNKNOWN]
#: The templates, by number, that have a pair of words.
_TEMPLATES_OF: dict[tuple[str, str], list[int]] = {}
for _number, (_, _own) in enumerate(_TEMPLATE_PAIRS):
    for _pair in sorted(_own):
        _TEMPLATES_OF.setdefault(_pair, []).append(_number)
#: n-grams of the templates by number; a text's other words make one more feature.
_GRAMS = {g: i for i, g in enumerate(sorted({tuple(w[i : i + n]) for _, w in _TEMPLATE_WORDS for n in (1, 2, 3) for i in range(len(w) - n + 1)}))}
_KNOWN = {g[0] for g in _GRAMS if len(g) == 1}


def held(words: list[str], family: str | None = None) -> float:
    """The largest share of a template's word pairs that a paragraph holds."""
    own = _pairs(words)
    return max((len(own & pairs) / len(pairs) for f, pairs in _TEMPLATE_PAIRS if family in (None, f)), default=0.0)


def features(words: list[str]) -> list[int]:
    """The numbers of the n-grams that occur."""
    found = set()
    for i, w in enumerate(words):
        if w in _KNOWN:
            found.add(_GRAMS[(w,)])
            two = _GRAMS.get((w, *words[i + 1 : i + 2]))
            if two is not None and i + 1 < len(words):
                found.add(two)
                three = _GRAMS.get((w, *words[i + 1 : i + 3]))
                if three is not None and i + 2 < len(words):
                    found.add(three)
    return sorted(found)


class Model(NamedTuple):
    """Weights by family and n-gram, biases, temperature, and the probability to believe."""

    weights: np.ndarray
    biases: np.ndarray
    temperature: float
    believed: float

    def probabilities(self, found: list[int]) -> np.ndarray:
        logits = (self.biases + self.weights[:, found].sum(axis=1)) / self.temperature
        chances = np.exp(logits - logits.max())
        return chances / chances.sum()


class Ordinary(NamedTuple):
    """An ordinary paragraph: the numbers of its n-grams, and some of its words."""

    found: list[int]
    words: list[str]


def _looked_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document, what :class:`Ordinary` has of two lines from anywhere in it, if they are like no template."""
    kind = pa.list_(pa.struct([("found", pa.list_(pa.int64())), ("words", pa.list_(pa.string()))]))

    def rows() -> Iterator[tuple]:
        for id_, text in rows_of(batches, "id", "text"):
            lines = [line for line in text.split("\n") if line]
            rng, out = random.Random(str(id_)), []
            for line in rng.sample(lines, min(2, len(lines))):
                words = words_of(line)
                if words and held(words) < 0.3:
                    # Words that no template has are all alike to the model.
                    some = ["" if w not in _KNOWN else w for w in words[:: -(-len(words) // 80)]]
                    out.append({"found": features(words), "words": some})
            yield id_, out

    return batches_of(rows(), pa.schema([("id", pa.int64()), ("lines", kind)]))


def _ordinary(docs: DataFrame, sample: int, id_column: str, text_column: str) -> list[Ordinary]:
    """Paragraphs like no template, from the documents with the smallest id hashes."""
    chosen = docs.select(F.col(id_column).cast("long").alias("id"), empty_if_null(F.col(text_column)).alias("text"))
    # A cut by hash first, wider than the sample, so that few texts are looked at.
    share = min(1.0, 4 * sample / max(1, chosen.count()))
    few = chosen.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) <= F.lit(int(share * (1 << 40))))
    seen = few.mapInArrow(_looked_at, "id long, lines array<struct<found:array<long>,words:array<string>>>")
    rows = bounded_sample(seen, "id", sample).collect()
    return [Ordinary(list(x["found"]), list(x["words"])) for r in rows for x in r["lines"]][:PARAGRAPHS]


def _examples(ordinary: list[Ordinary], seed: int) -> tuple[list[list[int]], np.ndarray]:
    """Feature lists and family numbers, of templates varied and of ordinary paragraphs."""
    rng = random.Random(seed)
    among = [w for p in ordinary for w in p.words] or ["a"]
    rows, families = [], []
    for family, words in _TEMPLATE_WORDS:
        for _ in range(VARIANTS):
            kept = [w for w in words if rng.random() > rng.choice((0, 0, 0.1, 0.2))] or words
            if len(kept) > 12 and rng.random() < 0.3:
                kept = kept[: len(kept) * 2 // 3]
            before = [rng.choice(among) for _ in range(rng.choice((0, 0, 3, 30)))]
            after = [rng.choice(among) for _ in range(rng.choice((0, 0, 3, 30)))]
            rows.append(features(before + kept + after))
            families.append(_FAMILIES.index(family))
    for _ in range(VARIANTS * len(_TEMPLATE_WORDS) // 2):
        # Words of templates in no order are no notice.
        loose = rng.sample(sorted(_KNOWN), rng.randint(1, 6)) + [rng.choice(among) for _ in range(rng.randint(0, 20))]
        rng.shuffle(loose)
        rows.append(features(loose))
        families.append(len(_FAMILIES) - 1)
    for p in [*(x.found for x in ordinary), *([features(words_of(d)) for d in DECOYS] * 10), []]:
        rows.append(p)
        families.append(len(_FAMILIES) - 1)
    return rows, np.array(families)


def fit(docs: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text") -> Model:
    ordinary = _ordinary(docs, sample, id_column, text_column)
    model = _trained(*_examples(ordinary[::2], seed=1))
    return _calibrated(model, *_examples(ordinary[1::2], seed=2))


def _trained(rows: list[list[int]], families: np.ndarray) -> Model:
    """Softmax regression by gradient steps of adapted length, with a penalty on squares."""
    k, n = len(_FAMILIES), len(rows)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    column = np.array([i for r in rows for i in r], np.int64)
    truth = np.eye(k)[families]
    state = np.zeros((k, len(_GRAMS) + 1))
    mean, square = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, STEPS + 1):
        logits = np.stack([np.bincount(row, weights=w[column], minlength=n) + b for w, b in zip(state[:, :-1], state[:, -1])], axis=1)
        chances = np.exp(logits - logits.max(axis=1, keepdims=True))
        error = (truth - chances / chances.sum(axis=1, keepdims=True)) / n
        grad = np.stack([np.append(np.bincount(column, weights=e[row], minlength=len(_GRAMS)), e.sum()) for e in error.T])
        grad[:, :-1] -= PENALTY * state[:, :-1]
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        state += 0.1 * (1 - step / (STEPS + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Model(state[:, :-1], state[:, -1], 1.0, 0.5)


def _calibrated(model: Model, rows: list[list[int]], families: np.ndarray) -> Model:
    """The temperature most likely on rows held out, and a belief that hardly any ordinary one reaches."""

    def loss(temperature: float) -> float:
        at = model._replace(temperature=temperature)
        return -sum(math.log(max(at.probabilities(r)[f], 1e-12)) for r, f in zip(rows, families))

    model = model._replace(temperature=min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss))
    ordinary = sorted((1 - model.probabilities(r)[-1] for r, f in zip(rows, families) if f == len(_FAMILIES) - 1), reverse=True)
    return model._replace(believed=min(0.9, max(0.5, ordinary[len(ordinary) // 100])))


class Notice(NamedTuple):
    paragraph: int
    start: int
    family: str
    probability: float
    confirmed: bool


def _judged(model: Model, words: list[str], paragraph: int, start: int) -> Notice | None:
    """A paragraph's notice, if the model believes one."""
    hits = features(words)
    if hits:
        chances = model.probabilities(hits)
        family = int(chances[:-1].argmax())
        if 1 - chances[-1] >= model.believed:
            name = _FAMILIES[family]
            return Notice(paragraph, start, name, float(chances[family]), held(words, name) >= HELD)
    return None


class _Line(NamedTuple):
    paragraph: int
    start: int
    words: list[str]
    #: Whether the line is a confirmed notice by itself.
    sure: bool


def _wrapped(model: Model, run: list[_Line]) -> list[tuple[Notice, int]]:
    """Confirmed notices that take several lines of a run, each with its last paragraph."""
    words = [w for line in run for w in line.words]
    at = [i for i, line in enumerate(run) for _ in line.words]
    hits: dict[int, list[tuple[int, tuple[str, str]]]] = {}
    for i, pair in enumerate(zip(words, words[1:])):
        for number in _TEMPLATES_OF.get(pair, ()):
            hits.setdefault(number, []).append((i, pair))
    stretches = set()
    for number, places in hits.items():
        pairs, reach = len(_TEMPLATE_PAIRS[number][1]), 2 * len(_TEMPLATE_WORDS[number][1])
        if len(places) < HELD * pairs:
            continue
        inside: Counter = Counter()
        first, best = 0, (0, 0, 0, 0)
        for last, (i, pair) in enumerate(places):
            inside[pair] += 1
            while i - places[first][0] > reach or inside[places[first][1]] > 1:
                inside[places[first][1]] -= 1
                if not inside[places[first][1]]:
                    del inside[places[first][1]]
                first += 1
            if len(inside) >= HELD * pairs:
                # Of stretches that overlap, the one that holds most.
                if best[0] and places[first][0] > best[3]:
                    stretches.add((best[0] / pairs, best[2], best[3]))
                    best = (0, 0, 0, 0)
                best = max(best, (len(inside), places[first][0] - i, places[first][0], i + 1))
        if best[0]:
            stretches.add((best[0] / pairs, best[2], best[3]))
    found, taken = [], {i for i, line in enumerate(run) if line.sure}
    for _, first, last in sorted(stretches, key=lambda x: (-x[0], x[1], x[2])):
        lines = range(at[first], at[last] + 1)
        if len(lines) > 1 and taken.isdisjoint(lines):
            notice = _judged(model, words[first : last + 1], run[lines[0]].paragraph, run[lines[0]].start)
            if notice and notice.confirmed:
                found.append((notice, run[lines[-1]].paragraph))
                taken.update(lines)
    return found


def notices(model: Model, text: str) -> tuple[int, list[Notice]]:
    """Paragraphs of a text, and those that look like a licence notice."""
    found, count, start = [], 0, 0
    run: list[_Line] = []
    spans: list[tuple[Notice, int]] = []
    for line in text.split("\n"):
        words = words_of(_COMMENT.sub("", line, count=1) if _COMMENT.match(line) else line)
        if words or line.strip():
            notice = _judged(model, words, count, start)
            if notice:
                found.append(notice)
        if words:
            run.append(_Line(count, start, words, bool(notice and notice.confirmed)))
        elif run:
            spans += _wrapped(model, run) if len(run) > 1 else []
            run = []
        count += bool(words or line.strip())
        start += len(line) + 1
    spans += _wrapped(model, run) if len(run) > 1 else []
    if spans:
        inside = {p for x, last in spans for p in range(x.paragraph, last + 1)}
        found = sorted([x for x in found if x.paragraph not in inside] + [x for x, _ in spans], key=lambda x: x.paragraph)
    return count, found


_DDL = "doc_id long, n_paragraphs long, license string, probability double, families array<string>, paragraphs array<long>, starts array<long>, n_unconfirmed long"
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_paragraphs", pa.int64()), ("license", pa.string()), ("probability", pa.float64()),
     ("families", pa.list_(pa.string())), ("paragraphs", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("n_unconfirmed", pa.int64())]
)


def scan(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its most probable confirmed family, if any, and every confirmed paragraph.

    ``families``, ``paragraphs`` (numbers from 0) and ``starts`` (code points
    before it) have an entry for each confirmed paragraph, in text order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                count, found = notices(model, text)
                sure = [x for x in found if x.confirmed]
                best = min(sure, key=lambda x: (-x.probability, x.family), default=None)
                yield (
                    doc_id, count, best and best.family, best and best.probability, [x.family for x in sure],
                    [x.paragraph for x in sure], [x.start for x in sure], len(found) - len(sure),
                )

        return batches_of(rows(), _SCHEMA)

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), empty_if_null(F.col(text_column)).alias("text"))
    return texts.mapInArrow(run, _DDL)

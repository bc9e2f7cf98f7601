"""Mixing, licence notices, HTML extraction, the quality model and the pipeline."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from ledgerloom.llm import html_extract, license_scan, mixing, quality
from llm.conftest import AWKWARD

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "sizes, expected",
    [
        ({"a": 100, "b": 100, None: 100}, {"a": 50, "b": 100, None: 150}),
        ({"a": 10, "b": 1000, "c": 1000}, {"a": 30, "b": 792, "c": 1188}),
        ({"a": 0, "b": 0}, {"a": 0, "b": 0}),
        ({}, {}),
    ],
)
def test_targets(sizes, expected):
    weights = {s: 1.0 + i % 3 for i, s in enumerate(mixing.in_order(list(sizes)))}
    assert {s: round(t, 6) for s, t in mixing.targets(sizes, weights).items()} == expected


def test_sources_are_ordered_by_code_point():
    assert mixing.in_order(["b", None, "é", "B", "😀", "￿"]) == ["B", "b", "é", "￿", "😀", None]


def test_mix_meets_its_targets_and_repeats(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    sources = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    taken, wanted, size = Counter(), {}, Counter()
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[sources[r.doc_id]] += r.taken
        size[sources[r.doc_id]] += r.size
        wanted[sources[r.doc_id]] = (r.target, r.source_size)
    assert {s: w[1] for s, w in wanted.items()} == size
    for s, (target, _) in wanted.items():
        assert abs(taken[s] - target) <= 0.005 * target
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(3)).collect())


def test_rates_are_exponential_tilts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("source = 'src2' OR source = 'src0'")
    rows = mixing.mix(docs, weights={"src0": 1.0, "src2": 2.0}).collect()
    import math

    for total in {r.source_size for r in rows}:
        slopes = [math.log(r.rate) / r.size for r in rows if r.source_size == total and r.rate < 3]
        assert max(slopes) - min(slopes) < 1e-9
        words = sum(r.rate * r.size for r in rows if r.source_size == total)
        assert abs(words - next(r.target for r in rows if r.source_size == total)) < 0.01


def test_mixing_awkward_rows(awkward, nothing):
    rows = mixing.mix(awkward).collect()
    sizes = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _ in AWKWARD]
    assert Counter((r.doc_id, r.size) for r in rows) == Counter(sizes)
    assert all(r.taken == 0 for r in rows if not r.size)
    taken = mixing.take(awkward)
    assert taken.columns == awkward.columns
    assert taken.count() == sum(r.copies for r in rows)
    assert mixing.mix(nothing).isEmpty() and mixing.take(nothing).isEmpty()


PATTERNS = {"cc": "Licensed under CC BY", "gpl": "GNU General Public", "apache": "Apache License", "mit": "MIT License", "proprietary": "All rights reserved"}


def test_licence_lines_of_a_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = license_scan.scan(docs, license_scan.fit(docs)).collect()
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        lines = texts[r.doc_id].split("\n")
        expected = [f for line in lines for f, p in PATTERNS.items() if p in line]
        assert r.families == expected
        assert r.n_paragraphs == sum(bool(line.strip()) for line in lines)
        for start, family in zip(r.starts, r.families):
            assert PATTERNS[family] in texts[r.doc_id][start:].split("\n")[0]


def test_held_out_notices(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = license_scan.fit(docs)
    rng, words = random.Random(9), "stone river under a tall grey sky while birds were calling".split()
    right = 0
    for family, templates in license_scan.TEMPLATES.items():
        for t in templates:
            for _ in range(20):
                kept = [w for w in t.split() if rng.random() > 0.08]
                _, found = license_scan.notices(model, " ".join(rng.choices(words, k=4) + kept + rng.choices(words, k=4)))
                right += bool(found) and found[0].family == family
    assert right >= 0.95 * 20 * sum(map(len, license_scan.TEMPLATES.values()))
    for text in license_scan.DECOYS:
        assert not [x for x in license_scan.notices(model, text)[1] if x.confirmed]


WRAPPED = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""",
    "bsd": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:""",
    "gpl": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
}


@pytest.mark.parametrize("sign", ["", "# ", " * ", "// ", "dnl "])
def test_wrapped_notices(spark, sign):
    if not hasattr(test_wrapped_notices, "model"):
        test_wrapped_notices.model = license_scan.fit(spark.read.parquet(f"{SMALL}/documents.parquet"))
    for family, text in WRAPPED.items():
        before = "The river was low that year.\nNobody went to the mill.\n\n"
        whole = before + "\n".join(sign + line for line in text.split("\n")) + "\n\nThe end of it."
        sure = [x for x in license_scan.notices(test_wrapped_notices.model, whole)[1] if x.confirmed]
        assert [(x.family, x.paragraph, x.start) for x in sure] == [(family, 2, len(before))]


def test_ordinary_lines_come_from_anywhere_at_full_length(spark):
    long = "so " * 300 + "the license of the software"
    docs = spark.createDataFrame([(i, "one\ntwo\n" + "\n".join([long] * 6)) for i in range(30)], "doc_id long, text string")
    found = license_scan._ordinary(docs, 100, "doc_id", "text")
    assert len(found) == 60 and license_scan.features(license_scan.words_of(long)) in [x.found for x in found]


def test_licences_of_awkward_rows(awkward, nothing):
    rows = license_scan.scan(awkward, license_scan.fit(awkward)).collect()
    assert len(rows) == len(AWKWARD) and all(r.license is None for r in rows)
    assert license_scan.scan(nothing, license_scan.fit(nothing)).isEmpty()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site for you.</div>
<div class="ad">Buy the best of all that there is in the city.</div>
<article><h1>The title &amp; more</h1><p>First   paragraph of the text, in\nwhich the words are those of a story that goes on for a while.<br>And on.</p>
<aside>See also the other news of the day.</aside><p>Short.</p><blockquote>caf&eacute;&nbsp;&lt;b&gt;</blockquote>
<form><label>Your name is here</label><button>Send</button></form><p>The last one of them, as it was in the <a href="#">beginning</a>.</p></article>
<section id="comments"><article class="comment"><p>I think that this is the best of all the stories that I have read.</p></article></section>
<footer>&copy; the site</footer></body></html>"""
TEXT = (
    "The title & more First paragraph of the text, in which the words are those of a story that goes on for a while. And on."
    " Short. café <b> The last one of them, as it was in the beginning."
)


def test_main_text():
    assert html_extract.main_text(PAGE) == TEXT
    assert html_extract.main_text(PAGE[: PAGE.index("<form>")] + "<p cla") == TEXT[: TEXT.index(" The last")]


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a</p><p>b</p>", "a b"), ("<p>a<!-- b", "a"),
        ("<script>x</script>", ""), ("<script>x", ""), ("x < y and 3 <4", "x < y and 3 <4"), ("<p title='a>b'>c</p>", "c"),
        ("&amp;lt; &#65;&#x42;", "&lt; AB"), ("<nav>menu<nav>deep</nav>menu</nav>", ""),
    ],
)
def test_small_pages(page, text):
    if "nav" in (page or ""):
        assert html_extract.main_text(page + "<p>The text of the page, which is the only one that there is on it.</p>").startswith("The text")
    else:
        assert html_extract.main_text(page) == text


def test_pages_without_an_article_element():
    good = "This is one of the paragraphs of the page, and it is long enough for the rules to take it as a part of the text that they look for."
    links = "".join(f'<li><a href="/{i}">The story of number {i}</a></li>' for i in range(8))
    page = f"<body><div><ul>{links}</ul></div><div><h2>A title</h2><p>{good}</p><p>Short one.</p><p>{good}</p></div><div><ul>{links}</ul></div>"
    assert html_extract.main_text(page) == f"A title {good} Short one. {good}"


@pytest.mark.parametrize(
    "good",
    [
        "Река берёт начало в горах к северу от города и течёт через широкую долину, где весной цветут сады, а осенью собирают виноград; местные жители ловят рыбу. Дорога идёт вдоль берега.",
        "这条河发源于城市北部的山区,流经宽阔的山谷。" * 9,
        "Iron 7.9 g/cm3, copper 8.96 g/cm3, zinc 7.1 g/cm3, tin 7.3 g/cm3, lead 11.3 g/cm3, silver 10.5 g/cm3, gold 19.3 g/cm3, nickel 8.9 g/cm3, cobalt 8.9 g/cm3.",
    ],
)
def test_pages_without_stop_words_or_an_article_element(good):
    links = "".join(f'<li><a href="/{i}">Раздел {i}</a></li>' for i in range(8))
    page = f"<body><nav><ul>{links}</ul></nav><div><h2>T</h2><p>{good}</p><p>Да.</p><p>{good}</p></div><ul>{links}</ul><footer><p>{good}</p></footer>"
    assert html_extract.main_text(page) == f"T {good} Да. {good}"
    assert html_extract.main_text(f"<nav>{links}</nav><p>Да.</p><footer>{links}</footer>") == "Да."


def test_names_made_from_titles():
    part = "This is one of the paragraphs of the page, and it is long enough for the rules to take it as a part of the text that they look for."
    sections = (
        f'<h2 id="the-search-for-life">The search</h2><p>{part}</p><section id="discussion"><h2 id="discussion-1">Discussion</h2><p>{part}</p></section>'
        f'<section id="form-and-function"><p>{part}</p></section><div class="section" id="related"><p>{part}</p></div><div id="notice-of-death"><p>{part}</p></div>'
    )
    around = f'<div class="share-buttons"><p>{part}</p></div><div class="related-posts"><p>{part}</p></div><div class="comments"><p>{part}</p></div>'
    text = f"The search {part} Discussion {part} {part} {part} {part}"
    assert html_extract.main_text(f"<article>{sections}{around}</article>") == text
    assert html_extract.main_text(f'<article class="post tag-search" id="ad-astra">{sections}{around}</article>') == text
    page = f'<div><h2 id="the-search-for-life">The search</h2><p>{part}</p><section id="form-and-function"><p>{part}</p></section>{around}</div>'
    assert html_extract.main_text(f'{page}<section id="comments"><p>{part}</p></section>') == f"The search {part} {part}"


def test_articles_of_a_corpus(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    import html

    pages_by = {r.page_id: r.html for r in pages.collect()}
    rows = html_extract.extract(pages).collect()
    assert len(rows) == len(pages_by)
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|$)", pages_by[r.page_id], re.DOTALL)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*(>|$)", " ", inner)).split())
        assert r.n_chars == len(r.text)
    assert html_extract.extract(pages.where("false")).isEmpty()


def test_awkward_pages(spark):
    rows = [(1, "u", None, 5), (1, "u", None, 5), (None, None, "<p>x</p>", 6), (2, "v", "<p>" * 50_000 + "deep", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    assert Counter(map(tuple, html_extract.extract(pages).collect())) == Counter(
        [(1, "u", "", 0), (1, "u", "", 0), (None, None, "x", 1), (2, "v", "deep", 4)]
    )


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("doc_id < 4000")
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    assert list(model.thresholds) == sorted(model.thresholds)
    graded = {r.doc_id: r for r in quality.grade_documents(docs, model).collect()}
    held_out = [r for r in labels.where("doc_id % 2 = 1").collect() if r.doc_id in graded]
    right = sum(graded[r.doc_id].kept == (r.quality == 1) for r in held_out)
    assert right >= 0.97 * len(held_out)
    clean = [r for r in held_out if r.quality == 1 and r.toxic == 0]
    assert sum(graded[r.doc_id].kept for r in clean) >= 0.99 * len(clean)
    mean = lambda rows: sum(graded[r.doc_id].expected_grade for r in rows) / len(rows)
    toxic = [r for r in held_out if r.quality == 1 and r.toxic == 1]
    assert mean([r for r in held_out if r.quality == 0]) < mean(toxic) < mean(clean)


def test_shapes_are_of_whole_words():
    assert quality.shape("x" * 100 + "42/Y") == "a9/A"


def test_quality_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 0), (2, 1, None), (None, 1, 0), (99, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int"
    )
    model = quality.fit(awkward, labels)
    rows = quality.grade_documents(awkward, model).collect()
    assert len(rows) == len(AWKWARD)
    assert all(0 <= r.p_at_least_2 <= r.p_at_least_1 <= 1 for r in rows)
    kept = quality.select_documents(awkward, model)
    assert kept.columns == awkward.columns and kept.count() == sum(r.kept for r in rows)
    unlabelled = quality.fit(awkward, labels.where("false"))
    assert quality.select_documents(awkward, unlabelled).count() == len(AWKWARD)
    assert quality.grade_documents(nothing, model).isEmpty()


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before, ids = docs, {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "exact_dedup", "minhash_near_dedup", "source_mixing", "best_fit_packing",
    ]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SMALL).cache()
        assert after.schema.names == docs.schema.names, name
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        assert kept < ids, name
        if name != "source_mixing":
            assert after.count() == len(kept)
        before, ids = after, kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, SMALL).collect()
    assert {r.doc_id for r in pieces} == ids
    assert sum(r.piece == 0 for r in pieces) == before.count()


def test_stages_on_awkward_rows(spark, awkward, nothing):
    before = awkward
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SMALL)
        assert after.columns == awkward.columns
        assert stage(spark, nothing, SMALL).isEmpty()
        before = after
    assert corpus_pipeline.STAGES[-1][1](spark, nothing, SMALL).isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, before, SMALL).count() > 0

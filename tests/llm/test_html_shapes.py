"""Pages made up of every container shape and every kind of boilerplate; the text to find is known."""

import itertools
import random
import time

import pytest

from ledgerloom.llm.html_extract import main_text

WORDS = "the mill of a town was in use for years and it is still there when they come to see what was built by the people who lived there".split()

CONTAINERS = [
    "<article>{}</article>", "<main>{}</main>", "<div class='post-content'>{}</div>", "<div class='text'>{}</div>", "<div id='content'>{}</div>",
    "<div role='main'>{}</div>", "<form id='aspnetForm' action='x'>{}</form>", "<div class='sidebar-left-layout'>{}</div>",
    "<div class='job-search-tips'>{}</div>", "<div class='wrapper comments-open'><article class='post has-comments'>{}</article></div>",
    "<article class='card'><p>Another page in a line.</p></article><div class='text'>{}</div>", "<table><tr><td>{}</td></tr></table>",
    "<form id='f'><div class='header-search-page'><main>{}</main></div></form>",
]
INSIDE = (
    "article-comments reader-comments user-comments post-comments entry-comments usercomments disqus_thread comment-body comment-content gpt-ad google-ads"
    " story-ad in-article-ad article-ad sponsored-content related-stories post-footer article-footer entry-meta share-this comments ad share-buttons"
).split()
OUTSIDE = [
    "<nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>News of the day</a></li></ul></nav>", "<header><h1>The Site</h1></header>",
    "<footer><p>All of this is ours and you may not take it, for it was made by us.</p></footer>", "<aside><p>{}</p></aside>",
    "<div class='cookie-banner'><p>{}</p></div>", "<div id='comments'><ol><li><article class='comment'><p>{}</p></article></li></ol></div>",
    "<form><label>Your name</label><input></form>", "<script>var a = '<p>no</p>';</script><style>p {{}}</style>",
]


def sentence(draw, n):
    words = [draw.choice(WORDS) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def page(draw, container, inside):
    paragraphs = [sentence(draw, draw.choice([30, 45, 60])) for _ in range(draw.randint(4, 7))]
    paragraphs[draw.randrange(1, len(paragraphs) - 1)] = sentence(draw, 5)
    noise = sentence(draw, 30)
    blocks = [f"<p>{p}</p>" for p in paragraphs]
    if inside:
        blocks.insert(draw.randrange(1, len(blocks) + 1), f"<div class='{inside}'><p>{noise}</p></div>")
    body = container.format("\n".join(blocks))
    before, after = (draw.sample(OUTSIDE, 3) for _ in range(2))
    fill = lambda xs: "".join(x.format(noise) for x in xs)
    return f"<html><head><title>t</title></head><body>{fill(before)}{body}{fill(after)}</body></html>", " ".join(paragraphs)


@pytest.mark.parametrize("container", CONTAINERS)
def test_every_container_with_every_boilerplate(container):
    draw = random.Random(container)
    for inside, _ in itertools.product([None, *INSIDE], range(3)):
        html, text = page(draw, container, inside)
        assert main_text(html) == text, (inside, html)


def test_titles_made_into_ids_mark_nothing():
    p = " ".join(WORDS * 2)
    body = f"<p>{p}</p><h2 id='related-work'>Related work</h2><p>{p}</p><section id='share-of-wind'><p>{p}</p></section><h2><span id='comments'>Comments</span></h2><p>{p}</p>"
    assert main_text(f"<article>{body}</article>").count(p) == 4
    assert "Related work" in main_text(f"<article>{body}</article>") and "Comments" in main_text(f"<article>{body}</article>")


def test_unmatched_end_tags_cost_no_walk():
    start = time.process_time()
    main_text("<div>" * 8000 + "</b>" * 8000 + "x")
    main_text("<div class='sidebar'>" * 20_000 + "</section>" * 20_000 + "x")
    assert time.process_time() - start < 1.5

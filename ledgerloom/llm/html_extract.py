"""The main text of web pages by block rules in two passes.

Method: a page is cut into blocks at the tags that browsers set apart. First
pass: stop-word density, length and link density call each block good, bad or
ambiguous; blocks in menus, headers, footers, sidebars, notices, adverts, forms
and comments, told by their tags, roles and class names, are bad; within the
article only whole names count, and ids of headings and sections, which are made
from titles, do not. A few words, as those for comments and adverts, always
count, whatever stands beside them. Elsewhere a form, or an element that only its
name speaks against, is a wrapper and no sign if it holds most of the page's
running text; so is an article element no sign if it holds next to none. Second pass:
ambiguous blocks, most of them short, take the label of the nearest decided
neighbours that are not around the article. Where most of what long blocks with
few links hold is not in a language of the stop words, such blocks are good without
them. Good blocks, in page order, are the text.

Each page is read alone, in one pass over its tags, so work is in proportion to
its length and nothing is shuffled.

Defined results: null and empty html give an empty text; a page cut off in the
middle gives the text up to there, without an unfinished tag; an unclosed script,
style or comment runs to the end; character references are decoded once, white
space within a block (as ``str.split`` knows it) becomes one space; repeated rows
come out each; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, empty_if_null, rows_of

# Frequent function words of six languages, and the vocabulary of
# HTML and of the class names that sites use.
STOP_WORDS = frozenset(
    """a about after all an and are as at be been but by can for from had has have he her his if in is it its more not of
    on one or our she so that the their they this to was we were what when which who will with would you your
    au aux avec ce ces dans de des du elle en est et il je la le les leur mais ne nous on ou par pas pour qu que qui sa se
    ses son sont sur un une vous
    al como con de del el ella en es esta este ha la las lo los más mi muy no o para pero por que se si sin su sus un una y ya
    aber als am an auch auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich ihr im in ist mit
    nach nicht noch nur oder sich sie sind so und von vor war was wie wir wird zu zum zur über
    che con da di e gli i il in la le lo ma nel non per più si sono una uno um uma os as do da dos das não com mais
    de het een en van ik te dat die in niet zijn op aan met als voor er maar om ook""".split()
)
BLOCK_TAGS = frozenset(
    """address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section summary
    table tbody td tfoot th thead title tr ul""".split()
)
#: What lies between these tags is no text of the page.
SKIPPED_TAGS = frozenset("script style noscript template iframe object svg math canvas audio video select textarea button title".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that end by themselves; they hold no state here.
LOOSE_TAGS = frozenset("p li dt dd td th tr tbody thead tfoot option optgroup".split())
AROUND_TAGS = frozenset("nav header footer aside form head menu dialog fieldset search".split())
AROUND_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
AROUND_NAMES = frozenset(
    """ad ads adbox adslot advert advertisement advertising adverts alert banner billboard breadcrumb breadcrumbs
    comment commentlist comments consent cookie cookies copyright disclaimer discussion disqus footer footnav form gdpr
    header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager
    pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar sidenav
    signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar tracking widget widgets""".split()
)
#: Words that make a name of one in AROUND_NAMES, as in share-buttons or related-posts.
AROUND_COMPOUNDS = frozenset(
    """area bar block bottom box btn button buttons container count head icon icons inline inner item items link links list
    news outer page panel posts section site slot title top unit wrap wrapper""".split()
)
#: Words that say it alone, also in names of the article's parts as article-comments or story-ad,
#: unless they tell of a state, as in comments-open or no-ads.
DECISIVE_NAMES = frozenset(
    """ad ads adbox adslot advert advertisement advertising adverts comment commentlist comments disqus footer meta related
    share sharing sponsor sponsored usercomments""".split()
)
STATES = frozenset("closed disabled enabled free has no off on open supported with without".split())
#: Tags on which an id names what the element is for; on others it may be made from a title.
NAMED_BY_ID = frozenset("div dl ol section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_TAGS = frozenset("article main".split())
#: A class or id of which these parts both appear, or the id alone, holds the article.
MAIN_OWNERS, MAIN_KINDS = frozenset("article entry main post story".split()), frozenset("body content text".split())
MAIN_NAMES = frozenset("article articlebody body content entry main post story text has no with without".split())

#: First pass. Characters of a long block, of one that stop words can vouch for;
#: share of stop words in running text; share of linked characters that is too much.
LONG, SOME, STOPS, LINKED = 140, 40, 0.12, 0.4
#: Share of the running text from which an element is a wrapper, and below which one is no article.
WRAPPER, ARTICLE = 0.5, 0.25

_TAG = re.compile(
    r"""<(?:!--(?:.*?-->|.*)|[!?][^>]*+(?:>|$)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|$)))""", re.DOTALL
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_BARE_HIDDEN = re.compile(r"\shidden(?=[\s>=/]|$)")
_WORD = re.compile(r"[^\W\d_]+")
_LEGAL = re.compile(r"^(?:©|\(c\)\s|copyright\b)|\ball rights reserved\b", re.IGNORECASE)

GOOD, BAD, OPEN = 1, -1, 0


SURE, UNSURE = 2, 1


def _is_around(tag: str, attributes: str, main: bool) -> int:
    """Whether an element stands around the article rather than in it, for sure or unless it wraps the page.

    The header of the article itself has its title.
    """
    if tag in AROUND_TAGS and not (main and tag == "header"):
        return UNSURE if tag == "form" else SURE
    if not attributes.strip("/> \t\n"):
        return 0
    if _BARE_HIDDEN.search(attributes):
        return SURE
    found = 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "")
        if name == "role" and value.lower() in AROUND_ROLES or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return UNSURE if name == "role" and value.lower() == "form" else SURE
        if name in ("class", "id") and tag not in ("html", "body", *MAIN_TAGS) or name in ("class", "id") and tag == "article":
            if name == "id" and (tag in HEADINGS or tag not in BLOCK_TAGS or main and _is_section(tag, attributes)):
                continue
            whole = main or tag in ("article", "section") or tag in HEADINGS
            for word in value.split():
                parts = {p.lower() for p in _NAME_PARTS.findall(word)}
                unknown = parts - AROUND_NAMES - AROUND_COMPOUNDS
                if parts & DECISIVE_NAMES and not parts & STATES and not (tag == "article" and unknown) and (name == "class" or tag in NAMED_BY_ID):
                    return SURE
                if parts & AROUND_NAMES and not parts & MAIN_NAMES and not (whole and unknown):
                    found = UNSURE
    return found


def _is_section(tag: str, attributes: str) -> bool:
    """Whether an element is a section of a text, by its tag or a class as generators give it."""
    return tag == "section" or any(
        name.lower() == "class" and "section" in next(filter(None, values), "").lower().split() for name, *values in _ATTRIBUTE.findall(attributes)
    )


def _is_main(tag: str, attributes: str) -> bool:
    if tag in MAIN_TAGS:
        return True
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next(filter(None, values), "").lower()
        name = name.lower()
        if name == "role" and value in ("main", "article") or name == "itemprop" and value == "articlebody" or name == "id" and value in ("content", "main", "article"):
            return True
        if name in ("class", "id") and tag not in ("html", "body"):
            for word in value.split():
                parts = set(_NAME_PARTS.findall(word))
                if parts & MAIN_OWNERS and parts & MAIN_KINDS:
                    return True
    return False


class _Block:
    """Text of one block, its linked characters, and where it stands."""

    __slots__ = ("parts", "linked", "around", "doubt", "main", "text", "heading")

    def __init__(self, around: bool, doubt: int, main: bool) -> None:
        self.parts: list[str] = []
        self.linked, self.around, self.main, self.text, self.heading = 0, around, main, "", False
        #: The number of the innermost element around it that may be a wrapper, 0 for none.
        self.doubt = doubt

    @property
    def running(self) -> int:
        """Its characters, if they may be running text."""
        return len(self.text) if len(self.text) >= SOME and self.linked <= LINKED / 2 * len(self.text) else 0


def blocks_of(page: str) -> list[_Block]:
    """The blocks of a page that have text."""
    found: list[_Block] = []
    stack: list[tuple[str, bool, int, bool]] = []
    open_tags: Counter[str] = Counter()
    around = main = False
    #: The innermost element around that may be a wrapper, by number; each knows the next one out.
    doubt, outer = 0, [0]
    links = at = 0
    block = _Block(False, 0, False)

    def close() -> None:
        nonlocal block
        block.text = " ".join(html.unescape("".join(block.parts)).split())
        if block.text:
            found.append(block)
        block = _Block(around, doubt, main)

    def add(text: str) -> None:
        block.parts.append(text)
        if links:
            block.linked += len(text.strip())

    position = _TAG.search(page)
    while position:
        if position.start() > at:
            add(page[at : position.start()])
        at = position.end()
        tag = (position[2] or "").lower()
        if not tag:
            pass
        elif position[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in LOOSE_TAGS and open_tags[tag]:
                while stack:
                    opened, around, doubt, main = stack.pop()
                    open_tags[opened] -= 1
                    if opened == tag:
                        break
            if tag in BLOCK_TAGS:
                links = 0
                close()
        else:
            attributes = position[3]
            if tag == "body":
                # A head that was left open ends here.
                stack = [s for s in stack if s[0] != "head"]
                open_tags = Counter(s[0] for s in stack)
                around, doubt, main = False, 0, False
            if tag in SKIPPED_TAGS and not attributes.endswith("/>"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            elif tag == "a":
                links += 1
            elif tag in BLOCK_TAGS or tag not in VOID_TAGS:
                before = around, doubt, main
                here, inner = _is_around(tag, attributes, main), _is_main(tag, attributes)
                if tag not in LOOSE_TAGS and tag not in VOID_TAGS and (tag in BLOCK_TAGS or here or inner):
                    stack.append((tag, *before))
                    open_tags[tag] += 1
                    around, main = around or here == SURE, main or inner
                    if here == UNSURE:
                        outer.append(doubt)
                        doubt = len(outer) - 1
                    if (around, doubt) != before[:2] and tag not in BLOCK_TAGS:
                        close()
                if tag in BLOCK_TAGS:
                    links = 0
                    close()
                    block.heading = tag in HEADINGS
        position = _TAG.search(page, at)
    add(page[at:])
    close()
    _settle(found, outer)
    return found


def _settle(blocks: list[_Block], outer: list[int]) -> None:
    """Decide the doubts: which elements wrap the page's text, and whether article elements hold it."""
    running, articles = [0] * len(outer), [0] * len(outer)
    for b in blocks:
        if not b.around:
            running[b.doubt] += b.running
            articles[b.doubt] += b.main * b.running
    # An element's text is its own and that of the elements within it, which have higher numbers.
    for i in range(len(outer) - 1, 0, -1):
        running[outer[i]] += running[i]
        articles[outer[i]] += articles[i]
    # Most of the text, and no article of weight beside it.
    wraps = [i == 0 or running[i] > WRAPPER * running[0] and articles[0] - articles[i] < ARTICLE * running[0] for i in range(len(outer))]
    is_in = [True] * len(outer)
    for i in range(1, len(outer)):
        is_in[i] = wraps[i] and is_in[outer[i]]
    for b in blocks:
        b.around = b.around or not is_in[b.doubt]
    beside = [b for b in blocks if not b.around]
    if sum(b.running for b in beside if b.main) < ARTICLE * sum(b.running for b in beside):
        # What such elements hold besides headings are teasers of other pages.
        for b in blocks:
            b.around, b.main = b.around or b.main and not b.heading, False


def _first_pass(block: _Block, has_main: bool) -> int:
    if block.around or has_main and not block.main:
        return BAD
    size = len(block.text)
    if block.linked > LINKED * size and size:
        return BAD
    if size < LONG and not block.main and _LEGAL.search(block.text):
        return BAD
    words = _WORD.findall(block.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if size >= LONG:
        return GOOD if stops >= STOPS or block.main else OPEN
    return GOOD if size >= SOME and stops >= STOPS and block.linked <= LINKED / 2 * size else OPEN


def _without_stop_words(labels: list[int], blocks: list[_Block]) -> list[int]:
    """Labels in which long blocks with few links are good if stop words vouch for less than half of what those hold."""
    long = {i for i, b in enumerate(blocks) if labels[i] != BAD and len(b.text) >= LONG and b.linked <= LINKED / 2 * len(b.text)}
    vouched, all_ = (sum(len(blocks[i].text) for i in long if labels[i] in which) for which in ((GOOD,), (GOOD, OPEN)))
    return labels if 2 * vouched >= all_ else [GOOD if i in long else label for i, label in enumerate(labels)]


def _second_pass(labels: list[int], blocks: list[_Block]) -> list[int]:
    """Labels in which every ambiguous block has that of its nearest decided neighbours.

    A heading goes with what follows it. If neighbours as near as each other
    differ, a block of the article proper is good; without any decided block, so
    are all.
    """
    if not any(labels):
        return [GOOD] * len(labels)
    before, after = [], []
    for way, out in ((range(len(labels)), before), (range(len(labels) - 1, -1, -1), after)):
        last = None
        for i in way:
            if labels[i] != OPEN:
                last = i
            out.append(last)
    after.reverse()
    result = []
    for i, label in enumerate(labels):
        if label == OPEN:
            near = [(abs(i - j), labels[j]) for j in (before[i], after[i]) if j is not None]
            if blocks[i].heading and after[i] is not None:
                near = near[-1:]
            least = min(d for d, _ in near)
            labels_there = {x for d, x in near if d == least}
            label = labels_there.pop() if len(labels_there) == 1 else GOOD if blocks[i].main else BAD
        result.append(label)
    return result


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    has_main = any(b.main and not b.around for b in blocks)
    labels = [_first_pass(b, has_main) for b in blocks]
    # Within the article proper only its own blocks vouch for each other.
    for inside, run in groupby(range(len(blocks)), key=lambda i: has_main and blocks[i].main and not blocks[i].around):
        at = list(run)
        if inside:
            for i, label in zip(at, _second_pass([labels[i] for i in at], [blocks[i] for i in at])):
                labels[i] = label
    # What is around the article says nothing about what stands beside it.
    at = [i for i, b in enumerate(blocks) if not b.around]
    beside = [blocks[i] for i in at]
    for i, label in zip(at, _second_pass(_without_stop_words([labels[i] for i in at], beside), beside)):
        labels[i] = label
    return " ".join(b.text for b, label in zip(blocks, labels) if label == GOOD)


_DDL = "page_id long, url string, text string, n_chars long"
_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i, u, t, len(t)) for i, u, t in ((i, u, main_text(h)) for i, u, h in rows_of(batches, "page_id", "url", "html")))
        return batches_of(rows, _SCHEMA)

    read = pages.select(
        F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), empty_if_null(F.col(html_column)).alias("html")
    )
    return read.mapInArrow(run, _DDL)

"""Main text of web pages by two-pass block rules.

A page is read once into blocks: runs of text between block-level tags.  The
first pass decides what it can from a block's structure and words:

* bad: within a menu, header, footer, sidebar, form, advert, notice or comment
  (by element, role, class or id), or mostly links;
* good: long, of few links and many stop words; half as many do within an article;
* else ambiguous: a short block, one of middling stop-word density, a long one
  within an article, or a paragraph or heading of links there.

Stop words tell nothing on a page whose long blocks hardly have any, as in a
language that isn't listed: there a long block is good if it has few links.

Names of classes and ids are weak evidence.  One counts if all of its words are
names of page furniture or say where it stands (``site-footer``, ``ad-slot-2``), so
``related-work`` and ``no-sidebar`` don't.  If all that would be good lies within
elements named so, the one that holds most of it is the page's wrapper and its
name doesn't count, unless it names notices, adverts or comments.

The second pass gives an ambiguous block the label of its nearest decided
neighbours within the same part of the page: of both if they agree, else of the
nearer one, else good within an article and bad outside.  A heading goes with
what follows it.  Text outside of an article is judged like any other.

Defined results: a null or empty page has an empty text; unclosed and stray tags
are tolerated; an unclosed comment, script or style runs to the end; a very long
page is read whole, in time proportional to it; two neighbours at the same
distance (ties) count as said above; repeated rows give a row each, with equal
texts; a null page_id or url stays as it is; an empty table gives no rows; columns
besides page_id, url and html are neither read nor returned.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm._shared import short_batches

#: Frequent words of the languages that are told from lists of names and links.
STOP_WORDS = frozenset(
    "the of and to in is that it for as with was be by on are this an at from or not have has which a"
    " le la les de des du et en un une que qui est pour dans par sur au aux avec pas ne se ce il elle"
    " der die das und in den von zu mit ist des dem für auf eine ein als auch nicht sich es an werden"
    " el la los las de que y en un una por con para del se no es su al lo como más pero sus le".split()
)
_BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content isn't text.
_SKIP = frozenset("script style noscript template iframe svg canvas object textarea head title audio video".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PROSE = _HEADINGS | {"p", "blockquote"}
_RAW = frozenset("script style textarea title noscript iframe".split())
_CONTAINER = frozenset("article main section div body html nav aside header footer form dialog ul ol dl table tr td th blockquote figure details select button menu fieldset address".split())
_BAD = frozenset("nav aside footer form menu select button dialog fieldset".split())
#: Words of names of page furniture, words that name what is never an article, and
#: words that only say which one or where.
_FURNITURE = frozenset(
    "banner promo promotion alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar side header masthead toolbar pagination pager"
    " footer share sharing social related recommend recommended recommendations widget signup login subscribe newsletter".split()
)
_NEVER_MAIN = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr notice notices comment comments disqus replies respond".split())
_NEUTRAL = frozenset(
    "site page main primary secondary global top bottom left right first last upper lower inner outer sub mega mobile box block area bar list item items links link posts post articles"
    " stories news buttons button icons icon slot unit wrap wrapper container section group row col column panel content holder text form thread reader user small large sticky".split()
)
_NAME_WORD = re.compile(r"[a-z]+")


def _named(names: str) -> str:
    """What classes and an id say: ``never`` main text, ``furniture`` or nothing."""
    said = ""
    for name in names.lower().replace("_", "-").split():
        found = set(_NAME_WORD.findall(name))
        if found & (_FURNITURE | _NEVER_MAIN) and found <= _FURNITURE | _NEVER_MAIN | _NEUTRAL:
            said = "never" if found & _NEVER_MAIN else said or "furniture"
    return said


_BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[^\W\d_]+")
#: Characters that make a block long; share of stop words that makes it good.
LONG, STOP_DENSITY, LINK_DENSITY = 70, 0.2, 0.5


@dataclass
class Block:
    text: str
    linked: int
    bad: bool
    main: bool
    part: int
    heading: bool = False
    #: The innermost element around it that is bad by its name alone, by number; 0 is none.
    named: int = 0
    #: A paragraph or heading.
    prose: bool = False


@dataclass
class Named:
    """Elements that are bad by their names alone: for each, from 1, the one around
    it, and whether its name may be a wrapper's."""

    around: list[int]
    wrapper: list[bool]


def blocks(page: str) -> tuple[list[Block], Named]:
    """All blocks that have text, in the order of the page, and the named elements."""
    out: list[Block] = []
    open_: list[tuple[str, bool, bool, int]] = []  # name, bad, main, number if bad by its name
    still: Counter[str] = Counter()  # names in open_
    inside: list[int] = [0]  # numbers of the named elements that are open
    named = Named([0], [True])
    bad = main = part = 0
    text: list[str] = []
    link_text: list[str] = []
    links, heading, prose = 0, False, False

    def flush() -> None:
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                linked = len(" ".join(html.unescape("".join(link_text)).split()))
                out.append(Block(whole, linked, bad > 0, main > 0, part, heading, inside[-1], prose))
            text.clear()
            link_text.clear()

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[1] or m[3]
        if name is None:
            found = m[0]
            if found[0] != "<" or found == "<":
                text.append(found)
                if links:
                    link_text.append(found)
            continue
        name = name.lower()
        if page[m.start() + 1] == "/":
            if name == "a":
                links = max(0, links - 1)
            elif name in _CONTAINER:
                flush()
                heading = prose = False
                if still[name]:
                    while True:
                        closed, was_bad, was_main, was_named = open_.pop()
                        still[closed] -= 1
                        bad -= was_bad
                        main -= was_main
                        if was_named:
                            inside.pop()
                        if was_bad or was_main or was_named:
                            part += 1
                        if closed == name:
                            break
                links = 0
            elif name in _BLOCK:
                flush()
                heading = heading and name not in _HEADINGS
                prose = prose and name not in _PROSE
            continue
        rest = m[2] if m[2] is not None else m[4]
        if name in _SKIP:
            if not rest.endswith("/") or name in _RAW:
                # Up to its own end tag; what it holds is not text.
                end = re.compile(rf"</{name}\b[^>]*>" + (r"|<(?:body|article|main|nav|header|div|p|h[1-6])\b" if name == "head" else ""), re.I).search(page, at)
                at = (end.start() if end and end[0][1] != "/" else end.end()) if end else size
            continue
        if name == "a":
            links += 1
        elif name in _BLOCK or name in _CONTAINER:
            flush()
            heading = name in _HEADINGS
            prose = name in _PROSE or prose and name == "br"
        if name in _CONTAINER and name not in _VOID and not rest.endswith("/"):
            attributes = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(rest)} if rest else {}
            role = attributes.get("role", "").lower()
            is_main = name in ("article", "main") or role in ("main", "article")
            is_bad = name in _BAD or role in _BAD_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true"
            is_bad = is_bad or (name == "header" and not main)
            own = 0
            if name not in ("body", "html", "main") and attributes:
                names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
                said = _named(names)
                # Within an article a header is its title's.
                if said and not (main and said == "furniture" and "header" in names.lower()):
                    own = len(named.around)
                    named.around.append(inside[-1])
                    named.wrapper.append(said == "furniture")
            # A reader's comment may be an article of its own.
            is_main = is_main and not bad and not is_bad
            open_.append((name, is_bad, is_main, own))
            still[name] += 1
            bad += is_bad
            main += is_main
            if own:
                inside.append(own)
            if is_bad or is_main or own:
                part += 1
    flush()
    return out, named


def _counted(b: Block, stop_words: frozenset[str]) -> tuple[int, int] | None:
    """Words and stop words of a long block of few links that isn't bad by its element."""
    if b.bad or b.linked > LINK_DENSITY * len(b.text) or len(b.text) < LONG:
        return None
    words = _WORD.findall(b.text.lower())
    return len(words), sum(w in stop_words for w in words)


def _decide(b: Block, counted: tuple[int, int] | None, known: bool) -> bool | None:
    if b.bad or b.named:
        return False
    if b.linked > LINK_DENSITY * len(b.text):
        # A paragraph of an article may be one link.
        return None if b.main and b.prose else False
    if counted is None:
        return None
    n, stops = counted
    if not known:
        return n > 0 or None
    density = stops / n if n else 0.0
    if density >= STOP_DENSITY / (2 if b.main else 1):
        return True
    return None if b.main or density >= STOP_DENSITY / 2 else False


def first_pass(found: list[Block], named: Named | None = None, stop_words: frozenset[str] = STOP_WORDS) -> list[bool | None]:
    """Good, bad or undecided; names of wrappers are taken off the blocks."""
    counted = [_counted(b, stop_words) for b in found]

    def decided() -> list[bool | None]:
        some = [c for b, c in zip(found, counted) if c and not b.named]
        words, stops = (sum(c[i] for c in some) for i in (0, 1))
        return [_decide(b, c, stops >= words * STOP_DENSITY / 2) for b, c in zip(found, counted)]

    first = decided()
    if any(first) or named is None:
        return first
    # No good block stands outside of named elements.  From the outside in, the one
    # that holds most text is the page's wrapper, until a good block is found.
    own: dict[int, list[int]] = {}
    size = [0] * len(named.around)
    for i, (b, c) in enumerate(zip(found, counted)):
        own.setdefault(b.named, []).append(i)
        size[b.named] += len(b.text) if c else 0
    within: dict[int, list[int]] = {}
    for x in range(len(size) - 1, 0, -1):
        size[named.around[x]] += size[x]
        within.setdefault(named.around[x], []).append(x)
    at = 0
    while not any(first) and (inner := [x for x in within.get(at, ()) if named.wrapper[x] and size[x]]):
        at = min(inner, key=lambda x: (-size[x], x))
        for i in own.get(at, ()):
            found[i].named = 0
        if any(counted[i] for i in own.get(at, ())):
            first = decided()
    return first


def labels(found: list[Block], named: Named | None = None, stop_words: frozenset[str] = STOP_WORDS) -> list[bool]:
    """Whether each block is main text, after both passes."""
    first = first_pass(found, named, stop_words)
    n = len(found)
    # Distance to, and label of, the nearest decided block of the same part on either side.
    before: list[tuple[int, bool] | None] = [None] * n
    after: list[tuple[int, bool] | None] = [None] * n
    for side, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last: tuple[int, bool, int] | None = None
        for i in order:
            if last and last[2] == found[i].part:
                side[i] = (abs(i - last[0]), last[1])
            if first[i] is not None:
                last = (i, first[i], found[i].part)
    out = []
    for i, label in enumerate(first):
        if label is None:
            a, b = before[i], after[i]
            near = [x for x in (a, b) if x]
            if not near:
                label = found[i].main
            elif len({x[1] for x in near}) == 1:
                label = near[0][1]
            elif found[i].heading:
                label = b[1]
            else:
                label = found[i].main if a[0] == b[0] else min(near)[1]
        out.append(label)
    return out


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    found, named = blocks(page)
    return " ".join(b.text for b, good in zip(found, labels(found, named)) if good)


def _extracts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pd.Series([extract(p if isinstance(p, str) else None) for p in pages], dtype=object)


def main_text(page: Column) -> Column:
    return F.pandas_udf(_extracts, "string")(page)


def extracted(pages: DataFrame) -> DataFrame:
    short_batches(pages.sparkSession)
    return pages.select("page_id", "url", main_text(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))

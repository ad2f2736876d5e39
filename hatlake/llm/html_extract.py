"""Main-text extraction by tag-path ratios.

A page becomes a list of blocks in page order, each with its root-to-leaf tag path (tags with their
classes). For each path the text length and the punctuation of all its blocks are summed; the ratio of
both to the number of blocks scores the path. Scores are laid along the page, smoothed with a Gaussian,
and fused with the unsmoothed score of the path; what is in links lowers the result, as do names of classes
that tell of boilerplate. Paths whose score reaches a share of the page's mean score are content, and
their blocks are selected. Then the element that holds the selected text is looked for (an ``article`` or
``main`` if it has a fair share of it), and the selected blocks inside it are the text.

Structure is dropped before: elements that aren't text, navigation, footers, asides, forms and the like.
Such an element, or one whose name tells of boilerplate, is kept like others if it holds an article or
most of the text. All of it is local to a page, and takes time proportional to the page.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What HTML itself says of its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head script style noscript template iframe object svg math canvas button select textarea input title".split())
#: Elements and roles that are never main text, and those that aren't unless they hold most of the text.
NEVER_TAGS, NEVER_ROLES = frozenset("nav footer menu".split()), frozenset("navigation banner contentinfo search menu menubar".split())
APART_TAGS, APART_ROLES = frozenset("form aside dialog".split()), frozenset("complementary alert alertdialog dialog form".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: What an open element of these kinds is closed by, and what bounds the search for it.
SCOPES = {
    "p": ({"p"}, CLOSES_P, {"td", "th", "table", "button", "object"}),
    "li": ({"li"}, {"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dt", "dd"}, {"dl"}),
    "cell": ({"td", "th"}, {"td", "th", "tr"}, {"tr", "table"}),
    "row": ({"tr"}, {"tr"}, {"table"}),
    "option": ({"option"}, {"option"}, {"select"}),
}
NO_SCOPES = (0,) * len(SCOPES)

#: Words of class and id names that tell of reader comments, of other boilerplate, and of what may be either.
TALK = frozenset("comment comments commentlist disqus respond reply replies discussion thread threads".split())
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner banners sponsor sponsored promo promotion promoted promos "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer masthead topbar toolbar pagination pager skip "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sharing".split()
)
WEAK = frozenset("header share social related recommended recommendations widget widgets copyright legal disclaimer".split())
#: What a name multiplies the score of its paths by, and the share of the selected text that annuls it.
TALK_FACTOR, STRONG_FACTOR, WEAK_FACTOR, APART_FACTOR, LEAST_FACTOR = 0.09, 0.1, 0.7, 0.001, 0.005
TALK_SHARE, MARK_SHARE = 0.9, 0.5

SIGMA = 1.0
#: The share of the mean score that a path must reach, and in an article or main element, which says itself what is content.
THRESHOLD, ARTICLE_THRESHOLD = 0.5, 0.15
#: What a path is worth if all of it is links.
LINK_SHARE = 0.1
#: An article or main element is the container if it has this share of the selected text, or if there isn't as much outside
#: of it as a story has characters; another element, if it has the last share.
ARTICLE_SHARE, STORY_CHARS, CONTAINER_SHARE = 0.125, 280, 0.9

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
_CLOSED = re.compile(r"(?:^|[\s\"'])/\s*$")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)


class Element(NamedTuple):
    parent: int
    tag: str
    path: int
    depth: int
    #: 1, or what the element's own name or meaning multiplies scores by.
    factor: float
    dropped: bool
    heading: bool
    #: For each of SCOPES the depth of the open element that it would close, or 0.
    scopes: tuple[int, ...]


class Block(NamedTuple):
    element: int
    text: str
    linked: int
    #: The text goes on after a marked inline element.
    glued: bool


@functools.lru_cache(4096)
def _named(tag: str, attributes: str) -> tuple[float, str]:
    """The factor of an element's name or meaning, and its classes as part of the path."""
    factor = 0.0 if tag in NEVER_TAGS else APART_FACTOR if tag in APART_TAGS else WEAK_FACTOR if tag == "header" else 1.0
    classes = ""
    if attributes.strip():
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), next(filter(None, values), "")
            if name in ("class", "id"):
                words = _WORDS.findall(_CAMEL.sub(" ", value).lower())
                if name == "class":
                    classes = ".".join(words)
                if tag not in ("html", "body", "article", "main"):
                    for known, value_of in ((TALK, TALK_FACTOR), (STRONG, STRONG_FACTOR), (WEAK, WEAK_FACTOR)):
                        if not known.isdisjoint(words):
                            factor = min(factor, value_of)
            elif name == "role" and value.strip().lower() in APART_ROLES:
                factor = min(factor, APART_FACTOR)
            elif name == "role" and value.strip().lower() in NEVER_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
                factor = 0.0
    return factor, classes


def _scopes_within(scopes: tuple[int, ...], tag: str, depth: int) -> tuple[int, ...]:
    """The scopes inside an element of this tag and depth."""
    if any(tag in kinds or tag in bounds for kinds, _, bounds in SCOPES.values()):
        return tuple(depth if tag in kinds else 0 if tag in bounds else was for was, (kinds, _, bounds) in zip(scopes, SCOPES.values(), strict=True))
    return scopes


def parse(page: str) -> tuple[list[Element], list[Block]]:
    """The elements of a page and its blocks in page order; white space at the ends of blocks is left out.

    Broken markup is read as a browser would in the main: a paragraph ends where another block begins, ends
    without a beginning are skipped, and a tag that breaks off at the end of the page is no text. Inline
    elements are part of the block they stand in, but for marked ones, which are blocks of their own.
    """
    elements = [Element(-1, "#root", 0, 0, 1.0, False, False, NO_SCOPES)]
    stack, open_tags = [0], {}
    paths: dict[tuple[int, str], int] = {}
    blocks: list[Block] = []
    parts: list[str] = []
    links = linked = 0
    glued = False
    at, n = 0, len(page)

    def flush(glue: bool = False) -> None:
        nonlocal linked, glued
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                blocks.append(Block(stack[-1], text, min(linked, len(text)), glued))
            parts.clear()
        linked, glued = 0, glue

    def pop_to(depth: int) -> None:
        """Close the open element of this depth and all within it."""
        glue = depth == len(stack) - 1 and elements[stack[depth]].tag in INLINE
        flush(glue)
        for index in stack[depth:]:
            open_tags[elements[index].tag] -= 1
        del stack[depth:]

    def push(tag: str, attributes: str, factor: float, classes: str, glue: bool = False) -> None:
        flush()
        up = elements[stack[-1]]
        key = (up.path, f"{tag}.{classes}" if classes else tag)
        path = paths.setdefault(key, len(paths) + 1)
        scopes = _scopes_within(up.scopes, tag, len(stack))
        elements.append(Element(stack[-1], tag, path, len(stack), factor, up.dropped or tag in DROPPED, up.heading or tag in HEADINGS, scopes))
        stack.append(len(elements) - 1)
        open_tags[tag] = open_tags.get(tag, 0) + 1

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not elements[stack[-1]].dropped:
            text = html.unescape(raw)
            parts.append(text)
            if links:
                linked += len(text.strip())

    while at < n:
        found = _TOKEN.search(page, at)
        if found is None:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        closing, tag, attributes = found.groups()
        if tag is None:
            if found.group().startswith("<![CDATA["):
                add(html.escape(found.group()[9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            if open_tags.get(tag):
                depth = len(stack) - 1
                while elements[stack[depth]].tag != tag:
                    depth -= 1
                # an inline element doesn't close the blocks that were opened inside it
                if tag not in INLINE or depth == len(stack) - 1:
                    pop_to(depth)
            continue
        if tag in RAW_TEXT:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                links += 1
            elif tag not in ("b", "i", "em", "strong") and attributes:
                factor, classes = _named(tag, attributes)
                if factor < WEAK_FACTOR:
                    push(tag, attributes, factor, classes)
            continue
        for number, (_, closers, _) in enumerate(SCOPES.values()):
            if tag in closers and (depth := elements[stack[-1]].scopes[number]):
                pop_to(depth)
        flush()
        if tag in VOID:
            continue
        if tag in ("article", "main", "section", "nav", "aside", "footer"):
            links = 0  # a link doesn't reach over sections
        factor, classes = _named(tag, attributes)
        if _CLOSED.search(attributes) and tag not in ("p", "div", "article", "section", "main", "body", "html"):
            continue
        push(tag, attributes, factor, classes)
    flush()
    return elements, blocks


def path_scores(keys: list, blocks: list[Block], factors: list[float]) -> list[float]:
    """The score of each block's path.

    ``keys`` names the path of each block. A path's ratio is ln(1 + its mean text length times one more than
    its mean punctuation); the mean of the smoothed ratios along the path's blocks is fused with it, and the
    result is lowered by the share of links and the factor of the path's names.
    """
    sums: dict = {}
    for key, block in zip(keys, blocks, strict=True):
        s = sums.setdefault(key, [0, 0, 0, 0])
        s[0] += len(block.text)
        s[1] += len(_PUNCTUATION.findall(block.text))
        s[2] += block.linked
        s[3] += 1
    ratio = {key: math.log1p(length / n * (1 + marks / n)) for key, (length, marks, _, n) in sums.items()}
    raw = np.array([ratio[key] for key in keys])
    reach = max(1, math.ceil(3 * SIGMA))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * SIGMA * SIGMA))
    along = np.convolve(raw, kernel)[reach:-reach] / np.convolve(np.ones(len(raw)), kernel)[reach:-reach]
    smooth: dict = {}
    for key, value in zip(keys, along.tolist(), strict=True):
        smooth[key] = smooth.get(key, 0.0) + value
    fused = {}
    for key, (length, _, linked, n) in sums.items():
        plain = LINK_SHARE + (1 - LINK_SHARE) * (1 - linked / length)
        fused[key] = (ratio[key] + smooth[key] / n) / 2 * plain
    return [fused[key] * factor for key, factor in zip(keys, factors, strict=True)]


def _mean_score(scores: list[float], blocks: list[Block]) -> float:
    """The mean score of the page's characters."""
    return sum(s * len(b.text) for s, b in zip(scores, blocks, strict=True)) / max(1, sum(len(b.text) for b in blocks))


def _masses(elements: list[Element], blocks: list[Block], weights: list[float]) -> list[float]:
    """The weight of all blocks below each element, by one pass from the leaves up."""
    mass = [0.0] * len(elements)
    for block, weight in zip(blocks, weights, strict=True):
        mass[block.element] += weight
    for index in range(len(elements) - 1, 0, -1):
        mass[elements[index].parent] += mass[index]
    return mass


def _plain(block: Block) -> int:
    return len(block.text) - block.linked


def _factors(elements: list[Element], blocks: list[Block]) -> list[float]:
    """What the names and meanings of an element and those around it multiply its scores by."""
    keys = [elements[b.element].path for b in blocks]
    scores = path_scores(keys, blocks, [1.0] * len(blocks))
    limit = THRESHOLD * _mean_score(scores, blocks)
    mass = _masses(elements, blocks, [_plain(b) * s if s >= limit else 0.0 for b, s in zip(blocks, scores, strict=True)])
    text = _masses(elements, blocks, [float(_plain(b)) for b in blocks])
    holds = [False] * len(elements)  # an article or main element with text
    for index in range(len(elements) - 1, 0, -1):
        e = elements[index]
        if text[index] > 0 and (holds[index] or e.tag in ("article", "main")):
            holds[e.parent] = True
    factors = [1.0] * len(elements)
    inside = [False] * len(elements)  # an article or main element that no mark takes away
    plain = False  # there is one
    for index in range(1, len(elements)):
        e = elements[index]
        spared = e.factor == 1 or holds[index]
        factors[index] = factors[e.parent] * (1.0 if spared else e.factor)
        inside[index] = inside[e.parent] or e.tag in ("article", "main") and factors[index] == 1
        plain = plain or inside[index] and text[index] > 0
    # Where an article says what is content, much text outside of it is no sign of main text: a footer can be longer.
    factors = [1.0] * len(elements)
    for index in range(1, len(elements)):
        e = elements[index]
        share = TALK_SHARE if e.factor == TALK_FACTOR else MARK_SHARE
        most = e.factor > 0 and mass[0] > 0 and mass[index] >= share * mass[0] and (inside[index] or not plain)
        factors[index] = factors[e.parent] * (1.0 if e.factor == 1 or holds[index] or most else e.factor)
    return factors


def _container(elements: list[Element], blocks: list[Block], selected: list[bool], scores: list[float]) -> int:
    """The element that holds the main text: the article with the most selected text, else ``main``, each if it has
    a fair share of it or no story stands outside; else the deepest element that holds nine tenths of the selected text."""
    mass = _masses(elements, blocks, [_plain(b) * s if chosen else 0.0 for b, s, chosen in zip(blocks, scores, selected, strict=True)])
    length = _masses(elements, blocks, [_plain(b) if chosen else 0.0 for b, chosen in zip(blocks, selected, strict=True)])
    text = _masses(elements, blocks, [float(_plain(b)) for b in blocks])
    for tag in ("article", "main"):
        above, marked = [False] * len(elements), [False] * len(elements)
        tops = []
        for index in range(1, len(elements)):
            up = elements[index].parent
            above[index], marked[index] = above[up] or elements[up].tag == tag, marked[up] or elements[up].factor < 1
            # below a mark it may be a teaser: it counts if it holds half of the text
            if elements[index].tag == tag and not above[index] and (not marked[index] or 2 * mass[index] >= mass[0]):
                tops.append(index)
        if tops:
            best = max(tops, key=lambda t: (mass[t], text[t]))
            fair = length[best] >= ARTICLE_SHARE * length[0] or length[0] - length[best] < STORY_CHARS
            if text[best] > 0 and 2 * mass[best] >= sum(mass[t] for t in tops) and fair:
                return best
    deepest = max((i for i in range(len(elements)) if mass[i] >= CONTAINER_SHARE * mass[0]), key=lambda i: (elements[i].depth, -i), default=0)
    # a single block can't be the container: its neighbours of the same parent belong to the text
    while deepest and elements[deepest].tag not in ("div", "section", "body", "td", "article", "main"):
        deepest = elements[deepest].parent
    return deepest


def select(elements: list[Element], blocks: list[Block]) -> list[Block]:
    """The blocks of the main text."""
    factors = _factors(elements, blocks)
    blocks = [b for b in blocks if factors[b.element] >= LEAST_FACTOR]
    if not blocks:
        return []
    of = [factors[b.element] for b in blocks]
    keys = [(elements[b.element].path, f) for b, f in zip(blocks, of, strict=True)]
    scores = path_scores(keys, blocks, of)
    # The mean is that of what has no mark against it: long comments must not lower what is asked of a path.
    clear = [(s, b) for s, b, f in zip(scores, blocks, of, strict=True) if f >= WEAK_FACTOR] or list(zip(scores, blocks, strict=True))
    mean = _mean_score(*map(list, zip(*clear, strict=True)))
    root = _container(elements, blocks, [s >= THRESHOLD * mean for s in scores], scores)
    within = [False] * len(elements)
    for index in range(len(elements)):
        within[index] = index == root or index > 0 and within[elements[index].parent]
    explicit = elements[root].tag in ("article", "main")
    if explicit:
        # What an article asks of a path is a share of its own mean: text around a short one can be longer.
        own = [(s, b) for s, b in clear if within[b.element]]
        mean = _mean_score(*map(list, zip(*own, strict=True))) if own else mean
    limit = (ARTICLE_THRESHOLD if explicit else THRESHOLD) * mean
    inside = [(b, s >= limit, f) for b, s, f in zip(blocks, scores, of, strict=True) if within[b.element]]
    # A path that holds a tenth of the container's plain text is content, if nothing speaks against it.
    lengths: dict[int, int] = {}
    for block, _, _ in inside:
        path = elements[block.element].path
        lengths[path] = lengths.get(path, 0) + _plain(block)
    whole = sum(lengths.values())
    stays = [s or f >= WEAK_FACTOR and 0 < whole <= 10 * lengths[elements[b.element].path] for b, s, f in inside]
    # A heading stays with what follows it.
    for i in range(len(inside) - 1, -1, -1):
        if elements[inside[i][0].element].heading and inside[i][2] >= WEAK_FACTOR:
            after = stays[i + 1 : i + 3]
            stays[i] = any(after) if after else stays[i]
    return [block for (block, _, _), stay in zip(inside, stays, strict=True) if stay]


def main_text(page: str | None) -> str:
    """The main text of a page: its blocks joined by an empty line; empty if there is none."""
    if not page:
        return ""
    elements, blocks = parse(page)
    if not blocks:
        return ""
    out: list[str] = []
    before = -1
    for block in select(elements, blocks):
        if block.glued and block.element == before:
            out[-1] += f" {block.text}"
        else:
            out.append(block.text)
        before = block.element
    return "\n\n".join(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) for page in batch.column(2).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points).

    Null, empty and markup-only pages have an empty text. Repeated rows and null ids are kept; an empty
    table gives no rows. Other columns aren't read, whatever their names. No shuffle: a page is read,
    parsed and given back by one task, a very long or deeply nested one in time proportional to its length.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(body_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)

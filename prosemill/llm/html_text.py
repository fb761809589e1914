"""Main text of web pages: parser events, text-to-tag ratios, smoothing and clustering.

One pass of the standard library's parser turns a page into blocks (the lines of the page: text
between block-level tags) and counts text and tags in each. Scripts, styles and the like are never
text. Menus, footers, adverts, forms, comments ... are known by element and name, and are out; but an
element that holds nearly all of the upper cluster's text is a wrapper of the page, whatever its
name, and stays.

The text-to-tag ratios of the blocks, smoothed by a Gaussian, are split into two clusters. The
article or main elements of the upper cluster's text, all of them, are the content region; without
any it is the smallest element that holds the upper cluster, with the blocks beside it up to the
next list of links. All of the region's blocks that are not out are the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from prosemill.llm.common import parts_of, pick

# fixed values: element names of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
SILENT = frozenset(
    "script style noscript template head title svg math iframe object embed applet canvas audio video map select option datalist"
    " textarea button input".split()
)
#: Out by their names; of these the second kind may wrap a page.
OUT = frozenset("nav footer aside dialog menu".split())
OUT_OR_WRAPPER = frozenset("form fieldset header".split())
#: A start tag of the first kind ends an open element of the second kind.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5"
    " h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("article aside body div footer header html main nav section table ul ol dl blockquote form".split())
RAW = frozenset(("script", "style"))

#: Words of class, id and role names that mark what is no article.
_OUT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert(?:s|isements?|ising)?|sponsor(?:ed|s)?|promo(?:s|tions?|ted)?|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay"
    r"|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|side|aside|widgets?|footer|foot|header|masthead|topbar|toolbar|comments?|comment-list|disqus|replies"
    r"|respond|related|recommend(?:ed|ations?)?|share|sharing|social|subscribe|newsletter|signup|login|search|pagination|pager|hidden|complementary"
    r"|contentinfo|dialog|form|skip|print|toc)(?:$|[\s_\d-])",
    re.IGNORECASE,
)
#: Names that say what an element has or belongs to, not what it is.
_STATE = re.compile(r"(?:^|(?<=\s))(?:has|with|without|no|is|show|hide|article|post|entry|story|content|main)[_-]+(?:\S*[_-])?(?:sidebars?|header|side|comments?|nav|menus?|ads?)(?=$|\s)", re.IGNORECASE)
_SPACES = re.compile(r"\s+")
_CONTENT = ("article", "main")
_HEADINGS = ("h1", "h2")
#: Width of the smoothing, in blocks.
SIGMA = 1.0
#: A wrapper holds this share of the upper cluster's text.
WRAPPER = 0.9


class Open(NamedTuple):
    """An open element, and what holds inside it."""

    name: str
    number: int
    silent: bool
    holder: int  # number of the innermost block element
    scope: int  # place in the stack of the innermost element that ends a scope
    link: bool
    own: bool  # whether in an article or main element


_OUTSIDE = Open("", -1, False, -1, -1, False, False)


class Blocks(HTMLParser):
    """Blocks of a page: (text, tags in it, number of the element that holds it); elements by number,
    which is their order. Every step takes the same time however deep elements are nested."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[Open] = []
        self.open: dict[str, list[int]] = {}  # places in the stack by name
        self.names: list[str] = []
        self.parent: list[int] = []
        self.marked: list[str] = []  # by element: "", "wrapper" if it may be one, or "out"
        self.blocks: list[tuple[str, int, int]] = []
        self.links: list[bool] = []  # whether most of a block's text is in links
        self.text: list[str] = []
        self.tags = self.linked = 0

    @property
    def top(self) -> Open:
        return self.stack[-1] if self.stack else _OUTSIDE

    def flush(self) -> None:
        if self.text:
            joined = _SPACES.sub(" ", "".join(self.text)).strip()
            if joined:
                self.blocks.append((joined, self.tags, self.top.holder))
                self.links.append(2 * self.linked > len(joined))
            self.text = []
            self.tags = self.linked = 0

    def close(self) -> None:
        super().close()
        self.flush()

    def pop_to(self, at: int) -> None:
        if any(x.name not in INLINE for x in self.stack[at:]):
            self.flush()
        for x in self.stack[at:]:
            self.open[x.name].pop()
        del self.stack[at:]

    def innermost(self, name: str) -> int:
        """The place in the stack of the innermost open element of that name, or -1."""
        return (self.open.get(name) or (-1,))[-1]

    def mark(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        if tag in ("html", "body", *_CONTENT):
            return ""
        if tag in OUT or tag == "header" and not self.top.own or tag in ("form", "fieldset"):
            return "out" if tag in OUT else "wrapper"
        if not attrs:
            return ""
        values = dict(attrs)
        if "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in (values.get("style") or "").replace(" ", "").lower():
            return "out"
        named = " ".join(values.get(k) or "" for k in ("class", "id", "role")).strip()
        return "wrapper" if named and _OUT.search(named) and _OUT.search(_STATE.sub("", named)) else ""

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        ends = CLOSES.get(tag, ())
        at = max([self.innermost(x) for x in ends] + [self.innermost("p") if tag in CLOSES_P else -1])
        if at >= 0 and at >= self.top.scope:
            self.pop_to(at)
        if tag not in INLINE:
            self.flush()
        elif tag == "br":
            self.text.append(" ") if self.text else None
        if tag in VOID:
            return
        above, number, block = self.top, len(self.names), tag not in INLINE
        mark = "" if above.silent else self.mark(tag, attrs)
        self.names.append(tag)
        self.parent.append(above.holder)
        self.marked.append(mark if block else "")
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(Open(
            tag, number, above.silent or tag in SILENT or bool(mark) and not block, number if block else above.holder,
            len(self.stack) if tag in SCOPE else above.scope, above.link or tag == "a", above.own or tag in _CONTENT,
        ))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.top.name == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        at = self.innermost(tag)
        if at >= 0 and (at >= self.top.scope or tag not in INLINE and tag not in ("p", "li")):
            self.pop_to(at)

    def handle_data(self, data):
        if not self.top.silent:
            self.text.append(data)
            if self.top.link:
                self.linked += len(data.strip())


def _two_means(x: np.ndarray) -> np.ndarray:
    """Whether each value is in the upper of two clusters."""
    low, high = x.min(), x.max()
    if high - low < 1e-9:
        return np.ones(len(x), bool)
    for _ in range(20):
        upper = x > (low + high) / 2
        a, b = x[~upper].mean(), x[upper].mean()
        if (a, b) == (low, high):
            break
        low, high = a, b
    return upper


def text_to_tag(blocks: list[tuple[str, int, int]]) -> np.ndarray:
    """Characters for each tag, on a logarithmic scale."""
    return np.log1p([len(t) / max(1, n) for t, n, _ in blocks])


def smoothed(ratio: np.ndarray) -> np.ndarray:
    """The ratios, each with its neighbours under a Gaussian."""
    reach = int(3 * SIGMA)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    weight = np.convolve(np.ones(len(ratio)), kernel)[reach : reach + len(ratio)]
    return np.convolve(ratio, kernel)[reach : reach + len(ratio)] / weight


class _Tree:
    """The elements of a page: what each holds, and its last descendant."""

    def __init__(self, parser: Blocks):
        self.names, self.parent, self.marked = parser.names, parser.parent, parser.marked
        self.last = list(range(len(self.names)))
        for n in range(len(self.names) - 1, -1, -1):
            if (p := self.parent[n]) >= 0:
                self.last[p] = max(self.last[p], self.last[n])

    def mass(self, blocks: list[tuple[str, int, int]], weight: np.ndarray) -> list[float]:
        """The blocks' weights in each element; those of the whole page are last."""
        out = [0.0] * (len(self.names) + 1)
        for (_, _, holder), w in zip(blocks, weight, strict=True):
            out[holder] += float(w)
        for n in range(len(self.names) - 1, -1, -1):
            out[self.parent[n]] += out[n]
        return out

    def out(self, mass: list[float]) -> list[bool]:
        """Whether each element is out, the page itself last: it or one around it is marked, and is no
        wrapper of nearly all mass."""
        out = [False] * (len(self.names) + 1)
        for n, (p, mark) in enumerate(zip(self.parent, self.marked, strict=True)):
            out[n] = out[p] or mark == "out" or mark == "wrapper" and not (mass[-1] > 0 and mass[n] >= WRAPPER * mass[-1])
        return out

    def outermost(self, kind: tuple[str, ...]) -> list[int]:
        found, end = [], -1
        for n, name in enumerate(self.names):
            if n > end and name in kind:
                found.append(n)
                end = self.last[n]
        return found


def extract(html: str) -> str:
    """The main text of one page, '' if it has none."""
    parser = Blocks()
    parser.feed(html)
    parser.close()
    if not parser.blocks:
        return ""
    tree = _Tree(parser)
    size = np.array([len(t) for t, _, _ in parser.blocks], float)
    links = np.array(parser.links)
    ratio = text_to_tag(parser.blocks)
    out = tree.out(tree.mass(parser.blocks, size * ((_two_means(smoothed(ratio)) | _two_means(ratio)) & ~links)))
    kept = [i for i, (_, _, holder) in enumerate(parser.blocks) if not out[holder]]
    if not kept:
        return ""
    blocks, links, size = [parser.blocks[i] for i in kept], links[kept], size[kept]
    holder = np.array([h for _, _, h in blocks])
    ratio = text_to_tag(blocks)
    chosen = _two_means(smoothed(ratio))
    inside = _named(tree, blocks, holder, chosen | _two_means(ratio), size)  # on a page of few blocks smoothing hides some
    if inside is None:
        inside = _unnamed(tree, blocks, holder, chosen, links)
    return " ".join([t for (t, _, _), keep in zip(blocks, inside, strict=True) if keep])


def _within(tree: _Tree, holder: np.ndarray, region: int) -> np.ndarray:
    """Whether each block lies in the element."""
    return (holder >= region) & (holder <= tree.last[region])


def _named(tree: _Tree, blocks: list[tuple[str, int, int]], holder: np.ndarray, chosen: np.ndarray, size: np.ndarray) -> np.ndarray | None:
    """The blocks in the article elements of content text, of several also what is between them in
    main, and a heading right before; None if they hold less than a third of such text."""
    weight = size * chosen
    mass = tree.mass(blocks, weight)
    articles = [n for n in tree.outermost(("article",)) if mass[n] > 0]
    mains = [n for n in tree.outermost(("main",)) if mass[n] > 0]
    if sum(mass[n] for n in articles) >= mass[-1] / 3:
        around = [m for m in mains if sum(m <= n <= tree.last[m] for n in articles) > 1]
        regions = around + [n for n in articles if not any(m <= n <= tree.last[m] for m in around)]
    elif sum(mass[n] for n in mains) >= mass[-1] / 3:
        regions = mains
    else:
        return None
    inside = np.zeros(len(blocks), bool)
    for n in regions:
        inside |= _within(tree, holder, n)
    heading = [h >= 0 and tree.names[h] in _HEADINGS for h in holder]
    first = int(np.flatnonzero(inside)[0])
    if not any(h and x for h, x in zip(heading, inside, strict=True)):
        while first and heading[first - 1]:
            first -= 1
            inside[first] = True
    return inside


def _unnamed(tree: _Tree, blocks: list[tuple[str, int, int]], holder: np.ndarray, chosen: np.ndarray, links: np.ndarray) -> np.ndarray:
    """The blocks of the smallest element that holds all content text, links aside, and what stands
    beside that."""
    core = np.flatnonzero(chosen & ~links)
    if not len(core):
        core = np.flatnonzero(chosen)
    inside = np.zeros(len(blocks), bool)
    inside[core[0] : core[-1] + 1] = True
    count = np.zeros(len(blocks))
    count[core] = 1
    held = tree.mass(blocks, count)
    around = [n for n, k in enumerate(held[:-1]) if k == len(core) and tree.names[n] in SCOPE - {"html", "body"} | {"td"}]
    if around:
        inside |= _within(tree, holder, max(around))
    here = np.flatnonzero(inside)
    for edge, step in ((here[0], -1), (here[-1], 1)):
        _extend(inside, links, int(edge), step)
    return inside


def _extend(inside: np.ndarray, links: np.ndarray, edge: int, step: int) -> None:
    """Blocks beyond the edge are inside too, up to two blocks of links in a row or links at the end:
    one between others, such as a byline, is part of the text."""
    at = edge + step
    while 0 <= at < len(links):
        if links[at] and not (0 <= at + step < len(links) and not links[at + step]):
            break
        inside[at] = True
        at += step


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text string, n_chars long.

    Character references are decoded, white space in a block is one space, blocks are joined in
    page order by one space. Null and empty pages and such without content give ''. Whole pages of
    any length are parsed; null and repeated page_ids keep their rows; other columns are left
    behind; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, "html", 4 << 20):
            texts = [extract(h or "") for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pick(pages, page_id="long", url="string", html="string").mapInArrow(run, "page_id long, url string, text string, n_chars long")

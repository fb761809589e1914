"""Text units of web pages: leaf elements, content scope, chunks, sections and links.

One pass of the standard library's parser over each page, in Arrow batches; all that follows (skip
reasons, packing, rollups) is native columns over the rows that it returns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.operators.runs import element_skip_reason, pack_units, unit_skip_reason

# fixed values: element names that candidates, headings and body text have
BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 li td th blockquote figcaption summary header footer main section article aside div table tr ul ol".split())
INLINE = frozenset("a button label option span q".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
BODY = frozenset("p li td th blockquote figcaption".split())
CODE = frozenset("pre code script style".split())
STRIPPED = frozenset("sup script style".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BOILERPLATE = frozenset("nav header footer aside".split())
SCOPES = ("article", "main", "#content", "#mw-content-text", "body")
_IMPLIED = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
_LIST_ENDS = {"li": {"ul", "ol"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "option": {"select"}}
_BLANK = re.compile(r"\n[ \t]*\n[ \t\n]*")
_BLANK_END = re.compile(r"\n[ \t]*\n[ \t\n]*$")


@dataclass
class Element:
    tag: str
    parent: int
    code: bool
    opted_out: bool
    pinned: bool
    hidden: bool
    boilerplate: bool
    id: str = ""
    children: list = field(default_factory=list)  # element numbers, texts, or None for a line break
    has_block: bool = False


class Page(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements = [Element("#root", -1, False, False, False, False, False)]
        self.open = [0]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        ends = _IMPLIED.get(tag, set()) | ({"p"} if tag in BLOCK else set())
        stop = _LIST_ENDS.get(tag, set())
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.elements[self.open[depth]].tag
            if name in ends:
                del self.open[depth:]
                break
            if name in stop or name in ("div", "article", "section", "main", "body", "td", "table"):
                break
        up = self.elements[self.open[-1]]
        if tag == "br":
            up.children.append(None)
        if tag in VOID:
            return
        a = {k: v or "" for k, v in attrs}
        pinned = a.get("translate") == "no" or "notranslate" in a.get("class", "").split()
        hidden = a.get("aria-hidden") == "true"
        n = len(self.elements)
        self.elements.append(
            Element(tag, self.open[-1], up.code or tag in CODE, up.opted_out or pinned or hidden, pinned, hidden, up.boilerplate or tag in BOILERPLATE, a.get("id", ""))
        )
        up.children.append(n)
        self.open.append(n)
        if tag in BLOCK:
            at = self.elements[n].parent
            while at > 0 and not self.elements[at].has_block:
                self.elements[at].has_block = True
                at = self.elements[at].parent

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.elements[self.open[depth]].tag == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        self.elements[self.open[-1]].children.append(data)

    def text(self, n: int) -> str:
        out, todo = [], [n]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x is not None:
                todo += reversed(self.elements[x].children)
        return "".join(out)

    def scope(self) -> int:
        """The first element of the scope list that holds text; the whole page without any."""
        for want in SCOPES:
            for n, e in enumerate(self.elements):
                if (want[0] == "#" and e.id == want[1:] or e.tag == want) and self.text(n).strip():
                    return n
        return 0

    def within(self, n: int, scope: int) -> bool:
        while n > scope:
            n = self.elements[n].parent
        return n == scope

    def leaves(self) -> list[int]:
        """Blocks without a block inside, then inline candidates that no such block holds."""
        blocks = [n for n, e in enumerate(self.elements) if e.tag in BLOCK and not e.has_block]
        leaf = set(blocks)
        lone = []
        for n, e in enumerate(self.elements):
            at = e.parent
            while e.tag in INLINE and at > 0 and at not in leaf:
                at = self.elements[at].parent
            if e.tag in INLINE and at <= 0:
                lone.append(n)
        return blocks + lone

    def chunks(self, n: int, own: frozenset[int] = frozenset()) -> list[list[tuple[str, bool, bool]]]:
        """Text nodes (text, nested, pinned) of an element, cut at line breaks and blank lines;
        empty chunks are kept. Elements that are units themselves and hidden parts are left out."""
        out: list[list[tuple[str, bool, bool]]] = [[]]

        def visit(at: int, pinned: bool) -> None:
            for c in self.elements[at].children:
                if c is None:
                    out.append([])
                elif isinstance(c, str):
                    cuts = [m.end() for m in _BLANK.finditer(c)]
                    for a, b in zip([0, *cuts], [*cuts, len(c)]):
                        if a < b:
                            out[-1].append((c[a:b], at != n, pinned))
                            if b in cuts:
                                out.append([])
                elif c not in own:
                    e = self.elements[c]
                    if pinned or e.pinned:
                        visit(c, True)
                    elif not (e.hidden or e.tag in STRIPPED):
                        visit(c, False)

        visit(n, False)
        return out


def joined_chunks(chunks: list[str], raws: list[str]) -> str:
    """Chunks joined by a line break, or a blank line where the raw text had one."""
    return "".join(c if i == 0 else ("\n\n" if _BLANK_END.search(raws[i - 1]) else "\n") + c for i, c in enumerate(chunks))


def plain_and_links(html: str) -> tuple[str, list[dict[str, str]]]:
    """Text without tags and the anchors (text, url) in it; what has no anchor is passed through."""
    if "<a" not in html:
        return html.strip(), []
    page = Page(html)
    links = []

    class Anchors(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag == "a":
                links.append({"text": "", "url": dict(attrs).get("href") or ""})
                self.inside = True

        def handle_endtag(self, tag):
            if tag == "a":
                self.inside = False

        def handle_data(self, data):
            if getattr(self, "inside", False):
                links[-1]["text"] += data

    a = Anchors()
    a.feed(html)
    a.close()
    return page.text(0).strip(), links


_UNITS = (
    "page_id long, el long, pos long, tag string, in_code boolean, opted_out boolean, boilerplate boolean, in_scope boolean, el_text string, "
    "chunk int, raw string, pinned boolean"
)


def page_units(pages: DataFrame) -> DataFrame:
    """One row per chunk of each leaf element of pages (page_id, html), with its place, flags and
    raw text; pos is document order. Null html has no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(html or "")
                scope, leaves = page.scope(), page.leaves()
                own = frozenset(leaves)
                for pos, n in enumerate(sorted(leaves)):
                    e = page.elements[n]
                    for k, nodes in enumerate(page.chunks(n, own - {n})):
                        raw = "".join(t for t, _, _ in nodes)
                        pinned = bool(nodes) and all(p for _, _, p in nodes)
                        rows.append((page_id, n, pos, e.tag, e.code, e.opted_out, e.boilerplate, page.within(n, scope), page.text(n), k, raw, pinned))
            if rows:
                names = [c.split()[0] for c in _UNITS.split(", ")]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.bool_()] * 4, pa.string(), pa.int32(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, _UNITS)


def with_reasons(units: DataFrame, document: bool = False) -> DataFrame:
    """units with the reason each is skipped for, null if it is sent."""
    element = element_skip_reason(F.col("el_text"), F.col("in_code"), F.col("opted_out"))
    unit = unit_skip_reason(F.col("raw"))
    if document:
        tag = F.when(F.col("tag").isin(*HEADING), "section-heading").when(~F.col("tag").isin(*BODY), "not-document-body-tag")
        return units.withColumn("reason", F.coalesce(tag, element, unit, F.when(F.col("pinned"), "all-text-pinned")))
    return units.withColumn("reason", F.coalesce(element, unit))


def section_groups(units: DataFrame, most: int = 512) -> DataFrame:
    """Groups of what is sent in document mode: sections begin at headings, each is packed in order."""
    from prosemill.functions.normalise import with_full_stop
    from prosemill.functions.text import collapsed
    from prosemill.operators.runs import section_numbers

    rows = with_reasons(units, document=True).withColumn("at", F.col("pos") * 100_000 + F.col("chunk"))
    rows = section_numbers(rows, "page_id", "at", F.col("tag").isin(*HEADING) & (F.col("chunk") == 0)).where("in_scope and reason is null")
    rows = rows.withColumn("key", F.struct("page_id", "section")).withColumn("text", with_full_stop(collapsed(F.col("raw"))))
    packed = pack_units(rows, "key", "at", "text", most)
    return packed.select("key.page_id", "key.section", F.col("at").cast("long").alias("at"), "tokens", "group_no")

"""Text blocks of HTML pages: a tolerant tag tree, read in Arrow batches."""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the HTML standard: elements without an end tag, elements within a line, elements whose content is no text,
# and which open elements a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template svg iframe object select textarea".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table html body article section main div td th".split())

#: Elements that say what stands in them; a block's area is the innermost of these that is open.
AREAS = frozenset("nav header footer aside form menu main article dialog".split())

BLOCK = "struct<tag: string, area: string, text: string, words: int, link_words: int, tags: int>"
PAGE = f"struct<title: string, blocks: array<{BLOCK}>>"
_PAGE_TYPE = pa.struct([("title", pa.string()), ("blocks", pa.list_(pa.struct([("tag", pa.string()), ("area", pa.string()), ("text", pa.string()), ("words", pa.int32()), ("link_words", pa.int32()), ("tags", pa.int32())])))])

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*(?:>|\Z))""", re.DOTALL)


class _Tree:
    """The open elements, and the blocks of text that have been closed. Every element is opened and closed once, so a page takes time in proportion to its length."""

    def __init__(self):
        self.open: list[str] = []
        self.outer: list[str] = []  # of the open elements those that aren't inline
        self.areas: list[str] = []
        self.count: Counter[str] = Counter()
        self.title: list[str] = []
        self.blocks: list[dict] = []
        self.parts: list[str] = []
        self.linked = self.tags = 0

    def text(self, raw: str) -> None:
        if self.count["title"]:
            self.title.append(raw)
        else:
            self.parts.append(raw)
            if self.count["a"]:
                self.linked += len(html.unescape(raw).split())

    def flush(self) -> None:
        """Ends a block, if there is any text in it."""
        words = html.unescape("".join(self.parts)).split()
        if words:
            found = self.outer[-1] if self.outer else "", self.areas[-1] if self.areas else "", " ".join(words), len(words), min(self.linked, len(words)), self.tags
            self.blocks.append(dict(zip(("tag", "area", "text", "words", "link_words", "tags"), found, strict=True)))
        self.parts, self.linked, self.tags = [], 0, 0

    def close(self, upto: int) -> None:
        while len(self.open) > upto:
            tag = self.open.pop()
            self.count[tag] -= 1
            if tag not in INLINE:
                self.outer.pop()
            if tag in AREAS:
                self.areas.pop()

    def start(self, tag: str, closed: bool) -> None:
        if tag in INLINE:
            self.tags += 1
            if tag == "br":
                self.parts.append(" ")
        else:
            self.flush()
            ended = ENDS.get(tag, frozenset()) | {"p"}
            if any(self.count[t] for t in ended):
                first = len(self.open)
                for i in range(len(self.open) - 1, -1, -1):
                    if self.open[i] in ended:
                        first = i
                    elif self.open[i] in SCOPE:
                        break
                self.close(first)
        if tag not in VOID and not closed:
            self.open.append(tag)
            self.count[tag] += 1
            if tag not in INLINE:
                self.outer.append(tag)
            if tag in AREAS:
                self.areas.append(tag)

    def end(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        if self.count[tag]:
            self.close(len(self.open) - 1 - self.open[::-1].index(tag))


def parse_page(page: str | None) -> dict:
    """Title and blocks of a page. A block is the text between two tags that aren't inline, with its white space reduced to single blanks.

    Start tags end what they can't stand in, end tags without a start are
    ignored, and whatever is open at the end of the page is ended there; so
    any text is a page. Scripts and other elements whose content isn't text
    are left out up to their end tag, or up to the end of the page.
    """
    tree, page, at, lower = _Tree(), page or "", 0, None
    while at < len(page):
        found = _TAG.search(page, at)
        if not found:
            break
        if found.start() > at:
            tree.text(page[at : found.start()])
        at = found.end()
        if tag := (found[2] or "").lower():
            if found[1]:
                tree.end(tag)
                continue
            closed = found[3].endswith("/>")
            if tag in RAW and not closed:
                tree.flush()
                lower = page.lower() if lower is None else lower
                at = lower.find(f"</{tag}", at)
                at = len(page) if at < 0 else at
            else:
                tree.start(tag, closed)
    if at < len(page):
        tree.text(page[at:])
    tree.flush()
    return {"title": " ".join(html.unescape("".join(tree.title)).split()), "blocks": tree.blocks}


def page_blocks(page: Column) -> Column:
    """Struct of title and blocks (tag, area, text, words, link_words, tags) of HTML text, as ``parse_page`` tells; null and empty pages have no blocks and an empty title. Pages of any length are read whole."""

    def parse(column: pa.Array) -> pa.Array:
        return pa.array([parse_page(p) for p in column.to_pylist()], _PAGE_TYPE)

    return F.arrow_udf(parse, PAGE)(page)

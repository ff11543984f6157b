"""Main text of HTML pages by two passes of block rules."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.rules import STOP_WORDS
from corpusloom.session import pick, table

# How HTML elements are read.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "select", "object", "canvas", "audio", "video"}
ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "head", "label", "datalist"}
MAIN = {"article", "main"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd",
    "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "link", "meta",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Elements that a new block element of the same kind closes; they never hold a section.
LEAVES = {"p", "li", "dt", "dd", "td", "th", "tr", "option", "h1", "h2", "h3", "h4", "h5", "h6", "thead", "tbody", "tfoot"}
ASIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|cookie|cookies|consent|gdpr|notice|notices|alert"
    r"|sidebar|side-bar|side|widget|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|pagination|pager|footer|foot|header|masthead|topbar|toolbar"
    r"|comment|comments|disqus|respond|reply|replies|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|popup|modal|overlay|copyright)(?:$|[\s_-])",
    re.I,
)
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "alertdialog"}

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TAG_STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
SPACE = re.compile(r"\s+")
EDGE = re.compile(r"^\W+|\W+$")
STOP = frozenset(STOP_WORDS)

GOOD, NEAR, SHORT, LINKED, POOR, BAD = "good", "near", "short", "linked", "poor", "bad"


@dataclass(frozen=True)
class Limits:
    """Bounds of the first pass: words, shares of stop words among words and of link text among characters.

    A corpus in languages without listed stop words sets both stop bounds to 0: length and links then decide.
    """

    short_words: int = 10
    long_words: int = 30
    stop_low: float = 0.12
    stop_high: float = 0.2
    most_links: float = 0.4
    most_links_short: float = 0.2


@dataclass
class Block:
    section: int
    main: bool
    aside: bool
    named: bool  # its element's, or only a surrounding element's, class or id is that of an aside
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    text: str = ""
    label: str = SHORT
    own_name: bool = False  # the name is the block's own, which holds nothing else


class Section(NamedTuple):
    """An open element that holds blocks; `named` if it, or one around it, is an aside by its class or id only."""

    tag: str
    number: int
    main: bool
    aside: bool
    named: bool


def _aside_by(tag: str, attributes: str) -> str | None:
    """'tag' if an element's tag, role or style takes it out of the text, 'name' if its class or id does."""
    if tag in ASIDE:
        return "tag"
    found = None
    for name, value in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return "tag"
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return "tag"
        if name == "role" and value.lower() in ASIDE_ROLES:
            return "tag"
        if name in ("class", "id") and ASIDE_NAMES.search(value):
            found = "name"
    return found


class Scanner:
    """Splits a page into text and tags in one pass. What is searched for in vain once is not searched for again, so time is linear."""

    def __init__(self, page: str) -> None:
        self.page, self.gone, self.loose = page, set(), False

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """Place of the > that ends a tag, outside its quoted values; in a page with open quotes the next > at all."""
        place = at
        while not self.loose:
            m = TAG_STOP.search(self.page, place)
            if m and m[0] == ">":
                return m.start()
            place = self.find(m[0], m.end()) + 1 if m else 0
            if not place:
                self.loose = True
        return self.find(">", at)

    def raw_end(self, tag: str, at: int) -> int:
        """Place behind the end tag of an element whose content is no markup, -1 if there is none."""
        if tag in self.gone:
            return -1
        m = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self.page, at)
        if not m:
            self.gone.add(tag)
        return m.end() if m else -1

    def pieces(self) -> Iterator[tuple[str, str, bool, str]]:
        """(text, '', ..) and ('', tag in lower case, closing, attributes) in page order."""
        page, at, end = self.page, 0, len(self.page)
        start = 0  # of the text that was not given yet
        while at < end:
            here = self.find("<", at)
            if here < 0:
                break
            after, text = here + 1, None
            if page.startswith("<!--", here):
                stop = self.find("-->", here + 4)
                after = stop + 3 if stop >= 0 else end
            elif page.startswith("<![CDATA[", here) and (stop := self.find("]]>", here)) >= 0:
                text, after = page[here + 9 : stop], stop + 3
            elif page.startswith(("<!", "<?"), here) and (stop := self.find(">", here)) >= 0:
                after = stop + 1
            else:
                closing = page.startswith("</", here)
                name = NAME.match(page, here + 1 + closing)
                stop = self.tag_end(name.end()) if name else -1
                if stop < 0:
                    at = here + 1  # a < that begins nothing is text
                    continue
                if here > start:
                    yield html.unescape(page[start:here]), "", False, ""
                tag, attributes = name[0].lower(), page[name.end() : stop]
                at = start = stop + 1
                if tag in RAW and not closing:
                    behind = -1 if attributes.endswith("/") else self.raw_end(tag, at)
                    if behind >= 0 or (tag in ("script", "style") and not attributes.endswith("/")):
                        at = start = behind if behind >= 0 else end
                    continue
                yield "", tag, closing, attributes
                continue
            if here > start:
                yield html.unescape(page[start:here]), "", False, ""
            if text:
                yield text, "", False, ""
            at = start = after
        if start < end:
            yield html.unescape(page[start:]), "", False, ""


class Open:
    """The open elements that hold blocks, indexed by tag: closing one, or finding none to close, takes constant time."""

    def __init__(self) -> None:
        self.stack = [Section("", 0, False, False, False)]
        self.places: dict[str, list[int]] = {}

    def push(self, section: Section) -> None:
        self.places.setdefault(section.tag, []).append(len(self.stack))
        self.stack.append(section)

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()

    def close(self, tag: str) -> None:
        if places := self.places.get(tag):
            self.cut(places[-1])


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order. Elements that are left open end with what holds them.

    What an aside holds is aside, also an article; a main element undoes asides that are so by
    their names only, which then are names of a layout. Every aside and every article is a
    section of its own, and what follows it belongs to the section around it again.
    """
    found: list[Block] = []
    open_ = Open()
    sections, links, breaks = 0, 0, 0
    block = Block(0, False, False, False)

    def close() -> None:
        nonlocal block, breaks
        block.text = SPACE.sub(" ", "".join(block.parts)).strip()
        if block.text:
            found.append(block)
        top = open_.stack[-1]
        block, breaks = Block(top.number, top.main, top.aside, top.named), 0

    for text, tag, closing, attributes in Scanner(page).pieces():
        if text:
            block.parts.append(text)
            if links:
                block.link_chars += len(text.strip())
            if not text.isspace():
                breaks = 0
        elif tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            breaks += 1
            block.parts.append(" ")
            if breaks > 1:
                close()
        elif tag in INLINE or (tag in RAW and closing):
            continue
        elif tag in LEAVES or tag in VOID or attributes.endswith("/"):
            links = 0
            close()
            if not closing and tag in LEAVES and (why := _aside_by(tag, attributes)):
                block.aside |= why == "tag"
                block.own_name = why == "name"
        else:
            links = 0
            top = open_.stack[-1]
            if closing:
                open_.close(tag)
            elif tag in ("html", "body"):
                open_.cut(1)
            else:
                if tag == "main":
                    while top.named and not top.aside:
                        open_.cut(len(open_.stack) - 1)
                        top = open_.stack[-1]
                why = _aside_by("" if tag in MAIN else tag, attributes) or ("tag" if tag == "header" and not top.main else None)
                main, aside, named = top.main or tag in MAIN, top.aside or why == "tag", top.named or why == "name"
                own = tag in MAIN or (aside, named) != (top.aside, top.named)
                sections += own
                open_.push(Section(tag, sections if own else top.number, main, aside, named))
            close()
    close()
    return found


def first_pass(block: Block, limits: Limits, stop_words: frozenset[str]) -> str:
    """Class of a block by itself: its length, share of stop words and share of link text."""
    words = block.text.split()
    links = block.link_chars / max(1, len(block.text))
    if len(words) < limits.short_words:
        return LINKED if links > limits.most_links_short else SHORT
    if links > limits.most_links:
        return BAD
    stops = sum(EDGE.sub("", w).lower() in stop_words for w in words) / len(words)
    if stops >= limits.stop_high and len(words) > limits.long_words:
        return GOOD
    return NEAR if stops >= limits.stop_low else POOR


def classify(blocks: list[Block], limits: Limits = Limits(), stop_words: frozenset[str] = STOP) -> None:
    """Set the blocks' labels to good or bad.

    First pass: every block gets a class by its length, stop-word and link density alone, and
    dense prose is good. Elements that are asides by their tag, role or style are bad. A class or
    an id that names an aside is a layout's where all prose of the page is dense prose under such
    names; and a block that is named itself, as a paragraph, stays if it is dense prose.
    What is not decided then is moved by its container: where a page has an article, near-good
    prose in it is good and poor blocks are open; outside it near-good prose and short blocks are
    bad, and dense prose is open, as the article is what is asked for.
    Second pass: a block that is still open takes the label of the nearest decided block of its
    section, near-good prose that of either side that is good; at a tie good counts. Where
    nothing near is decided, near-good prose is good, and a short block is good if it stands in
    the article. A short block of links is bad, and speaks for its neighbours only outside an article.
    """
    for b in blocks:
        b.label = BAD if b.aside else first_pass(b, limits, stop_words)
    prose_outside = any(not b.aside and not b.named and (b.main or b.label in (GOOD, NEAR)) for b in blocks)
    if prose_outside or not any(b.named and b.label == GOOD for b in blocks):
        for b in blocks:
            if b.named or (b.own_name and b.label != GOOD):
                b.label, b.aside = BAD, True
    article = any(b.main and not b.aside for b in blocks)
    inside, outside = {NEAR: GOOD, POOR: SHORT}, {GOOD: NEAR, NEAR: BAD, SHORT: BAD}
    for b in blocks:
        if article and not b.aside:
            b.label = (inside if b.main else outside).get(b.label, b.label)
        if b.label == POOR or (b.label == LINKED and not b.main) or ("©" in b.text and not b.main):
            b.label = BAD
    sections: dict[int, list[Block]] = {}
    for b in blocks:
        sections.setdefault(b.section, []).append(b)
    for held in sections.values():
        decided = [b.label if b.label in (GOOD, BAD) else None for b in held]
        before, after = _nearest(decided, 1), _nearest(decided, -1)
        for i, b in enumerate(held):
            if decided[i] or b.label == LINKED:
                b.label = decided[i] or BAD
                continue
            near = [(abs(i - j), decided[j]) for j in (before[i], after[i]) if j is not None]
            if not near:
                b.label = GOOD if b.main or (b.label == NEAR and not article) else BAD  # the container decides last
            elif b.label == NEAR:
                b.label = GOOD if any(x[1] == GOOD for x in near) else BAD
            else:
                b.label = max(near, key=lambda x: (-x[0], x[1] == GOOD))[1]


def _nearest(decided: list[str | None], step: int) -> list[int | None]:
    """Place of the nearest decided block of a section, seen in the direction of step."""
    last: int | None = None
    out: list[int | None] = [None] * len(decided)
    for i in range(len(decided))[::step]:
        out[i] = last
        if decided[i]:
            last = i
    return out


def main_text(page: str | None, limits: Limits = Limits(), stop_words: frozenset[str] = STOP) -> str:
    """The good blocks of a page, each on a line of its own; '' for null or empty."""
    if not page:
        return ""
    blocks = blocks_of(page)
    classify(blocks, limits, stop_words)
    return "\n".join(b.text for b in blocks if b.label == GOOD)


def extract(pages: DataFrame, limits: Limits = Limits(), stop_words: frozenset[str] = STOP) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row of pages; each page by itself.

    Null and empty html give an empty text. Repeated pages and pages without id or url are
    extracted each. Pages are read whole whatever their length, in time that grows with it.
    Ties between neighbours count as good. Columns other than page_id, url and html are not
    read, whatever they are called. An empty table gives an empty table.
    """

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [main_text(h, limits, stop_words) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": found, "n_chars": [len(t) for t in found]})

    narrow = pick(pages, "page_id", "url", "html")
    return narrow.mapInPandas(texts, f"page_id {narrow.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    # No SQL: blocks and densities; tests compare with an independent reading of every page.
    return extract(table(spark, sf_dir, "pages"))

"""Jobs over tables of web pages: links, fields, tables, listings, board and FAQ rows."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusloom.functions.dates import normalize_date
from corpusloom.session import pick

MOST_ROWS, MOST_COLS = 100, 30  # bounds of a cell's spans
FILES = re.compile(r"\.(pdf|hwp|hwpx|docx?|xlsx?|zip)(?:$|\?)", re.I)
DOWNLOADS = re.compile(r"download\.do|fileDown\.do|\.(?:pdf|hwp|hwpx)(?:\?|$)", re.I)
BOARD = re.compile(r"/bbs/[^/]+/\d+/(?:artclList|\d+/artclView)\.do")
MENU = {"nav", "menu"}
MOST_DEEP = 512  # levels of a page's tree
ENDS_ITS_LIKE = {"li", "tr", "td", "th", "dt", "dd", "p", "option", "a"}
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
UNREAD = {"script", "style", "nav", "input", "button", "select"}
BLOCKS = {"p", "div", "li", "ul", "ol", "dl", "dt", "dd", "tr", "td", "th", "table", "section", "article", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "br", "header", "footer", "main", "body"}


# Markup that every reader of HTML takes alike: text, end tags, start tags with plain attributes, comments and the document type.
_ATTR = r"""[ \t\n]+([a-zA-Z_][a-zA-Z0-9_-]*)(?:=("[^"&<>]*"|'[^'&<>]*'|[a-zA-Z0-9_]+(?=[ \t\n>]|\Z)))?(?=[ \t\n/>]|\Z)"""
_ATTRS = re.compile(_ATTR)
_TAG = re.compile(r"(<[^<>]*>)")
_PLAIN = re.compile(rf"""</([a-zA-Z][a-zA-Z0-9]*)[ \t\n]*>|<([a-zA-Z][a-zA-Z0-9]*)((?:{re.sub(r"\((?![?])", "(?:", _ATTR)})*)[ \t\n]*(/?)>|<!--[a-zA-Z0-9 .,_]*-->|<!(?:DOCTYPE|doctype) [a-zA-Z]+>""")
_ONE = re.compile(r"""<([a-z][a-z0-9]*) ([a-z]+)=("[^"&<>]*"|'[^'&<>]*')>""")  # a start tag of one attribute: the most that pages do not repeat, as addresses
RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes", "plaintext"}  # what stands in them may be no markup
READ_ALIKE = {"script", "style", "textarea", "title"}  # every version of the parser leaves references in the first two, and decodes them in the others


@lru_cache(maxsize=4096)  # pages repeat most of their tags
def _tag(piece: str) -> tuple[str | None, str | None, dict[str, str], bool, bool] | None:
    """What one tag closes or opens, its attributes, whether it ends itself and whether it stays open; a comment does nothing. None if it is not plain."""
    if m := _ONE.fullmatch(piece):
        return None, m[1], {m[2]: m[3][1:-1]}, False, m[1] not in EMPTY
    m = _PLAIN.fullmatch(piece)
    if m is None:
        return None
    closed, tag, attrs, empty = m.groups()
    pairs = {k.lower(): v[1:-1] if v[:1] in ("'", '"') else v for k, v in _ATTRS.findall(attrs)} if attrs else {}
    tag = tag and tag.lower()
    return closed and closed.lower(), tag, pairs, bool(empty), not empty and tag not in EMPTY


class Page(list):
    """All elements of a page in its order, and, once its tree is built, those of every tag, and of every id (with a #) and class."""

    __slots__ = ("names", "tags")

    def tagged(self, tag: str) -> list[Node]:
        try:
            tags = self.tags
        except AttributeError:
            tags = self.tags = {}
            for node in self:
                if (same := tags.get(node.tag)) is None:
                    tags[node.tag] = [node]
                else:
                    same.append(node)
        return tags.get(tag, [])

    def named(self, name: str) -> list[Node]:
        try:
            names = self.names
        except AttributeError:
            names = self.names = {}
            for node in self:
                if attrs := node.attrs:
                    if own := attrs.get("id"):
                        names.setdefault("#" + own, []).append(node)
                    if own := attrs.get("class"):
                        for c in dict.fromkeys(own.split()):
                            if c[0] != "#":
                                names.setdefault(c, []).append(node)
        return names.get(name, [])


@dataclass(eq=False, slots=True)
class Node:
    """An element. `page` holds all elements in the order of the page; those from `at` to `stop` are the node and what is in it."""

    tag: str
    attrs: dict[str, str]
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)
    depth: int = 0
    page: Page = field(default_factory=Page, repr=False)
    at: int = 0
    stop: int = 0

    def walk(self) -> list[Node]:
        return self.page[self.at : self.stop]

    def all(self, *tags: str) -> list[Node]:
        if len(tags) == 1:
            return [n for n in self.page.tagged(tags[0]) if self.at <= n.at < self.stop]
        return [n for n in self.page[self.at : self.stop] if n.tag in tags]

    def rows(self) -> list[Node]:
        """A table's own rows, without those of tables inside it."""
        found, stack = [], [self]
        while stack:
            node = stack.pop()
            if node.tag == "tr" and node is not self:
                found.append(node)
            else:
                stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and c.tag != "table")
        return found

    def marked(self, name: str) -> list[Node]:
        """Nodes of a class, or of an id if the name begins with #."""
        return [n for n in self.page.named(name) if self.at <= n.at < self.stop]

    def up(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def text(self) -> str:
        if self.stop == self.at + 1:  # no element in it
            return "".join(self.children) if self.tag not in ("script", "style") else ""
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in ("script", "style"):
                stack.extend(reversed(node.children))
        return "".join(out)


class _Builder(HTMLParser):
    """A tree of a page. Open elements are indexed by tag, so that closing one, or finding that none is open, takes constant time.

    As in browsers the tree is at most MOST_DEEP levels deep: what is nested deeper hangs beside
    its parent there, in the order of the page, while end tags still close what they belong to.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = Page()
        self.root = Node("", {}, page=self.nodes)
        self.nodes.append(self.root)
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}  # where elements of a tag stand among the open ones

    def _last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else 0

    def _close(self, place: int) -> None:
        while len(self.open) > place:
            self.places[self.open.pop().tag].pop()

    def _add(self, tag: str, attrs: dict[str, str]) -> Node:
        host = self.open[-1]
        if host.depth >= MOST_DEEP:
            host = host.parent
        node = Node(tag, attrs, host, [], host.depth + 1, self.nodes, len(self.nodes))
        host.children.append(node)
        self.nodes.append(node)
        return node

    def _start(self, tag: str, attrs: dict[str, str]) -> None:
        places = self.places.setdefault(tag, [])
        if places and tag in ENDS_ITS_LIKE:  # a new one ends one that was left open
            if places[-1] > max(map(self._last, ("ul", "ol", "dl", "table"))):
                self._close(places[-1])
        node = self._add(tag, attrs)
        if tag not in EMPTY:
            places.append(len(self.open))
            self.open.append(node)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._start(tag, {k: v or "" for k, v in attrs})

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._add(tag, {k: v or "" for k, v in attrs})

    def handle_endtag(self, tag: str) -> None:
        if places := self.places.get(tag):
            if places[-1] == len(self.open) - 1:
                self.open.pop()
                places.pop()
            else:
                self._close(places[-1])

    def handle_data(self, data: str) -> None:
        at = self.open[-1]
        (at if at.depth < MOST_DEEP else at.parent).children.append(data)

    def plain(self, html: str) -> bool:
        """Reads a page by one pattern, much faster than the parser; False if some of it is not plain markup.

        Does what _start, handle_endtag and handle_data do, in one loop: calls would take most of the time.
        """
        nodes, opened, all_places = self.nodes, self.open, self.places
        pieces, raw, top = iter(_TAG.split(html)), None, opened[-1]  # a text, a tag, a text and so on
        host, deepest = top, MOST_DEEP
        for text in pieces:
            if text:
                if "<" in text or (raw and "&" in text and raw not in READ_ALIKE):
                    return False
                if "&" in text and raw not in ("script", "style"):
                    text = unescape(text)
                host.children.append(text)
            if (piece := next(pieces, None)) is None:
                break
            if (known := (_tag if len(piece) <= 200 else _tag.__wrapped__)(piece)) is None:
                return False
            closed, tag, attrs, empty, stays = known
            if raw and closed != raw:
                return False
            if closed is not None:
                raw = None
                if places := all_places.get(closed):
                    if places[-1] == len(opened) - 1:
                        opened.pop()
                        places.pop()
                    else:
                        self._close(places[-1])
                    top = opened[-1]
                    host = top if top.depth < deepest else top.parent
            elif tag is not None:
                if tag in RAW:
                    if empty:
                        return False
                    raw = tag
                if not empty:
                    if (places := all_places.get(tag)) is None:
                        places = all_places[tag] = []
                    elif places and tag in ENDS_ITS_LIKE and places[-1] > max(map(self._last, ("ul", "ol", "dl", "table"))):
                        self._close(places[-1])
                        top = opened[-1]
                        host = top if top.depth < deepest else top.parent
                node = Node(tag, attrs, host, [], host.depth + 1, nodes, len(nodes))
                host.children.append(node)
                nodes.append(node)
                if stays:
                    places.append(len(opened))
                    opened.append(node)
                    top = node
                    if node.depth < deepest:
                        host = node
        return not raw

    def tree(self) -> Node:
        for node in reversed(self.nodes):
            if not (stop := node.stop):
                stop = node.stop = node.at + 1
            if (parent := node.parent) is not None and parent.stop < stop:
                parent.stop = stop
        return self.root


def read(html: str | None) -> Node:
    b = _Builder()
    if not b.plain(html or ""):
        b = _Builder()
        b.feed(html or "")
        b.close()
    return b.tree()


# A page's address and a path from its root that urljoin puts together as they stand.
_SITE = re.compile(r"(https?://[a-zA-Z0-9.-]+)/[a-zA-Z0-9_/-]*")
_PATH = re.compile(r"/(?!/)[a-zA-Z0-9_/-]*(?:\.[a-zA-Z]+)?(?:\?[a-zA-Z0-9_=&]+)?")
_site = lru_cache(maxsize=4096)(_SITE.fullmatch)


def _join(url: str, href: str) -> str:
    """urljoin, at once for a plain path from the site's root."""
    if href[:1] == "/" and _PATH.fullmatch(href) and (site := _site(url)):
        return site[1] + href
    return urljoin(url, href)


def _squeeze(text: str) -> str:
    return " ".join(text.split())


def _spaced(node: Node) -> str:
    """A node's texts with a blank between them."""
    if node.stop == node.at + 1:  # no element in it
        return _squeeze(" ".join(node.children)) if node.tag not in ("script", "style") else ""
    return _squeeze(" ".join(c for n in node.walk() if n.tag not in ("script", "style") for c in n.children if isinstance(c, str)))


def cells_of(table: Node) -> list[list[tuple[str, int, int]]]:
    """A table's own rows as cells of text, rows and columns spanned, within their bounds; a table inside a cell is text of the cell."""
    span = lambda c, n, most: min(most, max(1, int(c.attrs[n]))) if c.attrs and c.attrs.get(n, "").strip().isdigit() else 1
    return [
        [(_spaced(c), span(c, "rowspan", MOST_ROWS), span(c, "colspan", MOST_COLS)) for c in row.children if isinstance(c, Node) and c.tag in ("td", "th")]
        for row in table.rows()
    ]


def grid(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """A table's rows as 'a | b', cells repeated over all rows and columns that they span, also beyond the last row; gaps are empty cells."""
    if all(down == right == 1 for row in rows for _, down, right in row):
        width = max(map(len, rows), default=0)
        height = next((y for y in range(len(rows), 0, -1) if rows[y - 1]), 0)
        return [" | ".join([text for text, _, _ in row] + [""] * (width - len(row))) for row in rows[:height]]
    out: dict[tuple[int, int], str] = {}
    width = 0
    for y, row in enumerate(rows):
        x = 0
        for text, down, right in row:
            while (y, x) in out:
                x += 1
            if down == right == 1:
                out[y, x] = text
            else:
                for dy in range(down):
                    for dx in range(right):
                        out[y + dy, x + dx] = text
            x += right
            width = max(width, x)
    height = max((y for y, _ in out), default=-1) + 1
    return [" | ".join(out.get((y, x), "") for x in range(width)) for y in range(height)]


def _part(root: Node) -> None:
    """Breaks a tree's rings, so that its memory is free at once and nothing looks for them."""
    for node in root.page:
        node.parent = node.page = None


def _job(pages: DataFrame, make: Callable[[object, str, Node], list[tuple]], columns: str) -> DataFrame:
    """make(page_id, url, root of the page's tree) for every page, its tuples as rows."""
    narrow = pick(pages, "page_id", "url", "html")
    schema = to_arrow_schema(StructType.fromDDL(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(50_000)  # trees are taken apart, and rows hold no rings: they need not be looked for every 2,000 objects
        for batch in batches:
            rows: list[tuple] = []
            for p, u, h in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                root = read(h)
                rows += make(p, u or "", root)
                _part(root)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return narrow.mapInArrow(run, columns)


def links(pages: DataFrame) -> DataFrame:
    """Every link: page_id, place, href, target (absolute), label, in_menu, menu_path.

    menu_path: of the list items around a link, from the outermost, the label of the link that
    heads each of them.
    """

    def make(page_id: object, url: str, root: Node) -> list[tuple]:
        out = []
        for i, a in enumerate(root.all("a")):
            around = list(a.up())
            heads = [next((c for c in n.children if isinstance(c, Node) and c.tag == "a"), None) for n in reversed(around) if n.tag == "li"]
            path = [_squeeze(h.text()) for h in heads if h is not None]
            href = a.attrs.get("href", "")
            out.append((page_id, i, href, _join(url, href), _squeeze(a.text()), any(n.tag in MENU for n in around), path))
        return out

    return _job(pages, make, "page_id long, place int, href string, target string, label string, in_menu boolean, menu_path array<string>")


def discover(pages: DataFrame, canonical: Callable[[Column], Column], daily: str = "학사일정", days: int = 14) -> DataFrame:
    """An inventory of the pages that menus lead to: url, title, menu_path, kind, interval_days, status.

    A URL is its canonical form, else as it stands, and then left for review. Of several links
    to one URL the one of the deepest path counts, of equally deep ones the first; they are
    compared by a partial aggregate, so that a link that every page has meets nowhere.
    """
    found = links(pages).filter((F.col("href") != "") & (F.size("menu_path") > 0))
    keyed = found.select(canonical(F.col("target")).alias("own"), "target", "label", "menu_path", "page_id", "place")
    order = F.struct((-F.size("menu_path")).alias("depth"), "page_id", "place", "label", "menu_path", F.col("own").isNotNull().alias("known"))
    best = keyed.groupBy(F.coalesce("own", "target").alias("url")).agg(F.min(order).alias("b"))
    interval = F.when(F.array_join("b.menu_path", " ").contains(daily), 1).otherwise(days)
    return best.select("url", F.col("b.label").alias("title"), F.col("b.menu_path").alias("menu_path"), F.lit("guidance").alias("kind"), interval.alias("interval_days"),
                       F.when(F.col("b.known"), "pending").otherwise("external_or_dynamic_review").alias("status"))


@dataclass(frozen=True)
class Layout:
    """Names by which a site's pages mark their parts: classes, or ids with a #."""

    content: str = "#_contentBuilder"
    tabs: str = "#menuUItab"
    contact: str = "wrap-contact"
    hidden: tuple[str, ...] = ("hidden", "sch-guide-layer", "alb-foot")
    diet: str = "#dietInfoArea"
    calendar: str = "#schdulWrap"
    body: str = "txt"


def _visible_lines(node: Node, layout: Layout) -> list[str]:
    """Lines of a node's text; tables row by row, what no reader sees left out."""
    out, line, hidden = [], [], frozenset(layout.hidden)

    def end() -> None:
        if line:
            text = _squeeze("".join(line))
            line.clear()
            if text:
                out.append(text)

    stack: list[Node | str | None] = [*reversed(node.children)]  # None: a block ends
    while stack:
        c = stack.pop()
        if c is None:
            end()
        elif isinstance(c, str):
            line.append(c)
        elif c.tag in UNREAD or (c.attrs and (names := c.attrs.get("class")) and not hidden.isdisjoint(names.split())):
            continue
        elif c.tag == "table":
            end()
            out.extend(r for r in grid(cells_of(c)) if r.strip(" |"))
        else:
            if c.tag in BLOCKS:
                end()
                stack.append(None)
            stack.extend(reversed(c.children))
    end()
    return out


_LINKS = "array<struct<url:string,title:string>>"


def extract_page(pages: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Fields of guidance pages: page_id, title, content, content_status, tabs, boards, attachments, images, related, contact, updated, coverage.

    A page without the content element is read as a whole and has the coverage 'content_missing'.
    Tables are rendered with their spans; board links are named, their listings are not text of
    their own.
    """

    def make(page_id: object, url: str, root: Node) -> list[tuple]:
        found = root.marked(layout.content)
        content = found[0] if found else root
        anchors = [(_join(url, a.attrs["href"]), a.attrs["href"], _squeeze(a.text())) for a in content.all("a") if a.attrs.get("href")]
        tabs = [(_join(url, a.attrs["href"]), _squeeze(a.text())) for t in root.marked(layout.tabs) for a in t.all("a") if a.attrs.get("href")]
        boards = sorted({re.sub(r"/\d+/artclView\.do.*$", "/artclList.do", u).split("?")[0] for u, _, _ in anchors if BOARD.search(u)})
        files = [(u, name) for u, href, name in anchors if DOWNLOADS.search(href)]
        related = [(u, name) for u, href, name in anchors if href.startswith(("http", "/"))]
        images = [(_join(url, i.attrs["src"]), i.attrs.get("alt", "")) for i in content.all("img") if i.attrs.get("src")]
        contact = _squeeze(" ".join(n.text() for n in root.marked(layout.contact)[:1]))
        day = re.search(r"최종 수정일\s*:\s*(\d{4})[.\-/](\d{2})[.\-/](\d{2})", contact)
        coverage = "html_text_with_unextracted_media" if files or images else "html_text_only"
        if content.all("iframe") and not files:
            coverage = "dynamic_content_requires_review"
        if any(n.all("table") for n in content.marked(layout.diet)):
            coverage = "current_week_diet_html"
        elif any(n.marked("sche-comt") or n.marked("box-sch") for n in content.marked(layout.calendar)):
            coverage = "calendar_html"
        text = "\n".join(_visible_lines(content, layout))
        heading = next((_squeeze(h.text()) for h in root.all("h1")), "")
        title = next((t for u, t in tabs if u == url), heading)
        pairs = lambda rows: [{"url": u, "title": t} for u, t in rows]
        return [(page_id, title, text, "text" if text else "empty", pairs(tabs), boards, pairs(files), pairs(images), pairs(related), contact, "-".join(day.groups()) if day else "", coverage if found else "content_missing")]

    columns = f"page_id long, title string, content string, content_status string, tabs {_LINKS}, boards array<string>, attachments {_LINKS}, images {_LINKS}, related {_LINKS}, contact string, updated string, coverage string"
    return _job(pages, make, columns)


def extract_links(pages: DataFrame, layout: Layout = Layout(), viewer: str = "바로보기") -> DataFrame:
    """page_id, body, images (absolute http(s) URLs), attachments (links to downloads with a name, viewer buttons left out)."""

    def make(page_id: object, url: str, root: Node) -> list[tuple]:
        views = [n for n in root.marked("viewCont") if "view" in n.attrs.get("class", "").split()]
        body = next(("".join(x.text().split("\n")).strip() for v in views for x in v.marked(layout.body)), "")
        images = [u for v in views for i in v.all("img") if i.attrs.get("src") and urlsplit(u := _join(url, i.attrs["src"])).scheme in ("http", "https")]
        files = [{"url": _join(url, a.attrs["href"]), "title": name} for a in root.all("a") if "download.do" in a.attrs.get("href", "") and (name := _squeeze(a.text())) and name != viewer]
        return [(page_id, body, images, files)]

    return _job(pages, make, f"page_id long, body string, images array<string>, attachments {_LINKS}")


def fields(pages: DataFrame) -> DataFrame:
    """page_id, heading, n_images, attachments (names of linked files), tables (rendered rows), date, coverage."""

    def make(page_id: object, url: str, root: Node) -> list[tuple]:
        head = next((_squeeze(h.text()) for h in root.all("h1")), "")
        files = [_join(url, a.attrs["href"]) for a in root.all("a") if FILES.search(a.attrs.get("href", ""))]
        rows = [line for t in root.all("table") for line in grid(cells_of(t))]
        body = _squeeze(root.text())
        day = re.search(r"(20\d{2})[.-](\d{1,2})[.-](\d{1,2})", body)
        n_images = sum(bool(i.attrs.get("src")) for i in root.all("img"))
        return [(page_id, head, n_images, files, rows, f"{day[1]}-{int(day[2]):02d}-{int(day[3]):02d}" if day else None, "full" if len(body) >= 80 else "short" if body else "empty")]

    return _job(pages, make, "page_id long, heading string, n_images int, attachments array<string>, tables array<string>, date string, coverage string")


def listing(pages: DataFrame, since: str, article: str = r"https?://[^/]+/bbs/[^/]+/\d+/\d+/artclView\.do|https?://.*") -> DataFrame:
    """Rows of board pages that link to an article and hold a date: page_id, place, url, title, date, pinned, wanted.

    article: pattern that a row's whole URL must match. A row is pinned if it is marked as a
    notice or its first cell is no number.
    """
    whole = re.compile(article)

    def make(page_id: object, url: str, root: Node) -> list[tuple]:
        out = []
        for table in root.all("table"):
            for i, row in enumerate(table.rows()):
                cells = [c for c in row.children if isinstance(c, Node) and c.tag in ("td", "th")]
                texts = [_squeeze(c.text()) for c in cells]
                day = next((m for t in texts if (m := re.fullmatch(r"(20\d{2})[.-](\d{2})[.-](\d{2})\.?", t))), None)
                link = next((a for c in cells for a in c.all("a") if a.attrs.get("href")), None)
                target = _join(url, link.attrs["href"]) if link is not None else url
                if day and len(texts) > 1 and whole.fullmatch(target):
                    date = "-".join(day.groups())
                    pinned = "notice" in row.attrs.get("class", "").split() or not texts[0].isdigit()
                    out.append((page_id, i, target, _squeeze(link.text()) if link is not None else texts[1], date, pinned, date >= since))
        return out

    return _job(pages, make, "page_id long, place int, url string, title string, date string, pinned boolean, wanted boolean")


def reached(rows: DataFrame, since: str) -> DataFrame:
    """Per page whether its regular rows are all older than `since`; pinned rows do not count."""
    latest = F.max(F.when(~F.col("pinned"), F.col("date")))
    return rows.groupBy("page_id").agg(F.coalesce(latest < since, F.lit(False)).alias("reached"))


def board_rows(pages: DataFrame, source: str, category: str, today: Column) -> DataFrame:
    """Notices of board tables with fixed columns (number, title, writer, file, date): id, title, content, source, category, date, url.

    Rows of fewer than five cells, without a titled link, or whose link leads to no article are
    left out. Of several rows of one URL the first stays, by page and place.
    """

    def make(page_id: object, url: str, root: Node) -> list[tuple]:
        out = []
        for i, row in enumerate(root.all("tr")):
            cells = [c for c in row.children if isinstance(c, Node) and c.tag == "td"]
            link = next(iter(cells[1].all("a")), None) if len(cells) >= 5 else None
            title = _squeeze(link.text()) if link is not None else ""
            target = _join(url, link.attrs.get("href", "")) if title else ""
            parts = urlsplit(target)
            if title and parts.scheme in ("http", "https") and "artclView.do" in parts.path:
                out.append((page_id, i, title, _squeeze(cells[2].text()), _squeeze(cells[4].text()), target))
        return out

    rows = _job(pages, make, "page_id long, place int, title string, writer string, day string, url string")
    first = rows.groupBy("url").agg(F.min(F.struct("page_id", "place", "title", "writer", "day")).alias("r")).select("url", "r.*")
    named = F.when(F.col("writer") != "", F.concat(F.lit(f"{source} ("), "writer", F.lit(")"))).otherwise(source)
    return first.select(F.sha2("url", 256).alias("id"), "title", F.col("title").alias("content"), named.alias("source"), F.lit(category).alias("category"), normalize_date(F.col("day"), today).alias("date"), "url")


def _said(node: Node) -> str:
    """Lines of an answer as its source breaks them, with its tables row by row."""
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag == "table" and n is not node:
            out.append("\n".join(grid(cells_of(n))))
        elif n.tag not in ("script", "style"):
            stack.extend(reversed(n.children))
    return "\n".join(filter(None, map(_squeeze, "".join(out).splitlines())))


def faq(pages: DataFrame, prefix: str, category: str = "학사 FAQ", container: str = "faq-list") -> DataFrame:
    """A row for each question that a page answers: id, page_id, url, question, answer, category, total, content_hash.

    Questions are the items of the list in the page's container, with an element `question`, in
    which a `cate-name` names the category, and one `answer`, whose tables are rendered row by
    row; without the container they are the terms and descriptions (dt, dd) of the page. Items
    without either text are left out. `total` is how many pages the list has, as the page says
    (`_totPage`), else 1. The id follows from the question alone, so that it outlives a move.
    """

    def make(page_id: object, url: str, root: Node) -> list[tuple]:
        lists = root.marked(container)
        found = []
        for item in (i for box in lists[:1] for ul in box.children if isinstance(ul, Node) and ul.tag == "ul" for i in ul.children if isinstance(i, Node) and i.tag == "li"):
            asked, told = item.marked("question")[:1], item.marked("answer")[:1]
            if asked and told:
                names = [_squeeze(n.text()) for n in asked[0].marked("cate-name")[:1]]
                found.append((_spaced(asked[0]), _said(told[0]), names[0] if names else category))
        if not lists:
            terms = root.all("dt", "dd")
            found = [(_squeeze(q.text()), _said(a), category) for q, a in zip(terms, terms[1:], strict=False) if q.tag == "dt" and a.tag == "dd"]
        said = [_squeeze(n.text()) for n in root.marked("_totPage")[:1]]
        total = int(said[0]) if said and said[0].isdecimal() else 1
        return [(page_id, url, q, a, c, total) for q, a, c in found if q and a]

    rows = _job(pages, make, "page_id long, url string, question string, answer string, category string, total int")
    return rows.withColumns({"id": F.sha2(F.concat(F.lit(prefix), "question"), 256), "content_hash": F.sha2(F.concat_ws("\n", "question", "answer"), 256)})

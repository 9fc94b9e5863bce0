"""Layout-aware text of HTML pages.

A small tree builder (implied end tags, void and raw-text elements, bounded depth) and a renderer
that keeps what a reader sees: blocks on their own lines, a blank line around paragraphs, list
markers with nesting, preformatted text as it stands, and table cells in aligned columns. Pages are
independent rows, so the work is one narrow pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.llm.encoding import slices, tidy

DEPTH = 200
#: Cells longer than this do not widen their column.
COLUMN_WIDTH = 60
COLUMN_GAP = "  "

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noframes xmp iframe noembed".split())
RCDATA = frozenset("title textarea".split())
UNSEEN = frozenset(
    "head script style noscript template iframe object audio video canvas svg math datalist "
    "noframes noembed title meta link base".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
BLOCK = frozenset(
    "html body address article aside center details dialog dir div dd dt fieldset figcaption "
    "figure footer form header hgroup legend main nav option optgroup search section summary "
    "li tr caption thead tbody tfoot td th".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl blockquote pre table hr".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary "
    "table ul li dd dt".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TABLE_PARTS = frozenset("table caption thead tbody tfoot tr td th".split())
# What a start tag closes, and the elements beyond which it does not look.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "table", "td", "th"}),
    "optgroup": ({"option", "optgroup"}, {"select", "table", "td", "th"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}

_MARKUP = re.compile(r"<(?:(!--)|(/?)([A-Za-z][^\s/>]*)|[!?/])")
_REST_OF_TAG = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(source: str) -> dict[str, str]:
    if not source or source == "/":
        return {}
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        value = next((g for g in m.groups()[1:] if g is not None), "")
        out.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
    return out


class TreeBuilder:
    """Open elements as a stack; elements below ``DEPTH`` become siblings of the deepest one."""

    def __init__(self) -> None:
        self.root = Node("#root", {})
        self.stack = [self.root]
        self.open: dict[str, int] = {}

    def text(self, value: str) -> None:
        if self.open.get("head") and value.strip():
            self.close_to("head")
        self.stack[-1].children.append(value)

    def pop(self) -> None:
        self.open[self.stack.pop().tag] -= 1

    def close_to(self, tag: str) -> None:
        while self.stack[-1].tag != tag:
            self.pop()
        self.pop()

    def _close_implied(self, ends: set[str], beyond: set[str]) -> None:
        found = 0
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[depth].tag
            if tag in beyond:
                break
            if tag in ends:
                found = depth
        while found and len(self.stack) > found:
            self.pop()

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("html", "body") and self.open.get(tag):
            return
        if self.open.get("head") and tag not in HEAD_ONLY:
            self.close_to("head")
        if tag in ENDS_PARAGRAPH and self.open.get("p"):
            self._close_implied({"p"}, TABLE_PARTS)
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.pop()
        if tag in IMPLIED_ENDS:
            self._close_implied(*IMPLIED_ENDS[tag])
        if tag in ("td", "th") and self.stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push(Node("tr", {}))
        node = Node(tag, attrs)
        if tag in VOID:
            self.stack[-1].children.append(node)
        else:
            self._push(node)

    def _push(self, node: Node) -> None:
        if len(self.stack) > DEPTH:
            self.pop()
        self.stack[-1].children.append(node)
        self.stack.append(node)
        self.open[node.tag] = self.open.get(node.tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag == "br":
            self.stack[-1].children.append(Node("br", {}))
        elif self.open.get(tag):
            if tag not in TABLE_PARTS:  # does not reach out of its table cell
                for node in reversed(self.stack):
                    if node.tag == tag:
                        break
                    if node.tag in ("td", "th", "caption", "table"):
                        return
            self.close_to(tag)


def build_tree(html: str) -> Node:
    """The element tree of a page; damaged markup never raises."""
    tree, at, size = TreeBuilder(), 0, len(html)
    while at < size:
        m = _MARKUP.search(html, at)
        if m is None:
            break
        if m.start() > at:
            tree.text(unescape(html[at:m.start()]))
        if m[1]:
            stop = html.find("-->", m.end())
            at = size if stop < 0 else stop + 3
            continue
        rest = _REST_OF_TAG.match(html, m.end())
        stop = rest.end() if rest else html.find(">", m.end()) + 1
        if stop <= 0:  # the page ends inside a tag
            return tree.root
        at = stop
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            tree.end(tag)
            continue
        tree.start(tag, _attributes(html[m.end():stop - 1]))
        if tag in RAW or tag in RCDATA:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            inner = html[at:close.start() if close else size]
            if inner:
                tree.stack[-1].children.append(inner if tag in RAW else unescape(inner))
            tree.end(tag)
            if close is None:
                return tree.root
            past = html.find(">", close.end())
            at = size if past < 0 else past + 1
    if at < size:
        tree.text(unescape(html[at:]))
    return tree.root


def hidden(node: Node) -> bool:
    """Whether the element and all inside it are out of sight."""
    if node.tag in UNSEEN or "hidden" in node.attrs:
        return True
    if node.tag == "dialog" and "open" not in node.attrs:
        return True
    style = node.attrs.get("style")
    return bool(style and _HIDING.search(style))


class Page:
    """Lines of text with collapsed spaces and at most one blank line between blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.space = False
        self.indent = ""
        self.marker = ""

    def word(self, value: str) -> None:
        if not self.line:
            if self.gap > 1 and self.lines:
                self.lines.append("")
            self.gap = 0
            if self.marker:
                self.line.append(self.indent[:-len(self.marker)] + self.marker)
                self.marker = ""
            else:
                self.line.append(self.indent)
        elif self.space and len(self.line) > 1:
            self.line.append(" ")
        self.space = False
        self.line.append(value)

    def text(self, value: str) -> None:
        words = _SPACES.sub(" ", value)
        if words.startswith(" "):
            self.space = True
        inner = words.strip(" ")
        if inner:
            self.word(inner)
            self.space = words.endswith(" ")

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def newline(self) -> None:
        if self.line:
            self.end_line()
        elif self.lines:
            self.gap = 2

    def verbatim(self, value: str) -> None:
        for i, line in enumerate(value.split("\n")):
            if i:
                if not self.line:
                    self.lines.append("")
                self.end_line()
            if line:
                self.word(line.rstrip("\r"))

    def result(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


def _marker(node: Node, ordinal: int) -> str:
    if node.tag != "ol":
        return "- "
    return f"{ordinal}. "


def _number(value: str | None, default: int, most: int) -> int:
    try:
        return min(max(int(value), 1), most)
    except (TypeError, ValueError):
        return default


def _table_rows(node: Node) -> list[list[Node]]:
    parts = {"thead": [], "tbody": [], "tfoot": []}
    for child in node.children:
        if isinstance(child, Node) and not hidden(child):
            if child.tag == "tr":
                parts["tbody"].append(child)
            elif child.tag in parts:
                parts[child.tag] += [r for r in child.children if isinstance(r, Node)
                                     and r.tag == "tr" and not hidden(r)]
    return [[c for c in row.children if isinstance(c, Node) and c.tag in ("td", "th")
             and not hidden(c)] for rows in parts.values() for row in rows]


def _stray(node: Node) -> Iterator[Node | str]:
    """What stands in a table outside its cells; it is shown before the table."""
    for child in node.children:
        if isinstance(child, str) or child.tag not in ("thead", "tbody", "tfoot", "tr"):
            yield child
        elif not hidden(child):
            if child.tag == "tr":
                yield from (c for c in child.children
                            if isinstance(c, str) or c.tag not in ("td", "th"))
            else:
                for row in child.children:
                    if isinstance(row, str) or row.tag != "tr":
                        yield row
                    elif not hidden(row):
                        yield from (c for c in row.children
                                    if isinstance(c, str) or c.tag not in ("td", "th"))


def _table(node: Node, page: Page) -> None:
    for child in _stray(node):
        _render(child, page)
        page.block(1)
    grid: list[list[tuple[int, list[str], int]]] = []
    taken: dict[int, int] = {}
    for row in _table_rows(node):
        column, cells = 0, []
        busy, taken = taken, {c: n - 1 for c, n in taken.items() if n > 1}
        for cell in row:
            while busy.get(column):
                column += 1
            inner = Page()
            for child in cell.children:
                _render(child, inner)
            span = _number(cell.attrs.get("colspan"), 1, 1000)
            down = _number(cell.attrs.get("rowspan"), 1, 65534)
            text = inner.result()
            cells.append((column, text.split("\n") if text else [], span))
            if down > 1:
                taken.update((c, down - 1) for c in range(column, column + span))
            column += span
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for column, lines, span in cells:
            width = max((len(x) for x in lines), default=0)
            if span == 1 and width <= COLUMN_WIDTH:
                widths[column] = max(widths.get(column, 0), width)
    starts, at = {}, 0
    for column in sorted({c for cells in grid for c, _, _ in cells}):
        starts[column] = at
        if widths.get(column):
            at += widths[column] + len(COLUMN_GAP)
    for cells in grid:
        height = max((len(lines) for _, lines, _ in cells), default=0)
        size = sum(len(x) for _, lines, _ in cells for x in lines)
        if height * at > 10 * size + 10_000:  # padding would dwarf the text
            for _, lines, _ in cells:
                for line in lines:
                    page.verbatim(line)
                    page.end_line()
            continue
        for i in range(height):
            line = ""
            for column, lines, _ in cells:
                if i < len(lines) and lines[i]:
                    if line:
                        line = line.ljust(max(starts[column], len(line) + len(COLUMN_GAP)))
                    else:
                        line = " " * starts[column]
                    line += lines[i]
            if line:
                page.word(line)
                page.end_line()


def _render(node: Node | str, page: Page, keep: bool = False, ordinal: int = 0,
            parent: Node | None = None) -> None:
    if isinstance(node, str):
        if keep:
            page.verbatim(node)
        else:
            page.text(node)
        return
    if hidden(node):
        return
    tag = node.tag
    if tag == "br":
        page.newline()
        return
    if tag == "hr":
        page.block(2)
        return
    gap = 2 if tag in SPACED else 1 if tag in BLOCK else 0
    if tag in ("ul", "ol", "menu", "dl") and page.indent:
        gap = 1
    if gap:
        page.block(gap)
    before, marker = page.indent, ""
    if tag == "li":
        marker = _marker(parent, ordinal) if parent is not None else "- "
        page.indent, page.marker = before + " " * len(marker), marker
    elif tag in ("blockquote", "dd"):
        page.indent = before + "  "
    if tag == "table":
        _table(node, page)
    else:
        keep = keep or tag in ("pre", "textarea")
        count = _number(node.attrs.get("start"), 1, 10**9) - 1 if tag == "ol" else 0
        for child in node.children:
            if isinstance(child, Node) and child.tag == "li":
                count = _number(child.attrs.get("value"), count + 1, 10**9)
            _render(child, page, keep, count, node)
    page.indent, page.marker = before, "" if marker else page.marker
    if gap:
        page.block(gap)


def html_to_text(html: str | None) -> str:
    """The visible text of a page; null and empty give an empty text."""
    if not html:
        return ""
    page = Page()
    for child in build_tree(html).children:
        _render(child, page)
    return page.result()


@tidy
def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, size in slices(batch.column(1)):
            texts = [html_to_text(x) for x in batch.column(1).slice(first, size).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, size), pa.array(texts, pa.string()),
                 pa.array([len(x) for x in texts], pa.int64())],
                names=["page_id", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, text, n_chars`` of every row.

    Null and empty html give an empty text; a null id is kept; repeated rows give repeated rows;
    nesting beyond ``DEPTH`` is flattened, which loses no text. Other columns are not read.
    """
    return pages.select(F.col(id_col).cast("bigint").alias("page_id"),
                        F.col(html_col).alias("html")).mapInArrow(
        _extract, "page_id bigint, text string, n_chars bigint")

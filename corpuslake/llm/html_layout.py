"""HTML to text with layout: a tree with implied tags, visibility rules, lists and aligned tables.

The tree builder follows the implied-tag rules that matter for text (a block ends an
open paragraph, an item ends the item before it, cells and rows end each other,
missing rows are made). The renderer emits all visible text: blocks on lines of their
own, one blank line around paragraphs, headings, lists and tables, items behind "- " or
their number, preformatted text as it is, table cells padded to their columns.

The output is linear in the page. A column is as wide as its widest line of at most WIDE characters; a longer line is not
cut, it ends the alignment behind it. Empty columns between two cells take GAP characters at most, else one
separator. Indentation comes to INDENT characters for each one of the page (and 64 K) at most, then deeper levels stand at the 40th.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm._rows import without

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript noembed noframes iframe object audio video canvas datalist title rp".split())
#: What they hold is text, not markup; in those of the second set character references are read.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_ESCAPABLE = frozenset("textarea title".split())
#: Shown as it is.
_PREFORMATTED = frozenset("pre xmp listing".split())
#: Not drawn within math.
_MATH_UNSEEN = frozenset("annotation annotation-xml mphantom".split())
#: May stand in an open head; any other tag, or text, ends it.
_IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
#: Within svg, text is drawn in these only, and nothing below the second set is drawn where it stands.
_SVG_TEXT = frozenset("text foreignobject".split())
_SVG_UNSEEN = frozenset("title desc defs metadata symbol clippath mask marker pattern lineargradient radialgradient filter".split())
#: An opening tag of HTML ends svg and math, unless one of the second set stands between.
_BREAKS_OUT = frozenset(
    "b big blockquote br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
_HTML_WITHIN = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre xmp listing blockquote figure hr fieldset menu".split())
BLOCK = SPACED | frozenset(
    "html body div section article header footer main nav aside address form li dt dd tr td th thead tbody tfoot caption figcaption details summary legend center hgroup dialog optgroup option search".split()
)
_ENDS_P = SPACED | frozenset("div section article header footer main nav aside address form li dt dd details figcaption center dialog summary".split())
#: An opening tag closes these, back to the nearest of the second set.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
_SCOPE = frozenset({"table", "td", "th", "caption", "html"})
#: Bounds of the layout, as the module's text says.
WIDE, GAP, INDENT, LEVELS = 80, 240, 16, 40
#: The most columns and rows that a cell spans.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
_GONE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)
_WHITE = re.compile(r"[ \t\n\r\f]+")
_SOLID = re.compile(r"[^ \t\n\r\f]")


class Node:
    """An element: tag, attributes, children (elements and strings), the lines of a table or preformatted text once laid out.

    ``shown``: whether its own text is visible. Visibility is inherited, and an element can take it back.
    """

    __slots__ = ("attrs", "children", "lines", "shown", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], shown: bool = True):
        self.tag, self.attrs, self.children, self.lines, self.shown = tag, attrs, [], None, shown
        if "style" in attrs and (said := _VISIBILITY.findall(attrs["style"])):
            self.shown = said[-1].lower() == "visible"


class TreeBuilder(HTMLParser):
    """Builds a tree of Nodes, as deep as the page is, from tag soup; never fails on malformed input."""

    CDATA_CONTENT_ELEMENTS = tuple(_RAW)

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        #: How many elements of each tag are open, so that a deep page is not searched for what is not there.
        self.count: Counter[str] = Counter()
        #: Tables and preformatted texts in the order in which they open.
        self.laid: list[Node] = []

    def set_cdata_mode(self, elem: str) -> None:
        """From here on all is text, to the end tag; within svg and math that holds for scripts and styles only."""
        if elem in ("script", "style") or not (self.count["svg"] or self.count["math"]):
            super().set_cdata_mode(elem)

    def _drop(self, low: int) -> None:
        self.count.subtract(n.tag for n in self.open[low:])
        del self.open[low:]

    def _close_to(self, tags: set[str], bound: set[str]) -> None:
        if not any(self.count[t] for t in tags):
            return
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k].tag
            if tag in bound:
                return
            if tag in tags:
                # all of them down to the bound
                low = k
                while low - 1 > 0 and self.open[low - 1].tag in tags:
                    low -= 1
                self._drop(low)
                return

    def _leave_head(self) -> None:
        if self.open[-1].tag == "head":
            self._drop(len(self.open) - 1)

    def _leave_foreign(self) -> None:
        """Ends svg and math around the place where an HTML tag opens."""
        if not (self.count["svg"] or self.count["math"]):
            return
        low = 0
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in _HTML_WITHIN:
                break
            if self.open[k].tag in ("svg", "math"):
                low = k
        if low:
            self._drop(low)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in _IN_HEAD:
            self._leave_head()
        if tag in _BREAKS_OUT:
            self._leave_foreign()
        if tag in ("html", "body"):
            root = self.open[0]
            root.attrs.update({k: v or "" for k, v in attrs if k not in root.attrs})
            if said := _VISIBILITY.findall(dict(attrs).get("style") or ""):
                root.shown = said[-1].lower() == "visible"
            if tag == "body":
                self._close_to({"head"}, set())
            return
        if tag in _ENDS_P:
            self._close_to({"p"}, set(_SCOPE))
        if tag in BLOCK and any(n.tag == "head" for n in self.open[1:3]):
            self._close_to({"head"}, set())
        if tag in _CLOSES:
            self._close_to(*_CLOSES[tag])
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push(Node("tr", {}, self.open[-1].shown))
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open[-1].shown)
        if tag in _MATH_UNSEEN and self.count["math"]:
            node.attrs["hidden"] = ""
        if tag in VOID:
            self.open[-1].children.append(node)
        else:
            self._push(node)

    def _push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self.open.append(node)
        self.count[node.tag] += 1
        if node.tag == "table" or node.tag in _PREFORMATTED:
            self.laid.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("html", "body") and self.open[-1].tag == tag and tag not in BLOCK:
            self._drop(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("br", "p"):
            self._leave_head()
        if tag == "br":
            self.open[-1].children.append(Node("br", {}))
            return
        if tag in ("html", "body"):
            return
        if self.count[tag]:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == tag:
                    self._drop(k)
                    return
                if self.open[k].tag in _SCOPE and tag not in ("table", "tr", "thead", "tbody", "tfoot"):
                    break
        if tag == "p":
            self.open[-1].children.append(Node("p", {}))

    def handle_data(self, data: str) -> None:
        if self.cdata_elem in _ESCAPABLE:
            data = unescape(data)
        if _SOLID.search(data):
            self._leave_head()
        self.open[-1].children.append(data)

    def parse_html_declaration(self, i: int) -> int:
        """As the library's, but "<![" is a bogus comment up to the next ">", as in browsers: the library refuses broken ones.

        Within svg and math, "<![CDATA[" is text up to "]]>".
        """
        if not self.rawdata.startswith("<![", i):
            return super().parse_html_declaration(i)
        if self.rawdata.startswith("<![CDATA[", i) and (self.count["svg"] or self.count["math"]):
            end = self.rawdata.find("]]>", i)
            self.handle_data(self.rawdata[i + 9 : end if end >= 0 else None])
            return end + 3 if end >= 0 else len(self.rawdata)
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else len(self.rawdata)


def parse(html: str) -> TreeBuilder:
    """The tree of a page, with what has to be laid out within it."""
    builder = TreeBuilder()
    builder.feed(html)
    if builder.rawdata.startswith(("<!", "<?")):  # a comment without an end goes on to the end of the page
        builder.rawdata = ""
    if builder.cdata_elem and builder.rawdata:  # as does the text of an element without an end tag
        builder.handle_data(builder.rawdata)
        builder.rawdata = ""
    builder.close()
    return builder


def visible(node: Node) -> bool:
    """Whether an element takes part in the layout, by its tag and attributes; whether its text is visible says ``shown``."""
    if node.tag in UNSEEN:
        return False
    attrs = node.attrs
    if not attrs:
        return node.tag != "dialog"
    if "hidden" in attrs or (node.tag == "dialog" and "open" not in attrs):
        return False
    return "style" not in attrs or not _GONE.search(attrs["style"])


class _Lines:
    """Collects text: collapses white space within a line, keeps the breaks that blocks ask for."""

    def __init__(self, indent: int = 1 << 16) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.indent = indent  # characters of indentation that are left
        self.blank = False
        self.prefix: list[str] = []
        self.marker: str | None = None

    def text(self, data: str) -> None:
        data = _WHITE.sub(" ", data)
        if not self.line or self.line[-1].endswith(" "):
            data = data.lstrip(" ")
        if data:
            self.line.append(data)

    def end(self, blank: bool = False) -> None:
        """Ends the line, if there is one; ``blank`` asks for a blank line before the next."""
        text = "".join(self.line).strip(" ")
        self.line = []
        if text:
            self.raw(text)
        self.blank |= blank

    def raw(self, text: str) -> None:
        if self.blank and self.lines and self.lines[-1]:
            self.lines.append("")
        self.blank = False
        levels = self.prefix if self.marker is None else self.prefix[:-1]
        if len(levels) > LEVELS and 2 * len(levels) > self.indent:
            levels = levels[:LEVELS]
        lead = "".join(levels)
        self.indent -= len(lead)
        self.lines.append((lead + (self.marker or "") + text).rstrip())
        self.marker = None

    def done(self) -> str:
        self.end()
        return "\n".join(self.lines).strip("\n")


def render(page: TreeBuilder, indent: int = 1 << 16) -> str:
    """The visible text of a page, however deep: tables and preformatted texts are laid out first, the innermost before those around them.

    ``indent`` is how many characters of indentation there may be in all.
    """
    left = [indent]
    for node in reversed(page.laid):
        node.lines = table_lines(node, left) if node.tag == "table" else _plain(node).strip("\n").split("\n")
    return _text(page.root, left)


def _text(node: Node, left: list[int] | None = None) -> str:
    out = _Lines(left[0]) if left else _Lines()
    _render(node, out)
    text = out.done()
    if left:
        left[0] = out.indent
    return text


class _Frame:
    """An element whose children are being rendered, and what is to be done behind the last."""

    __slots__ = ("after", "closed", "drawing", "node", "number", "rest")

    def __init__(self, node: Node, after: Callable[[], object] | None = None, drawing: bool = False):
        self.node, self.after, self.rest = node, after, iter(node.children)
        self.closed = node.tag == "details" and "open" not in node.attrs
        self.drawing = drawing or node.tag == "svg"
        self.number = 1
        if node.tag == "ol" and re.fullmatch(r"-?\d{1,9}", node.attrs.get("start", "").strip()):
            self.number = int(node.attrs["start"])


def _render(node: Node, out: _Lines) -> None:
    frames = [_Frame(node)]
    while frames:
        frame = frames[-1]
        child = next(frame.rest, None)
        if child is None:
            frames.pop()
            if frame.after:
                frame.after()
        elif isinstance(child, str):
            if frame.node.shown and not frame.closed and not frame.drawing:
                out.text(child)
        elif visible(child) and not (frame.closed and child.tag != "summary"):
            entered = _drawn(child, out) if frame.drawing else _entered(child, frame, out)
            if entered:
                frames.append(entered)


def _drawn(child: Node, out: _Lines) -> _Frame | None:
    """The frame of a part of a drawing; its texts are apart by a space."""
    if child.tag in _SVG_UNSEEN:
        return None
    if child.tag not in _SVG_TEXT:
        return _Frame(child, drawing=True)
    out.text(" ")
    return _Frame(child, lambda: out.text(" "))


def _entered(child: Node, frame: _Frame, out: _Lines) -> _Frame | None:
    """The frame of a visible element, or None where it is done with."""
    tag = child.tag
    if tag == "br":
        if out.line:
            out.end()
        elif out.lines:
            out.blank = True
    elif tag == "hr":
        out.end(blank=True)
        if child.shown:
            out.raw("---")
        out.blank = True
    elif tag == "img":
        if child.attrs.get("alt") and child.shown:
            out.text(child.attrs["alt"])
    elif tag == "wbr" or (tag == "desc" and frame.node.tag in ("text", "tspan")):
        pass
    elif tag == "table" or tag in _PREFORMATTED:
        out.end(blank=True)
        for line in child.lines if any(child.lines) else []:
            out.raw(line)
        out.blank = True
    elif tag == "li":
        out.end()
        mark = f"{frame.number}. " if frame.node.tag == "ol" else "- "
        frame.number += 1
        out.prefix.append(" " * len(mark))
        out.marker = mark if child.shown else None
        return _Frame(child, lambda: _end_item(out))
    elif tag in ("ul", "ol", "menu") and frame.node.tag == "li":
        out.end()
        if out.marker is not None:
            out.raw("")
        return _Frame(child, out.end)
    elif tag in ("blockquote", "dd"):
        out.end(blank=tag == "blockquote")
        out.prefix.append("  ")
        return _Frame(child, lambda: (out.end(blank=tag == "blockquote"), out.prefix.pop()))
    elif tag in BLOCK:
        out.end(blank=tag in SPACED)
        return _Frame(child, lambda: out.end(blank=tag in SPACED))
    elif tag == "q":
        quote = '"' if child.shown else ""
        out.text(quote)
        return _Frame(child, lambda: out.text(quote))
    else:
        return _Frame(child)
    return None


def _end_item(out: _Lines) -> None:
    out.end()
    out.marker = None
    out.prefix.pop()


def _plain(node: Node) -> str:
    out: list[str] = []
    stack: list[tuple[Node | str, Node]] = [(x, node) for x in reversed(node.children)]
    while stack:
        x, around = stack.pop()
        if isinstance(x, str):
            if around.shown:
                out.append(x.expandtabs(8))
        elif x.tag == "br":
            out.append("\n")
        elif x.tag == "svg" and visible(x):
            out.append(_text(x))
        elif visible(x):
            stack.extend((y, x) for y in reversed(x.children))
    return "".join(out)


def _span(value: str | None, most: int) -> int:
    """A cell's span: the digits that the value begins with, at most ``most``; 1 where there are none."""
    found = re.match(r"[ \t\n\f\r]*\+?0*(\d*)", value or "")
    if not found or not found[0].strip(" \t\n\f\r+"):
        return 1
    return min(int(found[1][:6] or 0), most)


class _Held:
    """Columns that cells of rows above still take: spans [start, stop) apart from each other, in order, each up to a row."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int, int]] = []

    def drop(self, row: int) -> None:
        """Forgets what ends above ``row``."""
        if any(last < row for _, _, last in self.spans):
            self.spans = [x for x in self.spans if x[2] >= row]

    def free(self, column: int) -> int:
        """The first column from ``column`` on that none takes."""
        k = bisect_left(self.spans, (column + 1,)) - 1
        if k >= 0 and self.spans[k][1] > column:
            column = self.spans[k][1]
        k += 1
        while k < len(self.spans) and self.spans[k][0] == column:
            column = self.spans[k][1]
            k += 1
        return column

    def take(self, start: int, stop: int, last: int) -> None:
        """Takes columns; a neighbour that ends with the same row becomes one with them. Where a cell reaches over others, they keep theirs."""
        k = bisect_left(self.spans, (start,))
        if k < len(self.spans):
            stop = min(stop, self.spans[k][0])
        if k and self.spans[k - 1][1] == start and self.spans[k - 1][2] == last:
            self.spans[k - 1] = (self.spans[k - 1][0], stop, last)
        elif stop > start:
            self.spans.insert(k, (start, stop, last))


def _rows(table: Node, caption: list[str], left: list[int] | None) -> list[tuple[int, Node]]:
    """(number of its group, row) of a table's rows; what is outside of rows goes to ``caption``."""
    rows: list[tuple[int, Node]] = []
    stack: list[tuple[int, Node | str, Node]] = [(0, x, table) for x in reversed(table.children)]
    group = 0
    while stack:
        of, x, around = stack.pop()
        if isinstance(x, str):
            if x.strip() and around.shown:
                caption.append(_WHITE.sub(" ", x).strip())  # text outside cells is shown before the table
        elif not visible(x):
            continue
        elif x.tag == "tr":
            rows.append((of, x))
        elif x.tag in ("thead", "tbody", "tfoot"):
            group += 1
            stack.extend((group, y, x) for y in reversed(x.children))
        elif text := _text(x, left):
            caption += text.split("\n")
    return rows


def table_lines(table: Node, left: list[int] | None = None) -> list[str]:
    """A table's caption and rows; cells stand in columns as wide as their widest line (of WIDE characters at most), apart by " | "."""
    out: list[str] = []
    grid: list[dict[int, list[str]]] = []
    held, before = _Held(), -1
    rows = _rows(table, out, left)
    for number, (group, row) in enumerate(rows):
        if group != before:  # no cell reaches into another group of rows
            held, before = _Held(), group
        held.drop(number)
        cells: dict[int, list[str]] = {}
        column, loose = 0, []
        for x in row.children:
            if isinstance(x, str) or x.tag not in ("td", "th"):
                loose.append(x)
            elif visible(x):
                column = held.free(column)
                wide, tall = _span(x.attrs.get("colspan"), MOST_COLUMNS) or 1, _span(x.attrs.get("rowspan"), MOST_ROWS) or MOST_ROWS
                if text := _text(x, left):
                    cells[column] = text.split("\n")
                if tall > 1:
                    held.take(column, column + wide, number + tall - 1)
                column += wide
        extra = Node("div", {}, row.shown)
        extra.children = loose
        if text := _text(extra, left):
            out += text.split("\n")
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for column, lines in cells.items():
            widths[column] = max(widths.get(column, 0), *(len(x) for x in lines if len(x) <= WIDE), 0)
    used = sorted(widths)
    place = {column: k for k, column in enumerate(used)}
    starts = [0]  # where each used column begins if all before are as wide as they are
    for column in used:
        starts.append(starts[-1] + widths[column] + 3)

    def gap(a: int, b: int) -> str:
        """What stands for the empty columns a to b (places), each behind a separator."""
        return "".join(" | " + " " * widths[used[k]] for k in range(a, b)) if starts[b] - starts[a] <= GAP else ""

    for cells in grid:
        order = sorted(cells)
        for line in range(max((len(c) for c in cells.values()), default=0)):
            text, at = [], 0
            for column in order:
                if line >= len(cells[column]):
                    continue
                k = place[column]
                lead = gap(at, k)
                text.append((lead[3:] + " | " if lead else "") if not at and k else lead + " | " if k else "")
                text.append(cells[column][line].ljust(widths[column]))
                at = k + 1
            if at < len(used):
                text.append(gap(at, len(used)))
            out.append("".join(text).rstrip())
    return out


def extract_text(html: str | None) -> str:
    """The visible text of a page, laid out; null and empty pages give the empty text."""
    return render(parse(html), (1 << 16) + INDENT * len(html)) if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """page_id, the columns ``keep`` and text of every row; row by row, no shuffle.

    Null and empty pages give the empty text. Rows that repeat give equal rows, an empty table none. A kept
    column called page_id or text gives way to the result's; other columns are ignored.
    """
    columns = [c for c in without(keep, "page_id", "text") if c in pages.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([extract_text(x.as_py()) for x in batch.column(0)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], text], ["page_id", *columns, "text"])

    types = dict(pages.dtypes)
    rows = pages.select(F.col(html_col).cast("string").alias("__html"), F.col(id_col).cast("long").alias("page_id"), *columns)
    return rows.mapInArrow(run, ", ".join(["page_id long", *(f"`{c}` {types[c]}" for c in columns), "text string"]))

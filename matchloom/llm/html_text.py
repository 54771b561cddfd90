"""Layout-aware rendering of HTML: a small tree builder, visibility rules, and a text layout.

The tree builder closes what start and end tags imply (paragraphs, list items, table parts, options) and adds
missing table parts. The layout emits all visible text: paragraphs and headings are set off by a blank line,
other blocks by a line break; list items carry bullets or numbers and are indented; the cells of a table row
stand side by side, padded to the width of their column; what else stands in a table or row comes before the
table; white space collapses outside ``pre``. Formulas of MathML are inline text without their annotations; of a
drawing in SVG each text element gives a line.

Edge cases: null html gives null text, an empty or invisible page the empty text; text outside any tag is
visible; unclosed tags end with the page; elements may be nested to any depth; list items deeper than
``MAX_INDENT`` columns keep their bullets but are not indented further; columns wider than ``MAX_PAD`` are not
padded; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Generator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from matchloom.llm.common import small_batches

MAX_INDENT = 400
MAX_SPAN = 1000
MAX_PAD = 60

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
INVISIBLE = set(
    "head title meta link script style template noscript iframe noembed noframes object audio video canvas datalist rp "
    "annotation annotation-xml mphantom defs desc metadata symbol clippath mask pattern marker".split()
)
SPACED = set("p h1 h2 h3 h4 h5 h6 blockquote figure dl pre fieldset hr ul ol menu table".split())
BLOCK = SPACED | set(
    "html body address article aside center dd details dialog div dt figcaption footer form header hgroup legend li main nav "
    "option optgroup search section summary caption thead tbody tfoot tr td th".split()
)
#: what a start tag closes, and the elements at which the search for it stops
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
#: start tags that end an open paragraph
ENDS_PARAGRAPH = BLOCK - {"html", "body", "option", "optgroup", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "legend"}
PARTS = {"thead", "tbody", "tfoot"}
#: elements whose tags may close themselves, the places within them where HTML goes on, and the HTML tags that end them
FOREIGN = {"svg", "math"}
HTML_POINTS = {"foreignobject", "desc", "annotation-xml", "mi", "mo", "mn", "ms", "mtext"}
ENDS_FOREIGN = set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p "
    "pre ruby s small span strong strike sub sup table tt u ul var".split()
)
DRAWN = {"svg", "g", "text", "tspan", "textpath", "switch", "foreignobject"}
CELLS = {"td", "th", "caption"}
TABLE_PARTS = PARTS | CELLS | {"tr"}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>?""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_CLOSED = re.compile(r"(?:^|[\s\"']|^[^=]*|\s[^\s=]*)/\Z")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def _attributes(source: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(source)} if source.strip(" /\n\t") else {}


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("root")
    open_ = [root]
    depths: dict[str, list[int]] = {}  # tag -> where it is open, so that no search runs over the open elements

    def last(tags: set) -> int:
        return max([depths[t][-1] for t in tags if depths.get(t)], default=0)

    def cut(depth: int) -> None:
        for node in open_[depth:]:
            depths[node.tag].pop()
        del open_[depth:]

    def close(tags: set, stops: set) -> None:
        """Close the outermost of ``tags`` that is open within the innermost of ``stops``."""
        if any(depths.get(t) for t in tags):
            stop = last(stops)
            found = [d[i] for t in tags if (d := depths.get(t)) and (i := bisect_right(d, stop)) < len(d)]
            if found:
                cut(min(found))

    def end(tag: str) -> None:
        """Close the innermost ``tag`` that is open within the current table cell."""
        depth = depths[tag][-1]
        if tag == "table" or last(CELLS) <= depth:
            cut(depth)

    def foreign() -> bool:
        return any(depths.get(t) for t in FOREIGN) and last(FOREIGN) > last(HTML_POINTS)

    def start(tag: str, attributes: dict | None = None, closed: bool = False) -> None:
        node = Node(tag, attributes)
        open_[-1].children.append(node)
        if tag not in VOID and not closed:
            depths.setdefault(tag, []).append(len(open_))
            open_.append(node)

    at = 0
    while at < len(page):
        found = _TOKEN.search(page, at)
        if (text := page[at : found.start() if found else len(page)]) :
            open_[-1].children.append(html.unescape(text))
        if not found:
            break
        at = found.end()
        slash, tag, rest = found.group(1), (found.group(2) or "").lower(), found.group(3)
        if not tag:
            continue
        if slash:
            if tag == "br":
                start("br")
            elif depths.get(tag):
                close({tag}, {"table"}) if tag in TABLE_PARTS else end(tag)
            continue
        if tag in ENDS_FOREIGN and foreign():
            close(FOREIGN, HTML_POINTS)
        closed = rest.endswith("/") and (tag in FOREIGN or foreign()) and bool(_CLOSED.search(rest))
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in ENDS_PARAGRAPH:
            close({"p"}, {"table", "td", "th", "caption", "button", "object"})
        if tag in ("tr", "td", "th") and open_[-1].tag == "table":
            start("tbody")
        if tag in ("td", "th") and open_[-1].tag in PARTS:
            start("tr")
        start(tag, _attributes(rest), closed)
        if tag in RAW and not closed:
            closing = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            body = page[at : closing.start() if closing else len(page)]
            open_[-1].children.append(html.unescape(body) if tag in ("title", "textarea") else body)
            cut(len(open_) - 1)
            at = closing.end() if closing else len(page)
    return root


def visible(node: Node) -> bool:
    if node.tag in INVISIBLE:
        return False
    given = node.attributes
    if not given:
        return node.tag != "dialog"
    if "hidden" in given or (node.tag == "dialog" and "open" not in given):
        return False
    if node.tag == "input" and given.get("type", "").lower() == "hidden":
        return False
    if node.tag in DRAWN and (given.get("display") == "none" or given.get("visibility") in ("hidden", "collapse")):
        return False
    return not _UNSEEN.search(given.get("style", ""))


class Flow:
    """Lines of text; ``gap`` is the largest number of blank lines asked for before the next line."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0

    def text(self, text: str, keep: bool) -> None:
        if keep:
            first, *more = text.split("\n")
            self.line.append(first)
            for part in more:
                self.end_line(always=True)
                self.line.append(part)
            return
        text = _SPACE.sub(" ", text)
        if text.startswith(" ") and (not self.line or self.line[-1].endswith(" ")):
            text = text[1:]
        if text:
            self.line.append(text)

    def end_line(self, always: bool = False) -> None:
        line = "".join(self.line).rstrip(" ")
        self.line = []
        if line.strip() or always:
            self.put(line)

    def put(self, line: str) -> None:
        if self.lines and self.gap:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        self.lines.append(line)

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


Steps = Generator["Steps", None, None]


def run(steps: Steps) -> None:
    """Run ``steps`` and the steps they yield, each before its parent goes on: recursion without Python's stack."""
    waiting = [steps]
    while waiting:
        inner = next(waiting[-1], None)
        if inner is None:
            waiting.pop()
        else:
            waiting.append(inner)


def lay_out(node: Node, flow: Flow, keep: bool = False, nested: bool = False) -> Steps:
    for child in node.children:
        if isinstance(child, str):
            flow.text(child, keep)
        elif visible(child):
            yield _element(child, flow, keep, nested)


def _element(node: Node, flow: Flow, keep: bool, nested: bool) -> Steps:
    tag = node.tag
    if tag == "br":
        flow.end_line(always=True)
    elif tag == "table":
        flow.block(1)
        yield _table(node, flow)
        flow.block(1)
    elif tag in ("ul", "ol", "menu"):
        flow.block(0 if nested else 1)
        yield _list(node, flow)
        flow.block(0 if nested else 1)
    elif tag == "details" and "open" not in node.attributes:
        flow.block(0)
        for child in node.children:
            if isinstance(child, Node) and child.tag == "summary" and visible(child):
                yield lay_out(child, flow, keep)
        flow.block(0)
    elif tag == "svg":
        yield _drawing(node, flow)
    elif tag in ("mfrac", "mtr"):  # parts that stand apart
        for child in node.children:
            if isinstance(child, Node) and visible(child):
                flow.text(" ", False)
                yield _element(child, flow, False, nested)
        flow.text(" ", False)
    elif tag in BLOCK:
        gap = 1 if tag in SPACED else 0
        flow.block(gap)
        yield lay_out(node, flow, keep or tag == "pre", nested)
        flow.block(gap)
    else:
        yield lay_out(node, flow, keep, nested)


def _drawing(node: Node, flow: Flow) -> Steps:
    """The text elements of an SVG drawing and the HTML in it; strings elsewhere are not drawn."""
    waiting = node.children[::-1]
    while waiting:
        child = waiting.pop()
        if isinstance(child, str) or not visible(child):
            continue
        if child.tag in ("text", "foreignobject"):
            flow.block(0)
            yield lay_out(child, flow)
            flow.block(0)
        else:
            waiting.extend(reversed(child.children))


def _number(text: str | None, default: int) -> int:
    return int(text) if text and re.fullmatch(r"-?\d{1,9}", text) else default


def _list(node: Node, flow: Flow) -> Steps:
    number = _number(node.attributes.get("start"), 1)
    for child in node.children:
        if isinstance(child, str):
            flow.text(child, False)
        elif child.tag == "li" and visible(child):
            flow.block(0)
            number = _number(child.attributes.get("value"), number)
            marker = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            inner = Flow()
            yield lay_out(child, inner, nested=True)
            for i, line in enumerate(inner.done()):
                before = marker if i == 0 else "" if line.startswith(" " * MAX_INDENT) else " " * len(marker)
                flow.put(before + line if line else line)
        elif visible(child):
            yield _element(child, flow, False, True)


def _holders(row: Node) -> set[int]:
    """Ids of the elements between a row and its cells."""
    found: set[int] = set()
    waiting: list[tuple[Node, tuple]] = [(row, ())]  # an element and (its parent, that one's parents)
    while waiting:
        node, above = waiting.pop()
        for child in node.children:
            if isinstance(child, str) or not visible(child):
                continue
            if child.tag in ("td", "th"):
                at, rest = node, above
                while at is not row and id(at) not in found:
                    found.add(id(at))
                    at, rest = rest
            elif child.tag != "table":
                waiting.append((child, (node, above)))
    return found


def _table(node: Node, flow: Flow) -> Steps:
    captions, rows = Flow(), []

    # each with the cells of the row it stands in and the elements of that row that hold cells
    waiting: list[tuple] = [(c, None, None) for c in reversed(node.children)]
    while waiting:
        child, cells, holders = waiting.pop()
        if isinstance(child, str):
            captions.text(child, False)
        elif not visible(child):
            continue
        elif cells is not None and child.tag in ("td", "th"):
            cells.append(child)
        elif cells is not None and id(child) in holders:
            waiting.extend((c, cells, holders) for c in reversed(child.children))
        elif cells is None and child.tag == "tr":
            captions.block(0)
            rows.append([])
            holders = _holders(child)
            waiting.extend((c, rows[-1], holders) for c in reversed(child.children))
        elif cells is None and child.tag in PARTS:
            waiting.extend((c, None, None) for c in reversed(child.children))
        elif child.tag not in ("col", "colgroup"):  # captions and what doesn't belong in a table stand before it
            yield _element(child, captions, False, False)

    grid: list[dict[int, list[str]]] = [{} for _ in rows]
    taken: dict[int, int] = {}  # column -> rows still covered from above
    for r, cells in enumerate(rows):
        covered, taken = taken, {c: n - 1 for c, n in taken.items() if n > 1}
        column = 0
        for cell in cells:
            while covered.get(column):
                column += 1
            inner = Flow()
            yield lay_out(cell, inner)
            grid[r][column] = inner.done()
            across = min(MAX_SPAN, max(1, _number(cell.attributes.get("colspan"), 1)))
            down = min(MAX_SPAN, max(1, _number(cell.attributes.get("rowspan"), 1)))
            for c in range(column, column + across):
                if down > 1:
                    taken[c] = down - 1
            column += across
    widths: dict[int, int] = {}
    for row in grid:
        for column, lines in row.items():
            widths[column] = min(MAX_PAD, max([widths.get(column, 0), *map(len, lines)]))
    columns = sorted(widths)
    for line in captions.done():
        flow.put(line)
    for row in grid:
        for i in range(max([0, *map(len, row.values())])):
            parts = [(row.get(c, [])[i : i + 1] or [""])[0].ljust(widths[c]) for c in columns if widths[c]]
            flow.put("  ".join(parts).rstrip(" "))


def render(page: str | None) -> tuple[str | None, str | None]:
    """``(title, text)`` of a page."""
    if page is None:
        return None, None
    root = parse(page)
    flow = Flow()
    run(lay_out(root, flow))
    return _title(root), "\n".join(flow.done()).strip("\n")


def _title(root: Node) -> str | None:
    waiting = [root]
    while waiting:
        node = waiting.pop()
        if node.tag == "title":
            return _SPACE.sub(" ", "".join(c for c in node.children if isinstance(c, str))).strip(" ")
        if node.tag != "svg":
            waiting.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return None


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``column`` replaced by ``title, text`` (columns of these names are replaced)."""
    source = pages.select(*[c for c in pages.columns if c.lower() not in ("title", "text") or c == column])
    kept = [f for f in source.schema.fields if f.name != column]
    schema = StructType(kept).add("title", "string").add("text", "string")

    def rendered(batches):
        for batch in small_batches(batches, column):
            found = [render(p) for p in batch.column(column).to_pylist()]
            own = [c for name, c in zip(batch.schema.names, batch.columns) if name != column]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array([t for t, _ in found], pa.string()), pa.array([t for _, t in found], pa.string())], schema.names
            )

    return source.mapInArrow(rendered, schema)

"""HTML extraction: a tree with implied tags, then a layout of all visible text.

The tree builder closes what HTML lets authors leave open (p, li, dt and dd, options, table parts), ignores stray end tags, and keeps the
contents of raw-text elements out of the markup. Hidden are elements that browsers do not show (head, script, style, template and
the like), those with `hidden`, and those whose style has display: none, with all they hold; visibility: hidden is inherited until a descendant is
visible again. The layout folds white space as browsers do, starts blocks on lines of their own with blank lines around paragraphs and headings,
numbers or marks list items by depth, keeps preformatted lines, and writes a table's rows with their cells in aligned columns, by rowspan and
colspan.

Pages of any length and depth take time in proportion to their length: a page is scanned forward once, the parser keeps where in the stack each tag
is open, and tree and layout use no recursion.

Defined cases: null and empty html give an empty text; text without any markup is one block; markup that never ends counts as text; indentation
stops growing at WIDEST columns, whatever the depth; spans of cells beyond SPAN count as SPAN, as in browsers; repeated rows are rendered each; an empty
table gives no rows.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Generator, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from regioflux.llm.arrow import add_columns, text_column

WIDEST = 64
SPAN = 1000

#: A quote opens a value only after "=" and a name; elsewhere in a tag it is a character like others. A quoted value that never ends ends no tag.
_VALUE = r"[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:\"([^\"]*+)\"|'([^']*+)'|((?![\"'])[^ \t\n\r\f>]*+))"
_NAME = r"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+"
_ATTRIBUTE = re.compile(rf"({_NAME})(?:{_VALUE})?+")
_INSIDE = rf"(?:[ \t\n\r\f/]++|{_NAME}(?:{re.sub(r'\((?!\?)', '(?:', _VALUE)}|(?![ \t\n\r\f]*+=)))*+"
_TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)({_INSIDE})>")
_TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_BLANK = re.compile(r"[ \t\n\r\f]*+")
_BETWEEN = re.compile(r"[ \t\n\r\f/]*+")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible|initial)", re.I)

#: Fixed values of the HTML standard: elements by how they are parsed and shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title meta link base datalist audio video object iframe noembed noframes area param source track".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section summary table caption tr ul".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure fieldset".split())
#: Start tags that close an open element, and the elements beyond which they do not look for it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
#: Elements that parts of a table stand in; a part closes whatever else is open inside the nearest of them.
SECTIONS = frozenset({"thead", "tbody", "tfoot"})
PARENTS = {
    "tr": SECTIONS | {"table"},
    "td": SECTIONS | {"table", "tr"},
    "th": SECTIONS | {"table", "tr"},
    "thead": frozenset({"table"}),
    "tbody": frozenset({"table"}),
    "tfoot": frozenset({"table"}),
}
#: End tags that reach beyond a cell or table.
ENDS = frozenset("table tr thead tbody tfoot td th template noscript body html".split())
#: Blocks end an open paragraph; these elements shield one.
CLOSE_P = BLOCK - {"body", "html", "li", "dd", "dt", "tr", "caption", "option", "legend", "summary"}
SHIELD_P = frozenset("table td th caption button object".split())


class Node:
    __slots__ = ("children", "columns", "number", "rows", "shown", "tag", "visible")

    def __init__(self, tag: str) -> None:
        self.tag = tag
        self.visible = tag not in HIDDEN
        self.shown: bool | None = None
        self.number = self.rows = self.columns = 1
        self.children: list[Node | str] = []


class _Open:
    """The open elements, and where each tag stands among them."""

    def __init__(self, root: Node) -> None:
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, length: int) -> None:
        """Closes all but so many elements."""
        for node in self.nodes[length:]:
            self.places[node.tag].pop()
        del self.nodes[length:]

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of the tags, 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, tags: Iterable[str], stop: Iterable[str]) -> None:
        """Closes the outermost open element of the tags that lies inside the nearest stop element."""
        beyond = self.last(stop)
        inside = [p[i] for p in (self.places.get(t, []) for t in tags) if (i := bisect_right(p, beyond)) < len(p)]
        if inside:
            self.cut(min(inside))

    def into_table(self, tag: str) -> None:
        """Closes what is open between a part of a table and where it stands, and opens the row that a cell implies."""
        parent = self.last(PARENTS[tag])
        if parent <= self.last(("template", "noscript")):
            return
        self.cut(parent + 1)
        if tag in ("td", "th") and self.nodes[-1].tag != "tr":
            row = Node("tr")
            self.nodes[-1].children.append(row)
            self.push(row)

    def end(self, tag: str) -> None:
        """An end tag; one inside a cell or table closes nothing outside, unless it ends a part of a table or the page."""
        place = self.last((tag,))
        if place and (tag in ENDS or place >= self.last(("td", "th", "table"))):
            self.cut(place)


def _span(value: str) -> int:
    found = re.match(r"\s*\+?([0-9]{1,9})", value)
    return min(max(int(found[1]), 1), SPAN) if found else 1


def _new(tag: str, attributes: str) -> Node:
    node = Node(tag)
    if attributes and not attributes.isspace():
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), next((v for v in values if v), "")
            if name == "hidden" or (name == "style" and _NOT_SHOWN.search(value)) or (tag == "input" and name == "type" and value.lower() == "hidden"):
                node.visible = False
            elif name == "start" and tag == "ol" and re.fullmatch(r"\s*-?[0-9]{1,9}\s*", value):
                node.number = int(value)
            elif name == "rowspan":
                node.rows = _span(value)
            elif name == "colspan":
                node.columns = _span(value)
            if name == "style" and (set_to := _VISIBILITY.findall(value)):
                node.shown = set_to[-1].lower() in ("visible", "initial")
    return node


class _Scanner:
    """Finds markup in a page, going forward."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.last = source.rfind(">")
        self.dead: set[int] | None = None

    def _tag(self, at: int) -> tuple[int, str, str, str] | None:
        """End, slash, name and attributes of the tag at a place. After a first tag that never ends, attributes are read one by one,
        and places from which they do not come to an end are remembered, so that none is read twice in vain."""
        if self.dead is None:
            found = _TAG.match(self.source, at)
            if found:
                return found.end(), *found.groups()
            self.dead = set()
        head = _TAG_NAME.match(self.source, at)
        if not head:
            return None
        place, seen = head.end(), []
        while place not in self.dead:
            seen.append(place)
            place = _BETWEEN.match(self.source, place).end()
            if self.source.startswith(">", place):
                return place + 1, head[1], head[2], self.source[head.end() : place]
            found = _ATTRIBUTE.match(self.source, place)
            # A name followed by "=" whose value could not be read is a quoted value that never ends.
            if not found or (found.lastindex == 1 and self.source.startswith("=", _BLANK.match(self.source, found.end()).end())):
                break
            place = found.end()
        self.dead.update(seen)
        return None

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Begin and end of the next markup from a place on, and of a tag its slash, name and attributes."""
        source = self.source
        while (begin := source.find("<", at)) >= 0:
            if source.startswith("<!--", begin) or source.startswith("<![CDATA[", begin):
                mark = "-->" if source[begin + 2] == "-" else "]]>"
                end = source.find(mark, begin + (4 if mark == "-->" else 9))
                return begin, end + 3 if end >= 0 else len(source), "", "", ""
            if begin < self.last:
                if source[begin + 1] in "!?":
                    return begin, source.index(">", begin) + 1, "", "", ""
                found = self._tag(begin) if source[begin + 1] == "/" or source[begin + 1].isalpha() else None
                if found:
                    return begin, *found
            at = begin + 1
        return None

    def raw_end(self, tag: str, at: int) -> tuple[int, int]:
        """Where a raw-text element's contents and its end tag end."""
        found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(self.source, at, self.last + 1) if at <= self.last else None
        return found.span() if found else (len(self.source), len(self.source))


def tree(source: str) -> Node:
    root = Node("html")
    opened = _Open(root)
    scanner = _Scanner(source)
    at = 0
    while found := scanner.next(at):
        begin, end, closing, tag, attributes = found
        if begin > at:
            opened.nodes[-1].children.append(html.unescape(source[at:begin]))
        at = end
        tag = tag.lower()
        if not tag or tag == "html":
            continue
        if closing:
            if tag == "br":
                opened.nodes[-1].children.append(Node("br"))
            elif tag not in VOID:
                opened.end(tag)
            continue
        if tag in CLOSES:
            opened.close(*CLOSES[tag])
            if tag in PARENTS:
                opened.into_table(tag)
        elif opened.nodes[-1].tag == "head" and tag not in HIDDEN:
            opened.cut(len(opened.nodes) - 1)
        if tag in CLOSE_P:
            opened.close(("p",), SHIELD_P)
        node = _new(tag, attributes)
        opened.nodes[-1].children.append(node)
        if tag in RAW:
            stop, at = scanner.raw_end(tag, at)
            text = source[end:stop]
            node.children.append(html.unescape(text) if tag in ("textarea", "title") else text)
        elif tag == "form" and opened.nodes[-1].tag in PARENTS["td"]:
            continue  # a form between the parts of a table holds nothing
        elif tag not in VOID and not (attributes.endswith("/") and tag not in BLOCK and tag not in CLOSES):
            opened.push(node)
    if at < len(source):
        opened.nodes[-1].children.append(html.unescape(source[at:]))
    return root


class _Lines:
    """Lines of text with white space folded and wanted blank lines between blocks."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.line: list[str] = []
        self.gap = False
        self.lead = ""

    def text(self, value: str) -> None:
        value = _SPACE.sub(" ", value)
        if not self.line or self.line[-1].endswith(" "):
            value = value.lstrip(" ")
        if value:
            self.line.append(value)

    def end(self, blank: bool = False, forced: bool = False) -> None:
        line = "".join(self.line).rstrip(" ")
        self.line = []
        if line or forced:
            if self.gap and self.done:
                self.done.append("")
            self.gap = False
            self.done.append((self.lead + line).rstrip(" "))
            self.lead = " " * (len(self.lead) - len(self.lead.lstrip(" "))) if not self.lead.strip() else " " * len(self.lead)
        self.gap = self.gap or (blank and bool(self.done))

    def block(self, lines: list[str]) -> None:
        self.end()
        for x in lines:
            self.line = [x]
            self.end(forced=True)


#: A step of the layout yields the steps it needs done, and gets their results.
Step = Generator["Step", object, object]


def _done(step: Step) -> object:
    """The result of a step, with all steps that it asks for, however deep."""
    waiting, value = [step], None
    while waiting:
        try:
            asked = waiting[-1].send(value)
        except StopIteration as end:
            waiting.pop()
            value = end.value
        else:
            waiting.append(asked)
            value = None
    return value


def _parts(table: Node, shown: bool) -> Iterator[tuple[Node | str, Node, bool]]:
    """The children of a table, its sections and rows in order, but for sections: child, its parent, and whether what it inherits is shown."""
    waiting = [(iter(table.children), table, shown)]
    while waiting:
        children, parent, seen = waiting[-1]
        child = next(children, None)
        if child is None:
            waiting.pop()
        elif isinstance(child, Node) and child.tag in SECTIONS and parent.tag != "tr":
            if child.visible:
                waiting.append((iter(child.children), child, seen if child.shown is None else child.shown))
        else:
            yield child, parent, seen
            if isinstance(child, Node) and child.tag == "tr" and child.visible and parent.tag != "tr":
                waiting.append((iter(child.children), child, seen if child.shown is None else child.shown))


def _placed(rows: list[list[tuple[Node, list[str]]]]) -> list[list[tuple[int, int, list[str]]]]:
    """(column, columns, lines) of each row's cells: a cell takes the first columns that no cell of a row above reaches into."""
    until: dict[int, int] = {}
    out = []
    for number, row in enumerate(rows):
        column, placed = 0, []
        for node, lines in row:
            while until.get(column, 0) > number:
                column += 1
            for c in range(column, column + node.columns):
                if node.rows > 1 or c in until:
                    until[c] = max(until.get(c, 0), number + node.rows)
            placed.append((column, node.columns, lines))
            column += node.columns
        out.append(placed)
    return out


def _aligned(rows: list[list[tuple[int, int, list[str]]]]) -> list[str]:
    """The rows' lines with cells in columns. A row's last cell may be wider than its column."""
    width: dict[int, int] = {}
    wide = sorted((n, c, max(map(len, lines))) for row in rows for c, n, lines in row[:-1] if lines)
    for n, c, needed in wide:
        free = needed - sum(width.get(i, 0) + 2 for i in range(c, c + n - 1))
        width[c + n - 1] = max(width.get(c + n - 1, 0), free)
    last = max((c + n for row in rows for c, n, _ in row), default=0)
    start = [0]
    for c in range(last):
        start.append(start[-1] + width.get(c, 0) + 2)
    out = []
    for row in rows:
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            line = ""
            for c, _, lines in row:
                if k < len(lines):
                    line = line.ljust(start[c]) + lines[k]
            out.append(line.rstrip())
    return out


def _table(node: Node, shown: bool) -> Step:
    """Lines of a table's rows, and of what else it holds, such as its caption."""
    rows: list[list[tuple[Node, list[str]]]] = []
    rest = Node("div")
    for child, parent, seen in _parts(node, shown):
        if isinstance(child, str):
            if seen and not child.isspace():
                rest.children.append(child)
        elif child.tag == "tr" and parent.tag != "tr":
            if child.visible:
                rows.append([])
        elif parent.tag == "tr" and child.tag in ("td", "th"):
            if child.visible:
                rows[-1].append((child, (yield _rendered(child, seen))))
        else:
            if child.shown is None:
                child.shown = seen
            rest.children.append(child)
    return _aligned(_placed(rows)), (yield _rendered(rest, True))


def _lay_out(node: Node, out: _Lines, depth: int, pre: bool, shown: bool) -> Step:
    number = node.number
    for child in node.children:
        if isinstance(child, str):
            if not shown:
                continue
            if pre:
                first, *more = child.replace("\r\n", "\n").split("\n")
                out.line.append(first)
                for x in more:
                    out.end(forced=True)
                    out.line.append(x)
            else:
                out.text(child)
            continue
        if not child.visible:
            continue
        tag, seen = child.tag, shown if child.shown is None else child.shown
        if tag == "br":
            out.end(forced=True)
            continue
        if tag == "table":
            out.end(blank=True)
            lines, rest = yield _table(child, seen)
            out.block(rest)
            out.block(lines)
            out.end(blank=True)
            continue
        if tag not in BLOCK:
            yield _lay_out(child, out, depth, pre, seen)
            if tag in ("td", "th"):
                out.text(" ")
            continue
        spaced = tag in SPACED and not (tag in ("ul", "ol") and depth)
        out.end(blank=spaced)
        before = out.lead
        if tag == "li":
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            out.lead = before[:WIDEST] + mark
        elif tag in ("blockquote", "dd") and len(before) < WIDEST:
            out.lead = before + "  "
        yield _lay_out(child, out, depth + (tag in ("ul", "ol")), pre or tag == "pre", seen)
        out.end(blank=spaced)
        out.lead = before


def _rendered(node: Node, shown: bool = True) -> Step:
    out = _Lines()
    yield _lay_out(node, out, 0, False, shown if node.shown is None else node.shown)
    out.end()
    while out.done and not out.done[-1]:
        out.done.pop()
    return out.done


def render(source: str | None) -> str:
    return "\n".join(_done(_rendered(tree(source)))).strip("\n") if source else ""


def extract(pages: DataFrame, source: str = "html", name: str = "text") -> DataFrame:
    """All columns of the pages but the html, and the visible text."""

    def make(batch: pa.RecordBatch) -> list:
        return [pa.array([render(x) for x in text_column(batch, source).to_pylist()], type=pa.string())]

    return add_columns(pages, f"{name} string", make).drop(source)

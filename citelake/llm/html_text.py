"""HTML extraction by layout-aware rendering.

A tree builder applies implied tags (a ``<li>`` ends the open ``<li>``, a block ends an open ``<p>``, a ``<td>`` ends the
open cell ...) and ignores end tags that match nothing; visibility rules drop what a browser would not show (head,
script, style, comments, ``hidden``, ``display:none``, closed ``<details>`` and ``<dialog>`` and the like;
``visibility`` is inherited and can be turned on again inside). The renderer then emits all visible text: blocks on lines
of their own, headings and paragraphs set off by an empty line, list items with bullets or numbers and indented by
depth, ``<pre>`` as it stands, table cells aligned in the columns of a grid with column and row spans, and before a
table what lies between its parts.

Defined results: null, empty or markup-free input gives its text (null: empty); unclosed or stray tags, cut-off markup
and nesting of any depth are rendered as far as they go, without recursion and in time that grows with the page alone;
indentation and padding have bounds, text has none; rows, repeated ones too, and extra columns pass through, but a column
of the output's name gives way; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from citelake.llm.bpe import _renamed
from citelake.llm.common import fresh_name, mapped

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noembed noframes iframe object audio video canvas datalist area base link meta param source track desc defs metadata annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Opening the key ends open elements of its set, unless one of the bounds is met first.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
TABLE_PARTS = frozenset("tr tbody thead tfoot table".split())
TABLE_CONTEXT = frozenset("table tbody thead tfoot tr".split())
CELLS = frozenset("td th caption".split())
#: The element that the key goes into; whatever else is open in it ends.
CONTEXTS = {
    "td": {"tr", "tbody", "thead", "tfoot", "table"},
    "th": {"tr", "tbody", "thead", "tfoot", "table"},
    "tr": {"tbody", "thead", "tfoot", "table"},
    "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}, "caption": {"table"},
}
FOREIGN = frozenset("svg math".split())
#: Columns that lists and quotes indent by at most, that a cell pads others to, that an aligned row takes.
MAX_INDENT, MAX_CELL, MAX_ROW = 40, 80, 240
#: Tables inside tables that are laid out; cells of deeper ones are lines.
MAX_TABLES = 16
#: An end tag does not look for its start beyond these.
SCOPE = frozenset("table td th caption html template".split())

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
#: One attribute, or the white space and slashes before the end of a tag; a quote that isn't closed runs to the end.
_ATTRIBUTE = re.compile(r"[\s/]*(?:([^\s/>][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]*))?)?")
_COMMENT_END = re.compile(r"--!?>")
_GONE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")


@dataclass
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes and strings


def _attributes(text: str, at: int) -> tuple[dict[str, str], bool, int]:
    """Attributes of a tag from a place after its name, whether it closes itself, and the place after it or -1."""
    out: dict[str, str] = {}
    n = len(text)
    while at < n and text[at] != ">":
        m = _ATTRIBUTE.match(text, at)
        if m[1]:
            value = m[2] or ""
            if value[:1] in ("'", '"'):
                value = value[1:-1] if len(value) > 1 and value[-1] == value[0] else value[1:]
            out.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)
        at = m.end()
    return out, at < n and text[at - 1] == "/", at + 1 if at < n else -1


class _Open:
    """The open elements, with the places of each tag, so that no tag has to look through all of them."""

    def __init__(self, root: Node) -> None:
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.scopes, self.hard, self.blocks = [0], [0], [0]  # places of SCOPE, of those that table tags stop at, of blocks

    def lists(self, tag: str) -> Iterator[list[int]]:
        yield self.places.setdefault(tag, [])
        if tag in SCOPE:
            yield self.scopes
            if tag not in CELLS:
                yield self.hard
        if tag != "p" and (tag in SCOPE or tag in BLOCK):
            yield self.blocks

    def push(self, node: Node) -> None:
        for places in self.lists(node.tag):
            places.append(len(self.stack))
        self.stack.append(node)

    def close_to(self, k: int) -> None:
        while len(self.stack) > max(k, 1):
            for places in self.lists(self.stack.pop().tag):
                places.pop()

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def first_after(self, tags, bound: int) -> int | None:
        found = [p[k] for t in tags if (p := self.places.get(t)) and (k := bisect_right(p, bound)) < len(p)]
        return min(found, default=None)

    def end(self, tag: str) -> None:
        """An end tag: the nearest element of its name goes, unless a scope lies between."""
        k = self.last(HEADINGS if tag in HEADINGS else (tag,))
        if k and (self.hard if tag in TABLE_PARTS else self.scopes)[-1] <= k:
            self.close_to(k)

    def make_room(self, tag: str) -> None:
        """What a start tag ends by being there."""
        if tag in ENDS_P and (k := self.last(("p",))) > self.blocks[-1]:
            self.close_to(k)
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.close_to(len(self.stack) - 1)
        if tag in IMPLIED:
            ends, bounds = IMPLIED[tag]
            bound = self.last(bounds)
            lowest = self.first_after(ends, bound) if tag in TABLE_PARTS else k if (k := self.last(ends)) > bound else None
            if lowest is not None:
                self.close_to(lowest)
        if tag in CONTEXTS and (k := self.last(CONTEXTS[tag])) > self.last(CELLS):
            self.close_to(k + 1)  # other elements between the parts of a table do not hold its cells


def parse(text: str) -> Node:
    """The tree of a page or fragment, in time linear in its length."""
    root = Node("#root")
    open_ = _Open(root)
    stack = open_.stack
    at, n = 0, len(text)

    def add_text(s: str) -> None:
        if s:
            stack[-1].children.append(s if "&" not in s else html.unescape(s))

    done = 0  # text up to here is in the tree
    while (at := text.find("<", at)) >= 0:
        sign = text[at + 1 : at + 2]
        closing = sign == "/"
        name = _NAME.match(text, at + 1 + closing)
        if name is None and sign not in ("!", "?", "/"):
            at += 1
            continue
        add_text(text[done:at])
        if name is None:
            if text.startswith("<!--", at):
                m = None if text.startswith((">", "->"), at + 4) else _COMMENT_END.search(text, at + 4)
                at = m.end() if m else text.find(">", at + 4) + 1 if text.startswith((">", "->"), at + 4) else n
            else:
                at = text.find(">", at) + 1 or n
            done = at
            continue
        tag = name[0].lower()
        attributes, slash, at = _attributes(text, name.end())
        done = at = n if at < 0 else at
        if at == n and text[-1] != ">":
            break  # the page ends inside a tag
        if closing:
            if tag == "p" and not open_.places.get("p"):
                stack[-1].children.append(Node("p"))
            open_.end(tag)
            continue
        open_.make_room(tag)
        if stack[-1].tag == "head" and (tag == "body" or tag not in UNSEEN and tag != "noscript"):
            open_.close_to(len(stack) - 1)
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in VOID or tag == "form" and stack[-1].tag in TABLE_CONTEXT:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(text, at)
            content = text[at : end.start()] if end else text[at:]
            if content:
                node.children.append(html.unescape(content) if tag in ("textarea", "title") else content)
            done = at = (text.find(">", end.end()) + 1 or n) if end else n
            continue
        if slash and (tag in FOREIGN or open_.last(FOREIGN)):
            continue
        open_.push(node)
    add_text(text[done:])
    return root


def rendered(node: Node) -> bool:
    """Whether an element has a box at all."""
    a = node.attributes
    if node.tag in UNSEEN or "hidden" in a and a["hidden"].lower() != "until-found":
        return False
    if node.tag == "input":
        return a.get("type", "").lower() in ("submit", "button", "reset") and bool(a.get("value"))
    if node.tag == "dialog" and "open" not in a:
        return False
    return not ("style" in a and _GONE.search(a["style"]))


def shown_in(node: Node, shown: bool) -> bool:
    """Whether text of an element is visible, given that of the element around it."""
    m = _VISIBILITY.search(node.attributes["style"]) if "style" in node.attributes else None
    return m[1].lower() == "visible" if m else shown


def width(s: str) -> int:
    """Columns of a monospaced line: wide characters take two, combining ones none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class _Flow:
    """Lines of one block container."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False  # a space is due before the next text
        self.blank = False  # an empty line is due before the next line
        self.prefix: list[str] = []  # indentation of open lists and quotes
        self.indent = ""  # all of it, MAX_INDENT columns at most
        self.mark: str | None = None  # bullet of the next line

    def text(self, s: str) -> None:
        words = _SPACES.sub(" ", s)
        if words[:1] == " ":
            self.gap = True
        body = words.strip(" ")
        if not body:
            return
        if self.gap and self.line:
            self.line.append(" ")
        self.line.append(body)
        self.gap = words[-1] == " "

    def end_line(self) -> None:
        if self.line:
            self.emit("".join(self.line))
            self.line = []
        self.gap = False

    def emit(self, s: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        indent = self.indent
        if self.mark is not None:
            indent, self.mark = indent[: max(len(indent) - len(self.mark), 0)] + self.mark, None
        self.lines.append((indent + s).rstrip())

    def push(self, s: str) -> None:
        self.prefix.append(s if len(self.indent) + len(s) <= MAX_INDENT else "")
        self.indent += self.prefix[-1]

    def pop(self) -> None:
        s = self.prefix.pop()
        self.indent = self.indent[: len(self.indent) - len(s)]

    def part(self, spaced: bool) -> None:
        self.end_line()
        self.blank |= spaced and self.mark is None


def _number(ordered: Node) -> str:
    """The number of the next item of an ordered list."""
    given = ordered.attributes.get("#next", ordered.attributes.get("start", "1")).strip()
    k = int(given) if re.fullmatch(r"-?[0-9]{1,9}", given) else 1
    ordered.attributes["#next"] = str(k + 1)
    return f"{k}. "


def _parts(table: Node, shown: bool) -> tuple[list[tuple[str, list[tuple[Node, bool]]]], list[tuple[object, bool]]]:
    """Rows of a table (not of tables inside it), and what lies between its parts, which browsers show before it."""
    rows: list[tuple[str, list[tuple[Node, bool]]]] = []
    loose: list[tuple[object, bool]] = []
    todo = [(c, shown, True) for c in reversed(table.children)]
    while todo:
        node, seen, there = todo.pop()
        if isinstance(node, str):
            if node.strip():
                loose.append((node, seen))
            continue
        there = there and rendered(node)
        if node.tag in ("tbody", "thead", "tfoot"):
            todo += [(c, shown_in(node, seen), there) for c in reversed(node.children)]
        elif node.tag == "tr":
            seen = shown_in(node, seen)
            if there:
                cells = [c for c in node.children if isinstance(c, Node) and c.tag in ("td", "th") and rendered(c)]
                rows.append(("tr", [(c, seen) for c in cells]))
            loose += [(c, seen) for c in node.children if isinstance(c, str) and c.strip() or isinstance(c, Node) and c.tag not in ("td", "th")]
        elif node.tag in ("caption", "td", "th"):
            if there:
                rows.append((node.tag, [(node, seen)]))
        elif node.tag not in ("colgroup", "col"):
            loose.append((node, seen))
    return rows, loose


def _span(cell: Node, name: str, most: int) -> int:
    s = cell.attributes.get(name, "1").strip()
    return min(max(int(s), 1), most) if s.isascii() and s.isdigit() and len(s) < 6 else 1


def render(root: Node) -> str:
    """All visible text of a tree. Tables wait on a stack until their cells are rendered."""
    out = _Flow()
    # ("node", flow, node, pre, parent, shown, tables around), ("end", flow, node, indented), ("table", flow, rows)
    todo: list[tuple] = [("node", out, root, False, root, True, 0)]
    while todo:
        item = todo.pop()
        kind, flow = item[0], item[1]
        if kind == "end":
            _, _, node, indent = item
            flow.part(node.tag in SPACED)
            if indent:
                flow.pop()
            if node.tag == "li":
                flow.mark = None
            continue
        if kind == "table":
            _lay_out(flow, item[2])
            continue
        _, _, node, pre, owner, shown, depth = item
        if isinstance(node, str):
            if not shown:
                continue
            if pre:
                first, *more = node.split("\n")
                if first:
                    flow.line.append(first.expandtabs(4))
                for s in more:
                    flow.emit("".join(flow.line))
                    flow.line = [s.expandtabs(4)] if s else []
            else:
                flow.text(node)
            continue
        if not rendered(node):
            continue
        shown = shown_in(node, shown)
        tag = node.tag
        if tag == "br":
            if flow.line:
                flow.end_line()
            else:
                flow.emit("")
            continue
        if tag == "hr":
            flow.part(False)
            flow.emit("---")
            continue
        if tag == "img":
            continue
        if tag == "input":
            if shown:
                flow.text(node.attributes["value"])
            continue
        if tag == "table" and depth < MAX_TABLES:
            flow.part(True)
            rows, loose = _parts(node, shown)
            laid, later = [], []
            for name, cells in rows:
                made = [(_Flow(), c, seen) for c, seen in cells]
                laid.append((name, [(_span(c, "colspan", 1000), _span(c, "rowspan", 65534), f) for f, c, _ in made]))
                later += [("node", f, Node("#cell", c.attributes, c.children), False, c, seen, depth + 1) for f, c, seen in made]
            todo.append(("end", flow, node, False))
            todo.append(("table", flow, laid))
            todo += reversed(later)
            todo.append(("end", flow, Node("div"), False))
            todo += [("node", flow, c, False, node, seen, depth + 1) for c, seen in reversed(loose)]
            continue
        block = tag in BLOCK or tag in ("tr", "td", "th", "caption")
        if block:
            flow.part(tag in SPACED and not (tag in ("ul", "ol") and flow.prefix))
            indent = tag in ("ul", "ol", "menu", "dir", "blockquote", "dd")
            if indent:
                flow.push("   " if tag == "ol" else "  ")
            if tag == "li":
                flow.mark = _number(owner) if owner.tag == "ol" else "- "
            todo.append(("end", flow, Node(tag if not (tag in ("ul", "ol") and len(flow.prefix) > 1) else "div"), indent))
        inner = pre or tag in ("pre", "textarea", "listing", "xmp")
        children = node.children
        if inner and not pre and children and isinstance(children[0], str) and children[0].startswith("\n"):
            children = [children[0][1:], *children[1:]]
        if tag == "details" and "open" not in node.attributes:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        todo += [("node", flow, c, inner, node, shown, depth) for c in reversed(children)]
    out.end_line()
    return "\n".join(out.lines).strip("\n")


def _lay_out(flow: _Flow, rows: list) -> None:
    """Cells side by side, padded to the width of their column. A cell over several columns pads to all of them; one over
    several rows leaves its columns free in the rows below. Columns beyond MAX_ROW are not padded."""
    for _, cells in rows:
        for *_, f in cells:
            f.end_line()
    places, held = [], {}  # of the cells of each row; rows that a column is still held for
    widths: dict[int, int] = {}
    for tag, cells in rows:
        k, placed = 0, []
        for columns, more, f in cells if tag == "tr" else ():
            while k <= MAX_ROW and held.get(k):
                k += 1
            placed.append((k, columns, f))
            if columns == 1:
                widths[k] = max(widths.get(k, 0), *(min(width(s), MAX_CELL) for s in f.lines), 0)
            for c in range(k, min(k + columns, MAX_ROW)):
                held[c] = more
            k += columns
        held = {c: left - 1 for c, left in held.items() if left > 1} if tag == "tr" else held
        places.append(placed)
    starts = [0]
    while len(starts) <= MAX_ROW:
        starts.append(min(starts[-1] + widths.get(len(starts) - 1, 0) + 3, MAX_ROW))
    for (tag, cells), placed in zip(rows, places, strict=True):
        if tag != "tr":
            for *_, f in cells:
                for s in f.lines:
                    flow.emit(s)
            continue
        for line in range(max((len(f.lines) for *_, f in cells), default=0)):
            made, at = [], 0
            for k, columns, f in placed:
                a, b = (starts[min(c, MAX_ROW)] for c in (k, k + columns))
                for c in range(at, min(k, MAX_ROW)):  # columns held by cells above
                    made.append(" " * max(starts[c + 1] - starts[c] - 3, 0))
                s = f.lines[line] if line < len(f.lines) else ""
                made.append(s + " " * max(0, b - a - 3 - width(s)))
                at = k + columns
            flow.emit(" | ".join(made))


def to_text(page: str | None) -> str:
    return render(parse(page)) if page else ""


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """pages with a column of their visible text; narrow, a page in memory at a time."""
    tmp = fresh_name("text")
    k = pages.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                made = pa.array([to_text(x.as_py()) for x in part.column(k)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, tmp])

    return _renamed(mapped(pages, run, [T.StructField(tmp, T.StringType(), False)]), pages, tmp, out)

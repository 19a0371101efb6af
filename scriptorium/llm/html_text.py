"""Visible text of HTML pages, laid out as a reader sees it."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches
from .markup import CONTENT, END, RAW, START, TEXT, Scanner

_SHOW = re.compile(r"(display|visibility)\s*:\s*([\w-]+)\s*(!\s*important)?", re.I)
_CSS = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->|\"(?:[^\"\\\n]|\\(?:.|\Z))*\"?|'(?:[^'\\\n]|\\(?:.|\Z))*'?|[{};]", re.S)
_SCREEN = re.compile(r"(?:only\s+)?(?:screen|all)|not\s+(?:print|speech)|", re.I)
_SPACE = re.compile(r"[ \t\n\f\r]+")
#: Element classes of the HTML standard (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes datalist object audio video canvas desc defs symbol metadata".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir".split())
ENDS_P = BLOCK - frozenset("body html option optgroup td th tr tbody thead tfoot caption legend".split())
#: A start tag closes these open elements, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}), "th": ({"td", "th", "caption"}, {"tr", "table"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
#: Depth of the tree: what is opened deeper hangs at this depth, in order, seen as far as its true parent is. Columns are aligned up to this width, and up to this one in all; blocks within blocks are indented up to the last.
MOST_OPEN, MOST_WIDTH, MOST_INDENT, MOST_MARGIN = 200, 60, 400, 24
#: Columns and rows that a cell reaches over at most; columns beyond the first of these don't reach into later rows.
MOST_COLUMNS, MOST_ROWS = 100, 1000


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)
    under: Node | None = None  # the true parent of what hangs at the depth of the tree
    goes_on: bool = False  # whether this is more text of that parent
    shown: bool = True  # whether anything of it may be seen, and whether text in it is, once it has been walked
    sees: bool = True


def build(source: str) -> tuple[Node, list[str]]:
    """(tree, style sheets) of a page; missing start and end tags are implied."""
    root = Node("html")
    stack, sheets = [root], []
    opened: Counter[str] = Counter()

    def place(x: Node | str) -> None:
        parent = stack[-1]
        if len(stack) <= MOST_OPEN:
            parent.children.append(x)
            return
        host = stack[MOST_OPEN - 1].children
        if isinstance(x, Node):
            x.under = parent
            host.append(x)
            return
        last = host[-1]
        if last is not parent and not (isinstance(last, Node) and last.goes_on and last.under is parent):
            last = Node("div" if parent.tag in BLOCK else "span", under=parent, goes_on=True)
            host.append(last)
        last.children.append(x)

    def cut(at: int) -> None:
        opened.subtract(x.tag for x in stack[at:])
        del stack[at:]

    def text(s: str) -> None:
        if s:
            place(html.unescape(s))

    def close(tags: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> None:
        """Closes the outermost open element of `tags` inside the innermost of `until`."""
        if not any(opened[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in until:
                break
            if stack[i].tag in tags:
                last = i
                while last > 1 and stack[last - 1].tag in tags:
                    last -= 1
                cut(last)
                return

    def open_(tag: str, attrs: dict[str, str]) -> None:
        if tag in ENDS_P:
            close({"p"}, {"table", "td", "th", "button", "caption", "object"})
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            open_("tr", {})
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            cut(len(stack) - 1)
        if tag in BLOCK and tag not in ("html", "body") and len(stack) > 1 and stack[-1].tag == "head":
            cut(len(stack) - 1)
        node = Node(tag, attrs)
        empty = tag in VOID or tag == "form" and stack[-1].tag in ("table", "tbody", "thead", "tfoot", "tr")  # a form between cells holds nothing
        place(node)
        if not empty:
            stack.append(node)
            opened[tag] += 1

    for kind, name, attrs in Scanner(source).tokens():
        if kind == TEXT:
            text(name)
        elif kind == CONTENT:
            if stack[-1].tag == "style" and _on_screen(stack[-1].attrs.get("media", "")):
                sheets.append(name)
            stack[-1].children.append(html.unescape(name) if stack[-1].tag in ("textarea", "title") else name)
        elif kind == END:
            for i in range(len(stack) - 1 if opened[name] else 0, 0, -1):
                if stack[i].tag == name:
                    cut(i)
                    break
                if stack[i].tag in ("td", "th", "table") and name not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                    break
        elif name in ("html", "body"):
            if stack[1:] and stack[-1].tag == "head":
                cut(len(stack) - 1)
            root.attrs = attrs | root.attrs
        else:
            open_(name, attrs)
    return root, sheets


def _on_screen(condition: str) -> bool:
    """Whether a media list surely holds on a screen; a condition on its size or the like may not."""
    return any(_SCREEN.fullmatch(part.strip()) for part in condition.split(","))


def _declared(text: str, order: int) -> Iterator[tuple[str, tuple[bool, int, str]]]:
    """(property, (important, order, value)) of the declarations of a block that say what is seen."""
    for name, value, important in _SHOW.findall(text):
        yield name.lower(), (bool(important), order, value.lower())


@dataclass(frozen=True)
class Simple:
    """A tag, an id and classes that an element must all have."""

    tag: str
    ids: frozenset[str]
    classes: frozenset[str]

    def fits(self, node: Node) -> bool:
        return (not self.tag or node.tag == self.tag) and (not self.ids or self.ids == {node.attrs.get("id", "").lower()}) and self.classes <= set(node.attrs.get("class", "").lower().split())


#: By id, class or tag of an element: (ancestors, the element, weight, property, declaration) of each rule for it.
Rules = dict[str, list[tuple[list[Simple], Simple, tuple[int, int, int], str, tuple[bool, int, str]]]]
_SIMPLE = re.compile(r"[\w-]*(?:[.#][\w-]+)*")


def selector_of(text: str) -> list[Simple] | None:
    """Of `tag.class#id` and such inside one another; null for other selectors."""
    out = []
    for part in text.lower().split():
        if not _SIMPLE.fullmatch(part):
            return None
        names = re.findall(r"[.#]?[\w-]+", part)
        out.append(Simple("".join(x for x in names if x[0] not in ".#"), frozenset(x[1:] for x in names if x[0] == "#"), frozenset(x[1:] for x in names if x[0] == ".")))
    return out or None


def rules_of(sheets: list[str]) -> Rules:
    """What style sheets say of display and visibility, whatever the screen, by tags, classes, ids and what they stand in. Nested rules depend on their parents and don't count."""
    out: Rules = {}
    order = 0
    for sheet in sheets:
        opened: list[str | bool] = []  # selectors of a rule, or whether rules of a group count
        words: list[str] = []
        at = 0

        def end() -> None:
            nonlocal order
            if opened and isinstance(opened[-1], str):
                order += 1
                for name, said in _declared("".join(words), order):
                    for selector in opened[-1].split(","):
                        if chain := selector_of(selector):
                            *outer, own = chain
                            weight = tuple(sum(x) for x in zip(*((len(c.ids), len(c.classes), bool(c.tag)) for c in chain), strict=True))
                            key = "#" + min(own.ids) if own.ids else "." + min(own.classes) if own.classes else own.tag
                            out.setdefault(key, []).append((outer, own, weight, name, said))
            words.clear()

        for m in _CSS.finditer(sheet):
            words.append(sheet[at : m.start()])
            at = m.end()
            if m[0] == "{":
                start = "".join(words).strip()
                words.clear()
                if opened and opened[-1] is not True:
                    opened.append(False)
                elif start.startswith("@"):
                    name, _, condition = start[1:].replace("(", " (", 1).partition(" ")
                    opened.append(name.lower() == "layer" or name.lower() == "media" and _on_screen(condition))
                else:
                    opened.append(start)
            elif m[0] == ";":
                end()
            elif m[0] == "}":
                end()
                if opened:
                    opened.pop()
            else:
                words.append(" " if m[0][0] in "/<-" else '""')
        words.append(sheet[at:])
        end()
    return out


class Page:
    """Lines of a page while its tree is walked."""

    def __init__(self, rules: Rules):
        self.rules = rules
        self.visible = True  # whether text is seen where the walk is
        self.path: list[Node] = []  # elements that it is in
        self.margin = 0

    def _style(self, node: Node) -> dict[str, tuple]:
        """What the strongest declaration says: important ones first, then by selector (tags, classes, ids, the element's own), then the last."""
        out: dict[str, tuple] = {}
        style = node.attrs.get("style", "")
        if self.rules:
            keys = [node.tag, *("." + c for c in node.attrs.get("class", "").lower().split()), "#" + node.attrs.get("id", "").lower()]
            for outer, own, weight, prop, (important, order, value) in (rule for key in keys for rule in self.rules.get(key, ())):
                said = (important, weight, order, value)
                if (prop not in out or said > out[prop]) and own.fits(node) and (not outer or self.inside(outer)):
                    out[prop] = said
        for prop, (important, order, value) in _declared(style, 0) if style else ():
            said = (important, (math.inf,), order, value)
            if prop not in out or said[:3] >= out[prop][:3]:
                out[prop] = said
        return out

    def inside(self, outer: list[Simple]) -> bool:
        """Whether elements that fit lie around the walk, in this order."""
        left = len(outer)
        for node in reversed(self.path):
            if left and outer[left - 1].fits(node):
                left -= 1
        return not left

    def seen(self, node: Node) -> bool:
        """Whether anything of an element may be seen; its visibility is looked at where its text is."""
        node.shown = (node.under is None or node.under.shown) and self._seen(node)
        return node.shown

    def _seen(self, node: Node) -> bool:
        if node.tag in UNSEEN or node.tag == "input" or node.tag == "dialog" and "open" not in node.attrs:
            return False
        if not self.rules and "style" not in node.attrs:
            return "hidden" not in node.attrs
        display = self._style(node).get("display")
        return "hidden" not in node.attrs if display is None else display[-1] != "none"

    def enter(self, node: Node) -> bool:
        """Takes over the visibility of an element; returns the one before, for leave()."""
        before = self.visible
        if node.under is not None:
            self.visible = node.under.sees
        if self.rules or "style" in node.attrs:
            said = self._style(node).get("visibility")
            if said and said[-1] in ("hidden", "collapse", "visible"):
                self.visible = said[-1] == "visible"
        if node.tag == "svg":
            self.visible = False  # of a drawing only its texts
        elif node.tag in ("text", "foreignobject"):
            self.visible = True
        node.sees = self.visible
        self.path.append(node)
        return before

    def leave(self, before: bool) -> None:
        self.visible = before
        self.path.pop()

    def lines(self, node: Node, kept: bool = False) -> list[str]:
        """Lines of what a node holds. Empty lines stand between blocks that are spaced."""
        out: list[str] = []
        run: list[str] = []
        gap = False  # whether a blank line is due before the next line

        def flush() -> None:
            nonlocal gap
            joined = "".join(run)
            run.clear()
            found = joined.split("\n") if kept else [_SPACE.sub(" ", x).strip(" ") for x in joined.split("\x00")]
            if not kept:
                while found and not found[-1]:
                    found.pop()
            if any(x.strip() for x in found):
                put(found)

        def put(found: list[str]) -> None:
            nonlocal gap
            if gap and out:
                out.append("")
            gap = False
            out.extend(x.replace("\xa0", " ").rstrip() for x in found)

        def walk(nodes: list[Node | str]) -> None:
            nonlocal gap
            number = 0
            for x in nodes:
                if isinstance(x, str):
                    if self.visible:
                        run.append(x if kept else x.replace("\x00", ""))
                    continue
                if not self.seen(x):
                    continue
                before = self.enter(x)
                if x.tag == "br":
                    run.append("\n" if kept else "\x00")
                elif x.tag in BLOCK:
                    flush()
                    number += x.tag == "li"
                    inner = self.block(x, node, number, kept or x.tag == "pre")
                    if inner:
                        gap = gap or x.tag in SPACED
                        put(inner)
                        gap = x.tag in SPACED
                else:
                    walk(x.children)
                self.leave(before)

        walk(node.children)
        flush()
        return out

    def block(self, node: Node, parent: Node, number: int, kept: bool) -> list[str]:
        if node.tag == "table":
            return self.table(node)
        mark = ""
        if node.tag == "li":
            first = parent.attrs.get("start", "1") if parent.tag == "ol" else ""
            mark = f"{(int(first) if first.isdecimal() and len(first) < 9 else 1) + number - 1}. " if parent.tag == "ol" else "- "
        indent = " " * (len(mark) if mark else 4 if node.tag in ("dd", "blockquote") else 0)
        if self.margin + len(indent) > MOST_MARGIN:
            indent = ""
        self.margin += len(indent)
        found = self.lines(node, kept)
        self.margin -= len(indent)
        if node.tag == "pre":
            while found and not found[0].strip():
                found.pop(0)
            while found and not found[-1].strip():
                found.pop()
        if mark and found:
            return [mark + found[0], *((indent + x) if x else x for x in found[1:])]
        return [(indent + x) if x else x for x in found] if indent else found

    def parts(self, node: Node) -> tuple[list[Node | str], list[Node]]:
        """(loose content, rows) of a table; rows count wherever they stand outside a table of their own."""
        loose: list[Node | str] = []
        rows: list[Node] = []
        for x in node.children:
            if isinstance(x, str) or x.tag == "table":
                loose.append(x)
            elif self.seen(x):
                if x.tag == "tr":
                    rows.append(x)
                else:
                    self.path.append(x)
                    own, inner = self.parts(x)
                    self.path.pop()
                    if inner:
                        x.children = own
                    loose.append(x)
                    rows += inner
        return loose, rows

    def table(self, node: Node) -> list[str]:
        """Rows of cells, columns aligned; what stands between them comes first. A cell is shown in the first row and column that it reaches over."""
        loose, rows = self.parts(node)
        out = self.lines(Node("div", {}, loose))
        grid: list[list[tuple[int, list[str]]]] = []
        held: dict[int, int] = {}  # the first columns, and the row up to which a cell above reaches into them
        for number, tr in enumerate(rows):
            row: list[tuple[int, list[str]]] = []
            before = self.enter(tr)
            column, taken = 0, {}
            for cell in tr.children:
                if isinstance(cell, Node) and not self.seen(cell) or isinstance(cell, str) and not cell.strip():
                    continue
                if isinstance(cell, Node) and cell.tag in ("td", "th"):
                    across, down = (_span(cell, name, most) for name, most in (("colspan", MOST_COLUMNS), ("rowspan", MOST_ROWS)))
                    outer = self.enter(cell)
                    found = self.lines(cell)
                    self.leave(outer)
                else:
                    across, down, found = 1, 1, self.lines(Node("td", {}, [cell]))
                while held.get(column, 0) > number:
                    column += 1
                if found:
                    row.append((column, found))
                if down > 1:
                    taken |= dict.fromkeys(range(column, min(column + across, MOST_COLUMNS)), number + down)
                column += across
            self.leave(before)
            held |= taken
            if row:
                grid.append(row)
        widths: dict[int, int] = {}
        for row in grid:
            for column, cell in row:
                widths[column] = max(widths.get(column, 0), *(len(x) for x in cell if len(x) <= MOST_WIDTH), 0)
        starts, at, last = {}, 0, -1
        for column in sorted(widths):
            at = min(MOST_INDENT, at + 2 * (column - last - 1))
            starts[column] = at
            at, last = min(MOST_INDENT, at + widths[column] + 2), column
        for row in grid:
            for k in range(max(len(cell) for _, cell in row)):
                line, size = [], 0
                for column, cell in row:
                    if k < len(cell) and cell[k]:
                        gap = max(starts[column] - size, 2 if size else 0)
                        line.append(" " * gap + cell[k])
                        size += gap + len(cell[k])
                out.append("".join(line))
        return out


def _span(cell: Node, name: str, most: int) -> int:
    text = cell.attrs.get(name, "1").strip()
    return max(1, min(int(text), most)) if text.isdecimal() and len(text) < 6 else 1


def render(source: str | None) -> str:
    if not source:
        return ""
    root, sheets = build(source)
    page = Page(rules_of(sheets))
    page.enter(root)
    return "\n".join(page.lines(root)) if page.seen(root) else ""


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([render(x) for x in batch.column(1).to_pylist()], pa.string())], names=batch.schema.names)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text): all visible text of each page.

    A tree is built with implied tags; elements that are never shown, that carry `hidden` or an
    inline style or a rule of tags, classes and ids that hides them on any screen, are left out with all they hold. Blocks begin
    new lines, and paragraphs, headings, lists and tables stand apart by a blank line; lists
    have marks and indents; table columns are aligned. A null or empty page has an empty text.
    Rows that repeat an id all stay; an empty table gives no rows; other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias(id_col), F.col(html_col).cast("string").alias("text"))
    return arrow_batches(rows, _rendered, f"{id_col} long, text string", rows=500)

"""Visible text of HTML pages, laid out as a reader sees it.

A tokenizer, a tree builder with implied tags, and a renderer:

* **Tree.** Void elements, end tags that the next tag implies (``p``, ``li``, ``dt``/``dd``, table parts,
  ``option``), elements that end at their parent's end tag, raw text in ``script``/``style`` and the like. A stray end tag is dropped.
* **Visibility.** Nothing below the elements of ``UNSEEN`` (``head``, ``script``, ``style``, ``template``, embedded
  media), below an element with ``hidden``, or with ``display:none`` or ``visibility:hidden`` in its style. All other text
  is kept: navigation and footers, options, formulas, labels of drawings (but not what ``UNSEEN_FOREIGN`` names
  there), and ``noscript``, as no script runs here.
* **Layout.** White space folds except in ``pre`` and ``textarea``. Blocks stand on their own lines, paragraphs and headings
  with an empty line between; ``br`` breaks a line; list items get a dash or their number, indented by depth;
  table rows are lines whose cells are padded to the width of their column.

A null page gives a null text; an empty one, or one without visible text, an empty text. Depth is not
limited by recursion. Unknown elements are inline. Repeated rows give repeated results; other columns are not read.
A page of any length is read in one go; the work of a tag does not grow with the number of open elements.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
PLAIN_TEXT = frozenset("textarea title".split())
UNSEEN = frozenset("head script style template title noembed noframes iframe datalist audio video canvas object".split())
#: Not shown inside drawings and formulas.
UNSEEN_FOREIGN = frozenset("desc defs metadata annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset details".split())
BLOCK = SPACED | frozenset("html body div section article aside header footer nav main address li dt dd figcaption form legend summary tr thead tbody tfoot caption center dir menu hgroup search optgroup option".split())
#: A start tag of the key ends an open element of the values, looked for up to the scope.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tbody": ({"tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: A start tag of these ends an open paragraph.
ENDS_P = BLOCK - {"html", "body", "tr", "thead", "tbody", "tfoot", "caption", "option", "optgroup", "legend"}
#: An end tag does not reach beyond these.
WALLS = frozenset("table td th caption template".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
FOLD = re.compile(r"[ \t\n\f\r]+")


class Element:
    __slots__ = ("name", "seen", "children", "number")

    def __init__(self, name: str, seen: bool, number: int | None = None):
        self.name, self.seen, self.children, self.number = name, seen, [], number


class Stack(list):
    """The open elements, with the places of each name, so that no tag walks the whole stack."""

    def __init__(self, root: Element):
        super().__init__([root])
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, element: Element) -> None:
        self.places.setdefault(element.name, []).append(len(self))
        if element.name in WALLS or element.name in BLOCK:
            self.blocks.append(len(self))
        self.append(element)

    def cut(self, at: int) -> None:
        while len(self) > at:
            self.places[self.pop().name].pop()
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()

    def top(self, names) -> int:
        """The highest place of these names, or 0."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def lowest(self, names, above: int) -> int | None:
        """The lowest place of these names above a place."""
        found = [held[k] for n in names if (held := self.places.get(n)) and (k := bisect_right(held, above)) < len(held)]
        return min(found, default=None)


def build(page: str) -> Element:
    """The tree of a page; text children are strings."""
    root = Element("#page", True)
    stack = Stack(root)
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        end, name, inside, text = m.group(1), m.group(2), m.group(3), m.group(4)
        if text is not None:
            stack[-1].children.append(html.unescape(text) if "&" in text else text)
        elif name is not None:
            name = name.lower()
            if end:
                _close(stack, name)
                continue
            _imply(stack, name)
            attributes = _attributes(inside) if inside and not inside.isspace() else {}
            foreign = stack.places.get("svg") or stack.places.get("math")
            seen = stack[-1].seen and name not in UNSEEN and not (foreign and name in UNSEEN_FOREIGN) and "hidden" not in attributes and not HIDDEN.search(attributes.get("style", ""))
            start = attributes.get("value" if name == "li" else "start", "")
            element = Element(name, seen, int(start) if start.isdecimal() and len(start) < 10 else None)
            stack[-1].children.append(element)
            if name in RAW or name in PLAIN_TEXT:
                closing = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                content = page[at : closing.start() if closing else n]
                element.children.append(html.unescape(content) if name in PLAIN_TEXT else content)
                at = closing.end() if closing else n
            elif name not in VOID and not (foreign and inside.endswith("/")):
                stack.push(element)
    return root


def _attributes(inside: str) -> dict[str, str]:
    return {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(inside)}


def _close(stack: Stack, name: str) -> None:
    at = stack.top([name])
    crosses = name in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "template")
    if at and (crosses or at >= stack.top(WALLS)):
        stack.cut(at)


def _imply(stack: Stack, name: str) -> None:
    if name in ENDS_P and stack.blocks and stack[stack.blocks[-1]].name == "p":
        stack.cut(stack.blocks[-1])
    ends, scope = IMPLIED.get(name, (None, None))
    if ends:
        lowest = stack.lowest(ends, stack.top(scope))
        if lowest is not None:
            stack.cut(lowest)


class Lines:
    """Collects text; knows whether a line or an empty line is due before the next word."""

    def __init__(self):
        self.out: list[str] = []
        self.due = 0
        self.gap = False
        self.prefix = ""
        self.indent = 0

    def text(self, text: str, keep: bool) -> None:
        if keep:
            for i, line in enumerate(text.split("\n")):
                if i:
                    self.out.append("\n" + " " * self.indent) if self.out else None
                if line:
                    self._start()
                    self.out.append(line)
            return
        folded = FOLD.sub(" ", text)
        if folded.startswith(" "):
            self.gap = True
        words = folded.strip(" ")
        if not words:
            return
        self._start()
        self.out.append(words)
        self.gap = folded.endswith(" ")

    def _start(self) -> None:
        if self.due or not self.out:
            if self.out:
                self.out.append("\n" * self.due + " " * self.indent)
            elif self.indent:
                self.out.append(" " * self.indent)
            self.out.append(self.prefix)
            self.prefix = ""
        elif self.gap:
            self.out.append(" ")
        self.due, self.gap = 0, False

    def line(self, n: int = 1) -> None:
        self.due = max(self.due, n)
        self.gap = False

    def whole(self) -> str:
        text = "".join(self.out)
        return "\n".join(x.rstrip(" ") for x in text.split("\n")).strip("\n")


def render(root: Element) -> str:
    """Text of a tree, with an explicit stack instead of recursion."""
    frames: list[tuple[Lines, list]] = []
    lines = Lines()
    pre, lists = 0, []
    todo: list = [("open", root)]
    while todo:
        step, item = todo.pop()
        if step == "open":
            if isinstance(item, str):
                lines.text(item, pre > 0)
                continue
            if not item.seen:
                continue
            name = item.name
            todo.append(("close", item))
            if name == "br":
                lines.line(min(2, lines.due + 1))
                continue
            if name in BLOCK:
                lines.line(2 if name in SPACED and not (name in ("ul", "ol") and lists) else 1)
            if name == "hr":
                continue
            if name in ("pre", "textarea"):
                pre += 1
            elif name in ("ul", "ol", "menu", "dir"):
                lists.append([name == "ol", item.number if item.number is not None else 1])
            elif name == "li":
                top = lists[-1] if lists else [False, 1]
                if item.number is not None:
                    top[1] = item.number
                lines.prefix = f"{top[1]}. " if top[0] else "- "
                top[1] += 1
                lines.indent = 2 * max(0, len(lists) - 1)
            elif name == "table":
                frames.append((lines, []))
                lines = Lines()
            elif name == "tr" and frames:
                frames[-1][1].append([])
            elif name in ("td", "th") and frames:
                if not frames[-1][1]:
                    frames[-1][1].append([])
                _loose(lines, frames[-1][1])
                lines = Lines()
            todo.extend(("open", c) for c in reversed(item.children))
        else:
            name = item.name
            if name in ("pre", "textarea"):
                pre -= 1
            elif name in ("ul", "ol", "menu", "dir"):
                lists.pop()
                lines.indent, lines.prefix = 2 * max(0, len(lists) - 1), ""
            elif name in ("td", "th") and frames:
                frames[-1][1][-1].append(" ".join(lines.whole().split("\n")) if "\n\n" not in lines.whole() else FOLD.sub(" ", lines.whole()))
                lines = Lines()
            elif name == "table":
                _loose(lines, frames[-1][1])
                lines, rows = frames.pop()
                grid = aligned(rows)
                if grid:
                    lines.text(grid, True)
            if name in BLOCK:
                lines.line(2 if name in SPACED and not (name in ("ul", "ol") and lists) else 1)
    return lines.whole()


def _loose(lines: Lines, rows: list[list[str]]) -> None:
    """Text inside a table but outside a cell, such as a caption, becomes a row of its own."""
    text = lines.whole()
    if text:
        if rows and not rows[-1]:
            rows.insert(len(rows) - 1, [text])
        else:
            rows.append([text])
        lines.__init__()


def aligned(rows: list[list[str]]) -> str:
    """Rows as lines, cells padded to the width of their column with two blanks between."""
    rows = [r for r in rows if any(r)]
    columns = max(map(len, rows), default=0)
    # A row of one cell, as a caption, does not widen the first column of the others.
    widths = [max((len(r[i]) for r in rows if len(r) > i and (len(r) > 1 or columns == 1)), default=0) for i in range(columns)]
    return "\n".join("  ".join(c.ljust(widths[i]) if i < len(r) - 1 else c for i, c in enumerate(r)).rstrip() for r in rows)


def visible_text(page: str | None) -> str | None:
    return None if page is None else render(build(page))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Per row: id, the visible text, and its length ``n_chars`` (null for a null page)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(p.as_py()) for p in batch.column(1)]
            columns = [batch.column(0), pa.array(texts, pa.string()), pa.array([None if t is None else len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, text_col, "n_chars"])

    rows = pages.select(F.col(id_col).cast("bigint").alias(id_col), F.col(html_col).cast("string").alias(html_col))
    return rows.mapInArrow(run, f"{id_col} bigint, {text_col} string, n_chars bigint")

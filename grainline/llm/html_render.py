"""Layout-aware text of HTML pages.

A page is cut into tags and text by one pattern, built into a tree with the
usual implied tags (p, li, dt/dd, option, table parts, head/body) and written
out block by block: paragraphs and headings keep a blank line, other blocks a
line break, list items get bullets or numbers and indentation, table cells
are aligned in columns, pre keeps its spaces.  What a browser does not show is
left out: head, scripts, styles, templates, comments, ``hidden``,
``display:none``, ``visibility:hidden`` (unless a descendant is visible
again), closed ``details`` but for the summary, and all but the selected (or
first) option of a select.  All other text is kept.

Cells are placed on the table's grid: one with ``rowspan`` holds its columns in
the rows below, and its lines go on there.  Columns are as wide as their widest
cell, whatever its length.  Both passes use explicit stacks, so depth is no
limit.  Memory stays in proportion to the page: only where padding would take
over ``PAD_TIMES`` the table's text and ``PAD_FREE`` characters, the widest columns
are padded less (their cells are written whole all the same).

Defined cases: NULL html gives NULL text, empty html an empty text; tags that
are cut off at the end of the page are dropped, unknown tags are inline, stray
end tags are ignored (``</p>`` is an empty paragraph, ``</br>`` a break);
order, repeats and ids of rows do not matter; empty tables give an empty
result; other columns pass through, but one named like ``out_col`` is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAD_TIMES, PAD_FREE = 8, 1 << 20

# quotes delimit a value directly after its "=", others are plain characters
_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+|(?=>)))?+)*+)>""", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_GAP = re.compile(r"[ \t\n\r\f]+")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_SEEN = re.compile(r"visibility\s*:\s*([a-z]+)", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes datalist title audio video canvas object".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre figure table hr fieldset".split())
BLOCK = MARGIN | frozenset("address article aside body caption center dd details dialog div dt figcaption footer form header hgroup html legend li "
                           "main menu nav search section summary thead tbody tfoot tr td th".split())
CLOSES_P = BLOCK - frozenset("body html caption thead tbody tfoot tr td th legend".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template head".split())
CELLS, SECTIONS = frozenset(("td", "th")), frozenset(("thead", "tbody", "tfoot"))
#: An opening tag closes these open elements, up to the nearest of the scope.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": (SECTIONS | {"tr", "caption"}, {"table"}), "tbody": (SECTIONS | {"tr", "caption"}, {"table"}), "tfoot": (SECTIONS | {"tr", "caption"}, {"table"}),
}
SCOPE = frozenset(("table", "td", "th", "caption", "html", "button", "template"))


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.kids = tag, attrs, []


def _attrs(text: str) -> dict:
    if not text or text == "/":
        return {}
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text):
        v = a or b or c
        out.setdefault(name.lower(), unescape(v) if "&" in v else v)
    return out


def build_tree(html: str) -> Node:
    """Tree of the page; text is str, elements are Nodes."""
    root = Node("#root", {})
    stack = [root]

    def close(tags, scope) -> None:
        for i in range(len(stack) - 1, 0, -1):
            t = stack[i].tag
            if t in tags:
                # up to the outermost of them inside the scope
                while i > 1 and stack[i - 1].tag in tags:
                    i -= 1
                del stack[i:]
                return
            if t in scope or t in SCOPE and t not in tags and "table" not in scope:
                return

    def text(s: str) -> None:
        if s:
            if stack[-1].tag == "head" and s.strip():
                stack.pop()
            stack[-1].kids.append(unescape(s) if "&" in s else s)

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            cut = html.rfind("<", at)  # a tag cut off by the end of the page
            rest = html[at:] if cut < 0 or not re.match(r"</?[A-Za-z]", html[cut:cut + 3]) else html[at:cut]
            text(rest)
            break
        if m.start() > at:
            text(html[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].kids.append(Node("br", {}))
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPE and tag not in ("table", "tr", "thead", "tbody", "tfoot", "body", "html"):
                    i = 0
                    break
            else:
                i = 0
            if not i and tag == "p":
                stack[-1].kids.append(Node("p", {}))
            continue
        attrs = _attrs(m[3])
        if tag in ("html", "body") and any(x.tag == tag for x in stack):
            continue
        if stack[-1].tag == "head" and tag not in HEAD_ONLY:
            stack.pop()
        if tag in IMPLIED:
            close(*IMPLIED[tag])
            if tag in CELLS and stack[-1].tag in SECTIONS | {"table"}:
                row = Node("tr", {})
                stack[-1].kids.append(row)
                stack.append(row)
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in SCOPE or stack[i].tag in BLOCK:
                    break
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            body = html[at:end.start() if end else n]
            if tag == "textarea" and body:
                node.kids.append(unescape(body))
            elif tag == "xmp" and body:
                node.kids.append(body)
            close_at = html.find(">", end.start()) if end else -1
            at = close_at + 1 if close_at >= 0 else n
            continue
        stack.append(node)
    return root


class _Flow:
    """Lines of one block context (the page or a table cell)."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False        # a space is due before the next word
        self.margin = 0         # blank lines due before the next line
        self.indent = ""
        self.mark = ""          # bullet of the next line

    def text(self, s: str, pre: bool) -> None:
        if pre:
            parts = s.replace("\r\n", "\n").split("\n")
            for i, p in enumerate(parts):
                if i:
                    self.brk()
                if p:
                    self._put(p)
            return
        s = _GAP.sub(" ", s)
        if s == " ":
            self.gap = bool(self.line)
            return
        if not s:
            return
        if s[0] == " ":
            self.gap = bool(self.line)
            s = s[1:]
        tail = s[-1] == " "
        self._put(s[:-1] if tail else s)
        self.gap = tail

    def _put(self, s: str) -> None:
        if self.gap and self.line:
            self.line.append(" ")
        self.gap = False
        self.line.append(s)

    def end(self) -> None:
        """End the line, if it has any text."""
        if self.line:
            if self.lines and self.margin:
                self.lines.extend([""] * self.margin)
            self.margin = 0
            head = self.indent
            if self.mark:
                head = self.indent[:max(0, len(self.indent) - len(self.mark))] + self.mark
                self.mark = ""
            self.lines.append((head + "".join(self.line)).rstrip())
            self.line = []
        self.gap = False

    def brk(self) -> None:
        if self.line:
            self.end()
        elif self.lines:
            self.margin += 1

    def block(self, margin: int) -> None:
        self.end()
        self.margin = max(self.margin, margin)

    def add(self, lines: list[str]) -> None:
        for x in lines:
            if x:
                self.line.append(x)
                self.end()
            else:
                self.margin += 1


def _number(v: str | None, other: int) -> int:
    return int(v) if v and re.fullmatch(r"-?[0-9]{1,9}", v.strip()) else other


def _shown(node: Node) -> bool:
    a = node.attrs
    return not (node.tag in HIDDEN or "hidden" in a or "style" in a and _NONE.search(a["style"]))


def render(html: str | None) -> str | None:
    """Visible text of a page, laid out in lines."""
    if html is None:
        return None
    flow = _Flow()
    # what to do: (node or text, visible, pre), or a function to call
    todo: list = [(build_tree(html), True, False)]
    lists: list[list] = []     # [ordered, next number]
    tables: list[dict] = []

    def restore(saved):
        def run():
            flow.end()
            flow.indent, flow.mark = saved
        return run

    def end_block(margin):
        return lambda: flow.block(margin)

    def end_cell(outer, table, span, down):
        def run():
            nonlocal flow
            flow.end()
            table["rows"][-1].append((flow.lines, span, down))
            flow = outer
        return run

    def end_table(table):
        def run():
            tables.pop()
            flow.add(_aligned(table["rows"]))
            flow.block(1)
        return run

    while todo:
        item = todo.pop()
        if callable(item):
            item()
            continue
        node, visible, pre = item
        if isinstance(node, str):
            if visible:
                flow.text(node, pre)
            continue
        tag = node.tag
        if not _shown(node):
            continue
        style = node.attrs.get("style")
        if style and (m := _SEEN.search(style)):
            visible = m[1].lower() == "visible"
        if tag == "br":
            flow.brk()
            continue
        if tag == "wbr":
            continue
        kids = node.kids
        after = None
        if tag in CELLS and tables:
            table = tables[-1]
            if not table["rows"]:
                table["rows"].append([])
            after = end_cell(flow, table, max(1, min(_number(node.attrs.get("colspan"), 1), 1000)),
                             max(0, _number(node.attrs.get("rowspan"), 1)))
            flow = _Flow()
        elif tag == "tr" and tables:
            flow.end()
            tables[-1]["rows"].append([])
        elif tag == "table":
            flow.block(1)
            tables.append({"rows": []})
            after = end_table(tables[-1])
        elif tag in ("ul", "ol", "menu"):
            flow.block(0 if lists else 1)
            lists.append([tag == "ol", _number(node.attrs.get("start"), 1)])
            margin = 0 if len(lists) > 1 else 1

            def after(margin=margin):
                lists.pop()
                flow.block(margin)
        elif tag == "li":
            flow.block(0)
            mark = "* "
            if lists and lists[-1][0]:
                lists[-1][1] = _number(node.attrs.get("value"), lists[-1][1])
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            after = restore((flow.indent, ""))
            flow.indent, flow.mark = flow.indent + " " * len(mark), mark
        elif tag in ("blockquote", "dd"):
            flow.block(int(tag == "blockquote"))
            undo = restore((flow.indent, flow.mark))
            flow.indent += "  "

            def after(undo=undo, margin=int(tag == "blockquote")):
                undo()
                flow.block(margin)
        elif tag in BLOCK:
            margin = int(tag in MARGIN)
            flow.block(margin)
            after = end_block(margin)
            pre = pre or tag in ("pre", "xmp")
            if tag == "pre" and kids and isinstance(kids[0], str):
                kids = [kids[0].removeprefix("\n"), *kids[1:]]
        elif tag in ("textarea", "xmp", "listing"):
            pre = True
        elif tag == "select":
            options, dig = [], [node]
            while dig:
                x = dig.pop()
                if x.tag == "option":
                    options.append(x)
                else:
                    dig.extend(k for k in reversed(x.kids) if isinstance(k, Node))
            picked = [o for o in options if "selected" in o.attrs] or options[:1]
            kids = [k for o in picked for k in [" ", *o.kids, " "]]
        if tag == "details" and "open" not in node.attrs:
            kids = [k for k in kids if isinstance(k, Node) and k.tag == "summary"]
        if after:
            todo.append(after)
        todo.extend((k, visible, pre) for k in reversed(kids))
    flow.end()
    return "\n".join(flow.lines)


def _placed(rows: list) -> list[list[tuple]]:
    """Per row its cells as (column, span, rows, lines), columns that cells
    from above hold left free; rowspan 0 goes to the last row."""
    until: dict[int, int] = {}  # column -> first row that is free again
    out = []
    for r, row in enumerate(rows):
        col, cells = 0, []
        for lines, span, down in row:
            while until.get(col, 0) > r:
                col += 1
            high = min(down or len(rows), len(rows) - r)
            cells.append((col, span, high, lines))
            if high > 1:
                until.update(dict.fromkeys(range(col, col + span), r + high))
            col += span
        out.append(cells)
    return out


def _aligned(rows: list) -> list[str]:
    """Lines of a table; columns start where their widest cell lets them."""
    grid = _placed(rows)
    width: dict[int, int] = {}
    height, text = [], 0
    for cells in grid:
        height.append(max((len(lines) for _, _, high, lines in cells if high == 1), default=0))
        for col, span, _, lines in cells:
            text += sum(map(len, lines))
            if span == 1 and lines:
                width[col] = max(width.get(col, 0), max(map(len, lines)))
    for r, cells in enumerate(grid):
        for _, _, high, lines in cells:
            if high > 1:  # what does not fit beside its rows makes the last one higher
                height[r + high - 1] += max(0, len(lines) - sum(height[r:r + high]))
    room = max(PAD_TIMES * text, PAD_FREE) // max(1, sum(height))
    if sum(width.values()) > room:
        cap = 0
        for step in (1 << k for k in range(max(width.values()).bit_length(), -1, -1)):
            if sum(min(w, cap + step) for w in width.values()) <= room:
                cap += step
        width = {c: min(w, cap) for c, w in width.items()}
    known = sorted(width)
    sums = [0]
    for c in known:
        sums.append(sums[-1] + width[c] + 2)
    start = {col: sums[bisect_left(known, col)] for cells in grid for col, _, _, _ in cells}
    below: dict[int, list[tuple[int, str]]] = {}  # line -> (column, text)
    out, first = [], 0
    for cells, high in zip(grid, height):
        for col, _, _, lines in cells:
            for i, x in enumerate(lines):
                if x:
                    below.setdefault(first + i, []).append((col, x))
        for i in range(first, first + high):
            line = ""
            for col, x in sorted(below.pop(i, ())):
                if start[col] > len(line):
                    line += " " * (start[col] - len(line))
                elif line:
                    line += "  "
                line += x
            out.append(line.rstrip())
        first += high
    return out


def _render_rows(at: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            col = batch.column(at)
            rest = [i for i in range(batch.num_columns) if i != at]
            for lo in range(0, len(col), 500):
                part = col.slice(lo, 500)
                texts = [render(x) for x in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, 500) for i in rest), pa.array(texts, pa.string())],
                                                 [*(batch.schema.names[i] for i in rest), "_out"])
    return run


def extract_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the html replaced by its laid-out text."""
    names = [c for c in pages.columns if c != html_col]
    df = pages.select(*[pages[c].alias(f"c{i}") for i, c in enumerate(names)], pages[html_col].cast("string").alias("_html"))
    kinds = "".join(f"c{i} {pages.schema[c].dataType.simpleString()}, " for i, c in enumerate(names))
    out = df.mapInArrow(_render_rows(len(names)), f"{kinds}_out string")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c != out_col], F.col("_out").alias(out_col))

"""Layout-aware text of HTML pages.

A tag scanner feeds a tree builder that closes paragraphs, list items, table parts, options
and definition terms where HTML implies it. Rendering walks the visible part of the tree:
blocks stand on lines of their own, with a blank line around those that have margins; list
items are indented behind their bullet or number; table cells are padded to the width of
their column, spans included. White space collapses outside preformatted text.

Hidden are the head, scripts, styles, templates and fallbacks of embedded content, elements with the
hidden attribute, with display:none or visibility:hidden in their style or by the simple rules (tag, class,
id) of style elements, closed dialogs, and the body of closed details. Of several rules the important, then the
more specific, then the last one decides, and a style attribute precedes rules; rules for media other
than screen or all are skipped. Of an SVG image the text elements and foreign content are
shown, of MathML all but annotations; parts of a fraction and cells stand apart. All other text is emitted
whole. Elements nested deeper than `DEPTH` become siblings.

Null and empty pages give an empty text; text without tags is one block; other columns pass
through; repeated rows and empty tables need no special case.
"""

from __future__ import annotations

import bisect
import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._tables import fresh

DEPTH = 200
START = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
SPECIAL = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
SHOWN = re.compile(r"(?:^|[;\s])(display|visibility)\s*:\s*([\w-]+)[^;!]*(!\s*important)?", re.I)
SCREEN = re.compile(r"(?:only\s+)?(?:screen|all)", re.I)
SIMPLE = re.compile(r"(?=.)([a-z][a-z0-9]*)?([.#][\w-]+)?$", re.I)
COLLAPSE = re.compile(r"[ \t\n\r\f]+")
# fixed values of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head title script style template noscript iframe noembed noframes object audio video canvas datalist".split())
# of SVG and MathML: never drawn where they stand; where HTML starts again; HTML tags that end them
UNDRAWN = frozenset("defs symbol desc metadata clippath mask pattern marker".split())
ASIDE = {(a, b) for a in ("math", "semantics") for b in ("annotation", "annotation-xml")} | {(a, "desc") for a in ("text", "tspan", "textpath")}
APART = frozenset("mfrac munder mover munderover mtr mlabeledtr mtable".split())
HTML_INSIDE = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
LEAVES = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s "
    "small span strong strike sub sup table tt u ul var".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul caption tr".split()
)
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu blockquote pre table figure hr fieldset".split())
ENDS_P = BLOCK - frozenset("body html option optgroup caption tr legend".split())
LISTS = frozenset("ul ol menu dir".split())
SCOPE = frozenset("table td th caption html template object".split())
CLOSES = {
    "li": ({"li"}, LISTS), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}


class Marks:
    """Comments, declarations and tags of a page, in time linear in its length.

    A tag ends at the first `>` outside quotes; where quotes never close, at the first `>`. Scans that ran into the end of
    the page are remembered by the marks they passed, and what can no longer occur is not looked for again.
    """

    def __init__(self, page: str):
        self.page, self.dead = page, set()
        self.last = {c: page.rfind(c) for c in "\"'>"}

    def _end(self, at: int) -> int:
        """Place of the `>` outside quotes, -1 without one."""
        passed = []
        while s := SPECIAL.search(self.page, at):
            here, c = s.start(), s[0]
            if c == ">":
                return here
            passed.append(here)
            if here in self.dead or here >= self.last[c]:
                break
            at = self.page.find(c, here + 1) + 1
        self.dead.update(passed)
        return -1

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closing, tag, attributes) of the next mark; the tag is empty for comments and declarations."""
        page = self.page
        while m := START.search(page, at):
            start = m.start()
            if m[1]:
                end = page.find("-->", m.end())
                return start, len(page) if end < 0 else end + 3, False, "", ""
            if start > self.last[">"]:  # nothing but a comment can follow
                at = page.find("<!--", start + 1)
                if at < 0:
                    return None
                continue
            if m[3] is None:
                return start, page.find(">", start) + 1, False, "", ""
            end = self._end(m.end())
            if end < 0:
                end = page.find(">", m.end())
            return start, end + 1, bool(m[2]), m[3].lower(), page[m.end() : end]
        return None


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def get(self, name: str) -> str | None:
        """Value of an attribute; empty if it has none, None if it is absent."""
        if name not in self.attrs.lower():
            return None
        for m in ATTRIBUTE.finditer(self.attrs):
            if m[1].lower() == name:
                return html.unescape(m[2] or m[3] or m[4] or "")
        return None


def _for_screen(media: str) -> bool:
    return any(SCREEN.fullmatch(m.strip()) for m in media.split(",")) or not media.strip()


def _shown(declarations: str) -> list[tuple[str, bool, bool]]:
    """(property, hides, important) of what a rule or style says about being shown."""
    return [
        (m[1].lower(), m[2].lower() in (("none",) if m[1].lower() == "display" else ("hidden", "collapse")), bool(m[3]))
        for m in SHOWN.finditer(declarations)
    ]


def _rules(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules that hold on a screen, in order."""
    css, blocks, at = COMMENT.sub(" ", css), [], 0
    # open blocks: [prelude, do its rules hold, is it a rule, its declarations]
    for m in re.finditer(r"[{};]|\Z", css):
        said, at = css[at : m.start()].strip(), m.end()
        inside = blocks[-1] if blocks else ["", True, False, ""]
        if m[0] == "{":
            name, _, rest = said.partition(" ") if " " in said else said.partition("(")
            name = name.lower().split("(")[0]
            holds = name == "@media" and _for_screen(said[6:]) or name == "@layer" or name == "@supports" and not rest.lower().startswith("not")
            blocks.append([said, inside[1] and not inside[2] and (holds or not said.startswith("@")), not said.startswith("@"), ""])
            continue
        if inside[2]:
            inside[3] += said + ";"
        if blocks and m[0] != ";":
            done = blocks.pop()
            if done[1] and done[2]:
                yield done[0], done[3]


class Sheet:
    """The simple rules about being shown, by their id, class or tag."""

    def __init__(self):
        self.by: dict[str, list] = {}
        self.n, self.hides = 0, False

    def read(self, css: str) -> None:
        for selectors, declarations in _rules(css):
            said = _shown(declarations)
            if not said:
                continue
            for selector in selectors.split(","):
                if m := SIMPLE.match(selector.strip()):
                    self.n += 1
                    tag, mark = (m[1] or "").lower(), m[2] or ""
                    rank = ((mark[:1] == "#", mark[:1] == ".", bool(tag)), self.n)
                    self.by.setdefault(mark or tag, []).append((tag, rank, said))
                    self.hides |= any(h for _, h, _ in said)

    def hidden(self, node: Node) -> bool:
        """Whether rules and the style attribute of a node hide it."""
        style = (node.get("style") or "") if node.attrs else ""
        if not style and not self.hides:
            return False
        found = [((i, 1, (), (0, k)), p, h) for k, (p, h, i) in enumerate(_shown(style))]
        if self.hides:
            names = [node.tag]
            if node.attrs:
                names += [f".{c}" for c in set((node.get("class") or "").split())] + [f"#{node.get('id')}"]
            for name in names:
                for tag, (weight, order), said in self.by.get(name, ()):
                    if not tag or tag == node.tag:
                        found += [((i, 0, weight, (order, k)), p, h) for k, (p, h, i) in enumerate(said)]
        last: dict[str, tuple] = {}
        for rank, prop, hides in found:
            if prop not in last or rank > last[prop][0]:
                last[prop] = (rank, hides)
        return any(hides for _, hides in last.values())


def tree(page: str) -> tuple[Node, Sheet]:
    """Root of the element tree, and the rules of the page's style elements."""
    root = Node("#root")
    stack, sheet, at = [root], Sheet(), 0
    embeds = re.search(r"<(?:svg|math)\b", page, re.I)

    def text(until: int) -> None:
        if until > at:
            stack[-1].kids.append(html.unescape(page[at:until]))

    def close(tags: set[str], barrier) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in barrier:
                return
            if stack[k].tag in tags:
                # outer parts of the same family close too: a row closes its open cell and itself
                while k > 1 and stack[k - 1].tag in tags:
                    k -= 1
                del stack[k:]
                return

    marks = Marks(page)
    while m := marks.after(at):
        text(m[0])
        _, at, closing, tag, attrs = m
        if not tag:
            continue
        if closing:
            if tag == "br":
                stack[-1].kids.append(Node("br"))
            elif tag == "p" and not _open(stack, "p"):
                stack[-1].kids.append(Node("p"))
            else:
                _end(stack, tag)
            continue
        if tag in ("html", "body") and _open(stack, tag):
            continue
        foreign = _foreign(stack) if embeds else 0
        if foreign and tag in LEAVES:
            del stack[foreign:]
            foreign = 0
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in ENDS_P:
            close({"p"}, SCOPE | {"button"})
        if tag == "body":
            close({"head"}, {"html"})
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag in VOID or foreign and attrs.endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            body = page[at : end.start()]
            if tag == "style":
                if _for_screen(node.get("media") or ""):
                    sheet.read(body)
            node.kids.append(html.unescape(body) if tag in ("textarea", "title") else body)
            at = end.end()
        elif not attrs.endswith("/") or tag in BLOCK:
            if len(stack) < DEPTH:
                stack.append(node)
    text(len(page))
    return root, sheet


def _foreign(stack: list[Node]) -> int:
    """Where on the stack the SVG or MathML element starts whose content comes next; 0 if it is HTML."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in ("svg", "math"):
            while k > 1 and stack[k - 1].tag not in HTML_INSIDE and (outer := _foreign(stack[:k])):
                k = outer
            return k
        if stack[k].tag in HTML_INSIDE:
            return 0
    return 0


def _open(stack: list[Node], tag: str) -> bool:
    for node in reversed(stack):
        if node.tag == tag:
            return True
        if node.tag in SCOPE and tag == "p":
            return False
    return False


def _end(stack: list[Node], tag: str) -> None:
    inside_cell = tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "body", "html")
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if inside_cell and stack[k].tag in ("td", "th", "caption") or stack[k].tag == "table":
            return


class Lines:
    """Text lines under construction, with pending gaps, indent and list marker."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap, self.space, self.indent, self.marker = 0, False, "", ""

    def add(self, text: str, pre: bool = False) -> None:
        if pre:
            first, *rest = text.replace("\r\n", "\n").split("\n")
            if first:
                self._put(first)
            for line in rest:
                self._line()
                if line:
                    self._put(line)
            return
        text = COLLAPSE.sub(" ", text)
        if not text:
            return
        if text[0] == " ":
            self.space = True
            text = text[1:]
        if text:
            tail = text[-1] == " "
            self._put(text[:-1] if tail else text)
            self.space = tail

    def _put(self, text: str) -> None:
        if self.now:
            if self.space:
                self.now.append(" ")
        elif self.gap and self.lines:
            self.lines += [""] * (self.gap - 1)
        self.gap, self.space = 0, False
        self.now.append(text)

    def _line(self) -> None:
        body = "".join(self.now)
        self.lines.append(((self.indent[: len(self.indent) - len(self.marker)] + self.marker if body else self.indent) + body).rstrip())
        if body:
            self.marker = ""
        self.now, self.space = [], False

    def block(self, gap: int = 1) -> None:
        """End the line; the next text starts `gap` lines further down."""
        if self.now:
            self._line()
        self.space = False
        self.gap = max(self.gap, gap)

    def line_break(self) -> None:
        if self.now or self.lines:
            self._line()

    def done(self) -> list[str]:
        self.block()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        return lines


class Page:
    def __init__(self, page: str):
        self.root, self.sheet = tree(page)

    def seen(self, node: Node) -> bool:
        if node.tag in UNSEEN:
            return False
        if self.sheet.hidden(node):
            return False
        if not node.attrs:
            return node.tag != "dialog"
        if node.get("hidden") is not None:
            return False
        if node.tag == "input":
            return False
        return node.tag != "dialog" or node.get("open") is not None

    def render(self, node: Node, out: Lines, pre: bool = False, depth: int = 0) -> None:
        number = 0
        closed = node.tag == "details" and node.get("open") is None
        for kid in node.kids:
            if closed and (isinstance(kid, str) or kid.tag != "summary"):
                continue
            if isinstance(kid, str):
                if node.tag not in ("table", "tbody", "thead", "tfoot", "tr") or kid.strip():
                    out.add(kid, pre)
                continue
            tag = kid.tag
            if not self.seen(kid):
                continue
            if tag == "br":
                out.line_break()
            elif tag == "wbr":
                pass
            elif tag == "img":
                out.add(kid.get("alt") or "")
            elif tag == "table":
                self.table(kid, out)
            elif tag == "svg":
                self.drawing(kid, out, depth)
            elif (node.tag, tag) in ASIDE:
                continue
            elif node.tag in APART:
                out.space = True
                self.render(kid, out, pre, depth)
                out.space = True
            elif tag in BLOCK:
                gap = 2 if tag in MARGIN and not (tag in LISTS and depth) else 1
                out.block(gap)
                if tag == "li":
                    number = self.number(node, kid, number)
                    mark = f"{number}. " if node.tag == "ol" else "- "
                    self.indented(kid, out, mark, pre, depth + 1)
                elif tag in ("dd", "blockquote"):
                    self.indented(kid, out, "", pre, depth)
                else:
                    self.render(kid, out, pre or tag == "pre", depth)
                out.block(gap)
            else:
                self.render(kid, out, pre or tag == "textarea", depth)

    def drawing(self, node: Node, out: Lines, depth: int) -> None:
        """The text elements and foreign content of an SVG image, set apart by a space."""
        for kid in node.kids:
            if isinstance(kid, str) or kid.tag in UNDRAWN or not self.seen(kid):
                continue
            if kid.tag in ("text", "foreignobject"):
                out.space = True
                self.render(kid, out, False, depth)
                out.space = True
            else:
                self.drawing(kid, out, depth)

    @staticmethod
    def number(parent: Node, item: Node, before: int) -> int:
        given = item.get("value") or (parent.get("start") if before == 0 else None)
        try:
            return int(given) if given else before + 1
        except ValueError:
            return before + 1

    def indented(self, node: Node, out: Lines, mark: str, pre: bool, depth: int) -> None:
        indent, marker = out.indent, out.marker
        out.indent, out.marker = indent + " " * (len(mark) or 2), mark
        if marker:  # the item opens with a list: both marks share the line
            out.marker = marker + mark
        self.render(node, out, pre, depth)
        out.block()
        if mark and out.marker and not marker:  # an item without text
            out.now = [""]
            out.marker = ""
        out.now = []
        out.indent, out.marker = indent, ""

    def table(self, node: Node, out: Lines) -> None:
        out.block(2)
        grid: list[dict[int, list[str]]] = []
        spans: list[tuple[int, int, int]] = []
        loose: list[str] = []
        taken: dict[int, list[tuple[int, int]]] = {}  # columns of a row that cells above reach into

        def rows(part: Node) -> None:
            for kid in part.kids:
                if isinstance(kid, str):
                    if kid.strip():
                        loose.append(COLLAPSE.sub(" ", kid).strip())
                elif not self.seen(kid):
                    continue
                elif kid.tag in ("tbody", "thead", "tfoot"):
                    rows(kid)
                elif kid.tag in ("tr", "td", "th"):
                    row(kid if kid.tag == "tr" else _wrapped(kid))
                elif kid.tag not in ("col", "colgroup"):
                    sub = Lines()
                    self.render(_wrapped(kid), sub)
                    loose.extend(sub.done())

        def row(tr: Node) -> None:
            y, x = len(grid), 0
            grid.append({})
            for cell in tr.kids:
                if isinstance(cell, str):
                    if cell.strip():
                        loose.append(COLLAPSE.sub(" ", cell).strip())
                    continue
                if not self.seen(cell):
                    continue
                while beyond := max((end for start, end in taken.get(y, ()) if start <= x < end), default=0):
                    x = beyond
                sub = Lines()
                self.render(cell, sub)
                wide, high = (_span(cell.get(a)) for a in ("colspan", "rowspan"))
                grid[y][x] = sub.done()
                if wide > 1:
                    spans.append((y, x, wide))
                for j in range(1, min(high, total - y)):
                    taken.setdefault(y + j, []).append((x, x + wide))
                x += wide
            taken.pop(y, None)

        def count(part: Node) -> int:
            return sum(count(k) if k.tag in ("tbody", "thead", "tfoot") else k.tag in ("tr", "td", "th") for k in part.kids if not isinstance(k, str))

        total = count(node)  # a row span ends with the table
        rows(node)
        for line in loose:
            out.add(line)
            out.block()
        # columns in which no cell starts take no room
        starts = sorted({x for r in grid for x in r})
        dense = {x: i for i, x in enumerate(starts)}
        wide_cells = {(y, dense[x]): bisect.bisect_left(starts, x + w) - dense[x] for y, x, w in spans}
        grid = [{dense[x]: lines for x, lines in r.items()} for r in grid]
        columns = len(starts)
        width = [0] * columns
        for y, r in enumerate(grid):
            for x, lines in r.items():
                if (y, x) not in wide_cells:
                    width[x] = max([width[x], *map(_width, lines)])
        for y, r in enumerate(grid):
            tall = max((len(v) for v in r.values()), default=0)
            for k in range(tall):
                parts, x = [], 0
                last = max(r)
                while x <= last:
                    span = min(wide_cells.get((y, x), 1), columns - x) or 1
                    line = r[x][k] if x in r and k < len(r[x]) else ""
                    room = sum(width[x : x + span]) + 3 * (span - 1)
                    parts.append(line + " " * max(room - _width(line), 0))
                    x += span
                line = " | ".join(parts).rstrip()
                if line.strip(" |"):
                    out.add(line, pre=True)
                    out.block()
        out.block(2)


def _wrapped(cell: Node) -> Node:
    parent = Node("tr")
    parent.kids.append(cell)
    return parent


def _span(value: str | None) -> int:
    return min(max(int(value), 1), 1000) if value and value.strip().isdigit() else 1


def _width(text: str) -> int:
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def visible_text(page: str | None) -> str:
    if not page:
        return ""
    parsed, out = Page(page), Lines()
    parsed.render(parsed.root, out)
    lines = out.done()
    while lines and not lines[0]:
        lines.pop(0)
    return "\n".join(lines)


def extract(pages: DataFrame, column: str = "html", out: str = "text") -> DataFrame:
    """Add the visible text of a column of pages; `out` gets underscores if taken."""
    out = fresh(pages, out)
    at, names = pages.columns.index(column), pages.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sys

        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEPTH))
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = pa.array([visible_text(p) for p in batch.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*names, out])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(out, T.StringType())]))

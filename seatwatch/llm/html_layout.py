"""HTML extraction by layout-aware rendering.

A tree builder (tokens, implied end tags, raw-text elements, void elements) gives
balanced open, text and close events; a renderer turns them into all visible text:
blocks on lines of their own, blank lines around paragraphs and headings, list
markers with indentation, preformatted text as it is, and table cells padded to
their columns.  Text of SVG and MathML is text, their titles, definitions and
annotations are not.  Not visible: head, script, style, template, noscript, comments,
elements with the hidden attribute or an inline display:none, form values, and text
under an inline visibility:hidden up to elements with visibility:visible.

Cells stand on a grid: spans of columns and rows count, columns are as wide as their cells'
lines of up to ALIGN characters (longer ones run on), and no line is padded beyond WIDE
characters, so that the text stays in proportion to its source.

Malformed markup never fails: stray end tags are ignored, open elements end with
their parent or the text, a < that opens no tag is text, a quote in a tag's name belongs to it.  Null html is empty text.
Nesting is held on explicit stacks with the places of each tag, so its depth costs nothing
but memory.  Indentation ends at INDENT characters; tables within NESTED others are rendered
as rows of text; a span over rows counts as one row while SPANS others are open.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Element classes of HTML (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title datalist iframe object audio video canvas select textarea noembed noframes rp".split())
FOREIGN = frozenset({"svg", "math"})
#: Elements of FOREIGN ones whose content is HTML.
HOSTS = frozenset("foreignobject annotation-xml".split())
UNSEEN_FOREIGN = frozenset("desc defs metadata symbol clippath mask pattern marker filter lineargradient radialgradient annotation annotation-xml".split())
#: Elements of FOREIGN ones that stand apart from the text around them.
APART = frozenset("svg text mtr mtd".split())
ROW_PARTS = frozenset("tr thead tbody tfoot col colgroup".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table caption ul".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "legend"}
#: An opening tag ends open ones of the set, looking no further up than the scope.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
SCOPES = frozenset({"table", "td", "th", "caption", "html", "template"})
ALIGN, WIDE, INDENT, NESTED, SPANS = 60, 240, 40, 16, 64
_TAG = re.compile(r"""<(?:!--(?:.*?--!?>|.*\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+)(>|\Z)|[!?/][^>]*(?:>|\Z)|(?=[a-zA-Z]))""", re.S)
_BREAK_FIRST = re.compile(r"(?:\r?\n)?")
_STRAY = re.compile(r"<()()()()/[^>]*(?:>|\Z)")
_END, _BREAK = re.compile("[>\"']"), re.compile(r"[\s/>]")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_MAY_HIDE = re.compile(r"display|visibility", re.I)
_NO_PROPERTY = re.compile(r"""/\*.*?(?:\*/|\Z)|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|\([^)]*(?:\)|\Z)""", re.S)
_HIDES = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([\w-]+)\s*(!\s*important)?\s*(?=;|\Z)", re.I)
_BARE_VALUE = re.compile(r"""=\s*[^\s"'>]+\Z""")
_SPACE = re.compile(r"[ \t\n\r\f]+")


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(text):
        if value[:1] in ('"', "'"):
            value = value[1:-1]
        out.setdefault(name.lower(), html.unescape(value))
    return out


def hiding(style: str) -> tuple[str | None, str | None]:
    """display and visibility of a style attribute; of several declarations the last, an important one before others."""
    got: dict[str, tuple[bool, str]] = {}
    if _MAY_HIDE.search(style):
        for name, value, important in _HIDES.findall(_NO_PROPERTY.sub(" ", style)):
            name, value = name.lower(), value.lower()
            if name == "visibility" and value not in ("visible", "hidden", "collapse", "inherit", "initial", "unset"):
                continue
            if important or not got.get(name, (False, ""))[0]:
                got[name] = (bool(important), value)
    return tuple(got[n][1] if n in got else None for n in ("display", "visibility"))


def closable(source: str):
    """Tells for the place of a < before a letter whether that tag ends (with a > outside quotes, or the text).

    One pass from the end: what follows a quote follows from where the quote closes."""
    ends, breaks = [m.start() for m in _END.finditer(source)], [m.start() for m in _BREAK.finditer(source)]
    good, last = [True] * (len(ends) + 1), {}
    for i in range(len(ends) - 1, -1, -1):
        if (c := source[ends[i]]) != ">":
            good[i] = c in last and good[last[c] + 1]
            last[c] = i

    def closes(at: int) -> bool:
        name = bisect_left(breaks, at + 2)
        return good[bisect_left(ends, breaks[name] if name < len(breaks) else len(source))]

    return closes


def build(source: str) -> Iterator[tuple[str, str, dict]]:
    """Balanced events: ("open", tag, attributes), ("text", text, {}), ("close", tag, {}).  Void elements close at once."""
    stack: list[str] = []
    at, n = 0, len(source)

    places: dict[str, list[int]] = {}  #: of the open elements of each tag

    def push(tag: str) -> None:
        places.setdefault(tag, []).append(len(stack))
        stack.append(tag)

    def end_to(depth: int):
        while len(stack) > depth:
            tag = stack.pop()
            places[tag].pop()
            yield "close", tag, {}

    def nearest(tags) -> int:
        return max((p[-1] for t in tags if (p := places.get(t))), default=-1)

    def top(tags, scope) -> int | None:
        i = nearest(tags)
        return i if i >= 0 and i >= nearest(scope) else None

    closes = None
    letter = lambda i: source[i : i + 1].isascii() and source[i : i + 1].isalpha()

    def next_tag(at: int) -> re.Match | None:
        """The next tag or comment.  Once a tag has no end, ends are looked up, so that none is searched for twice."""
        nonlocal closes
        if not closes:
            m = _TAG.search(source, at)
            if not m or m.group(2) or (m.end() > m.start() + 1 and not (source[m.start() + 1] == "/" and letter(m.start() + 2))):
                return m
            closes, at = closable(source), m.start()
        while (at := source.find("<", at)) >= 0:
            if letter(at + 1):
                if closes(at):
                    return _TAG.match(source, at)
            elif source[at + 1 : at + 2] == "/" and letter(at + 2) and not closes(at + 1):
                return _STRAY.match(source, at)
            elif source[at + 1 : at + 2] in ("!", "?", "/"):
                return _TAG.match(source, at)
            at += 1
        return None

    while at < n:
        m = next_tag(at)
        text = source[at : m.start() if m else n]
        if text:
            yield "text", html.unescape(text), {}
        if not m:
            break
        at = m.end()
        slash, tag, rest, _ = m.groups()
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            if tag == "br" or (tag == "p" and top({"p"}, SCOPES) is None):
                yield "open", tag, {}
                yield "close", tag, {}
                continue
            scope = {"table"} if tag in IMPLIED and tag != "li" or tag in ("table",) else SCOPES
            found = top({tag}, scope - {tag})
            if found is not None:
                yield from end_to(found)
            continue
        if tag in IMPLIED:
            ends, scope = IMPLIED[tag]
            above = nearest(scope)
            inner = [p[k] for t in ends if (p := places.get(t)) and (k := bisect_right(p, above)) < len(p)]
            if inner:
                yield from end_to(min(inner))
        if tag in CLOSES_P:
            found = top({"p"}, SCOPES)
            if found is not None:
                yield from end_to(found)
        if tag in ("td", "th") and top({"tr"}, {"table"}) is None and top({"table"}, ()) is not None:
            push("tr")
            yield "open", "tr", {}
        yield "open", tag, attributes(rest) if rest else {}
        if tag in VOID or (rest.endswith("/") and not _BARE_VALUE.search(rest) and (tag in FOREIGN or top(FOREIGN, HOSTS) is not None)):
            yield "close", tag, {}
            continue
        push(tag)
        if tag in ("pre", "listing"):  # a line break right after the tag isn't shown
            at = _BREAK_FIRST.match(source, at).end()
        if tag in RAW and not rest.rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            stop = end.start() if end else n
            if stop > at:
                raw = source[at:stop]
                yield "text", html.unescape(raw) if tag in ("title", "textarea") else raw, {}
            at = stop
    yield from end_to(0)


class _Flow:
    """Text of one block context (the page, or a table cell)."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0  #: blank lines owed before the next line
        self.space = False
        self.indents: list[int] = []  #: of the open elements
        self.indent = 0  #: their sum, the next lines' indentation
        self.mark = ""  #: list marker owed to the next line

    def text(self, t: str) -> None:
        t = _SPACE.sub(" ", t)
        body = t.strip(" ")
        if self.now and t[:1] == " ":
            self.space = True
        if body:
            if self.space and self.now:
                self.now.append(" ")
            self.now.append(body)
            self.space = False
            if t[-1:] == " ":
                self.space = True

    def emit(self, line: str) -> None:
        if self.lines and self.gap:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        indent = " " * min(self.indent, INDENT)
        if self.mark:
            indent = indent[: max(0, len(indent) - len(self.mark))] + self.mark
            self.mark = ""
        self.lines.append((indent + line).rstrip())

    def push_indent(self, width: int) -> None:
        self.indents.append(width)
        self.indent += width

    def pop_indent(self) -> None:
        if self.indents:
            self.indent -= self.indents.pop()

    def end_line(self) -> None:
        if self.now:
            self.emit("".join(self.now))
            self.now = []
        self.space = False

    def line_break(self) -> None:
        self.emit("".join(self.now))
        self.now = []
        self.space = False

    def blank(self) -> None:
        self.end_line()
        self.gap = max(self.gap, 1)


def _span(text: str | None, most: int, least: int = 1) -> int:
    m = re.match(r"\s*(\d{1,9})", text or "")
    return min(max(int(m[1]), least), most) if m else 1


def _table_lines(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Cells (lines, columns, rows that they span) at their columns' places, two spaces apart at least."""
    grid: list[list[tuple[int, int, list[str]]]] = []  #: (first column, end, lines) by row
    below: list[tuple[int, int, int]] = []  #: spans from rows above: (first column, end, rows left)
    for row in rows:
        at, placed, taken = 0, [], sorted(below)
        below = [(a, b, left - 1) for a, b, left in taken if left > 1]
        k = 0
        for lines, columns, height in row:
            while k < len(taken) and taken[k][0] <= at:
                at = max(at, taken[k][1])
                k += 1
            placed.append((at, at + columns, lines))
            if height > 1 and len(below) < SPANS:
                below.append((at, at + columns, height - 1))
            at += columns
        if placed:
            grid.append(placed)
    starts = sorted({a for row in grid for a, _, _ in row})  # columns in which no cell begins have no width
    number = {a: i for i, a in enumerate(starts)}
    fitting = lambda lines: max((len(x) for x in lines if len(x) <= ALIGN), default=0)
    width = [0] * len(starts)
    spanning = []
    for row in grid:
        for i, (a, b, lines) in enumerate(row):
            last = bisect_right(starts, b - 1) - 1
            if last == number[a]:
                width[last] = max(width[last], fitting(lines))
            elif i + 1 < len(row):
                spanning.append((number[a], last, fitting(lines)))
    for first, last, need in spanning:
        width[last] = max(width[last], need - sum(width[first:last]) - 2 * (last - first))
    place, at = [], 0
    for w in width:
        place.append(min(at, WIDE))
        at += w + 2 if w else 0
    out = []
    for row in grid:
        for k in range(max(1, *(len(lines) for _, _, lines in row))):
            line = ""
            for a, _, lines in row:
                if k < len(lines) and lines[k]:
                    line = (line + "  " if line else "").ljust(place[number[a]]) + lines[k]
            out.append(line.rstrip())
    return out


def render(source: str | None) -> str:
    """All visible text of an HTML document."""
    flow, flows = _Flow(), []
    tables: list[list[list[tuple[list[str], int, int]]]] = []
    spans: list[tuple[int, int]] = []  #: of the open cells
    plain = 0  #: open tables that are too deep for a grid
    lists: list[tuple[str, int]] = []  #: kind and count
    hidden = pre = 0
    seen: list[bool] = []  #: whether each open element is there
    shown = [True]  #: whether the text of each open element is visible
    foreign = 0
    for kind, value, attrs in build(source or ""):
        if kind == "text":
            if hidden or not shown[-1]:
                continue
            if pre:
                first, *more = value.replace("\r\n", "\n").split("\n")
                flow.now.append(first)
                for part in more:
                    flow.line_break()
                    flow.now.append(part)
            else:
                flow.text(value)
            continue
        tag = value
        if kind == "open":
            display, visibility = hiding(attrs["style"]) if "style" in attrs else (None, None)
            if foreign:
                display, visibility = display or attrs.get("display"), visibility or attrs.get("visibility")
            gone = display == "none" or (visibility == "collapse" and tag in ROW_PARTS)
            show = not (tag in UNSEEN or "hidden" in attrs or gone or tag == "input" or (foreign and tag in UNSEEN_FOREIGN))
            seen.append(show)
            shown.append(visibility in ("visible", "initial") or (shown[-1] and visibility not in ("hidden", "collapse")))
            foreign += tag in FOREIGN
            hidden += not show
            if hidden:
                continue
            if foreign and tag in APART:
                flow.space = True
            if tag == "br":
                if shown[-1]:
                    flow.line_break()
            elif tag == "table":
                flow.blank()
                if plain or len(tables) == NESTED:
                    plain += 1
                else:
                    tables.append([])
            elif tag == "tr" and plain:
                flow.end_line()
            elif tag in ("td", "th") and plain:
                flow.space = True
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                spans.append((_span(attrs.get("colspan"), 1000), _span(attrs.get("rowspan"), 65534, 0) or 65534))
                flows.append(flow)
                flow = _Flow()
            elif tag in BLOCK:
                (flow.blank if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists) else flow.end_line)()
                if tag in ("ul", "ol", "menu", "dir"):
                    start = attrs.get("start", "")
                    lists.append(("ol" if tag == "ol" else "ul", int(start) - 1 if re.fullmatch(r"-?\d{1,9}", start) else 0))
                elif tag == "li":
                    style, count = lists[-1] if lists else ("ul", 0)
                    if lists:
                        lists[-1] = (style, count + 1)
                    mark = f"{count + 1}. " if style == "ol" else "- "
                    if shown[-1]:
                        flow.mark = mark
                    flow.push_indent(len(mark))
                elif tag in ("blockquote", "dd"):
                    flow.push_indent(2)
                elif tag == "pre":
                    pre += 1
            continue
        visible = shown.pop()
        apart = foreign and tag in APART
        foreign -= tag in FOREIGN
        if not seen.pop():
            hidden -= 1
            continue
        if hidden:
            continue
        if apart:
            flow.space = True
        if tag in ("td", "th", "tr") and plain:
            flow.space = True
        elif tag == "table" and plain:
            plain -= 1
            flow.blank()
        elif tag in ("td", "th") and flows:
            flow.end_line()
            cell, flow = flow.lines, flows.pop()
            tables[-1][-1].append((cell, *spans.pop()))
        elif tag == "table" and tables:
            rows = tables.pop()
            flow.end_line()
            for line in _table_lines(rows):
                if line or visible:
                    flow.emit(line)
            flow.blank()
        elif tag in BLOCK:
            (flow.blank if tag in SPACED and not (tag in ("ul", "ol", "menu") and len(lists) > 1) else flow.end_line)()
            if tag in ("ul", "ol", "menu", "dir") and lists:
                lists.pop()
            elif tag == "li":
                if flow.mark and visible:
                    flow.emit("")
                flow.pop_indent()
            elif tag in ("blockquote", "dd"):
                flow.pop_indent()
            elif tag == "pre":
                pre -= 1
    flow.end_line()
    return "\n".join(flow.lines)


def rendered(column: Column) -> Column:
    @F.arrow_udf("string")
    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([render(x.as_py()) for x in batch], pa.string())

    return make(column)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, text (all visible text), for every row of pages (page_id, html)."""
    return pages.select("page_id", rendered(F.col("html")).alias("text"))

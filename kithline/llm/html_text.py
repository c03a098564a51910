"""Text of HTML pages as a reader sees it.

Tags are read in order into a stack of open elements, with the start and end
tags that HTML lets authors leave out put in (p, li, dt, dd, option, table rows,
cells and sections, head). What isn't shown is left out: scripts, styles, heads,
templates, hidden elements (``hidden``, ``display:none``; ``aria-hidden`` isn't one
of them), closed details but for their summary. ``visibility`` is inherited: its
hidden text is left out, and children may be visible again. In svg pictures text
elements are shown, in formulas all but annotations; there, and only there, a
slash closes a tag, also right after an attribute. The text of a textarea is never read as tags. The rest is laid
out: blocks apart by a blank line or a line break, lists with bullets, numbers
and indents, preformatted text as it is, table cells in columns padded to a
common width. Spans are taken up to HTML's own limits (1,000 columns, 65,534
rows); columns without any text are not padded.

The reader is a loop over an explicit stack, so nesting of any depth is fine.

Edge cases: null or empty html gives empty text; html of any length and any kind
of broken markup is read whole; repeated rows give repeated results; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from kithline.llm.common import arrow_map, kind

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style template noscript head title iframe object audio video canvas datalist".split())
#: Parts of svg pictures that show text, and parts of pictures and formulas that don't.
SVG_TEXT, FOREIGN_UNSEEN = {"text", "foreignobject"}, set("title desc metadata defs style script symbol annotation annotation-xml".split())
FOREIGN = {"svg", "math"}
# Start tags that end a picture or formula which nobody closed, and parts of formulas in which they don't.
BREAKOUT = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strike strong sub sup table tt u ul var".split())
FORMULA_TEXT = {"mi", "mo", "mn", "ms", "mtext"}
MOST_COLUMNS, MOST_ROWS = 1_000, 65_534
#: Blocks with a blank line around them, and blocks on lines of their own.
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr".split())
LINED = set("html body div section article aside header footer nav main address form fieldset li dt dd tr caption figcaption details summary legend option optgroup select dialog center menu hgroup search".split())
SECTIONS, CELLS, LISTS = {"thead", "tbody", "tfoot"}, {"td", "th"}, {"ul", "ol", "menu"}
HEAD_PARTS = set("title meta link base script style noscript template head".split())
#: What a start tag closes, looking up to the fence.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", *CELLS}), "dt": ({"dt", "dd"}, {"dl", *CELLS}), "dd": ({"dt", "dd"}, {"dl", *CELLS}), "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": (CELLS, {"table", "tr"}), "th": (CELLS, {"table", "tr"}),
    **{s: ({"tr", "td", "th", "caption", *SECTIONS}, {"table"}) for s in SECTIONS},
}
_HIDDEN_STYLE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\b", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")
#: Whether the parser leaves references in a textarea as they are.
_RAW_TEXTAREA = "textarea" not in getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ())


class Flow:
    """Lines of one box, and the line being filled."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0  # blank lines owed before the next content
        self.space = False

    def words(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if text == " " or not text:
            self.space = self.space or bool(text and self.line)
            return
        if self.line and (self.space or text[0] == " "):
            self.line.append(" ")
        self.line.append(text.strip(" "))
        self.space = text[-1] == " "

    def end_line(self) -> None:
        if self.line:
            self._put("".join(self.line))
        self.line, self.space = [], False

    def _put(self, line: str) -> None:
        if self.lines:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        self.lines.append(line)

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def take(self, lines: list[str]) -> None:
        self.end_line()
        for line in lines:
            self._put(line)

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


class Open:
    __slots__ = ("tag", "shown", "seen", "flow", "outer", "count", "rows", "span", "down", "closed")

    def __init__(self, tag: str, shown: bool, seen: bool, flow: Flow, outer: Flow | None = None):
        self.tag, self.shown, self.seen, self.flow, self.outer = tag, shown, seen, flow, outer  # shown: has a box; seen: its own text is visible
        self.count, self.rows, self.span, self.down, self.closed = 0, [], 1, 1, False


class Renderer(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Flow()
        self.stack: list[Open] = [Open("#root", True, True, self.root)]
        self.pre = 0
        self.opened: Counter[str] = Counter()

    # the tree

    def _open_to(self, tags: set[str], fence: set[str]) -> int:
        """Place of the innermost open element of these tags inside the fence, or 0."""
        if not any(self.opened[t] for t in tags):
            return 0
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                return i
            if self.stack[i].tag in fence:
                return 0
        return 0

    def _in_foreign(self) -> str:
        """The picture or formula that the place is in, if its content isn't HTML again."""
        if not (self.opened["svg"] or self.opened["math"]):
            return ""
        return next((o.tag for o in reversed(self.stack) if o.tag in FOREIGN or o.tag == "foreignobject"), "").replace("foreignobject", "")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        foreign = self._in_foreign()
        if foreign and tag in BREAKOUT and self.stack[-1].tag not in FORMULA_TEXT:
            self._pop_to(next(i for i, o in enumerate(self.stack) if o.tag in FOREIGN))
            foreign = ""
        if foreign:
            got, top = dict(attrs), self.stack[-1]
            unseen = tag in FOREIGN_UNSEEN or "hidden" in got or _HIDDEN_STYLE.search(got.get("style") or "") or (got.get("display") or "").strip().lower() == "none"
            self.opened[tag] += 1
            if tag in ("text", "foreignobject") and top.shown and not unseen:
                top.flow.words(" ")
            seen = self._visible(top.seen or (foreign == "svg" and tag in SVG_TEXT), got)
            self.stack.append(Open(tag, top.shown and not unseen, seen, top.flow))
            self._close_slashed()
            return
        if self.stack[-1].tag == "head" and tag not in HEAD_PARTS:
            self._pop_to(len(self.stack) - 1)
        if tag in CLOSES:
            tags, fence = CLOSES[tag]
            while at := self._open_to(tags, fence):
                self._pop_to(at)
        if (tag in SPACED or tag in LINED) and tag not in ("option", "optgroup") and (at := self._open_to({"p"}, {"table", *CELLS, "button"})):
            self._pop_to(at)
        if tag in CELLS and self.stack[-1].tag in {"table", *SECTIONS}:
            self.handle_starttag("tr", [])
        got = dict(attrs)
        top = self.stack[-1]
        if tag == "br":
            if top.shown:
                if not top.flow.line and top.flow.lines:
                    top.flow.gap = max(top.flow.gap, 1)
                top.flow.end_line()
            return
        if tag in VOID:
            if tag == "hr" and top.shown:
                top.flow.block(1)
            return
        unseen = tag in UNSEEN or "hidden" in got or _HIDDEN_STYLE.search(got.get("style") or "") or (tag == "dialog" and "open" not in got) or (top.tag == "details" and top.closed and tag != "summary")
        self._push(tag, top.shown and not unseen, got)
        if tag in FOREIGN:
            self._close_slashed()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML, but see below

    def _close_slashed(self) -> None:
        """In pictures and formulas a tag that ends in a slash has no content."""
        if (self.get_starttag_text() or "").endswith("/>"):
            self._pop()

    @staticmethod
    def _visible(inherited: bool, got: dict[str, str | None]) -> bool:
        said = _VISIBILITY.search(got.get("style") or "")
        return said[1].lower() == "visible" if said else inherited

    def _push(self, tag: str, shown: bool, got: dict[str, str | None]) -> None:
        flow = self.stack[-1].flow
        seen = self._visible(self.stack[-1].seen, got) and tag != "svg"
        self.opened[tag] += 1
        if tag == "textarea":
            self.set_cdata_mode(tag)
        if not shown:
            self.stack.append(Open(tag, False, seen, flow))
            return
        if tag in SPACED or tag in LINED:
            nested = tag in LISTS and any(o.tag == "li" for o in self.stack[-2:])
            flow.block(1 if tag in SPACED and not nested else 0)
        boxed = tag in CELLS or tag in ("li", "blockquote", "dd", "pre", "table")
        self.stack.append(Open(tag, True, seen, Flow() if boxed else flow, flow if boxed else None))
        own = self.stack[-1]
        if tag == "ol":
            start = got.get("start") or "1"
            own.count = int(start) - 1 if re.fullmatch(r"-?\d{1,9}", start) else 0
        elif tag in CELLS:
            span, down = (re.match(r"\s*\+?(\d{1,9})", got.get(k) or "") for k in ("colspan", "rowspan"))
            own.span = min(int(span[1]) or 1, MOST_COLUMNS) if span else 1
            own.down = min(int(down[1]) or MOST_ROWS, MOST_ROWS) if down else 1  # 0: all rows that follow
        elif tag == "details":
            own.closed = "open" not in got
        elif tag == "pre":
            self.pre += 1
        elif tag == "tr" and (table := self._table()):
            table.rows.append([])

    def _table(self) -> Open | None:
        return next((o for o in reversed(self.stack) if o.tag == "table"), None) if self.opened["table"] else None

    def handle_endtag(self, tag: str) -> None:
        if self._in_foreign():
            if tag in ("p", "br"):
                self._pop_to(next(i for i, o in enumerate(self.stack) if o.tag in FOREIGN))
            elif at := self._open_to({tag}, {"foreignobject"} - {tag}):
                self._pop_to(at)
                return
        fence = set() if tag in ("table", "html", "body") else {"table"} if tag in CELLS or tag in SECTIONS or tag == "tr" else {*CELLS, "table", "caption"} - {tag}
        if tag == "p" and not self._open_to({"p"}, fence):
            self.handle_starttag("p", [])  # a lone </p> is an empty paragraph
        if tag in ("br",):
            self.handle_starttag("br", [])
        elif at := self._open_to({tag}, fence):
            self._pop_to(at)

    def _pop_to(self, at: int) -> None:
        while len(self.stack) > at:
            self._pop()

    def _pop(self) -> None:
        own = self.stack.pop()
        self.opened[own.tag] -= 1
        if not own.shown:
            return
        tag, outer = own.tag, own.outer
        if outer is not None:
            if tag == "pre":
                self.pre -= 1
                own.flow.take("".join(own.rows).removeprefix("\n").rstrip("\n").split("\n") if own.rows else [])
            lines = own.flow.done()
            if tag == "li":
                parent = next((o for o in reversed(self.stack) if o.tag in LISTS), None) if any(self.opened[t] for t in LISTS) else None
                mark = "- "
                if parent is not None and parent.tag == "ol":
                    parent.count += 1
                    mark = f"{parent.count}. "
                if lines:
                    outer.take([mark + lines[0], *((" " * len(mark) + x) if x else "" for x in lines[1:])])
            elif tag in ("blockquote", "dd"):
                outer.take([f"  {x}" if x else "" for x in lines])
            elif tag in CELLS:
                table = self._table()
                if table is not None and table.rows:
                    table.rows[-1].append((lines, own.span, own.down))
                else:
                    outer.take(lines)
            elif tag == "table":
                outer.take(lines)  # caption and stray text
                outer.take(aligned(own.rows))
            else:
                outer.take(lines)
        if tag in SPACED or tag in LINED:
            nested = tag in LISTS and any(o.tag == "li" for o in self.stack[-1:])
            (outer or own.flow).block(1 if tag in SPACED and not nested else 0)

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        if top.tag == "head" and data.strip():
            self._pop_to(len(self.stack) - 1)
            top = self.stack[-1]
        if not top.shown or not top.seen or (top.tag == "details" and top.closed):
            return
        if top.tag == "textarea":
            data = unescape(data) if _RAW_TEXTAREA else data
        if self.pre and (box := next((o for o in reversed(self.stack) if o.tag == "pre"), None)) and not any(o.tag in CELLS for o in self.stack[self.stack.index(box) :]):
            box.rows.append(data.replace("\r\n", "\n"))
        else:
            top.flow.words(data)

    def text(self) -> str:
        self.close()
        self._pop_to(1)
        return "\n".join(x.rstrip() for x in self.root.done())


def aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of cells (lines, columns, rows) in columns padded to a common width, two blanks apart."""
    width: dict[int, int] = {}
    grid: list[list[tuple[int, list[str]]]] = []
    taken: list[tuple[int, int, int]] = []  # columns from, to; rows that a cell above still reaches into
    for row in rows:
        at, k, placed, below = 0, 0, [], []
        for lines, span, down in row:
            while k < len(taken) and taken[k][0] <= at:
                at = max(at, taken[k][1])
                k += 1
            placed.append((at, lines))
            if any(lines):
                width[at] = max([width.get(at, 0), *map(len, lines)])
            if down > 1:
                below.append((at, at + span, down))
            at += span
        taken = sorted((a, b, n - 1) for a, b, n in [*taken, *below] if n > 1)
        grid.append(placed)
    columns = sorted(width)
    out = []
    for placed in grid:
        cells = dict(placed)
        for k in range(max((len(c) for c in cells.values()), default=0)):
            out.append("  ".join((c[k] if k < len(c) else "").ljust(width[j]) for j in columns for c in [cells.get(j, [])]).rstrip())
    return out


def render(html: str | None) -> str:
    reader = Renderer()
    reader.feed(html or "")
    return reader.text()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars, n_lines of each page; one narrow stage."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [render(x) for x in batch.column("html").to_pylist()]
        counts = [pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string()), *counts], ["page_id", "text", "n_chars", "n_lines"])

    return arrow_map(pages.select("page_id", "html"), work, f"page_id {kind(pages, 'page_id')}, text string, n_chars bigint, n_lines bigint", "html")

"""HTML extraction: layout-aware rendering of the visible text of pages.

A tree builder keeps the stack of open elements, opens and closes elements that HTML implies (a
paragraph ends where a block begins, a list item where the next one does, cells and rows of tables and
options likewise), skips end tags that match nothing, and reports what opens and closes. A renderer
follows it: elements that are hidden give nothing; blocks begin on lines of their own, with an empty
line around paragraphs, headings, lists and tables; list items get a mark or number and are indented by
depth; cells of a table are padded so that columns line up, over the columns and rows that they span;
preformatted text keeps its spaces.

Hidden are elements that are never drawn (head, script, ...), those with the attribute ``hidden``, and
those that their style, or a rule of a ``style`` element before them whose selector is one element name,
class or id (or these together, or a list of such), does not display or makes invisible. Other selectors, rules
within @-blocks, sheets in other files and scripts are not followed. ``aria-hidden`` hides nothing from the eye, so nothing
here; texts of alternatives (``alt``) and values of form controls are not text of the page.

The work is in proportion to the page: the places of open elements are kept by name, and a quote that
nothing closes is looked for once.

Defined results: null and empty pages give empty text; text outside any element is visible text; tags
that never end are closed at the end of the page, and a tag whose quote is never closed ends at the next
``>``; nesting may be of any depth, of which ``DEEPEST`` levels of lists are indented; rows without a
page_id are rendered like others; repeated rows give equal results; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.shared import table

#: Names of elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style template noscript iframe object svg math audio video canvas datalist select option".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr".split())
BLOCK = SPACED | frozenset("html body div section article aside header footer nav main address li dt dd tr td th thead tbody tfoot caption form center details summary figcaption legend menu dir hgroup search".split())
CELL = frozenset(("td", "th"))
#: An element that opens ends those listed, up to the fence.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "tr"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "tr"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
CLOSES_P = BLOCK - frozenset("html body li dt dd tr td th thead tbody tfoot caption legend summary figcaption".split())

#: Levels of lists that are indented.
DEEPEST = 40

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)", re.S)
STOP = re.compile(r"[>\"']")
VALUE = re.compile(r"=\s*$")
RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
SELECTOR = re.compile(r"([a-zA-Z][a-zA-Z0-9]*)?((?:[.#][\w-]+)*)$")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
BLANK = re.compile(r"[ \t\n\r\f]+")


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape(value.strip("\"'")) if value else "")
    return out


class Sheet:
    """The simple selectors whose elements are not visible: for each name, class or id, what else it takes."""

    def __init__(self):
        self.rules: dict[str, list[frozenset[str]]] = {}

    def read(self, css: str) -> None:
        css = re.sub(r"/\*.*?(?:\*/|\Z)", "", css, flags=re.S)
        depth = 0
        for part in re.split(r"(@[^{};]*\{)", css):  # rules within @-blocks do not count
            if part.startswith("@"):
                depth = 1
                continue
            if depth:
                at = 0
                for m in re.finditer(r"[{}]", part):
                    depth += 1 if m[0] == "{" else -1
                    if not depth:
                        at = m.end()
                        break
                if depth:
                    continue
                part = part[at:]
            for selectors, body in RULE.findall(part):
                if UNSEEN.search(body):
                    for selector in selectors.split(","):
                        m = SELECTOR.match(selector.strip())
                        if m and m[0]:
                            parts = frozenset([*([m[1].lower()] if m[1] else []), *re.findall(r"[.#][\w-]+", m[2])])
                            self.rules.setdefault(min(parts), []).append(parts)

    def hides(self, tag: str, attrs: dict[str, str]) -> bool:
        if not self.rules:
            return False
        own = {tag, *("." + c for c in attrs.get("class", "").split()), "#" + attrs.get("id", "")}
        return any(rule <= own for name in own if name in self.rules for rule in self.rules[name])


def is_hidden(tag: str, attrs: dict[str, str], sheet: Sheet) -> bool:
    return tag in HIDDEN or bool(attrs and ("hidden" in attrs or UNSEEN.search(attrs.get("style", "")))) or sheet.hides(tag, attrs)


def spanned(attrs: dict[str, str], name: str, most: int) -> int:
    value = attrs.get(name, "1").strip()
    return min(most, int(value)) if re.fullmatch(r"\d{1,6}", value) and int(value) else 1


class Flow:
    """Lines of text in the making: pending spaces and breaks take effect when something follows."""

    __slots__ = ("breaks", "lines", "prefix", "space", "text")

    def __init__(self):
        self.lines: list[str] = []
        self.text: list[str] = []
        self.space = False
        self.breaks = 0
        self.prefix = ""

    def end_line(self) -> None:
        self.lines.append("".join(self.text).rstrip(" "))
        self.text, self.space = [], False

    def need(self, breaks: int) -> None:
        """At least so many line ends before what follows."""
        if self.text:
            self.end_line()
        self.breaks = max(self.breaks, breaks)
        self.space = False

    def settle(self) -> None:
        if self.breaks and self.lines:
            self.lines += [""] * (self.breaks - 1)
        self.breaks = 0

    def inline(self, text: str, indent: str) -> None:
        parts = BLANK.split(text)
        for i, part in enumerate(parts):
            if i:
                self.space = True
            if not part:
                continue
            if not self.text:
                self.settle()
                self.text.append(self.prefix or indent)
                self.prefix = ""
            elif self.space:
                self.text.append(" ")
            self.text.append(part)
            self.space = False

    def exact(self, text: str, indent: str) -> None:
        first, *rest = text.replace("\r\n", "\n").split("\n")
        for i, part in enumerate([first, *rest]):
            if i:
                self.settle()
                self.end_line()
            if part:
                if not self.text:
                    self.settle()
                    self.text.append(self.prefix or indent)
                    self.prefix = ""
                self.text.append(part)

    def done(self) -> list[str]:
        if self.text:
            self.end_line()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        return lines


class Renderer:
    """Takes what the tree builder opens and closes, and text."""

    def __init__(self):
        self.flows = [Flow()]
        self.sheet = Sheet()
        self.tables: list[list[list[tuple[list[str], int, int]]]] = []
        self.spans: list[tuple[int, int]] = []  # columns and rows of the open cells
        self.lists: list[list] = []  # [kind, next number]
        self.levels = [0]  # open lists in each flow
        self.unseen = self.exact = 0
        self.title: list[str] = []
        self.in_title = 0

    def indent(self) -> str:
        return "  " * min(DEEPEST, self.levels[-1])

    def open(self, tag: str, attrs: dict[str, str]) -> bool:
        """Whether the element is hidden; ``close`` needs it again."""
        if tag == "title":
            self.in_title += 1
        hide = is_hidden(tag, attrs, self.sheet)
        self.unseen += hide
        if self.unseen:
            return hide
        flow = self.flows[-1]
        if tag == "br":
            if flow.text:
                flow.end_line()
            else:
                flow.breaks += 1
            return hide
        if tag in CELL and self.tables and self.tables[-1]:
            self.flows.append(Flow())
            self.levels.append(0)
            self.spans.append((spanned(attrs, "colspan", 1000), spanned(attrs, "rowspan", 65534)))
            return hide
        if tag == "table":
            flow.need(2)
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("ul", "ol", "menu", "dir"):
            flow.need(1 if self.lists else 2)
            start = attrs.get("start", "1")
            self.lists.append(["ol" if tag == "ol" else "ul", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            self.levels[-1] += 1
        elif tag == "li":
            flow.need(1)
            mark = "- "
            if self.lists and self.lists[-1][0] == "ol":
                mark = f"{self.lists[-1][1]}. "
                self.lists[-1][1] += 1
            flow.prefix = self.indent()[2:] + mark
        elif tag in SPACED:
            flow.need(1 if flow.prefix else 2)
        elif tag in BLOCK:
            flow.need(1)
        self.exact += tag in ("pre", "textarea")
        return hide

    def close(self, tag: str, hide: bool) -> None:
        if tag == "title":
            self.in_title -= 1
        self.unseen -= hide
        if self.unseen or hide:
            return
        if tag in CELL and self.tables and self.tables[-1] and len(self.flows) > 1:
            self.levels.pop()
            self.tables[-1][-1].append((self.flows.pop().done(), *self.spans.pop()))
            return
        flow = self.flows[-1]
        if tag == "table" and self.tables:
            self.lay_out(self.tables.pop(), flow)
            flow.need(2)
        elif tag in ("ul", "ol", "menu", "dir") and self.lists:
            self.lists.pop()
            self.levels[-1] = max(0, self.levels[-1] - 1)
            flow.need(1 if self.lists else 2)
            flow.prefix = ""
        elif tag in SPACED:
            flow.need(2)
        elif tag in BLOCK and tag != "tr":
            flow.need(1)
            if tag == "li":
                flow.prefix = ""
        self.exact -= tag in ("pre", "textarea")

    def lay_out(self, rows: list[list[tuple[list[str], int, int]]], flow: Flow) -> None:
        placed: list[list[tuple[list[str], int, int]]] = []  # (lines, first column, end column)
        held: list[tuple[int, int, int]] = []  # columns that cells of rows above still take: first, end, row where they end
        for number, row in enumerate(rows):
            held = [x for x in held if x[2] > number]
            taken, now, column, fresh = iter(held), None, 0, []
            now = next(taken, None)
            out = []
            for lines, across, down in row:
                while now and now[0] <= column:
                    column = max(column, now[1])
                    now = next(taken, None)
                out.append((lines, column, column + across))
                if down > 1:
                    if fresh and fresh[-1][1] == column and fresh[-1][2] == number + down:
                        fresh[-1] = (fresh[-1][0], column + across, number + down)
                    else:
                        fresh.append((column, column + across, number + down))
                column += across
            held = sorted(held + fresh) if fresh else held
            if any(any(x[0]) for x in out):
                placed.append(out)
        if all(len(out) == 1 and out[0][1] == 0 for out in placed) and not self.indent():  # one column: nothing to line up
            for out in placed:
                if not flow.text:
                    flow.settle()
                flow.lines += out[0][0]
            return
        edges = sorted({x[1] for out in placed for x in out})  # columns where no cell begins have no width of their own
        place = {c: i for i, c in enumerate(edges)}
        widths = [0] * len(edges)
        wide = []
        for out in placed:
            for lines, lo, hi in out:
                need, first, end = max(map(len, lines), default=0), place[lo], bisect_left(edges, hi)
                if end - first == 1:
                    widths[first] = max(widths[first], need)
                elif need:
                    wide.append((end - first, first, end, need))
        for _, first, end, need in sorted(wide):
            have = sum(widths[first:end]) + 2 * (end - first - 1)
            widths[end - 1] += max(0, need - have)
        starts = [0]
        for w in widths:
            starts.append(starts[-1] + w + 2)
        indent = self.indent()
        for out in placed:
            for k in range(max(len(x[0]) for x in out)):
                line, at = [], 0
                for lines, lo, _ in out:
                    text = lines[k] if k < len(lines) else ""
                    if text:
                        line += [" " * (starts[place[lo]] - at), text]
                        at = starts[place[lo]] + len(text)
                if not flow.text:
                    flow.settle()
                flow.lines.append((indent + "".join(line)).rstrip())

    def write(self, text: str) -> None:
        if self.in_title:
            self.title.append(text)
        if self.unseen:
            return
        if self.exact:
            self.flows[-1].exact(text, self.indent())
        else:
            self.flows[-1].inline(text, self.indent())

    def result(self) -> str:
        return "\n".join(self.flows[0].done())


class Stack:
    """Open elements, with the places of each name, and of all blocks."""

    def __init__(self, renderer: Renderer):
        self.r, self.open = renderer, []
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, attrs: dict[str, str]) -> None:
        self.where.setdefault(tag, []).append(len(self.open))
        if tag in BLOCK:
            self.blocks.append(len(self.open))
        self.open.append((tag, self.r.open(tag, attrs)))

    def pop(self) -> None:
        tag, hide = self.open.pop()
        self.where[tag].pop()
        if tag in BLOCK:
            self.blocks.pop()
        self.r.close(tag, hide)

    def last(self, names) -> int:
        """The place of the innermost of ``names``, or -1."""
        return max((self.where[n][-1] for n in names if self.where.get(n)), default=-1)

    def close_to(self, place: int) -> None:
        while len(self.open) > place:
            self.pop()

    def end(self, names, fence) -> None:
        """Close open elements down to the outermost of ``names`` above the fence."""
        above = self.last(fence)
        found = [self.where[n][i] for n in names if self.where.get(n) and (i := bisect_left(self.where[n], above + 1)) < len(self.where[n])]
        if found:
            self.close_to(min(found))

    def end_inline(self, tag: str) -> None:
        """End an inline element; one outside the innermost block stays open."""
        place = self.last((tag,))
        if place >= 0 and place > (self.blocks[-1] if self.blocks else -1):
            self.close_to(place)


class Tags:
    """Finds where a tag ends: at the first ``>`` that is not within a quoted value."""

    def __init__(self, page: str):
        self.page, self.unclosed = page, set()

    def end(self, at: int) -> int:
        """The place of the ``>``, or -1."""
        begin = at
        while m := STOP.search(self.page, at):
            quote, at = m[0], m.end()
            if quote == ">":
                return m.start()
            if quote not in self.unclosed and VALUE.search(self.page, max(begin, m.start() - 40), m.start()):
                close = self.page.find(quote, at)
                if close < 0:
                    self.unclosed.add(quote)  # none behind this place closes either
                else:
                    at = close + 1
        return -1


HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
UNFENCED = frozenset(("table", "html", "body", "tr", "tbody", "thead", "tfoot"))


def render(page: str | None) -> tuple[str, str]:
    """(visible text, title) of a page."""
    page = page or ""
    r = Renderer()
    stack, tags = Stack(r), Tags(page)
    at, n = 0, len(page)
    while at < n:
        m = MARKUP.search(page, at)
        end = m.end() if m else n
        if m and m[2] and (end := tags.end(m.end()) + 1) == 0:
            m = None  # no tag ends any more
        stop = m.start() if m else n
        if stop > at:
            piece = page[at:stop]
            r.write(html.unescape(piece) if "&" in piece else piece)
        if m is None:
            break
        at = end
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                r.write(m[0][9:].removesuffix("]]>"))
            continue
        tag = name.lower()
        if m[1]:
            if tag == "p" and not stack.where.get("p"):
                stack.push("p", {})
                stack.pop()
            elif tag == "br":
                r.open("br", {})
            elif tag in BLOCK:
                fence = () if tag in UNFENCED else ("table",) if tag in CELL else ("td", "th", "table")
                stack.end(HEADINGS if tag in HEADINGS else (tag,), [f for f in fence if f != tag])
            else:
                stack.end_inline(tag)
            continue
        raw = page[m.end() : at - 1]
        attrs = attributes(raw) if raw and not raw.isspace() else {}
        if tag in CLOSES_P:
            stack.end(("p",), ("td", "th", "table", "button"))
        if tag in ENDS:
            stack.end(*ENDS[tag])
        if tag in CELL and stack.where.get("table") and stack.last(("table",)) > stack.last(("tr",)):
            stack.push("tr", {})
        if tag in VOID:
            hide = r.open(tag, attrs)
            if tag != "br":
                r.close(tag, hide)
            continue
        stack.push(tag, attrs)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(page, at)
            raw = page[at : close.start() if close else n]
            if tag == "style":
                r.sheet.read(raw)
            r.write(html.unescape(raw) if tag in ("title", "textarea") else raw)
            at = close.end() if close else n
            stack.pop()
    stack.close_to(0)
    return r.result(), BLANK.sub(" ", "".join(r.title)).strip()


SCHEMA = "page_id bigint, title string, text string, n_chars bigint, n_lines bigint"


def extract(pages: DataFrame) -> DataFrame:
    """Columns of SCHEMA for every row of ``pages`` (page_id, html); a narrow map."""

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 200):
                ids, pages_ = batch.column(0).slice(lo, 200), batch.column(1).slice(lo, 200).to_pylist()
                done = [render(p) for p in pages_]
                texts = [t for t, _ in done]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([t for _, t in done], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + bool(t) for t in texts], pa.int64())],
                    ["page_id", "title", "text", "n_chars", "n_lines"],
                )

    return pages.select("page_id", "html").mapInArrow(run, SCHEMA)


def op6_layout_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

"""Layout-aware text of web pages: what a reader sees, laid out as lines.

A tokenizer reads tags, comments and raw-text elements in one pass. The tree
builder turns them into properly nested events: it implies end tags (a block
closes an open paragraph, an item the item before, a cell the cell before) and
start tags (rows of cells), keeps end tags from reaching out of a table cell,
and drops subtrees that are not visible. Elements that are not visible are
open elements like others: implied end tags and those of parents close them.
Not visible are elements without a rendering (``HIDDEN``), those with
``hidden`` or ``aria-hidden``, and those whose style says so: their own, or the
rules of the page's style sheets for types, classes, ids and compounds of them,
weighed by importance, specificity and order. Selectors beyond these (with
combinators, attributes, pseudo-classes) match nothing; of conditional groups
only ``@media`` for all or screen counts.

The renderer lays the events out: inline white space collapses, blocks begin
and end lines, paragraphs and the like are set off by a blank line, items get
their bullet or number and are indented by depth, preformatted text stays, and
the cells of a table are aligned in columns (up to ``MAX_PAD`` characters wide;
wider cells are kept whole but not padded). It is iterative: the depth of a
page is bounded by memory only.

Defined cases: null or empty html gives an empty text; broken markup is read
as far as a browser would (an unclosed comment or script hides the rest);
rows are rendered one by one, so repeated rows give repeated results; an empty
table gives an empty result; columns other than page_id and html are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_PAD, MAX_SPAN = 40, 1000

# Fixed values of the HTML standard: elements by how they are laid out.
HIDDEN = frozenset("audio canvas datalist head iframe noembed noframes noscript object script style svg template title video".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 ol p pre table ul xmp".split())
BLOCK = SPACED | frozenset("address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup html legend li main menu nav optgroup option search section summary tbody td textarea tfoot th thead tr".split())
CLOSES_P = (BLOCK - frozenset("body caption html legend option optgroup tbody td textarea tfoot th thead tr".split())) | {"hr"}
#: What an element closes where open, up to one of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"optgroup"}),
    "optgroup": ({"option", "optgroup"}, set()),
    "td": ({"td", "th", "caption"}, {"table"}),
    "th": ({"td", "th", "caption"}, {"table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
CELLS, TABLE_PARTS = frozenset({"td", "th"}), frozenset("caption tbody td tfoot th thead tr".split())
SCOPE = frozenset({"object", "template"})
FENCE = frozenset("caption table td th".split()) | SCOPE
#: Elements that stand in the head, and inline ones that outlive the block they were opened in.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: Elements of HTML that end an svg they are found in, unless within one of the second set.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strike strong sub sup table tt u ul var".split())
FOREIGN = frozenset("svg foreignobject desc title".split())

_START = re.compile(r"""<([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<([A-Za-z][^\s/>]*+)([^>]*+)>")
_END = re.compile(r"</([A-Za-z][^\s/>]*+)[^>]*+>")
_ATTR = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'<>]++))?+""")
_OUT_OF_SIGHT = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_CSS_COMMENT = re.compile(r"/\*(?:[^*]++|\*(?!/))*+(?:\*/|\Z)")
_CSS_MARK = re.compile(r"[{};]")
_SCREEN = re.compile(r"@media\s*+(?:only\s++)?(?:all|screen)\s*+\Z", re.I)
_SIMPLE = re.compile(r"([A-Za-z][\w-]*+|\*)?((?:[.#][A-Za-z_-][\w-]*+)*+)")
_NAMED = re.compile(r"[.#][\w-]++")
_DECLARED = re.compile(r"\s*+(display|visibility)\s*+:\s*+([A-Za-z-]++)\s*+(!\s*+important)?\s*+", re.I)
_BLANK = re.compile(r"[\x20\t\n\f\r]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>|</{name}(?=[\s/>])", re.I) for name in RAW}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", "", text), ("start", name, attributes), ("end", name, "") and
    ("css", "", style sheet)."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", "", entities.unescape(page[at:])
            return
        if lt > at:
            yield "text", "", entities.unescape(page[at:lt])
        mark = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            to = lt + 5 if page.startswith(">", lt + 4) else page.find("-->", lt + 4) + 3
            at = n if to == 2 else to
        elif mark in ("!", "?") and mark or mark == "/" and not page[lt + 2 : lt + 3].isalpha():
            to = page.find(">", lt + 1)
            at = n if to < 0 else to + 1
        elif mark == "/":
            m = _END.match(page, lt)
            if m is None:
                return
            yield "end", m[1].lower(), ""
            at = m.end()
        elif "a" <= mark.lower() <= "z" and mark:
            m = _START.match(page, lt) or _LOOSE.match(page, lt)
            if m is None:  # the page ends within a tag
                return
            name = m[1].lower()
            yield "start", name, m[2]
            at = m.end()
            if name in ("pre", "textarea"):  # the line break right after the tag is not text
                at += 2 if page.startswith("\r\n", at) else page.startswith("\n", at)
            if name in RAW:
                close = _RAW_END[name].search(page, at)
                to = close.start() if close else n
                body = page[at:to]
                if name in ("textarea", "title", "xmp"):
                    yield "text", "", body if name == "xmp" else entities.unescape(body)
                elif name == "style":
                    yield "css", "", body
                yield "end", name, ""
                at = close.end() if close else n
        else:
            yield "text", "", "<"
            at = lt + 1


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        value = m[2] or ""
        out.setdefault(m[1].lower(), entities.unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return out


class Styles:
    """What style sheets say of ``display`` and ``visibility``, by element.

    A rule is filed under its id, else its first class, else its type, so an
    element is held against the rules for its own names only.
    """

    def __init__(self) -> None:
        self.rules: dict[str, list[tuple[str, frozenset[str], str, bool, tuple[bool, int, int, int, int]]]] = {}
        self.read = 0

    def add(self, sheet: str) -> None:
        sheet = _CSS_COMMENT.sub(" ", sheet)
        at, within = 0, []  # within: for each open group, whether it counts
        for m in _CSS_MARK.finditer(sheet):
            prelude, at = sheet[at : m.start()].strip(), m.end()
            if m[0] == "{":
                group = prelude[:1] == "@"
                counts = all(within) and (not group or bool(_SCREEN.match(prelude)))
                within.append(counts)
                if counts and not group:
                    end = sheet.find("}", at)
                    self._rule(prelude, sheet[at : end if end >= 0 else len(sheet)])
            elif m[0] == "}" and within:
                within.pop()

    def _rule(self, selectors: str, body: str) -> None:
        said = [m for m in map(_DECLARED.fullmatch, body.split(";")) if m]
        for selector in selectors.split(",") if said else ():
            m = _SIMPLE.fullmatch(selector.strip())
            if not m or not m[0]:
                continue
            kind, names = m[1].lower() if m[1] and m[1] != "*" else "", _NAMED.findall(m[2])
            ids = sum(x[0] == "#" for x in names)
            key = next((x for x in names if x[0] == "#"), names[0] if names else kind)
            for d in said:
                self.read += 1
                weight = (bool(d[3]), 0, ids, 2 * (len(names) - ids) + bool(kind), self.read)
                self.rules.setdefault(key, []).append((kind, frozenset(names), d[1].lower(), _gone(d[2]), weight))

    def unseen(self, name: str, given: dict[str, str]) -> bool:
        """Whether an element is out of sight by the sheets and its own style."""
        names = frozenset([*("." + c for c in given.get("class", "").split()), *(["#" + given["id"]] if given.get("id") else [])])
        best: dict[str, tuple[tuple[bool, int, int, int, int], bool]] = {}
        for key in (*names, name, ""):
            for kind, needed, what, gone, weight in self.rules.get(key, ()):
                if kind in ("", name) and needed <= names and (what not in best or best[what][0] < weight):
                    best[what] = weight, gone
        for m in filter(None, map(_DECLARED.fullmatch, given.get("style", "").split(";"))):
            weight, what = (bool(m[3]), 1, 0, 0, 0), m[1].lower()
            if what not in best or best[what][0] <= weight:
                best[what] = weight, _gone(m[2])
        return any(gone for _, gone in best.values())


def _gone(value: str) -> bool:
    return value.lower() in ("none", "hidden", "collapse")


def styles(page: str) -> Styles | None:
    """The page's style sheets, or None if none of them hides anything."""
    if not _OUT_OF_SIGHT.search(page):
        return None
    found, on = Styles(), False
    for kind, name, raw in tokens(page):
        if kind == "start":
            on = name == "style" and bool(_SCREEN.match("@media " + attributes(raw).get("media", "all")))
        elif kind == "css" and on:
            found.add(raw)
    return found if found.rules else None


def _unseen(name: str, raw: str, sheets: Styles | None = None) -> bool:
    if name in HIDDEN:
        return True
    if not raw.strip(" /") and not sheets:
        return name == "dialog"
    a = attributes(raw)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or name == "dialog" and "open" not in a:
        return True
    return sheets.unseen(name, a) if sheets else bool(_OUT_OF_SIGHT.search(a.get("style", "")))


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """Nested events of the visible tree: start, end, text, and br."""
    open_: list[tuple[str, bool, bool]] = []  # name, whether its start was told, whether it is unseen
    count: dict[str, int] = {}
    hidden = 0  # unseen elements that are open
    sheets = styles(page)

    def drop(i: int) -> tuple[str, bool, bool]:
        nonlocal hidden
        name, shown, unseen = open_.pop(i)
        count[name] -= 1
        hidden -= unseen
        return name, shown, unseen

    def close_to(depth: int) -> Iterator[tuple[str, str, str]]:
        again: list[str] = []
        while len(open_) > depth:
            name, shown, unseen = drop(-1)
            if shown:
                yield "end", name, ""
            if unseen and name in FORMATTING:
                again.append(name)
            elif name in FENCE:
                again.clear()
        for name in reversed(again):
            push(name, True)

    def find(names: set[str] | frozenset[str], fence: set[str] | frozenset[str]) -> int:
        """Depth of the outermost of the innermost run of ``names`` before a fence, or -1."""
        if not any(count.get(x) for x in names):
            return -1
        found = -1
        for i in range(len(open_) - 1, -1, -1):
            name = open_[i][0]
            if name in fence or name in SCOPE:
                break
            if name in names:
                found = i
        return found

    def push(name: str, unseen: bool = False) -> bool:
        """Open an element; whether to tell its start."""
        nonlocal hidden
        shown = name in BLOCK and not unseen and not hidden
        open_.append((name, shown, unseen))
        count[name] = count.get(name, 0) + 1
        hidden += unseen
        return shown

    for kind, name, raw in tokens(page):
        if open_ and open_[-1][0] == "head" and (raw.strip("\t\n\f\r ") if kind == "text" else name not in IN_HEAD if kind == "start" else name in ("body", "html", "br")):
            yield from close_to(len(open_) - 1)
        if kind == "text":
            if not hidden:
                yield kind, "", raw
        elif kind == "start":
            foreign = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] in FOREIGN), -1) if count.get("svg") else -1
            if foreign >= 0 and open_[foreign][0] == "svg":
                if name in BREAKOUT:
                    yield from close_to(foreign)
                elif raw.rstrip().endswith("/"):
                    continue
            if name in CLOSES_P and (at := find({"p"}, FENCE)) >= 0:
                yield from close_to(at)
            if name in IMPLIED and (at := find(*IMPLIED[name])) >= 0:
                yield from close_to(at)
            if name in ("a", "nobr") and (at := find({name}, FENCE)) >= 0:
                drop(at)
            if name in ("br", "hr"):
                if not hidden:
                    yield "br" if name == "br" else "rule", name, ""
                continue
            if name in VOID or name == "head" and any(x != "html" for x, _, _ in open_):
                continue
            unseen = _unseen(name, raw, sheets)
            if unseen and raw.rstrip().endswith("/") and (name == "svg" or name not in HIDDEN):
                continue
            if name in TABLE_PARTS:
                if not count.get("table"):
                    continue
                if name in CELLS and find({"tr"}, {"table"}) < 0 and push("tr"):
                    yield "start", "tr", ""
            if push(name, unseen):
                yield "start", name, raw
        elif name == "br":
            if not hidden:
                yield "br", name, ""
        elif count.get(name) and not (hidden and name in ("body", "html")):
            at, crossed = -1, False  # whether a block is open within
            fence = {"table"} | SCOPE if name in TABLE_PARTS else SCOPE if name == "table" else FENCE if name != "template" else frozenset()
            for i in range(len(open_) - 1, -1, -1):
                inner = open_[i][0]
                if inner == name:
                    at = i
                    break
                if inner in fence:
                    break
                crossed = crossed or inner in BLOCK
            if at < 0:
                continue
            if name in FORMATTING:
                drop(at)
                if not crossed:
                    yield from close_to(at)
            elif name in BLOCK or not crossed or open_[at][2]:
                yield from close_to(at)
    yield from close_to(0)


class Flow:
    """Lines of one flow of blocks: the page's, or a table cell's."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.gap = False  # a space, or a blank line, is due
        self.indent: list[int] = []
        self.bullets: list[str] = []  # of the open items, empty once written
        self.pre = 0

    @property
    def bullet(self) -> str:
        """The innermost item's, if no line has been written since it began."""
        return self.bullets[-1] if self.bullets else ""

    def text(self, value: str) -> None:
        if self.pre:
            first, *rest = value.replace("\r\n", "\n").split("\n")
            self._add(first)
            for piece in rest:
                self.end_line(force=True)
                self._add(piece)
            return
        if value[:1] in " \t\n\f\r" and value[:1]:
            self.space = True
        value_end = value[-1:] in (" ", "\t", "\n", "\f", "\r")
        body = _BLANK.sub(" ", value).strip(" ")
        if body:
            if self.space and self.line:
                self.line.append(" ")
            self._add(body)
            self.space = bool(value_end)

    def _add(self, piece: str) -> None:
        if piece:
            if not self.line:
                if self.gap and self.lines and self.lines[-1] != "":
                    self.lines.append("")
                self.gap = False
            self.line.append(piece)

    def end_line(self, force: bool = False) -> None:
        if self.line or force:
            depth = max(0, len(self.indent) - 1)
            lead = "  " * depth + self.bullet if self.bullet else " " * (2 * depth + (self.indent[-1] if self.indent else 0))
            self.lines.append((lead + "".join(self.line)).rstrip() if self.line or self.bullet else "")
            self.line, self.bullets = [], [""] * len(self.bullets)
        self.space = False

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap = self.gap or spaced and not self.bullet

    def add_lines(self, lines: list[str]) -> None:
        self.end_line()
        if lines and self.gap and self.lines and self.lines[-1] != "":
            self.lines.append("")
        self.gap = False
        depth = 2 * max(0, len(self.indent) - 1)
        lead = " " * (depth + (self.indent[-1] if self.indent else 0))
        if lines and self.bullet:
            self.lines.append(" " * depth + self.bullet + lines[0])
            lines, self.bullets = lines[1:], [""] * len(self.bullets)
        self.lines += [lead + x if x else x for x in lines]

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _span(raw: str, name: str) -> int:
    value = attributes(raw).get(name, "1") if raw else "1"
    return min(MAX_SPAN, max(1, int(value))) if value.isascii() and value.isdigit() and len(value) < 6 else 1


def align(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table: rows of cells (lines, columns, rows spanned)."""
    grid: list[dict[int, tuple[list[str], int]]] = []
    taken: dict[int, int] = {}  # column -> further rows that a cell above takes
    width: dict[int, int] = {}
    for row in rows:
        at, placed, fresh = 0, {}, {}
        for lines, columns, down in row:
            while taken.get(at):
                at += 1
            placed[at] = lines, columns
            if columns == 1:
                widest = max(map(len, lines), default=0)
                width[at] = max(width.get(at, 0), widest if widest <= MAX_PAD else 0)
            if down > 1:
                fresh.update((at + i, down - 1) for i in range(columns))
            at += columns
        taken = {k: v - 1 for k, v in taken.items() if v > 1} | fresh
        grid.append(placed)
    out = []
    for placed in grid:
        last = max(placed, default=-1)
        for k in range(max((len(x) for x, _ in placed.values()), default=0)):
            line, filled = [], 0
            for at in sorted(placed):
                if at > filled:  # columns that cells above leave empty
                    line.append(" " * sum(width.get(i, 0) + 2 for i in range(filled, at)))
                lines, columns = placed[at]
                piece, filled = lines[k] if k < len(lines) else "", at + columns
                line.append(piece if at == last else piece.ljust(sum(width.get(i, 0) + 2 for i in range(at, filled)) - 2) + "  ")
            out.append("".join(line).rstrip())
    return out


def render(page: str | None) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    flows = [Flow()]
    tables: list[list[list[tuple[list[str], int, int]]]] = []
    cells: list[tuple[int, int]] = []
    lists: list[int] = []  # next number; 0 for bullets
    for kind, name, raw in events(page):
        flow = flows[-1]
        if kind == "text":
            flow.text(raw)
        elif kind == "br":
            flow.end_line(force=True)
        elif kind == "rule":
            flow.block(True)
        elif kind == "start":
            if name == "table":
                flow.block(True)
                tables.append([])
            elif name == "tr":
                tables[-1].append([])
            elif name in CELLS:
                if not tables[-1]:
                    tables[-1].append([])
                cells.append((_span(raw, "colspan"), _span(raw, "rowspan")))
                flows.append(Flow())
            else:
                nested = name in ("ul", "ol", "menu", "dir")
                flow.block(name in SPACED and not (nested and lists))
                if nested:
                    lists.append(int(name == "ol"))
                    flow.indent.append(0)
                elif name == "li":
                    number = lists[-1] if lists else 0
                    if number:
                        lists[-1] += 1
                    flow.bullets.append(f"{number}. " if number else "- ")
                    if flow.indent:
                        flow.indent[-1] = len(flow.bullet)
                elif name in ("pre", "xmp", "textarea"):
                    flow.pre += 1
        elif name == "table":
            flow.add_lines(align(tables.pop()))
            flow.gap = True
        elif name in CELLS:
            columns, down = cells.pop()
            tables[-1][-1].append((flows.pop().done(), columns, down))
        elif name != "tr":
            nested = name in ("ul", "ol", "menu", "dir")
            flow.end_line()
            if nested:
                lists.pop()
                flow.indent.pop()
            elif name == "li":
                flow.bullets.pop()
            elif name in ("pre", "xmp", "textarea"):
                flow.pre -= 1
            flow.block(name in SPACED and not (nested and lists))
    return "\n".join(flows[0].done())


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            texts = [render(x.as_py()) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "text", "n_chars"])


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars per input row."""
    return pages.selectExpr("cast(page_id as long) as page_id", "html").mapInArrow(_rows, "page_id long, text string, n_chars long")

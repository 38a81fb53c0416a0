"""Pages against a plain recursive renderer that starts from a tree.

Random trees are written as pages, so their brute force needs no parser; the
pages of the test table go through the standard library's parser.
"""

import html
import re
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearvote.llm import html_text, queries
from tests.conftest import SF

GAP = object()
LISTS, SPACED, INLINE = {"ul", "ol"}, {"p", "h1", "blockquote", "pre", "ul", "ol", "table"}, {"b", "i", "a", "span", "br"}


def brute_lines(nodes, listed=False):
    """Lines of a flow: a blank one wherever a gap parts two lines."""
    out, gap = [], False
    for item in brute_flow(nodes, 0, 0, listed):
        if item is GAP:
            gap = True
            continue
        lead, text, bullet = item
        if text and gap and out and out[-1]:
            out.append("")
        gap = gap and not text
        out.append((lead + text).rstrip() if text or bullet else "")
    while out and not out[-1]:
        out.pop()
    return out


def brute_flow(nodes, depth, hang, listed):
    """Gaps and (lead, text, whether the lead is a bullet) for each line."""
    lead = " " * (2 * max(0, depth - 1) + hang)
    out, run = [], ""

    def flush():
        nonlocal run
        pieces = [re.sub(r"[ \t\n\f\r]+", " ", x).strip(" ") for x in run.split("\0")]
        for k, piece in enumerate(pieces):
            if piece or k < len(pieces) - 1:
                out.append((lead, piece, False))
        run = ""

    for node in nodes:
        if isinstance(node, str):
            run += node
            continue
        tag, attrs, children = node
        if hides(tag, attrs):
            continue
        if tag in INLINE:
            run += brute_inline(node)
            continue
        flush()
        spaced = tag in SPACED and not (tag in LISTS and listed)
        out += [GAP] * spaced
        if tag in LISTS:
            for n, (_, _, inside) in enumerate((c for c in children if not isinstance(c, str)), 1):
                bullet = f"{n}. " if tag == "ol" else "- "
                items = brute_flow(inside, depth + 1, len(bullet), True)
                while items and items[0] is GAP:
                    items.pop(0)
                if items and not items[0][2]:
                    items[0] = (" " * (2 * depth) + bullet, items[0][1], True)
                out += items
        elif tag == "table":
            out += [(lead, x, False) for x in brute_table(children, listed)]
        elif tag == "pre":
            out += [(lead, x, False) for x in "".join(children).removesuffix("\n").split("\n")] if children else []
        else:
            out += brute_flow(children, depth, hang, listed)
        out += [GAP] * spaced
    flush()
    return out


def brute_inline(node):
    if isinstance(node, str):
        return node
    tag, attrs, children = node
    return "" if hides(tag, attrs) else "\0" if tag == "br" else "".join(map(brute_inline, children))


def brute_table(rows, listed):
    """Every place of the grid is worked out; cells start at the first free one."""
    used, cells = set(), []
    for r, (_, _, row) in enumerate(rows):
        c = 0
        for _, attrs, inside in row:
            while (r, c) in used:
                c += 1
            wide, high = int(attrs.get("colspan", 1)), int(attrs.get("rowspan", 1))
            used |= {(r + i, c + j) for i in range(high) for j in range(wide)}
            cells.append((r, c, wide, brute_lines(inside, listed)))
    width = {}
    for _, c, wide, lines in cells:
        longest = max(map(len, lines), default=0)
        if wide == 1 and longest <= html_text.MAX_PAD:
            width[c] = max(width.get(c, 0), longest)
    out = []
    for r in range(len(rows)):
        mine = [x for x in cells if x[0] == r]
        for k in range(max((len(x[3]) for x in mine), default=0)):
            line, end = "", 0
            for _, c, wide, lines in mine:
                line += " " * sum(width.get(i, 0) + 2 for i in range(end, c))
                end = c + wide
                line += (lines[k] if k < len(lines) else "").ljust(sum(width.get(i, 0) + 2 for i in range(c, end)) - 2) + "  "
            out.append(line.rstrip())
    return out


def hides(tag, attrs):
    return tag in {"head", "script", "style", "title"} or "hidden" in attrs or attrs.get("style") == "display:none" or attrs.get("class") == "off"


def written(node):
    if isinstance(node, str):
        return html.escape(node)
    tag, attrs, children = node
    given_ = "".join(f' {k}="{v}"' for k, v in attrs.items())
    return f"<{tag}{given_}>" + ("" if tag == "br" else "".join(map(written, children)) + f"</{tag}>")


words = st.text(alphabet="ab <&\n", max_size=8)
attributes = st.sampled_from([{}, {}, {}, {}, {"hidden": ""}, {"style": "display:none"}, {"class": "off"}, {"class": "on"}])
node = lambda tags, inside: st.tuples(st.sampled_from(tags), attributes, st.lists(inside, max_size=4))
inline = st.recursive(words | st.just(("br", {}, [])), lambda x: node(["b", "i", "span"], x), max_leaves=4)
texts_only = st.recursive(words, lambda x: node(["b", "span"], x), max_leaves=3)
spans = st.sampled_from([{}, {}, {}, {"colspan": "2"}, {"rowspan": "2"}, {"colspan": "3", "rowspan": "2"}])
pre = st.text(alphabet="ab \n", min_size=1, max_size=10).filter(lambda x: x.strip() and x[0] not in " \n").map(lambda x: ("pre", {}, [x]))


def blocks(inside):
    item = st.tuples(st.just("li"), st.just({}), st.lists(inside, max_size=3))
    cell = st.tuples(st.sampled_from(["td", "th"]), spans, st.lists(texts_only | node(["p", "div"], texts_only), max_size=3))
    row = st.tuples(st.just("tr"), st.just({}), st.lists(cell, min_size=1, max_size=4))
    return (
        node(["p", "h1"], inline)
        | node(["div", "blockquote"], inside)
        | st.tuples(st.sampled_from(["ul", "ol"]), attributes, st.lists(item, max_size=3))
        | st.tuples(st.just("table"), attributes, st.lists(row, max_size=3))
        | pre
    )


trees = st.lists(st.recursive(inline | pre, lambda x: blocks(x | inline), max_leaves=12), max_size=5)


@given(trees, st.booleans())
@settings(max_examples=500, deadline=None)
def test_random_trees(tree, sheet_first):
    sheet, body = "<style>p { margin: 0 } .off, #none { display: none }</style>", "".join(map(written, tree))
    page = sheet + body if sheet_first else body + sheet
    assert html_text.render(page).split("\n") == (brute_lines(tree) or [""])


class Tree(HTMLParser):
    """Trees of the pages of the test table: paragraphs and items may be left open."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.stack = [("root", {}, [])]
        self.feed(page)
        self.close()

    def up_to(self, tag):
        while self.stack.pop()[0] != tag:
            pass

    def handle_starttag(self, tag, attrs):
        names = [x[0] for x in self.stack]
        if "p" in names and tag not in INLINE:
            self.up_to("p")
        self.stack[-1][2].append((tag, {k: v or "" for k, v in attrs}, []))
        if tag not in ("br", "meta"):
            self.stack.append(self.stack[-1][2][-1])

    def handle_endtag(self, tag):
        if tag in [x[0] for x in self.stack]:
            self.up_to(tag)

    def handle_data(self, data):
        self.stack[-1][2].append(data)


def test_whole_table(spark, duck):
    pages = dict(duck.sql("SELECT page_id, html FROM pages").fetchall())
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op8_html_extraction(spark, SF).collect()}
    assert got.keys() == pages.keys() and len(got) > 200
    for page_id, page in pages.items():
        text = "\n".join(brute_lines(Tree(page).stack[0][2]))
        assert got[page_id] == (text, len(text))


@pytest.mark.parametrize(
    "page, text",
    [
        ("<style>.x{display:none}</style><p class='a x'>a<p>b", "b"),
        ("<p id=k>a</p>b<style>/* c } */ @import 'u'; p#k , i { color:red; DISPLAY : none !important }</style>", "b"),
        ("<style>.x{display:none}.y{display:block}</style><p class='x y'>a</p>b", "a\n\nb"),
        ("<style>p.x{display:none}.x{display:block}</style><p class=x>a</p>b", "b"),
        ("<style>.x{display:none}</style><p class=x style='display:block'>a</p>b", "a\n\nb"),
        ("<style>.x{display:none!important}</style><p class=x style='display:block'>a</p>b", "b"),
        ("<style>@media print{.x{display:none}}</style><p class=x>a</p>b", "a\n\nb"),
        ("<style>@media screen{.x{display:none}} .z{visibility:hidden}</style><p class=x>a</p><i class=z>c</i>b", "b"),
        ("<style media=print>.x{display:none}</style><p class=x>a</p>b", "a\n\nb"),
        ("<!--<style>.x{display:none}</style>--><p class=x>a</p>b", "a\n\nb"),
        ("<style>.x p, .y:hover{display:none}</style><p class=x>a</p>b", "a\n\nb"),
        ("<style>.x{display:none</style><p class=x>a</p>b", "b"),
        ("<style>}{;</style><p style='display:none'>a</p>b", "b"),
        ("<pre>\na\n b</pre>c", "a\n b\n\nc"),
        ("<ul><li><table><td>a<td>b</table>c</ul>", "- a  b\n\n  c"),
        ("<table><td colspan=2>wide<td>x<tr><td>a<td>b<td>c</table>", "wide  x\na  b  c"),
    ],
)
def test_sheets_and_layout(page, text):
    assert html_text.render(page) == text


def test_long_sheets():
    rules = "".join(f".c{i}{{display:none}}" for i in range(20_000))
    page = f"<style>{rules}</style>" + "".join(f"<p class=c{i}>a</p><p class=d>b</p>" for i in range(0, 20_000, 10))
    assert html_text.render(page) == "\n\n".join(["b"] * 2_000)
    assert html_text.render("<style>" + "/*" * 50_000 + "</style>a") == "a"
    assert html_text.render("<style>.x{display:none" + " " * 100_000 + "x}</style><p class=x>a") == "a"

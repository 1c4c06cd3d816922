"""Visible text of web pages, laid out as a reader sees it.

A page becomes a tree (implied tags opened and closed, raw-text elements kept whole), invisible subtrees are left out, and the
rest is rendered: blocks on lines of their own, a blank line around paragraphs, headings, lists and tables, list items with
marks and indents, table cells padded to columns over all rows they span, preformatted text as it is.

Not shown: elements with ``hidden``, ``display: none`` or ``visibility: hidden`` in their own style or by a rule of a ``<style>``
element with a plain selector (tag, class, id), what a closed ``<details>`` holds below its summary, and the contents of form controls
(``<option>``, ``<textarea>``), which are values and no text. ``visibility: visible`` shows an element inside a hidden one.

A page is read in time linear in its length, whatever stays unclosed in it.
"""

from __future__ import annotations

import html
import re
import textwrap
from bisect import bisect_left
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrays

# Fixed values of HTML: which elements have no content, end others, stand as blocks or are never shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
UNSEEN = frozenset("script style template noscript head title meta link iframe noembed noframes datalist object "
                   "audio video canvas select textarea param source track".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset".split())
BLOCK = SPACED | frozenset("html body div section article aside header footer nav main address form li dt dd tr td th hr "
                           "caption thead tbody tfoot figcaption details summary center legend dir menu hgroup".split())
ENDS_P = BLOCK - frozenset("html body td th tr thead tbody tfoot caption li dt dd figcaption legend summary".split())
#: What an opening tag ends, and the elements such an end doesn't reach beyond.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "dir", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
SCOPE = frozenset("table td th caption button object html template".split())
#: In drawings and formulas: what is not shown there.
FOREIGN = frozenset("desc metadata defs symbol clippath mask pattern marker annotation annotation-xml".split())
WIDEST = 80  # longer lines of table cells are broken at blanks; a word that is longer still sticks out

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</?[A-Za-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^<]+|<", re.S)
OPENED = re.compile(r"</?[A-Za-z]")
MARKS = re.compile("[>\"']")
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}
GONE = re.compile(r"display\s*:\s*none", re.I)
UNLIT = re.compile(r"visibility\s*:\s*(?:hidden|collapse)", re.I)
LIT = re.compile(r"visibility\s*:\s*visible", re.I)
RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
SELECTOR = re.compile(r"([a-z][a-z0-9]*)?(?:([.#])([\w-]+))?", re.I)
BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


class Closings:
    """Where a tag ends: the first ``>`` outside quotes after it begins. Worked out once from the end of the page, for every ``>``
    and quote mark, outside and inside quotes of both kinds."""

    def __init__(self, page: str) -> None:
        self.at = [m.start() for m in MARKS.finditer(page)]
        self.out = [-1] * (len(self.at) + 1)
        double = single = -1
        for i in range(len(self.at) - 1, -1, -1):
            mark = page[self.at[i]]
            plain = self.at[i] if mark == ">" else double if mark == '"' else single
            double, single = (self.out[i + 1] if mark == '"' else double), (self.out[i + 1] if mark == "'" else single)
            self.out[i] = plain

    def of(self, start: int) -> int:
        """Place after the end of the tag whose marks begin at ``start``; 0 if it never ends."""
        return self.out[bisect_left(self.at, start)] + 1


def _tokens(page: str) -> Iterator[tuple[str, int]]:
    """Tokens and where each ends; ``send`` goes on elsewhere."""
    at, closings = 0, None
    while at < len(page):
        opened = OPENED.match(page, at) if closings else None
        if opened:
            end = closings.of(opened.end()) or at + 1
            token = page[at:end]
        else:
            m = TOKEN.match(page, at)
            token, end = m[0], m.end()
            if token == "<" and OPENED.match(page, at):
                closings = Closings(page)  # a tag that never ends: from here on ends are looked up
        moved = yield token, end
        at = end if moved is None else moved


def parse(page: str) -> Node:
    root = Node("html", {})
    stack = [root]
    places: dict[str, list[int]] = {}  # where a tag is open above the root, so that no open element is looked at twice
    tokens, moved = _tokens(page), None

    def push(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def cut(i: int) -> None:
        for node in stack[i:]:
            places[node.tag].pop()
        del stack[i:]

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def end(tags: set, fence: set) -> None:
        while tags and (i := last(tags)) > last(fence):
            cut(i)
            tags = tags & {"td", "th", "tr", "tbody", "thead", "tfoot"} if stack[-1].tag in tags else set()

    while True:
        try:
            token, at = tokens.send(moved)
        except StopIteration:
            return root
        moved = None
        if token[0] != "<" or token == "<":
            stack[-1].children.append(html.unescape(token))
            continue
        named = NAME.match(token)
        if not named:
            continue
        tag = named[1].lower()
        if token[1] == "/":
            i = last((tag,))
            if tag == "p" and not i:
                stack[-1].children.append(Node("p", {}))
            elif i and (tag in BLOCK or i >= last(SCOPE)):
                cut(i)
            continue
        attributes = _attributes(token[named.end():-1])
        if tag in ("html", "body"):
            root.attributes.update({k: v for k, v in attributes.items() if k not in root.attributes})
            if tag == "body":
                end({"head"}, set())
            continue
        if tag in ENDS_P or tag in IMPLIED:
            end({"p"}, SCOPE | ({"ul", "ol", "dl"} if tag not in IMPLIED else set()))
        if tag in IMPLIED:
            end(*IMPLIED[tag])
            if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                row = Node("tr", {})
                stack[-1].children.append(row)
                push(row)
        elif stack[-1].tag == "head" and tag not in UNSEEN and tag != "base":
            cut(len(stack) - 1)
        foreign = tag in ("svg", "math") or places.get("svg") or places.get("math")
        if foreign and tag in FOREIGN:
            attributes["hidden"] = ""
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if foreign and token.endswith("/>"):
            continue
        if tag in RAW_END and tag != "plaintext":
            stop = RAW_END[tag].search(page, at)
            node.children.append(page[at:stop.start() if stop else len(page)])
            moved = stop.end() if stop else len(page)
        elif tag not in VOID and not (token.endswith("/>") and tag in ("path", "circle", "rect")):
            push(node)


def visible(node: Node) -> bool:
    a = node.attributes
    return not (node.tag in UNSEEN or "hidden" in a or (node.tag == "input") or
                (node.tag == "dialog" and "open" not in a) or ("style" in a and GONE.search(a["style"])))


def _rules(root: Node) -> dict[tuple[str, str, str], str]:
    """(tag, mark, name) of plain selectors → what their rules say, from all style elements."""
    found: dict[tuple[str, str, str], str] = {}
    waiting = [root]
    while waiting:
        node = waiting.pop()
        if node.tag == "style":
            for selectors, body in RULE.findall("".join(x for x in node.children if isinstance(x, str))):
                if GONE.search(body) or UNLIT.search(body):
                    for one in selectors.split(","):
                        m = SELECTOR.fullmatch(one.strip())
                        if m and m[0]:
                            key = ((m[1] or "").lower(), m[2] or "", m[3] or "")
                            found[key] = found.get(key, "") + ";" + body
        waiting += [x for x in node.children if not isinstance(x, str)]
    return found


def _styles(node: Node, rules: dict[tuple[str, str, str], str]) -> str:
    """The rules that hold for an element, then its own style."""
    a = node.attributes
    names = [("", ""), *[(".", c) for c in a.get("class", "").split()], *([("#", a["id"])] if "id" in a else [])]
    said = [rules[t, mark, name] for t in ("", node.tag) for mark, name in names if (t, mark, name) in rules] if rules else []
    return ";".join([*said, a.get("style", "")])


def settle(root: Node) -> Node:
    """Apply what hides and shows elements, so that ``visible`` can tell from each element alone: an unlit element keeps only
    those inside it that are lit again, a closed ``details`` only its summary."""
    rules = _rules(root)
    waiting = [(root, True)]
    while waiting:
        node, lit = waiting.pop()
        children: list = []
        inner = list(node.children)
        if node.tag == "details" and "open" not in node.attributes:
            inner = [x for x in inner if not isinstance(x, str) and x.tag == "summary"][:1]
        for x in inner:
            if isinstance(x, str):
                if lit:
                    children.append(x)
                continue
            said = _styles(x, rules)
            if GONE.search(said):
                continue
            own = False if UNLIT.search(said) else True if LIT.search(said) else lit
            waiting.append((x, own))
            children.append(x)
        node.children = children
    return root


class _Page:
    """Lines under way: ``words`` are the parts of the open line, ``gap`` blank lines are due before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.words: list[str] = []
        self.gap, self.space = 0, False

    def text(self, text: str, kept: bool) -> None:
        if kept:
            first, *more = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self.put(first)
            for x in more:
                self.lines.append("".join(self.words))
                self.words = [x] if x else []
            return
        for i, word in enumerate(BLANKS.split(text)):
            self.space |= i > 0
            if word:
                self.put((" " if self.space and self.words and not self.words[-1].endswith(" ") else "") + word)
                self.space = False

    def put(self, text: str) -> None:
        if not text:
            return
        if self.gap and not self.words:
            if self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
        self.words.append(text)

    def turn(self) -> None:
        """End the line, an empty one too."""
        self.lines.append("".join(self.words).rstrip())
        self.words, self.space = [], False

    def stop(self, gap: int = 1) -> None:
        """End the line; ``gap`` 2 leaves a blank line before what follows."""
        if self.words:
            self.turn()
        self.space = False
        self.gap = max(self.gap, gap)

    def block(self, lines: list[str]) -> None:
        for x in lines:
            if self.gap and self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
            self.lines.append(x)

    def done(self) -> list[str]:
        self.stop()
        lines = self.lines
        while lines and not lines[0].strip():
            lines = lines[1:]
        while lines and not lines[-1].strip():
            lines = lines[:-1]
        return lines


Steps = Generator["Steps", list[str] | None, list[str] | None]


def _run(steps: Steps) -> list[str]:
    """What ``steps`` return; each yields the steps whose result it waits for, so depth costs no recursion."""
    waiting, value = [steps], None
    while waiting:
        try:
            waiting.append(waiting[-1].send(value))
            value = None
        except StopIteration as e:
            waiting.pop()
            value = e.value
    return value


def _lines(node: Node, kept: bool = False) -> Steps:
    page = _Page()
    yield _inside(node, page, kept)
    return page.done()


def _inside(node: Node, page: _Page, kept: bool) -> Steps:
    for x in node.children:
        if isinstance(x, str):
            page.text(x, kept)
        elif not visible(x):
            continue
        elif x.tag == "br":
            page.turn()
        elif x.tag == "hr":
            page.stop()
        elif x.tag == "table":
            page.stop(2)
            page.block((yield _table(x)))
            page.stop(2)
        elif x.tag in ("ul", "ol", "menu", "dir"):
            gap = 1 if node.tag == "li" else 2
            page.stop(gap)
            page.block((yield _list(x)))
            page.stop(gap)
        elif x.tag == "li":
            page.stop()
            page.block((yield _item("- ", x)))
            page.stop()
        elif x.tag == "dd":
            page.stop()
            page.block(["    " + s if s else s for s in (yield _lines(x))])
            page.stop()
        elif x.tag in BLOCK:
            gap = 2 if x.tag in SPACED else 1
            page.stop(gap)
            yield _inside(x, page, kept or x.tag == "pre")
            page.stop(gap)
        elif x.tag == "q":
            page.put('"')
            yield _inside(x, page, kept)
            page.put('"')
        else:
            yield _inside(x, page, kept)


def _item(mark: str, node: Node) -> Steps:
    lines = yield _lines(node)
    return [(mark if i == 0 else " " * len(mark)) + s if s else s for i, s in enumerate(lines)]


def _list(node: Node) -> Steps:
    out: list[str] = []
    start = node.attributes.get("start", "1")
    number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    for x in node.children:
        if isinstance(x, str):
            if x.strip():
                out.append(BLANKS.sub(" ", x.strip()))
        elif visible(x):
            if x.tag == "li":
                value = x.attributes.get("value", "")
                number = int(value) if re.fullmatch(r"-?\d{1,9}", value) else number
                out += yield _item(f"{number}. " if node.tag == "ol" else "- ", x)
                number += 1
            else:
                out += ["  " + s if s else s for s in (yield _lines(_wrap(x)))]
    return out


def _wrap(node: Node) -> Node:
    outer = Node("div", {})
    outer.children.append(node)
    return outer


def _span(node: Node, name: str) -> int:
    span = node.attributes.get(name, "1")
    return max(1, min(int(span), 1000)) if span.isascii() and span.isdigit() else 1


def _wrapped(lines: list[str]) -> list[str]:
    out: list[str] = []
    for x in lines:
        out += [x] if len(x) <= WIDEST else textwrap.wrap(
            x, WIDEST, break_long_words=False, break_on_hyphens=False, expand_tabs=False, replace_whitespace=False) or [x]
    return out


def _table(node: Node) -> Steps:
    above: list[str] = []
    rows: list[list[tuple[list[str], int, int]]] = []  # cells: lines, columns and rows they span

    def walk(n: Node) -> Steps:
        for x in n.children:
            if isinstance(x, str):
                if x.strip():
                    above.append(BLANKS.sub(" ", x.strip()))
            elif not visible(x) or x.tag in ("col", "colgroup"):
                continue
            elif x.tag in ("tbody", "thead", "tfoot"):
                yield walk(x)
            elif x.tag == "tr":
                cells = []
                for c in x.children:
                    if isinstance(c, str):
                        if c.strip():
                            cells.append(([BLANKS.sub(" ", c.strip())], 1, 1))
                    elif visible(c):
                        inner = yield _lines(c if c.tag in ("td", "th") else _wrap(c))
                        cells.append((_wrapped(inner), _span(c, "colspan"), _span(c, "rowspan")))
                if cells:
                    rows.append(cells)
            else:
                above.extend((yield _lines(_wrap(x))))

    yield walk(node)
    # Each cell's first column: columns that a cell from above still holds are passed over.
    placed: list[list[tuple[int, list[str], int]]] = []
    taken: dict[int, int] = {}  # column → rows for which a cell above holds it
    width: dict[int, int] = {}
    for cells in rows:
        line, at, held = [], 0, dict(taken)
        for lines, span, deep in cells:
            while held.get(at, 0):
                at += 1
            line.append((at, lines, span))
            if span == 1:
                width[at] = max(width.get(at, 0), min(WIDEST, max(map(len, lines), default=0)))
            if deep > 1:
                for k in range(at, at + span):
                    taken[k] = max(taken.get(k, 0), deep)
            at += span
        taken = {k: n - 1 for k, n in taken.items() if n > 1}
        placed.append(line)
    # A cell over several columns that needs more room than they have widens the last one.
    for line in placed:
        for at, lines, span in line:
            if span > 1:
                room = sum(width.get(k, 0) for k in range(at, at + span)) + 2 * (span - 1)
                more = min(WIDEST, max(map(len, lines), default=0)) - room
                if more > 0:
                    width[at + span - 1] = width.get(at + span - 1, 0) + more
    columns = max((at + span for line in placed for at, _, span in line), default=0)
    start = [0]
    for k in range(columns):
        start.append(start[-1] + width.get(k, 0) + 2)
    out = list(above)
    for line in placed:
        for i in range(max(1, max(len(lines) for _, lines, _ in line))):
            text = ""
            for at, lines, _ in line:
                if i < len(lines) and lines[i]:
                    gap = start[at] - len(text)
                    text += " " * (gap if gap > 0 else 2 if text else 0) + lines[i]
            out.append(text.rstrip())
    return out


def extract(page: str | None) -> str:
    """The visible text of a page; of NULL or an empty page the empty text."""
    return "\n".join(_run(_lines(settle(parse(page))))) if page else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(page) for (page,) in arrays(batch, "html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("page_id")), batch.column(batch.schema.get_field_index("url")),
             pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages; NULLs stay NULL, a NULL page has an empty text, an empty table an
    empty result. Rows are independent of each other; only the three named columns are read."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long")

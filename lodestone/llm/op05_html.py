"""HTML to text as it is laid out.

A tree builder reads the tags in one pass and keeps the stack of open elements: end tags that HTML lets
authors leave out are implied (p before a block, li, dt, dd, option, tr, td, thead, head, ...), an end tag
closes its element only within its table cell, and misnested inline elements don't close the blocks
in them. Its events, which nest, go to a renderer:

* visibility: script, style, template, noscript, iframe and the rest of HIDDEN_TAGS, the whole head, elements with `hidden` or
  display:none, visibility:hidden until a visible descendant (inline or by a style sheet's rules for a tag, class or id; later rules win, at-rules
  and selectors of several elements don't count), a closed dialog, and a closed details but for its
  summary show nothing; everything else is emitted;
* block spacing: blocks stand on their own lines, those with margins (p, headings, lists, tables, ...) apart by a blank line;
  br breaks the line; white space collapses but in pre, listing, xmp and textarea;
* lists: "- " or the number of the item (start, value), nested ones indented;
* tables: a row on a line, cells under one another between " | ", rowspan and colspan kept; a cell of several blocks or
  items has a line for each. A column is as wide as its widest cell of up to 40
  characters; wider cells stick out. A table of one column, which lays out a page, keeps its cells' blocks.

Nesting is held in lists, not in recursion, so depth is no limit. Defined results: null stays null; empty html and html without visible text give "";
a "<" that begins no tag is text; what isn't closed ends with the page; each input row gives one row; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import arrays as A
from lodestone.llm.names import col

WIDEST, SPAN = 40, 1000
RAW_TAGS = frozenset("script style template noscript iframe noembed noframes textarea title xmp".split())
HIDDEN_TAGS = frozenset("script style template noscript iframe noembed noframes title datalist rp object audio video canvas svg math head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = frozenset("title meta link script style base noscript template".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table blockquote pre listing xmp figure fieldset hr".split())
BLOCK = MARGIN | frozenset("address article aside body caption center details dialog dd div dt figcaption footer form header hgroup html legend li main nav optgroup option search section summary textarea tr thead tbody tfoot".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre listing search section summary table ul xmp li dd dt".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset(("td", "th"))
SECTIONS = frozenset(("thead", "tbody", "tfoot"))
WALL = frozenset("table td th caption html template button object".split())
LISTS = frozenset("ul ol menu dir".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+)|=)*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*([\w-]+)", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
_AT_RULE = re.compile(r"@[^{;]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*(?:\}|$))")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)$")
_SEEN = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW_TAGS}
_WANTED = re.compile(r"hidden|style|open|span|start|value", re.I)


def style_rules(sheet: str) -> list[tuple[str, frozenset[str], str | None, str | None]]:
    """Of every rule of plain selectors (a tag, classes and an id, or some of them): tag, the classes and id as written, and the display and visibility it sets."""
    out = []
    for selectors, body in _RULE.findall(_AT_RULE.sub("", _COMMENT.sub("", sheet))):
        shown, seen = _DISPLAY.findall(body), _SEEN.findall(body)
        if shown or seen:
            for one in selectors.split(","):
                if (m := _SELECTOR.match(one.strip())) and m[0]:
                    out.append(((m[1] or "*").lower(), frozenset(re.findall(r"[.#][\w-]+", m[2])), shown[-1].lower() if shown else None, seen[-1].lower() if seen else None))
    return out


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(raw):
        out.setdefault(name.lower(), _html.unescape(a or b or c))
    return out


def _number(text: str | None, default: int) -> int:
    try:
        return int((text or "").strip())
    except ValueError:
        return default


class _Lines:
    """Lines of the page or of a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank, self.spaced = False, True
        self.indents, self.marker = [""], ""

    def text(self, t: str, pre: bool) -> None:
        if pre:
            first, *rest = t.replace("\r\n", "\n").split("\n")
            self._add(first)
            for more in rest:
                if self.line:
                    self.end()
                else:
                    self.lines.append("")
                self._add(more)
            return
        t = _SPACE.sub(" ", t)
        if self.spaced and t[:1] == " ":
            t = t[1:]
        if t:
            self._add(t)
            self.spaced = t[-1] == " "

    def _add(self, t: str) -> None:
        if not t:
            return
        if not self.line:
            if self.blank and self.lines and self.lines[-1]:
                self.lines.append("")
            self.blank = False
            self.line.append(self.marker or self.indents[-1])
            self.marker = ""
        self.line.append(t)
        self.spaced = False

    def end(self, margin: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.blank |= margin
        self.spaced = True

    def done(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1].strip():
            self.lines.pop()
        while self.lines and not self.lines[0].strip():
            self.lines.pop(0)
        return self.lines


class _Table:
    def __init__(self) -> None:
        self.rows: list[dict[int, list[str]]] = []
        self.taken: dict[int, int] = {}
        self.column = 0

    def row(self) -> None:
        self.rows.append({})
        self.taken = {c: n - 1 for c, n in self.taken.items() if n > 1}
        self.column = 0

    def cell(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.row()
        while self.column in self.taken:
            self.column += 1
        self.rows[-1][self.column] = lines
        for c in range(self.column, self.column + across):
            if down > 1:
                self.taken[c] = down
        self.column += across

    def into(self, out: _Lines) -> None:
        rows = [r for r in self.rows if any(r.values())]
        columns = sorted({c for r in rows for c, lines in r.items()})
        if len(columns) <= 1:
            for r in rows:
                for lines in r.values():
                    for line in lines:
                        out._add(line)
                        out.end(margin=not line)
            return
        flat = [{c: [x.rstrip() for x in lines if x.strip()] for c, lines in r.items()} for r in rows]
        width = {c: max((len(x) for r in flat for x in r.get(c, ()) if len(x) <= WIDEST), default=0) for c in columns}
        for r in flat:
            for k in range(max(map(len, r.values()))):
                line = {c: lines[k] for c, lines in r.items() if k < len(lines)}
                out._add(" | ".join(line.get(c, "").ljust(width[c]) for c in columns if c <= max(line)))
                out.end()


class Renderer:
    """Takes the events of a tree in order."""

    def __init__(self) -> None:
        self.page = self.out = _Lines()
        self.open: list[list] = []  # name, shown, display none, extra
        self.tables: list[tuple[_Table, _Lines]] = []
        self.gone, self.shown, self.pre = 0, True, 0
        self.rules: list[tuple[str, frozenset[str], str | None, str | None]] = []

    def start(self, name: str, attr: dict[str, str]) -> None:
        none = name in HIDDEN_TAGS or "hidden" in attr or name == "dialog" and "open" not in attr
        shown = self.shown
        if self.rules:
            own = {f".{c}" for c in attr.get("class", "").split()} | {f"#{attr.get('id')}"}
            for tag, marks, display, visibility in self.rules:
                if tag in ("*", name) and marks <= own:
                    none = name in HIDDEN_TAGS or display == "none" if display else none
                    shown = visibility == "visible" if visibility else shown
        if style := attr.get("style"):
            if display := _DISPLAY.findall(style):
                none = name in HIDDEN_TAGS or display[-1].lower() == "none"
            if seen := _SEEN.findall(style):
                shown = seen[-1].lower() == "visible"
        parent = self.open[-1] if self.open else None
        if parent and parent[0] == "details" and parent[3] == "closed" and name != "summary":
            none = True
        entry = [name, self.shown, none, None]
        self.open.append(entry)
        self.shown = shown
        self.gone += none
        if name == "details" and "open" not in attr:
            entry[3] = "closed"
        if name in ("pre", "listing", "xmp", "textarea"):
            self.pre += 1
        if self.gone:
            return
        if name in BLOCK:
            self.out.end(name in MARGIN and not (name in LISTS and self._in_list()))
        if name in ("ol", "ul", "menu", "dir"):
            entry[3] = [name == "ol", _number(attr.get("start"), 1)]
        elif name == "li":
            lst = next((e for e in reversed(self.open[:-1]) if e[0] in LISTS), None)
            mark = "- "
            if lst and lst[3] and lst[3][0]:
                n = _number(attr.get("value"), lst[3][1])
                lst[3][1] = n + 1
                mark = f"{n}. "
            at = self.out.indents[-1]
            self.out.marker = at + mark
            self.out.indents.append(at + " " * len(mark))
            entry[3] = self.out
        elif name == "dd":
            self.out.indents.append(self.out.indents[-1] + "  ")
            entry[3] = self.out
        elif name == "table":
            self.tables.append((_Table(), self.out))
            entry[3] = self.tables[-1]
        elif name == "tr" and self.tables:
            self.tables[-1][0].row()
        elif name in CELLS and self.tables:
            entry[3] = (self.out, _number(attr.get("colspan"), 1), _number(attr.get("rowspan"), 1), self.tables[-1][0])
            self.out = _Lines()

    def _in_list(self) -> bool:
        return any(e[0] == "li" for e in self.open[-3:])

    def end(self) -> None:
        name, shown, none, extra = self.open.pop()
        hidden = self.gone > 0
        self.gone -= none
        self.shown = shown
        if name in ("pre", "listing", "xmp", "textarea"):
            self.pre -= 1
        if hidden:
            return
        if name in ("li", "dd") and extra is not None:
            extra.end()
            extra.indents.pop()
            extra.marker = ""
        elif name == "table" and extra is not None:
            self.tables.pop()
            self.out = extra[1]
            self.out.end(True)
            extra[0].into(self.out)
        elif name in CELLS and extra is not None:
            lines = self.out.done()
            self.out = extra[0]
            extra[3].cell(lines, min(max(extra[1], 1), SPAN), min(max(extra[2], 1), SPAN))
        if name in BLOCK:
            self.out.end(name in MARGIN and not (name in LISTS and self._in_list()))

    def text(self, t: str) -> None:
        if self.gone or not self.shown or not t:
            return
        if self.open and self.open[-1][0] == "details" and self.open[-1][3] == "closed":
            return
        out = self.out
        if self.tables and self.open[-1][0] in ("table", "tr", "thead", "tbody", "tfoot", "caption"):
            if not t.strip():
                return
            out = self.tables[-1][1]  # text between cells stands before its table
        out.text(t.replace("\xa0", " ") if "\xa0" in t else t, self.pre > 0)

    def newline(self) -> None:
        if not self.gone and self.shown:
            if self.out.line:
                self.out.end()
            elif self.out.lines and self.out.lines[-1]:
                self.out.lines.append("")


class Builder:
    """Feeds a renderer with the start tags, end tags and texts that the page implies."""

    def __init__(self) -> None:
        self.stack: list[str] = []
        self.count: Counter[str] = Counter()  # of open elements by name, so that what isn't open isn't looked for
        self.to = Renderer()

    def _pop_to(self, i: int) -> None:
        for _ in range(len(self.stack) - i):
            self.count[self.stack.pop()] -= 1
            self.to.end()

    def _close(self, names: frozenset[str] | tuple[str, ...], wall: frozenset[str]) -> bool:
        """Closes the innermost of the names, and all in it, unless a wall is met before."""
        if not any(self.count[n] for n in names):
            return False
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i] in names:
                self._pop_to(i)
                return True
            if self.stack[i] in wall:
                return False
        return False

    def start(self, name: str, raw: str) -> None:
        if name == "image":
            name = "img"
        if self.stack and self.stack[-1] == "head" and name not in IN_HEAD:
            self._pop_to(len(self.stack) - 1)
        if name == "br":
            self.to.newline()
            return
        if name in CLOSES_P:
            self._close(("p",), WALL)
        if name in HEADINGS and self.stack and self.stack[-1] in HEADINGS:
            self._pop_to(len(self.stack) - 1)
        elif name == "li":
            self._close(("li",), WALL | LISTS)
        elif name in ("dd", "dt"):
            self._close(("dd", "dt"), WALL | {"dl"})
        elif name in ("option", "optgroup"):
            self._close(("option", "optgroup") if name == "optgroup" else ("option",), WALL | {"select"})
        elif name in CELLS:
            self._close(CELLS, frozenset(("table",)))
            if self.count["table"] and not self._inside("tr"):
                self._open("tr", {})
        elif name == "tr":
            self._close(("tr", "caption"), frozenset(("table",)))
        elif name in SECTIONS:
            self._close(SECTIONS | {"caption"}, frozenset(("table",)))
            self._close(("tr",), frozenset(("table",)))
        if name in VOID:
            if name == "hr":
                self.to.start(name, {})
                self.to.end()
            return
        self._open(name, attributes(raw) if raw and (self.to.rules or _WANTED.search(raw)) else {})

    def _inside(self, name: str) -> bool:
        for n in reversed(self.stack):
            if n == name:
                return True
            if n == "table":
                return False
        return False

    def _open(self, name: str, attr: dict[str, str]) -> None:
        self.stack.append(name)
        self.count[name] += 1
        self.to.start(name, attr)

    def end(self, name: str) -> None:
        if name == "br":
            self.to.newline()
        elif name == "p":
            if not self._close(("p",), WALL):
                self.to.start("p", {})
                self.to.end()
        elif name in HEADINGS:
            self._close(HEADINGS, WALL)
        elif name in ("table", "tr", "td", "th", "thead", "tbody", "tfoot"):
            self._close((name,), frozenset(("table",)) if name != "table" else frozenset())
        elif name in BLOCK or name in WALL:
            self._close((name,), WALL - {name})
        elif self.count[name]:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i] == name:
                    # a hidden inline element ends with all that is in it; others leave the blocks they straddle open
                    if self.to.open[i][2] or not any(n in BLOCK for n in self.stack[i + 1 :]):
                        self._pop_to(i)
                    else:
                        self.count[name] -= 1
                        self.stack[i] = self.to.open[i][0] = ""
                    return
                if self.stack[i] in WALL:
                    return

    def text(self, raw: str) -> None:
        if self.stack and self.stack[-1] == "head" and raw.strip():
            self._pop_to(len(self.stack) - 1)
        self.to.text(_html.unescape(raw) if "&" in raw else raw)

    def feed(self, page: str) -> str:
        at, n, loose, last = 0, len(page), 0, page.rfind(">")
        while at < n:
            i = page.find("<", at)
            if i < 0 or i > last:
                self.text(page[at:])
                break
            mark = page[i + 1 : i + 2]
            if mark == "!" or mark == "?":
                if i > at:
                    self.text(page[at:i])
                if page.startswith("<!--", i):
                    j = page.find("-->", i + 2)
                    k = page.find("--!>", i + 4, n if j < 0 else j)
                    at = k + 4 if k >= 0 else n if j < 0 else j + 3
                elif page.startswith("<![CDATA[", i) and (j := page.find("]]>", i)) >= 0:
                    at = j + 3
                else:
                    at = page.find(">", i) + 1
                continue
            m = _TAG.match(page, i) if loose < 50 else None
            if m is None and (m := _LOOSE.match(page, i)):
                loose += 1  # a tag that quotes carry to the end of the page; after many, no longer looked for
            if m is None:
                j = page.find("<", i + 1)
                j = n if j < 0 else j
                if page.startswith("</", i) and mark == "/" and (k := page.find(">", i)) >= 0 and not page[i + 2 : i + 3].isalpha():
                    if i > at:
                        self.text(page[at:i])
                    at = k + 1
                else:
                    self.text(page[at:j])
                    at = j
                continue
            if i > at:
                self.text(page[at:i])
            at = m.end()
            name = m[2].lower()
            if m[1]:
                self.end(name)
                continue
            self.start(name, m[3])
            if name in RAW_TAGS:
                found = _END[name].search(page, at)
                stop, after = (found.start(), found.end()) if found else (n, n)
                if name == "style" and attributes(m[3]).get("media", "all").lower() in ("", "all", "screen"):
                    self.to.rules += style_rules(page[at:stop])
                if name in ("textarea", "xmp"):
                    self.to.text((_html.unescape(page[at:stop]) if name == "textarea" else page[at:stop]).removeprefix("\n"))
                if self.stack and self.stack[-1] == name:
                    self._pop_to(len(self.stack) - 1)
                at = after
            elif name in ("pre", "listing") and page.startswith("\n", at):
                at += 1
        self._pop_to(0)
        return "\n".join(self.to.page.done())


def render(page: str | None) -> str | None:
    return None if page is None else Builder().feed(page)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns of `keep`, then text: what each page shows."""
    keep = tuple(c for c in keep if c != "text")
    rows = pages.select(col(html_col).cast("string").alias("html"), *(col(c).alias(f"k{k}") for k, c in enumerate(keep)))

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        text = pa.array([render(p) for p in b.column(0).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*b.columns[1:], text], [*(f"k{k}" for k in range(len(keep))), "text"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:]]
    out = A.map_batches(rows, run, ", ".join([*kinds, "text string"]))
    return out.select(*(F.col(f"k{k}").alias(c) for k, c in enumerate(keep)), "text")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op5_html_extraction": op5_html_extraction}
ORACLE: dict[str, str] = {}

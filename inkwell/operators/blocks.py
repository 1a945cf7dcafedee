"""Blocks: a DataFrame of documents to a DataFrame of block tokens.

Line ends and NULs are handled before, as expressions. What depends on all the
lines before (which containers are open) is a fold over a document's lines,
done next to the data in Arrow batches; its result is an array of tokens per document, and everything after
(levels, tree, relations, rendering) works on these.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.links import label_key, normalize_link, unescape, valid_link
from ..functions.text import normalize
from ..plans.config import Syntax

TOKEN = (
    "pos int, type string, tag string, nesting int, attrs array<struct<key:string,value:string>>, line_begin int, line_end int, "
    "content string, markup string, info string, hidden boolean, meta map<string,string>"
)
#: Reference definitions travel as rows of this type until they are split off.
DEFINITION = "reference_definition"

# Fixed values of the CommonMark specification: the names of HTML blocks of kind 6, the grammar of tags, how HTML blocks begin and end.
HTML_BLOCK_NAMES = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 "
    "head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
).split()
_ATTR = r"(?:\s+[a-zA-Z_:][a-zA-Z0-9:._-]*(?:\s*=\s*(?:[^\"'=<>`\x00-\x20]+|'[^']*'|\"[^\"]*\"))?)"
OPEN_TAG, CLOSE_TAG = rf"<[A-Za-z][A-Za-z0-9-]*{_ATTR}*\s*/?>", r"</[A-Za-z][A-Za-z0-9-]*\s*>"
_HTML_KINDS = [
    (re.compile(r"<(script|pre|style|textarea)(?=\s|>|$)", re.I), re.compile(r"</(script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?({'|'.join(HTML_BLOCK_NAMES)})(?=\s|/?>|$)", re.I), None),
    (re.compile(rf"(?:{OPEN_TAG}|{CLOSE_TAG})\s*$"), None),
]
_ITEM = re.compile(r"([-+*])(?=[ \t]|$)|(\d{1,9})([.)])(?=[ \t]|$)")
_HR = re.compile(r"([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
_HEADING = re.compile(r"(#{1,6})(?:[ \t]+(.*))?$")
_ALERT = re.compile(r"\[!(note|tip|important|warning|caution)\][ \t]*$", re.I)
_TASK = re.compile(r"\[([ xX])\](?=[ \t])")


_BLANKS = re.compile(r"[ \t]*")


class _Line:
    """What is left of a line: text from ``at`` on, with the column that it stands in; ``pad`` columns of a tab cut in two."""

    __slots__ = ("at", "col", "pad", "text")

    def __init__(self, text: str):
        self.text, self.at, self.col, self.pad = text, 0, 0, 0

    def indent(self) -> int:
        end = _BLANKS.match(self.text, self.at).end()
        if self.text.find("\t", self.at, end) < 0:
            return self.pad + end - self.at
        width, col = self.pad, self.col + self.pad
        for c in self.text[self.at : end]:
            step = 4 - col % 4 if c == "\t" else 1
            width, col = width + step, col + step
        return width

    def skip(self, columns: int) -> None:
        """Drop up to so many columns of white space."""
        if not self.pad and self.text.startswith(" " * columns, self.at):
            self.at, self.col, columns = self.at + columns, self.col + columns, 0
        while columns > 0:
            if self.pad:
                used = min(columns, self.pad)
                self.pad, self.col, columns = self.pad - used, self.col + used, columns - used
            elif self.text[self.at : self.at + 1] == " ":
                self.at, self.col, columns = self.at + 1, self.col + 1, columns - 1
            elif self.text[self.at : self.at + 1] == "\t":
                self.at, self.pad = self.at + 1, 4 - self.col % 4
            else:
                break

    def take(self, chars: int) -> None:
        self.at, self.col = self.at + chars, self.col + chars

    def rest(self) -> str:
        return " " * self.pad + self.text[self.at :]

    def bare(self) -> str:
        return self.text[_BLANKS.match(self.text, self.at).end() :]


class _Block:
    __slots__ = ("begin", "children", "data", "end", "kind", "lines", "loose", "open")

    def __init__(self, kind: str, begin: int, **data):
        self.kind, self.begin, self.end, self.data = kind, begin, begin + 1, data
        self.children, self.lines, self.open, self.loose = [], [], True, False


def _cells(row: str) -> list[str]:
    found = re.split(r"(?<!\\)\|", row.strip())
    if found and not found[0].strip():
        found = found[1:]
    if found and not found[-1].strip():
        found = found[:-1]
    return [c.replace("\\|", "|").strip() for c in found]


def _alignments(row: str) -> list[str] | None:
    row = row.strip()
    if len(row) < 2 or not re.fullmatch(r"[-:|][-:|][-:| \t]*|[:|][ \t][-:| \t]*", row) or "-" not in row:
        return None
    cells = _cells(row)
    if not cells or not all(re.fullmatch(r":?-+:?", c) for c in cells):
        return None
    return [("center" if c[-1] == ":" else "left") if c[0] == ":" else ("right" if c[-1] == ":" else "") for c in cells]


def fold(text: str, syntax: Syntax) -> _Block:
    """The block tree of a document, line by line: match open containers, try new blocks, continue a paragraph, or add text."""
    on = lambda rule: rule in syntax.rules["block"]
    options = syntax.options
    root = _Block("document", 0)
    chain = [root]  # open blocks, outermost first
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    tables = on("table")
    for number, raw in enumerate(lines):
        if raw[:1].isalpha() and len(chain) < 3 and chain[-1].kind in ("document", "paragraph") and not (tables and "|" in raw):  # no rule but the paragraph's begins with a letter
            if len(chain) == 1:
                chain.append(_Block("paragraph", number))
                root.children.append(chain[1])
            chain[1].lines.append(raw)
            root.end = chain[1].end = number + 1
            continue
        line, depth = _Line(raw), 1
        deep = 3 if on("code") else 10**9  # more columns are code
        while depth < len(chain):  # which of the open blocks go on?
            block, indent = chain[depth], line.indent()
            blank = not line.bare()
            if block.kind == "blockquote":
                if indent > deep or line.bare()[:1] != ">":
                    break
                line.skip(indent)
                line.take(1)
                line.skip(1)
            elif block.kind == "item":
                if blank:
                    if not block.children:
                        break
                    line.skip(indent)
                elif indent >= block.data["indent"]:
                    line.skip(block.data["indent"])
                else:
                    break
            elif block.kind == "fence":
                close = line.bare()
                if indent <= deep and close[:1] == block.data["markup"][0] and re.fullmatch(rf"{re.escape(close[:1])}{{{len(block.data['markup'])},}}[ \t]*", close):
                    block.end, block.open = number + 1, False
                    depth = -1
                    break
                line.skip(min(indent, block.data["indent"]))
            elif block.kind == "code_block":
                if not blank and indent < 4:
                    break
                line.skip(4)
            elif block.kind == "html_block":
                if blank and block.data["ends"] is None:
                    break
            elif block.kind in ("paragraph", "table") and (blank or block.kind == "table" and indent > deep):
                break
            depth += 1
        if depth < 0:
            for b in chain[:-1]:
                b.end = number + 1
            chain.pop()
            continue
        matched, tip = chain[:depth], chain[-1]
        here = matched[-1]
        blank = not line.bare()
        if here.kind in ("fence", "code_block", "html_block"):
            here.lines.append(line.rest())
            if here.kind != "code_block" or not blank:
                for b in matched:
                    b.end = number + 1
            if here.kind == "html_block" and here.data["ends"] is not None and here.data["ends"].search(line.rest()):
                chain = matched[:-1]
            else:
                chain = matched
            continue
        if here.kind == "table" and here.data.pop("delimiter", False):  # read with the header
            for b in matched:
                b.end = number + 1
            chain = matched
            continue
        # New blocks.
        opened: list[_Block] = []
        lazy_possible = tip.kind == "paragraph" and len(matched) < len(chain) and not blank and _goes_on(tip, line.bare(), on("reference"), options)
        in_paragraph = here.kind == "paragraph"
        while not blank:
            indent, bare = line.indent(), line.bare()
            parent = opened[-1] if opened else next(b for b in reversed(matched) if b.kind in ("document", "blockquote", "item", "list"))
            interrupts = not opened and (in_paragraph or lazy_possible)
            table = here if here.kind == "table" and not opened else None
            nested = len(matched) + len(opened) >= options["maxNesting"]
            if tables and not table and not lazy_possible and indent <= deep and "|" in bare and number + 1 < len(lines) and (align := _delimiters(lines[number + 1], [*matched, *opened], deep)):
                header = _cells(bare)
                if len(header) == len(align):
                    opened.append(_Block("table", number, align=align, header=header, rows=[], padded=0, delimiter=True))
                    break
            if indent > deep:
                if not interrupts and not table:
                    if parent.kind == "list":
                        parent = None
                    block = _Block("code_block", number)
                    line.skip(4)
                    block.lines.append(line.rest())
                    opened.append(block)
                break
            if on("blockquote") and bare[0] == ">" and not nested:
                line.skip(indent)
                line.take(1)
                line.skip(1)
                opened.append(_Block("blockquote", number))
                blank = not line.bare()
                continue
            if on("heading") and (m := _HEADING.match(bare)):
                content = re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", m[2] or "").strip()
                opened.append(_Block("heading", number, level=len(m[1]), content=content, markup=m[1]))
                break
            if on("fence") and (m := _FENCE.match(bare)):
                opened.append(_Block("fence", number, markup=m[1] or m[3], info=(m[2] if m[1] else m[4]) or "", indent=indent))
                break
            if on("html_block") and options["html"] and bare[0] == "<":
                kind = next((k for k, (start, _) in enumerate(_HTML_KINDS) if start.match(bare)), None)
                if kind is not None and not (kind == 6 and interrupts):
                    ends = _HTML_KINDS[kind][1]
                    block = _Block("html_block", number, ends=ends)
                    block.lines.append(line.rest())
                    block.open = not (ends is not None and ends.search(bare))
                    opened.append(block)
                    break
            if on("lheading") and in_paragraph and not opened and len(matched) == len(chain) and (m := re.fullmatch(r"(=+|-+)[ \t]*", bare)):
                _definitions(here, on("reference"), options)
                if here.lines:
                    here.kind, here.end, here.open = "lheading", number + 1, False
                    here.data.update(level=1 if bare[0] == "=" else 2, markup=bare[0])
                    for b in matched:
                        b.end = number + 1
                    opened = None
                    break
            if on("hr") and (m := _HR.match(bare)):
                opened.append(_Block("hr", number, markup=m[1] * (bare.count(m[1]) + 1)))
                break
            if on("list") and (m := _ITEM.match(bare)) and not nested:
                after = bare[m.end() :]
                empty = not after.strip(" \t")
                current = next((b for b in reversed(matched) if b.kind == "list"), None) if not opened and here.kind == "list" else None
                if not (interrupts and not (lazy_possible and current) and (empty or (m[2] and int(m[2]) != 1))):
                    marker = m[1] or m[3]
                    line.skip(indent)
                    line.take(m.end())
                    inner = line.indent()
                    if empty or inner > 4:
                        inner = 1
                    line.skip(inner)
                    if current is None or current.data["marker"] != marker:
                        opened.append(_Block("list", number, marker=marker, start=int(m[2]) if m[2] else None))
                    opened.append(_Block("item", number, indent=indent + m.end() + inner, marker=marker, info=m[2] or ""))
                    blank = not line.bare()
                    continue
            break
        if opened is None:
            chain = matched[:-1]
            continue
        if opened:
            chain = matched
            while chain[-1].kind in ("paragraph", "table") or (chain[-1].kind == "list" and opened[0].kind != "item"):
                chain.pop()
            for block in opened:
                chain[-1].children.append(block)
                chain = [*chain, block]
            if not blank and opened[-1].kind in ("blockquote", "item"):
                block = _Block("paragraph", number)
                block.lines.append(line.bare())
                chain[-1].children.append(block)
                chain.append(block)
            for b in chain:
                b.end = number + 1
            if chain[-1].kind in ("heading", "hr") or not chain[-1].open:
                chain.pop()
            continue
        if blank:
            if matched[-1].kind in ("paragraph", "table"):
                matched.pop()
            chain = matched
            for b in chain:
                if b.kind == "blockquote":
                    b.end = number + 1
            continue
        if here.kind == "table":
            cells = _cells(line.bare())
            width = len(here.data["align"])
            here.data["padded"] += max(0, width - len(cells))
            if here.data["padded"] <= 65536:
                here.data["rows"].append((number, (cells + [""] * width)[:width]))
                for b in matched:
                    b.end = number + 1
                continue
            matched.pop()
            here = matched[-1]
        if in_paragraph or lazy_possible:
            tip.lines.append(line.bare())
            for b in chain:
                b.end = number + 1
            continue
        chain = matched
        while chain[-1].kind == "list":
            chain.pop()
        block = _Block("paragraph", number)
        block.lines.append(line.bare())
        chain[-1].children.append(block)
        chain.append(block)
        for b in chain:
            b.end = number + 1
    return root


def _delimiters(raw: str, containers: list[_Block], deep: int) -> list[str] | None:
    """The alignments of a table's second line, if ``raw`` is one within the containers of the first."""
    if not re.search(r"[-:|]", raw):
        return None
    line = _Line(raw)
    for block in containers:
        indent = line.indent()
        if block.kind == "blockquote":
            if indent > deep or line.bare()[:1] != ">":
                return None
            line.skip(indent)
            line.take(1)
            line.skip(1)
        elif block.kind == "item":
            if indent < block.data["indent"]:
                return None
            line.skip(block.data["indent"])
    return _alignments(line.bare()) if line.indent() <= deep else None


_LABEL = re.compile(r"\[((?:[^\\\[\]]|\\.)*+)(\]:)?", re.S)
_TITLE = re.compile(r"\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|\(((?:[^()\\]|\\.)*)\)", re.S)
_GAP, _TAIL = re.compile(r"[ \t]*\n?[ \t]*"), re.compile(r"[ \t]*(?=\n|$)")
_POINTED = re.compile(r"<((?:[^<>\\\n]|\\.)*)>")
_DEEPEST = 32


def destination(text: str, at: int) -> tuple[str, int] | None:
    """The raw destination of a link that begins at ``at``, and where it ends: in angle brackets, or without blanks and with round brackets in pairs."""
    if text[at : at + 1] == "<":
        return (m[1], m.end()) if (m := _POINTED.match(text, at)) else None
    depth, i, n = 0, at, len(text)
    while i < n:
        c = text[i]
        if c <= " " or c == "\x7f":
            break
        if c == "\\" and i + 1 < n and text[i + 1] > " ":
            i += 1
        elif c == "(":
            depth += 1
            if depth > _DEEPEST:
                return None
        elif c == ")":
            if not depth:
                break
            depth -= 1
        i += 1
    return (text[at:i], i) if i > at and not depth else None


def _definition(text: str, at: int, options: dict) -> tuple[str, str, str, int] | None:
    """The reference definition at ``at``: label, destination, title, and the end of its last line."""
    label = _LABEL.match(text, at)
    if not label or not label[2] or not label[1].strip():
        return None
    dest = destination(text, _GAP.match(text, label.end()).end())
    href = (options.get("normalize_link") or normalize_link)(unescape(dest[0])) if dest else ""
    if not dest or not (options.get("validate_link") or valid_link)(href):
        return None
    gap = _GAP.match(text, dest[1])
    named = _TITLE.match(text, gap.end()) if gap.end() > dest[1] else None
    if named and "\n\n" not in named[0] and (stop := _TAIL.match(text, named.end())):
        return label[1], href, unescape(named[1] or named[2] or named[3] or ""), stop.end()
    return (label[1], href, "", stop.end()) if (stop := _TAIL.match(text, dest[1])) else None


def _definitions(block: _Block, active: bool, options: dict) -> list[tuple[str, str, str, int, int]]:
    """Take the reference definitions off the start of a paragraph: (label, destination, title, first line, line after). Linear in the text: it is joined once."""
    found = block.data.setdefault("definitions", [])
    if not active or not block.lines or not block.lines[0].startswith("["):
        return found
    text, at, line = "\n".join(block.lines), 0, block.begin
    while text.startswith("[", at) and (one := _definition(text, at, options)):
        label, href, title, end = one
        after = line + text.count("\n", at, end) + 1
        found.append((label, href, title, line, after))
        line, at = after, end + 1
    block.lines = block.lines[line - block.begin :]
    block.begin = line
    return found


def _goes_on(block: _Block, bare: str, active: bool, options: dict) -> bool:
    """Whether a line outside of the paragraph's container still continues it: not if the paragraph is definitions alone and the line no part of the last."""
    if not active or not block.lines[0].startswith("[") or len(block.lines) < block.data.get("again", 0):
        return True
    trial = _Block("paragraph", 0)
    trial.lines = [*block.lines, bare]
    _definitions(trial, True, options)
    if len(trial.lines) > 1:  # an open label, or text: looked at again when it has twice the lines, so that all looks together are linear
        block.data["again"] = 2 * len(block.lines)
    return trial.lines != [bare]


def tokens(root: _Block, syntax: Syntax) -> list[tuple]:
    """The tree as rows of TOKEN, in order."""
    out: list[tuple] = []
    options = syntax.options

    def put(kind, tag, nesting, block=None, content="", markup="", info="", attrs=(), hidden=False, meta=None, begin=None, end=None):
        begin = block.begin if block is not None and begin is None else begin
        end = block.end if block is not None and end is None else end
        out.append((len(out), kind, tag, nesting, attrs, begin, end, content, markup, info, hidden, meta.items() if meta else ()))

    def paragraph(block, tag, kind, hidden=False, markup=""):
        for label, href, title, begin, end in _definitions(block, "reference" in syntax.rules["block"], options):
            put(DEFINITION, "", 0, content=href, markup=title, info=label, begin=begin, end=end)
            if options.get("inline_definitions"):
                put("definition", "", 0, begin=begin, end=end, hidden=True, meta={"id": label_key(label), "title": title, "url": href, "label": label})
        if not block.lines:
            return
        put(f"{kind}_open", tag, 1, block, markup=markup, hidden=hidden)
        put("inline", "", 0, block, content="\n".join(block.lines).strip())
        put(f"{kind}_close", tag, -1, markup=markup, hidden=hidden)

    def table(block):
        styles = [[("style", f"text-align:{a}")] if a else [] for a in block.data["align"]]

        def row(cells, tag, begin):
            put("tr_open", "tr", 1, begin=begin, end=begin + 1)
            for cell, style in zip(cells, styles):
                put(f"{tag}_open", tag, 1, attrs=style)
                put("inline", "", 0, content=cell, begin=begin, end=begin + 1)
                put(f"{tag}_close", tag, -1)
            put("tr_close", "tr", -1)

        put("table_open", "table", 1, block)
        put("thead_open", "thead", 1, begin=block.begin, end=block.begin + 1)
        row(block.data["header"], "th", block.begin)
        put("thead_close", "thead", -1)
        if block.data["rows"]:
            put("tbody_open", "tbody", 1, begin=block.begin + 2, end=block.end)
            for number, cells in block.data["rows"]:
                row(cells, "td", number)
            put("tbody_close", "tbody", -1)
        put("table_close", "table", -1)

    def loose(block):
        """A list is loose where a blank line stands between its items or between blocks of one of them."""
        gap = lambda a, b: b.begin > _last(a)
        return any(gap(a, b) for a, b in zip(block.children, block.children[1:])) or any(gap(a, b) for item in block.children for a, b in zip(item.children, item.children[1:]))

    def visit(block, tight=False):
        kind, data = block.kind, block.data
        if kind == "paragraph":
            paragraph(block, "p", "paragraph", hidden=tight)
        elif kind == "lheading":
            paragraph(block, f"h{data['level']}", "heading", markup=data["markup"])
        elif kind == "heading":
            put("heading_open", f"h{data['level']}", 1, block, markup=data["markup"])
            put("inline", "", 0, block, content=data["content"])
            put("heading_close", f"h{data['level']}", -1, markup=data["markup"])
        elif kind == "hr":
            put("hr", "hr", 0, block, markup=data["markup"])
        elif kind == "fence":
            words = unescape(data["info"]).split()
            put("fence", "code", 0, block, content="".join(x + "\n" for x in block.lines), markup=data["markup"], info=data["info"], meta={"lang": words[0]} if words else {})
        elif kind == "code_block":
            while block.lines and not block.lines[-1].strip(" \t"):
                block.lines.pop()
            put("code_block", "code", 0, block, content="".join(x + "\n" for x in block.lines))
        elif kind == "html_block":
            put("html_block", "", 0, block, content="".join(x + "\n" for x in block.lines))
        elif kind == "table":
            table(block)
        elif kind == "blockquote":
            first = block.children[0] if block.children else None
            alert = _ALERT.match(first.lines[0]) if options.get("alerts") and first is not None and first.kind == "paragraph" and first.lines else None
            if alert:
                name = alert[1].lower()
                put("alert_open", "div", 1, block, attrs=[("class", f"markdown-alert markdown-alert-{name}")], meta={"kind": name})
                put("alert_title_open", "p", 1, begin=block.begin, end=block.begin + 1, attrs=[("class", "markdown-alert-title")])
                put("inline", "", 0, content=name.capitalize(), begin=block.begin, end=block.begin + 1)
                put("alert_title_close", "p", -1)
                first.lines, first.begin = first.lines[1:], first.begin + 1
            else:
                put("blockquote_open", "blockquote", 1, block, markup=">")
            for child in block.children:
                visit(child)
            put("alert_close" if alert else "blockquote_close", "div" if alert else "blockquote", -1, markup="" if alert else ">")
        elif kind == "list":
            ordered = data["start"] is not None
            name, tag = ("ordered_list", "ol") if ordered else ("bullet_list", "ul")
            is_tight = not loose(block)
            tasks = [_TASK.match(i.children[0].lines[0]) if options.get("tasklists") and i.children and i.children[0].kind == "paragraph" and i.children[0].lines else None for i in block.children]
            attrs = [("start", str(data["start"]))] if ordered and data["start"] != 1 else []
            put(f"{name}_open", tag, 1, block, markup=data["marker"], attrs=attrs + ([("class", "contains-task-list")] if any(tasks) else []))
            for item, task in zip(block.children, tasks):
                meta = {}
                if task:
                    meta = {"checked": "true" if task[1] in "xX" else "false"}
                    item.children[0].lines[0] = item.children[0].lines[0][task.end() :].lstrip(" \t")
                put("list_item_open", "li", 1, item, markup=data["marker"], info=item.data["info"], meta=meta, attrs=[("class", "task-list-item")] if task else [])
                for child in item.children:
                    visit(child, is_tight)
                put("list_item_close", "li", -1, markup=data["marker"])
            put(f"{name}_close", tag, -1, markup=data["marker"])

    for child in root.children:
        visit(child)
    return out


def _last(block: _Block) -> int:
    """The line after the last one that holds something of the block."""
    if block.kind in ("list", "item") and block.children:
        return _last(block.children[-1])
    return block.begin + 1 if block.kind == "item" else block.end


#: TOKEN as Arrow types.
ATTRS_ARROW = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
META_ARROW = pa.map_(pa.string(), pa.string())
TOKEN_ARROW = {
    "pos": pa.int32(), "type": pa.string(), "tag": pa.string(), "nesting": pa.int32(), "attrs": ATTRS_ARROW, "line_begin": pa.int32(), "line_end": pa.int32(), "content": pa.string(), "markup": pa.string(),
    "info": pa.string(), "hidden": pa.bool_(), "meta": META_ARROW,
}


def _column(values: tuple, kind: pa.DataType) -> pa.Array:
    """An array; attributes and meta are sequences of pairs, most of them empty."""
    if kind not in (ATTRS_ARROW, META_ARROW):
        return pa.array(values, kind)
    offsets = pa.array(itertools.accumulate(map(len, values), initial=0), pa.int32())
    pairs = [p for v in values if v for p in v]
    keys, said = pa.array([k for k, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string())
    return pa.MapArray.from_arrays(offsets, keys, said) if kind == META_ARROW else pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([keys, said], names=["key", "value"]))


def structs(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.StructArray:
    """Tuples as an array of structs, column by column."""
    columns = list(zip(*rows)) if rows else [() for _ in types]
    return pa.StructArray.from_arrays([_column(c, t) for c, t in zip(columns, types.values())], names=list(types))


def lists(offsets: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


#: TOKEN as the fields of a struct type.
TOKEN_STRUCT = "struct<" + re.sub(r"(^|, )([a-z_]+) ", r"\1\2:", TOKEN) + ">"


def sources(docs: DataFrame, syntax: Syntax, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) with line ends and NULs handled; documents with a null text are left out."""
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    text = normalize(name(text_col)) if syntax.active("core", "normalize") else name(text_col)
    return spread(docs.select(name(id_col).alias("doc_id"), text.alias("text")).where("text is not null"))


#: An input of this size is a partition of its own (the usual split of a file).
SPLIT = 128 << 20


def spread(source: DataFrame) -> DataFrame:
    """Parsing is the work, but a small input often comes as one split, or is coalesced to few partitions: one whose splits would keep less than a quarter of the cores busy is dealt out to them. Larger ones stay where they are stored."""
    if source.isStreaming or not hasattr(source, "_jdf"):  # a remote session does not tell the size
        return source
    cores = source.sparkSession.sparkContext.defaultParallelism
    leaves = source._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))  # of the tables that are read
    return source.repartition(cores) if 4 * size < cores * SPLIT else source


#: Bytes of text whose tokens are held at a time; a longer text is a slice of its own.
SLICE = 4 << 20


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """A batch in slices of about SLICE bytes of text, so that memory does not depend on how many rows Spark puts into a batch."""
    sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
    start = held = 0
    for k, n in enumerate(sizes):
        if held and held + (n or 0) > SLICE:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n or 0
    yield batch.slice(start)


def whole(text: str) -> list[tuple]:
    """A text as one inline token."""
    return [(0, "inline", "", 0, (), 0, 1, text, "", "", False, ())]


def nested(docs: DataFrame, syntax: Syntax | None = None, *, id_col: str = "doc_id", text_col: str = "text", inline_only: bool = False) -> DataFrame:
    """(doc_id, tokens): a row per document with its block tokens as an array, definitions among them."""
    syntax = syntax or Syntax.preset()
    return folded(sources(docs, syntax, id_col, text_col), syntax, inline_only)


def folded(source: DataFrame, syntax: Syntax, inline_only: bool = False) -> DataFrame:
    """(doc_id, tokens) of (doc_id, text) with normal line ends."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in itertools.chain.from_iterable(map(slices, batches)):
            made, offsets = [], [0]
            for text in batch.column("text").to_pylist():
                made += whole(text) if inline_only else tokens(fold(text, syntax), syntax)
                offsets.append(len(made))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists(offsets, structs(made, TOKEN_ARROW))], names=["doc_id", "tokens"])

    return source.mapInArrow(each, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, tokens array<{TOKEN_STRUCT}>")


def parse(docs: DataFrame, syntax: Syntax | None = None, **columns) -> DataFrame:
    """Block tokens: a row per token with doc_id and ``pos``, definitions among them. A null text has none. With ``inline_only`` the whole text is one inline token."""
    return nested(docs, syntax, **columns).select("doc_id", F.inline("tokens"))

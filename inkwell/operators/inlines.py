"""Inlines: block tokens to inline tokens.

A document's blocks are folded and their contents scanned in one pass, so forward
references resolve without a join; a bounded number of definitions that documents
share travels along, more are joined before, by the labels in use. A link that names no known label stays text.
"""

from __future__ import annotations

import bisect
import collections
import functools
import itertools
import re
import unicodedata
from collections.abc import Iterator, Mapping
from types import MappingProxyType

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.links import entity, label_key, normalize_link, normalize_link_text, normalized_link, unescape, valid_link
from ..functions.joins import looked_up
from ..functions.text import normalize_reference, validate_link
from ..plans.config import Syntax
from . import blocks, typography
from .blocks import _TITLE, ATTRS_ARROW, CLOSE_TAG, DEFINITION, META_ARROW, OPEN_TAG, destination, lists, structs

INLINE = "struct<sub:int,type:string,tag:string,nesting:int,attrs:array<struct<key:string,value:string>>,content:string,markup:string,info:string,meta:map<string,string>>"
INLINE_ARROW = {
    "sub": pa.int32(), "type": pa.string(), "tag": pa.string(), "nesting": pa.int32(), "attrs": ATTRS_ARROW, "content": pa.string(), "markup": pa.string(), "info": pa.string(), "meta": META_ARROW,
}
# Fixed values of the CommonMark specification: inline HTML, automatic links, entities.
_TAG = re.compile(rf"{OPEN_TAG}|{CLOSE_TAG}", re.S | re.I)
_SHORT_COMMENT = re.compile("<!---?>")
_AUTOLINK = re.compile(r"<(?:([a-zA-Z][a-zA-Z0-9+.-]{1,31}:[^<>\x00-\x20]*)|([a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*))>")
_ENTITY = re.compile(r"&(#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});")
_PLAIN = re.compile(r"[^\n$%&*+\-:<=>@\[\\\]^_`{}~!#]+")
_FULL_LABEL = re.compile(r"\[((?:[^\\\[\]]|\\.)*)\]", re.S)
#: A reported label that no definition names.
UNRESOLVED = "unresolved"


def _space(c: str) -> bool:
    return not c or c in "\t\n\x0b\x0c\r" or unicodedata.category(c) == "Zs"


def _punctuation(c: str) -> bool:
    return bool(c) and unicodedata.category(c)[0] in "PS"


#: What ends the markup that these open; comments have an end of their own.
_ENDS = [("<![CDATA[", "]]>"), ("<?", "?>"), ("<!", ">")]


class _Scan:
    """One content to its tokens. Tokens are a list linked in both directions, so that tags go around a run or a link in one step; every search that can fail is remembered, so that the scan is linear."""

    def __init__(self, text: str, refs: Mapping[str, tuple[str, str]], syntax: Syntax):
        self.text, self.refs, self.syntax, self.options = text, refs, syntax, syntax.options
        self.valid = self.options.get("validate_link") or valid_link
        self.normal = self.options.get("normalize_link") or normalize_link
        self.shown = self.options.get("normalize_link_text") or normalize_link_text
        self.unresolved: list[str] = []  # labels of full references without a definition
        self.on = frozenset(syntax.rules["inline"])
        self.nodes: list[list] = [[]]  # tokens: type, tag, nesting, attrs, content, markup, info; the first stands for both ends
        self.after, self.before = [0], [0]
        self.said: list[str] = []  # text that is no token yet
        self.marks: list[list] = []  # delimiter runs: node, char, left to use, length, opens, closes
        self.brackets: list[tuple] = []  # node, position after, image, runs below
        self.links = self.inactive = 0  # how many brackets are no images; below this place of the stack those are inactive
        self.absent: dict[str, int] = {}  # a closing string, or a number of backticks, and from where on there is none
        self.html_links = 0  # raw <a> tags that are open

    def insert(self, at: int, token: list) -> int:
        """``token`` behind the node ``at``."""
        node, follow = len(self.nodes), self.after[at]
        self.nodes.append(token)
        self.after.append(follow)
        self.before.append(at)
        self.after[at] = self.before[follow] = node
        return node

    def put(self, kind, tag="", nesting=0, attrs=(), content="", markup="", info="", meta=None) -> int:
        self.flush()
        return self.insert(self.before[0], [kind, tag, nesting, list(attrs), content, markup, info, *([list(meta.items())] if meta else [])])

    def say(self, text: str) -> None:
        self.said.append(text)

    def flush(self) -> None:
        if self.said:
            self.insert(self.before[0], ["text", "", 0, [], "".join(self.said), "", ""])
            self.said = []

    def chain(self, node: int) -> list[list]:
        """The tokens behind a node."""
        out = []
        while node := self.after[node]:
            out.append(self.nodes[node])
        return out

    @functools.cached_property
    def openings(self) -> list[int]:
        """Where unescaped opening brackets stand."""
        return [m.start() for m in re.finditer(r"\\.|\[", self.text, re.S) if m[0] == "["]

    @functools.cached_property
    def comment_ends(self) -> list[tuple[int, int]]:
        """Dashes that end a comment, as three dashes never do: (first dash, end)."""
        return [(m.start(), m.end()) for m in re.finditer("-+>", self.text) if len(m[0]) % 3 == 0]

    def run(self) -> list[list]:
        text, i, n = self.text, 0, len(self.text)
        while i < n:
            m = _PLAIN.match(text, i)
            if m:
                self.say(m[0])
                i = m.end()
                continue
            c = text[i]
            i = self.special(c, i)
        self.flush()
        self.pair(0)
        tokens = self.merged(self.chain(0), final=False)
        core = self.syntax.rules["core"]
        if self.options["linkify"] and "linkify" in core:
            tokens = self.linked(tokens)
        if self.options["typographer"] and "replacements" in core:
            auto = False
            for t in tokens:
                if t[0] == "text" and not auto:
                    t[4] = typography.replaced(t[4])
                auto = t[0] == "link_open" and t[6] == "auto" or auto and t[0] != "link_close"
        if self.options["typographer"] and "smartquotes" in core:
            typography.smart_quotes(tokens, self.options["quotes"])
        return self.merged(tokens)

    def linked(self, tokens: list[list]) -> list[list]:
        """Bare links in the text outside links."""
        out, depth = [], 0
        for t in tokens:
            if t[0] in ("link_open", "link_close") or t[0] == "html_inline" and re.match(r"</?a[>\s]", t[4], re.I):
                depth = max(0, depth + (-1 if t[0] == "link_close" or t[4].startswith("</") else 1))
            at = 0
            for start, end, url in typography.bare_links(t[4]) if t[0] == "text" and not depth else ():
                href = self.normal(url)
                if start == 0 and out and out[-1][0] == "text_special" or not self.valid(href):
                    continue
                said = t[4][start:end]
                out.append(["text", "", 0, [], t[4][at:start], "", ""])
                out.append(["link_open", "a", 1, [("href", href)], "", "linkify", "auto"])
                out.append(["text", "", 0, [], self.shown(said), "", ""])
                out.append(["link_close", "a", -1, [], "", "linkify", "auto"])
                at = end
            out.append([*t[:4], t[4][at:], *t[5:]] if at else t)
        return out

    def special(self, c: str, i: int) -> int:
        text, on = self.text, self.on
        if c == "\n" and "newline" in on:
            hard = bool(self.said) and self.said[-1].endswith("  ")
            if self.said:
                self.said[-1] = self.said[-1].rstrip(" ")
            self.put("hardbreak" if hard else "softbreak", "br")
            i += 1
            while text[i : i + 1] in (" ", "\t"):
                i += 1
            return i
        if c == "\\" and "escape" in on:
            follow = text[i + 1 : i + 2]
            if follow == "\n":
                self.put("hardbreak", "br")
                i += 2
                while text[i : i + 1] in (" ", "\t"):
                    i += 1
                return i
            if follow and re.match(r"[!-/:-@\[-`{-~]", follow):
                self.put("text_special", content=follow, markup="\\" + follow, info="escape")
                return i + 2
        elif c == "`" and "backticks" in on:
            ticks = re.compile("`+").match(text, i)[0]
            if self.absent.get(ticks, i + 1) > i:
                end = re.compile(rf"(?<!`){ticks}(?!`)").search(text, i + len(ticks))
                if end:
                    code = text[i + len(ticks) : end.start()].replace("\n", " ")
                    if len(code) > 2 and code[0] == code[-1] == " " and code.strip(" "):
                        code = code[1:-1]
                    self.put("code_inline", "code", content=code, markup=ticks)
                    return end.end()
                self.absent[ticks] = i
            self.say(ticks)
            return i + len(ticks)
        elif c in "*_" and "emphasis" in on or c == "~" and "strikethrough" in on:
            return self.delimiter(c, i)
        elif c == "[" and "link" in on:
            return self.bracket(i, "[", False)
        elif c == "!" and text[i + 1 : i + 2] == "[" and "image" in on:
            return self.bracket(i, "![", True)
        elif c == "]" and self.brackets:
            return self.link(i)
        elif c == "<":
            if "autolink" in on and (m := _AUTOLINK.match(text, i)):
                url = self.normal(m[1] or "mailto:" + m[2])
                if self.valid(url):
                    self.put("link_open", "a", 1, [("href", url)], markup="autolink", info="auto")
                    self.put("text", content=self.shown(m[1] or m[2]))
                    self.put("link_close", "a", -1, markup="autolink", info="auto")
                    return m.end()
            if "html_inline" in on and self.options["html"] and (end := self.html_end(i)):
                self.put("html_inline", content=text[i:end])
                if re.match(r"</?a[>\s]", text[i : i + 4], re.I):
                    self.html_links += -1 if text[i + 1] == "/" else 1
                return end
        elif c == "&" and "entity" in on and (m := _ENTITY.match(text, i)) and (char := entity(m[1])):
            self.put("text_special", content=char, markup=m[0], info="entity")
            return m.end()
        elif c == ":" and self.options["linkify"] and "linkify" in on and text.startswith("://", i) and self.html_links + self.links <= 0:
            scheme = re.search(r"(?<![A-Za-z0-9+.\\-])[A-Za-z][A-Za-z0-9+.-]*$", "".join(self.said[-4:])[-16:])
            m = typography.URL.match(text, i - len(scheme[0])) if scheme else None
            url = typography.trimmed(_within(m[0]) if self.brackets else m[0]) if m else ""
            if len(url) > len(scheme[0]) + 3 if scheme else False:
                href = self.normal(url)
                if self.valid(href):
                    self.said = ["".join(self.said)[: -len(scheme[0])]]
                    self.put("link_open", "a", 1, [("href", href)], markup="linkify", info="auto")
                    self.put("text", content=self.shown(url))
                    self.put("link_close", "a", -1, markup="linkify", info="auto")
                    return m.start() + len(url)
        self.say(c)
        return i + 1

    def html_end(self, i: int) -> int | None:
        """Where the raw HTML ends that begins at i."""
        text = self.text
        if m := _TAG.match(text, i):
            return m.end()
        if text.startswith("<!--", i):
            if m := _SHORT_COMMENT.match(text, i):
                return m.end()
            dashes = re.compile("-*").match(text, i + 4).end()
            if (dashes - i - 4) % 3 == 2 and text[dashes : dashes + 1] == ">":
                return dashes + 1
            at = bisect.bisect_left(self.comment_ends, (dashes, 0))
            return self.comment_ends[at][1] if at < len(self.comment_ends) else None
        for opening, closing in _ENDS:
            if text.startswith(opening, i) and (opening != "<!" or re.match("[A-Za-z]", text[i + 2 : i + 3])):
                if self.absent.get(closing, i + 1) <= i:
                    return None
                end = text.find(closing, i + 2)
                if end < 0:
                    self.absent[closing] = i
                    return None
                return end + len(closing)
        return None

    def bracket(self, i: int, opening: str, image: bool) -> int:
        self.brackets.append((self.put("text", content=opening), i + len(opening), image, len(self.marks)))
        self.links += not image
        return i + len(opening)

    def delimiter(self, c: str, i: int) -> int:
        text = self.text
        j = i
        while text[j : j + 1] == c:
            j += 1
        before, after = text[i - 1 : i] if i else "", text[j : j + 1]
        left = not _space(after) and (not _punctuation(after) or _space(before) or _punctuation(before))
        right = not _space(before) and (not _punctuation(before) or _space(after) or _punctuation(after))
        opens, closes = (left, right) if c != "_" else (left and (not right or _punctuation(before)), right and (not left or _punctuation(after)))
        n = j - i
        single = self.options.get("strikethrough_single_tilde")
        if c == "~" and (n < 2 and not single or n > 2 and single):
            self.say(text[i:j])
            return j
        self.marks.append([self.put("text", content=c * n), c, n, n, opens, closes])
        return j

    def pair(self, floor: int) -> None:
        """Match closing delimiter runs to opening ones above ``floor`` of the stack; what pairs gets tags around it.

        ``waiting`` holds the runs that may still open. What lies between the two runs of a pair leaves it, and where a kind of closing run
        found nothing the next of its kind need not look again.
        """
        waiting: list[tuple[int, list]] = []  # place in the stack, run
        nothing: dict[tuple, int] = {}  # a kind of closing run, and the place below which it finds none
        single = self.options.get("strikethrough_single_tilde")
        for place, closer in enumerate(self.marks[floor:]):
            node, char, _, length, opens, closes = closer
            key = (char, opens, length % 3, length if char == "~" else 0)
            while closes and closer[2]:
                below = nothing.get(key, 0)
                at = len(waiting) - 1
                while at >= 0 and waiting[at][0] >= below:
                    run = waiting[at][1]
                    if run[1] == char:
                        if char == "~":  # by twos, or by equal widths where one is enough
                            fits = run[3] == length if single else run[2] > 1 and closer[2] > 1
                        else:
                            fits = not ((run[5] or opens) and (run[3] + length) % 3 == 0 and (run[3] % 3 or length % 3))
                        if fits:
                            break
                    at -= 1
                else:
                    nothing[key] = place
                    break
                opener = waiting[at][1]
                used = 2 if opener[2] >= 2 and closer[2] >= 2 else 1
                name, tag = ("s", "s") if char == "~" else ("strong", "strong") if used == 2 else ("em", "em")
                self.insert(opener[0], [f"{name}_open", tag, 1, [], "", char * used, ""])
                self.insert(self.before[node], [f"{name}_close", tag, -1, [], "", char * used, ""])
                for run in (opener, closer):
                    run[2] -= used
                    self.nodes[run[0]][4] = char * run[2]
                del waiting[at + bool(opener[2]) :]
                if char == "~" and closer[2] < 2:
                    break
            if opens and closer[2]:
                waiting.append((place, closer))
        del self.marks[floor:]

    def link(self, i: int) -> int:
        text = self.text
        at, start, image, floor = self.brackets.pop()
        active = image or len(self.brackets) >= self.inactive
        self.links -= not image
        self.inactive = min(self.inactive, len(self.brackets))
        if not active:
            self.say("]")
            return i + 1
        found, meta = self.target(i + 1), None
        if found is None:
            m = _FULL_LABEL.match(text, i + 1)
            nested = bisect.bisect_left(self.openings, start)
            end, own = (m.end() if m else i + 1), not (m and m[1])
            if own and nested < len(self.openings) and self.openings[nested] < i:  # no label holds a bracket
                self.say("]")
                return i + 1
            key = label_key(text[start:i] if own else m[1])
            ref = self.refs.get(key)
            if not ref or not key:
                if not own and key:
                    self.unresolved.append(key)
                self.say("]")
                return i + 1
            found = (*ref, end)
            meta = {"label": key} if self.options.get("store_labels") else None
        href, title, end = found
        self.flush()
        self.pair(floor)
        titled = [("title", title)] if title else []
        if image:
            alt = _alt(self.chain(at))
            last = self.before[at]
            self.after[last], self.before[0] = 0, last
            self.put("image", "img", 0, [("src", href), ("alt", alt), *titled], content=text[start:i], meta=meta)
        else:
            self.nodes[at] = ["link_open", "a", 1, [("href", href), *titled], "", "", "", *([list(meta.items())] if meta else [])]
            self.put("link_close", "a", -1)
            self.inactive = len(self.brackets)
        return end

    def target(self, i: int) -> tuple[str, str, int] | None:
        """The ``(destination "title")`` at i: (href, title, end)."""
        text = self.text
        if text[i : i + 1] != "(":
            return None
        blank = re.compile(r"[ \t\n]*")
        at = blank.match(text, i + 1).end()
        href = title = ""
        if text[at : at + 1] != ")":
            dest = destination(text, at)
            if dest:
                href = self.normal(unescape(dest[0]))
                if not self.valid(href):
                    return None
                gap = blank.match(text, dest[1])
                at = gap.end()
                if gap[0] and (named := _TITLE.match(text, at)):
                    title = unescape(next(g for g in named.groups() if g is not None))
                    at = blank.match(text, named.end()).end()
        return (href, title, at + 1) if text[at : at + 1] == ")" else None

    @staticmethod
    def merged(tokens: list[list], final: bool = True) -> list[list]:
        """Neighbouring texts as one; escaped characters and entities stay apart until the end."""
        out: list[list] = []
        for is_text, group in itertools.groupby(tokens, key=lambda t: t[0] == "text" or final and t[0] == "text_special"):
            if not is_text:
                out += group
            elif said := "".join(t[4] for t in group):
                out.append(["text", "", 0, [], said, "", ""])
        return out


def _within(url: str) -> str:
    """What of a URL lies before the bracket that closes the label around it."""
    depth = 0
    for i, c in enumerate(url):
        depth += (c == "[") - (c == "]")
        if depth < 0:
            return url[:i]
    return url


def _alt(tokens: list[list]) -> str:
    """What an image's text gives as plain text."""
    return "".join(t[4] if t[0] in ("text", "text_special") else "\n" if t[0] == "softbreak" else dict(t[3]).get("alt", "") if t[0] == "image" else "" for t in tokens)


def definitions(rows: DataFrame) -> DataFrame:
    """The reference definitions among block rows: doc_id, label (normalised), title, href, lines, and rn: 1 is the one that counts, the others are duplicates."""
    found = rows.where(F.col("type") == DEFINITION).select("doc_id", normalize_reference(F.col("info")).alias("label"), F.col("markup").alias("title"), F.col("content").alias("href"), "line_begin", "line_end", "pos")
    order = Window.partitionBy("doc_id", "label").orderBy("pos")
    return found.withColumn("rn", F.row_number().over(order)).drop("pos")


#: Shared definitions up to this number travel to the tasks as they are; more are joined by label.
MAX_BROADCAST_LABELS = 100_000


def _known(shared: DataFrame) -> DataFrame:
    """(label, to): the valid ones among shared definitions (label, title, href), of each label the smallest."""
    known = shared.select(normalize_reference(F.col("label")).alias("label"), F.struct(normalized_link(F.col("href")).alias("href"), F.coalesce("title", F.lit("")).alias("title")).alias("to")).where(validate_link(F.col("to.href")))
    return known.groupBy("label").agg(F.min("to").alias("to"))


def _joined(source: DataFrame, known: DataFrame) -> DataFrame:
    """``source`` with ``common``: the known definitions whose labels a text names in brackets.

    What a text names depends on the text alone, so definitions are found for each different text and looked up by its
    digest: ids do not matter. Labels that many texts name, and texts that many documents have, are hot keys: their share is counted, and they are sent to all tasks.
    """
    digest = F.sha2("text", 256)
    raw = F.explode(F.regexp_extract_all("text", F.lit(r"\[((?:[^\\\[\]]|\\.)+)\]"), F.lit(1)))
    named = source.select(digest.alias("text_key"), raw.alias("raw")).select("text_key", normalize_reference(F.col("raw")).alias("label")).distinct()
    found = looked_up(named, known, "label").groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("label", "to"))).alias("common"))
    return looked_up(source.withColumn("text_key", digest), found, "text_key", "left").drop("text_key")


def document(text: str, syntax: Syntax, table: Mapping[str, tuple[str, str]], inline_only: bool = False, report: bool = False, own_first: bool = True) -> tuple[list[tuple], list[list[tuple]]]:
    """The block tokens of one text and for each its inline tokens. ``table`` holds definitions that go behind the text's own, or before."""
    own = blocks.whole(text) if inline_only else blocks.tokens(blocks.fold(text, syntax), syntax)
    if mine := {label_key(t[9]): (t[7], t[8]) for t in reversed(own) if t[1] == DEFINITION}:  # of one label the first counts
        table = collections.ChainMap(mine, table) if own_first else collections.ChainMap(table, mine)
    kids = []
    for t in own:
        found: list[tuple] = []
        if t[1] == "inline" and t[7]:
            scan = _Scan(t[7], table, syntax)
            found = [(k, name, tag, nesting, attrs, content, markup, info, meta[0] if meta else ()) for k, (name, tag, nesting, attrs, content, markup, info, *meta) in enumerate(scan.run(), 1)]
            if report:
                found += [(10**9, UNRESOLVED, "", 0, (), label, "", "", ()) for label in scan.unresolved]
        kids.append(found)
    return own, kids


def nested(docs: DataFrame, syntax: Syntax | None = None, *, id_col: str = "doc_id", text_col: str = "text", inline_only: bool = False, shared: DataFrame | None = None, report: bool = False) -> DataFrame:
    """(doc_id, tokens, children): a row per document with its block tokens and, for each, the array of its inline tokens (empty but for those of type inline).

    ``shared`` may hold definitions (label, title, href) that every document can use after its own. With ``report``, labels of
    full references that no definition names come as children of type UNRESOLVED.
    """
    syntax = syntax or Syntax.preset()
    source = blocks.sources(docs, syntax, id_col, text_col)
    none = F.lit(None).cast("map<string,struct<href:string,title:string>>")
    everywhere: dict[str, tuple[str, str]] = {}
    if shared is not None:
        known = _known(shared)
        few = known.limit(MAX_BROADCAST_LABELS + 1).collect()
        everywhere = {r["label"]: (r["to"]["href"], r["to"]["title"]) for r in few} if len(few) <= MAX_BROADCAST_LABELS else {}
    source = source.withColumn("common", none) if shared is None or everywhere or not few else _joined(source, known)

    return parsed(source, syntax, everywhere, inline_only=inline_only, report=report)


def parsed(source: DataFrame, syntax: Syntax, everywhere: Mapping[str, tuple[str, str]] = MappingProxyType({}), *, inline_only: bool = False, report: bool = False, own_first: bool = True) -> DataFrame:
    """(doc_id, tokens, children) of (doc_id, text, common): ``common`` are a row's further definitions, ``everywhere`` those of rows without; they go behind the text's own, or before."""
    kind, everywhere = source.schema["doc_id"].dataType.simpleString(), dict(everywhere)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in itertools.chain.from_iterable(map(blocks.slices, batches)):
            tokens, ends, made, inner = [], [0], [], [0]
            for text, common in zip(batch.column("text").to_pylist(), batch.column("common").to_pylist()):
                own, kids = document(text, syntax, {k: (v["href"], v["title"]) for k, v in common} if common else everywhere, inline_only, report, own_first)
                for found in kids:
                    made += found
                    inner.append(len(made))
                tokens += own
                ends.append(len(tokens))
            children = lists(ends, lists(inner, structs(made, INLINE_ARROW)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists(ends, structs(tokens, blocks.TOKEN_ARROW)), children], names=["doc_id", "tokens", "children"])

    return source.mapInArrow(folded, f"doc_id {kind}, tokens array<{blocks.TOKEN_STRUCT}>, children array<array<{INLINE}>>")


def rows(documents: DataFrame, outer: bool = False) -> DataFrame:
    """All tokens of nested documents: doc_id, pos, sub (0 for block tokens; 1, 2, ... for the children of an inline token at pos), and the token's columns. With ``outer`` a document without tokens has a row of nulls."""
    block = lambda t: F.struct(
        t["pos"].alias("pos"), F.lit(0).alias("sub"), *[t[c].alias(c) for c in ("type", "tag", "nesting", "attrs", "line_begin", "line_end", "content", "markup", "info", "hidden", "meta")]
    )
    nothing = F.lit(None).cast("int")
    child = lambda c, pos: F.struct(
        pos.alias("pos"), c["sub"].alias("sub"), *[c[x].alias(x) for x in ("type", "tag", "nesting", "attrs")], nothing.alias("line_begin"), nothing.alias("line_end"), *[c[x].alias(x) for x in ("content", "markup", "info")],
        F.lit(False).alias("hidden"), c["meta"].alias("meta"),
    )
    every = F.transform("tokens", lambda t, i: F.concat(F.array(block(t)), F.transform(F.get("children", i), lambda c: child(c, t["pos"]))))
    kept = F.filter(F.flatten(every), lambda t: t["type"] != DEFINITION)
    return documents.select("doc_id", F.inline_outer(kept) if outer else F.inline(kept))


def block_tokens(rows: DataFrame) -> DataFrame:
    """Block rows in the form of all tokens: for what does not look into inline content."""
    return rows.where(F.col("type") != DEFINITION).withColumn("sub", F.lit(0))

"""HTML extraction by tree scoring.

A page becomes a small tree. Paragraphs pass points, for their length and
commas, to their ancestors; links take points away; the container with the most
points and its siblings, but for lists of links, are kept. Each page is parsed on its own, in
batches, where it is stored: no shuffle.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import of_row, packed, unpacked

#: Comments, declarations, the begin of a tag, or text.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)|([^<]+|<)", re.S)
#: The end of a tag, or a quoted value; a value that runs over the end of its tag (its closing quote is missing).
_STEP, _BROKEN = re.compile(r">|=\s*([\"'])"), re.compile(r"[^<>]*>[^<]*</?[a-zA-Z]")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var label img wbr br data ruby rt rp "
    "math semantics mi mn mo ms mtext mrow mstyle mspace msub msup msubsup mfrac msqrt mroot mover munder munderover".split()
)
#: What these hold is no markup; the end is the first end tag.
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Markup that is skipped as a whole, with what is nested in it.
_SKIPPED = frozenset("template noscript svg object annotation annotation-xml".split())
_REGION = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)({'|'.join(sorted(_SKIPPED, key=len, reverse=True))})(?![^\s/>])[^>]*(>)", re.S | re.I)
_NOT_TEXT = frozenset("head nav footer aside button select option datalist dialog menu canvas audio video map".split()) | _RAW | _SKIPPED
#: Names of what is no text, as a part of a class or id.
_NOT_TEXT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr popup menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar related recommended sharing social comment comments disqus replies respond footer subscribe newsletter login signup pagination pager toolbar".split()
)
#: Names that say so only alone or beside words of layout, and not where another name of the element says that it is text.
_WHOLE_NAMES = frozenset("hidden side skip share notice notices alert modal overlay widget widgets search reply".split())
_LAYOUT = frozenset("site page global main top bottom left right box block bar wrapper wrap container area section list item items inner outer panel slot unit button buttons icon icons link links group row col column".split())
_PAGE_HEAD_NAMES = frozenset("header masthead topbar".split())
_NOT_TEXT_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog form menu menubar".split())
_GOOD_NAMES = frozenset("article content post entry story body main text page".split())
_PARAGRAPHS = frozenset("p pre blockquote li td dd h1 h2 h3 h4 h5 h6 figcaption".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table body article section div main".split())


#: A class with one of these parts speaks of what is not there (``no-sidebar``), or of more than the named part.
_NEGATING = frozenset("no non not without with has".split())
#: A block's points reach so many ancestors.
_REACH = 12
#: A sibling of the best container with a larger share of links is a list of links.
_LINKS = 0.5


class _Node:
    """An element. What depends on its ancestors is taken over from the parent when it opens, so nothing walks up the tree."""

    __slots__ = ("article", "block", "dropped", "form", "kept", "linked", "links", "parent", "points", "size", "tag", "texts")

    def __init__(self, tag: str, parent: _Node | None, dropped: bool = False, points: float = 0.0):
        self.tag, self.parent, self.dropped, self.points, self.size, self.links, self.kept, self.texts = tag, parent, dropped, points, 0, 0, False, 0
        self.block = parent.block if parent is not None and tag in _INLINE else self
        self.linked = tag == "a" or parent is not None and parent.linked
        self.article = self if tag in ("article", "main") else parent.article if parent is not None else None
        self.form = parent.form if parent is not None and parent.form is not None else self if tag == "form" else None


def _no_text(attributes: dict[str, str], page_head: bool) -> bool:
    """Whether the classes and the id of an element name something that is no text. Every value is judged as a whole, its parts between hyphens together."""
    values = [frozenset(re.split("[_-]+", v)) for v in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()]
    good = any(len(parts) == 1 and parts & _GOOD_NAMES for parts in values)
    weak = (_WHOLE_NAMES | _PAGE_HEAD_NAMES) if page_head else _WHOLE_NAMES
    for parts in values:
        if parts & _NEGATING:
            continue
        if parts & _NOT_TEXT_NAMES or not good and parts & weak and parts <= weak | _LAYOUT:
            return True
    return False


def _open(tag: str, attributes: str, parent: _Node) -> _Node:
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    role, outer = found.get("role", "").lower(), tag in ("article", "main", "body", "html", "form")
    outside = parent.article is None
    unwanted = not outer and (outside and tag == "header" or ("class" in found or "id" in found) and _no_text(found, outside))
    dropped = parent.dropped or tag in _NOT_TEXT or unwanted or role in _NOT_TEXT_ROLES or "hidden" in found or found.get("aria-hidden") == "true"
    good = tag not in _INLINE and not _GOOD_NAMES.isdisjoint(re.split(r"[\s_-]+", f"{found.get('class', '')} {found.get('id', '')}".lower()))
    return _Node(tag, parent, dropped, 25.0 if tag == "article" else 20.0 if tag == "main" else 10.0 if good else 0.0)


def _tag_end(page: str, at: int) -> int:
    """Where the tag that is open at ``at`` ends: at the first > outside of quoted values, or the first one at all where a closing quote is missing. There is one."""
    i = at
    while m := _STEP.search(page, i):
        if not m[1]:
            return m.start()
        close = page.find(m[1], m.end())
        if close < 0 or _BROKEN.match(page, m.end(), close):
            return page.find(">", m.end())
        i = close + 1
    return page.find(">", at)


class _Tree:
    """The open elements, with counts by name: of all, and of the inline ones since the last block."""

    def __init__(self):
        self.root = _Node("html", None)
        self.nodes, self.stack, self.open, self.inline = [self.root], [self.root], Counter(), [Counter()]
        self.blocks: list[tuple[_Node, str, int]] = []  # nearest block element, text, characters of links
        self.pieces: list[str] = []
        self.linked = 0

    def push(self, node: _Node) -> None:
        self.stack.append(node)
        self.nodes.append(node)
        self.open[node.tag] += 1
        if node.tag in _INLINE:
            self.inline[-1][node.tag] += 1
        else:
            self.inline.append(Counter())

    def cut(self, to: int) -> None:
        """Close all but the first ``to`` open elements."""
        while len(self.stack) > to:
            tag = self.stack.pop().tag
            self.open[tag] -= 1
            if tag in _INLINE:
                self.inline[-1][tag] -= 1
            else:
                self.inline.pop()

    def say(self, text: str) -> None:
        if not self.stack[-1].dropped:
            self.pieces.append(text)
            if self.stack[-1].linked:
                self.linked += len(text.strip())

    def end_block(self) -> None:
        if self.pieces:
            at = self.stack[-1].block
            text = " ".join(html.unescape("".join(self.pieces)).split())
            if text and not at.dropped:
                self.blocks.append((at, text, self.linked))
            self.pieces.clear()
        self.linked = 0

    def close(self, tags: tuple[str, ...], within: frozenset[str] = frozenset()) -> None:
        """Close the innermost element of these names, if none of ``within`` stands before it."""
        if not any(self.open[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                self.end_block()
                self.cut(i)
                return
            if self.stack[i].tag in within:
                return

    def close_inline(self, tag: str) -> None:
        if self.inline[-1][tag]:
            while self.stack[-1].tag != tag:
                self.cut(len(self.stack) - 1)
            self.cut(len(self.stack) - 1)


def _regions(page: str) -> dict[int, int]:
    """Where the elements that are skipped as a whole end, by where they begin; those without an end are not there."""
    found: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for m in _REGION.finditer(page):
        if not m[2]:
            continue
        begun = open_.setdefault(m[2].lower(), [])
        if m[1]:
            if begun:
                found[begun.pop()] = m.end()
        elif page[m.end() - 2] != "/":
            begun.append(m.start())
        else:
            found[m.start()] = m.end()
    return found


def main_text(page: str | None) -> str:
    """The text of a page's article: its blocks in page order, joined by blank lines. Time is linear in the page, whatever it holds."""
    tree, page, pos = _Tree(), page or "", 0
    last, regions = page.rfind(">"), _regions(page)
    while m := _TOKEN.match(page, pos):
        pos = m.end()
        if m[3]:
            tree.say(m[3])
            continue
        if not m[2]:
            continue
        if pos > last:  # no tag ends behind: the rest is text
            tree.say(page[m.start() :])
            break
        tag = m[2].lower()
        if tag in _SKIPPED:  # without an end its own tag goes, not the rest of the page
            pos = regions.get(m.start(), _tag_end(page, pos) + 1)
            continue
        end = _tag_end(page, pos)
        attributes, pos = page[pos:end], end + 1
        if m[1]:
            if tag in _INLINE:
                tree.close_inline(tag)
            else:
                tree.close((tag,))
            continue
        alone = attributes.endswith("/")
        if tag == "br":
            tree.say(" ")
        elif tag in _RAW:
            shut = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, pos)
            pos = shut.end() if shut else len(page)
        elif tag in ("html", "body"):
            tree.end_block()
        elif tag not in _VOID:
            if tag not in _INLINE:
                tree.end_block()
                tree.close(("p",), _SCOPE)
                tree.close(_CLOSES.get(tag, ()), _SCOPE)
            if not alone:
                tree.push(_open(tag, attributes, tree.stack[-1]))
        elif tag == "hr":
            tree.end_block()
    tree.end_block()
    return "\n\n".join(_chosen(tree))


def _chosen(tree: _Tree) -> list[str]:
    """The texts of the best container and of its siblings; of a container in an article, those of the whole article.

    A form is no text, but if it holds paragraphs and half of all text, it is the page's frame.
    """
    total = sum(len(text) for _, text, _ in tree.blocks)
    for at, text, _ in tree.blocks:
        if at.form is not None:
            at.form.size += len(text)
            at.form.texts += at.tag == "p"
    blocks = [x for x in tree.blocks if x[0].form is None or x[0].form.texts and 2 * x[0].form.size >= total]
    for node in tree.nodes:
        node.size = 0
    if not blocks:
        return []
    scored: dict[_Node, None] = {}
    for at, text, linked in blocks:
        at.size += len(text)
        at.links += min(linked, len(text))
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        node, share = (at.parent or at) if at.tag in _PARAGRAPHS else at, 1.0
        for level in range(1, _REACH + 1):
            if node is None:
                break
            node.points += points * share
            scored[node] = None
            share = 0.5 if level == 1 else 1 / (3 * level)
            node = node.parent
    for node in reversed(tree.nodes):  # children come after their parents
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.links += node.links
    score = lambda n: n.points * (1 - n.links / max(1, n.size))
    best = max(scored, key=score)
    floor = max(10.0, 0.2 * score(best))
    whole = best.article
    best = whole or best

    def related(node: _Node) -> bool:
        """Beside an article, what is as good as text of it; else whatever is not mostly links."""
        density = node.links / max(1, node.size)
        if whole is None:
            return density < _LINKS
        return score(node) >= floor or node.tag in ("h1", "h2", "h3") or (node.tag == "p" and density < 0.25 and node.size > 80)

    for node in tree.nodes:
        sibling = node.parent is not None and node.parent is best.parent and related(node)
        node.kept = node is best or sibling or node.parent is not None and node.parent.kept
    return [text for at, text, _ in blocks if at.kept]


def extract(pages: DataFrame, *, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the main text of each page.

    Null and empty pages, and pages without text outside menus, adverts and the
    like, give an empty text. Pages are independent: repeated rows and ties get equal texts.
    An input column with the name of the output is replaced. An empty table gives an empty one.
    """

    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype=object)

    names = pages.columns
    found = packed(pages).select("row", of(of_row(html_col)).alias("main"))
    if out_col.lower() == html_col.lower():
        return unpacked(found, names, {}, {html_col: F.col("main")})
    return unpacked(found, names, {out_col: F.col("main")})

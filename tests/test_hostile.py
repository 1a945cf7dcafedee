"""Inputs made to be slow: the scan of 50 kB takes well under a few seconds each, and four times the input about four times as long."""

import time

import pytest

from inkwell.operators import blocks, inlines
from inkwell.plans.config import Syntax

INLINE = {
    "links with emphasis": "[*a*](b) ", "open comments": "a <!--", "comments that three dashes never end": "<!-- --->", "images": "![[]()", "brackets": "[", "closing brackets": "a]", "stars": "*a ",
    "two kinds of runs": "*a _b_ ", "links in links": "[a](", "round brackets": "[a](b(", "quotes": "\"'", "open quotes": "'a \"", "character data": "<![CDATA[", "instructions": "<?", "declarations": "<!X", "backticks": "`a``",
    "entities": "&amp;a", "tags": '<a b="', "colons": ":", "addresses": "a,", "URLs": "http://a(", "tildes": "~a~~", "long runs": "**a _b_ c*", "labels": "[[a]](b)", "escapes": "\\[",
}
BLOCKS = {"quotes": ">", "items": "- ", "fences": "```\n", "tables": "a|b\n-|-\n", "definitions": "[a]:", "definitions in lines": "[a]:\n", "comments": "<!--\n", "headings": "# #", "equals": "a\n==="}
SYNTAX = Syntax.preset("gfm-like2", typographer=True, linkify=True, html=True)


def seconds(work) -> float:
    began = time.process_time()
    work()
    return time.process_time() - began


def scan(text):
    return lambda: inlines._Scan(text, {}, SYNTAX).run()


@pytest.mark.parametrize("name", INLINE)
def test_contents(name):
    unit = INLINE[name]
    for end in ("", "*" * 2000 + ")" * 2000):
        once = unit * (50_000 // len(unit)) + end
        took = seconds(scan(once))
        assert took < 4
        if took > 0.5:
            assert seconds(scan(unit * (200_000 // len(unit)) + end)) < 8 * took


@pytest.mark.parametrize("name", BLOCKS)
def test_documents(name):
    unit = BLOCKS[name]
    assert seconds(lambda: blocks.tokens(blocks.fold(unit * (50_000 // len(unit)), SYNTAX), SYNTAX)) < 4


def test_long_runs_around_links():
    """One opening run that pairs with thousands of closing ones, and links between."""
    tokens = inlines._Scan("*" * 3000 + "a _b_ [c](d) e*" * 3000, {}, SYNTAX).run()
    assert sum(t[0] == "em_open" for t in tokens) + 2 * sum(t[0] == "strong_open" for t in tokens) >= 3000
    assert sum(t[0] == "link_open" for t in tokens) == 3000 and all(sum(t[2] for t in tokens[:k]) >= 0 for k in range(0, len(tokens), 997))

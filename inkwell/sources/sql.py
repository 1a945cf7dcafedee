"""The parser for SQL: a table function of a text, for lateral joins with any table."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..engine import Engine
from ..operators import inlines
from ..operators.blocks import DEFINITION
from ..plans.config import PRESETS, Syntax

COLUMNS = (
    "pos int, sub int, type string, tag string, nesting int, level int, attrs array<struct<key:string,value:string>>, line_begin int, line_end int, content string, markup string, info string, hidden boolean, meta map<string,string>"
)


def _rows(text: str, syntax: Syntax) -> Iterator[tuple]:
    """The token rows of a text."""
    if syntax.active("core", "normalize"):
        text = re.sub(r"\r\n?", "\n", text).replace("\x00", "�")
    depth = 0
    for (pos, kind, tag, nesting, attrs, begin, end, content, markup, info, hidden, meta), kids in zip(*inlines.document(text, syntax, {})):
        if kind == DEFINITION:
            continue
        depth += min(nesting, 0)
        yield pos, 0, kind, tag, nesting, depth, list(attrs), begin, end, content, markup, info, hidden, dict(meta)
        depth += max(nesting, 0)
        inner = 0
        for sub, name, own, step, pairs, said, marks, more, about in kids:
            inner += min(step, 0)
            yield pos, sub, name, own, step, inner, list(pairs), None, None, said, marks, more, False, dict(about)
            inner += max(step, 0)


def register(spark: SparkSession, name: str = "markdown_tokens", **engines: Engine) -> None:
    """Register ``markdown_tokens(text, preset)``: a row per token, block tokens with sub 0 and their inline tokens behind them.

    ``SELECT d.id, t.* FROM docs d, LATERAL markdown_tokens(d.body, 'gfm-like2') t``. The preset is the name of one, or of one
    of ``engines``, which may have any rules and options. A null text or preset gives no row; an unknown preset is an error.
    """
    known = {preset: Engine(preset).config() for preset in PRESETS} | {key: engine.config() for key, engine in engines.items()}

    class Tokens:
        def eval(self, text: str, preset: str):
            if text is None or preset is None:
                return
            if preset not in known:
                raise ValueError(f"no such preset: {preset}; known are {', '.join(known)}")
            yield from _rows(text, known[preset])

    spark.udtf.register(name, udtf(Tokens, returnType=COLUMNS, useArrow=True))

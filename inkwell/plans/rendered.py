"""Registered queries that render one document per row of a table: a rule each, the Markdown and the HTML as templates with {column} in place of values.

The same templates give the Spark query and the SQL, so each states what a rule has to recover from the source.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine


def filled(template: str) -> Column:
    return F.concat(*[F.col(x).cast("string") if k % 2 else F.lit(x) for k, x in enumerate(re.split(r"\{(\w+)\}", template)) if k % 2 or x])


def filled_sql(template: str) -> str:
    return " || ".join(f"CAST({x} AS VARCHAR)" if k % 2 else "'" + x.replace("'", "''") + "'" for k, x in enumerate(re.split(r"\{(\w+)\}", template)) if k % 2 or x)


def typed() -> Engine:
    return Engine("default", {"typographer": True})


def loud(engine: Engine) -> Engine:
    """A plugin: texts in capitals."""
    return engine.add_render_rule("text", lambda token: F.upper(token["content"]))


def highlighted(content: Column, lang: Column) -> Column:
    return F.when(lang == "x", F.concat(F.lit("<mark>"), F.rtrim(F.regexp_replace(content, "\n", "")), F.lit("</mark>")))


_PART, _CUSTOMER, _ORDER = ("part", "p_partkey"), ("customer", "c_custkey"), ("orders", "o_orderkey")
_LINK = '<a href="/c/{c_custkey}">{c_name}</a>'
#: name: (table, id), engine, Markdown, HTML.
CASES: dict[str, tuple[tuple[str, str], Callable[[], Engine], str, str]] = {
    "indented_code": (_PART, Engine, "    {p_name}\n\n    \t{p_type}\n\nafter", "<pre><code>{p_name}\n\n\t{p_type}\n</code></pre>\n<p>after</p>\n"),
    "thematic_breaks": (_ORDER, Engine, "{o_orderkey}\n***\n- - -\n ___\n{o_custkey}", "<p>{o_orderkey}</p>\n<hr />\n<hr />\n<hr />\n<p>{o_custkey}</p>\n"),
    "html_blocks": (_CUSTOMER, Engine, "<div class=x>\n*{c_name}*\n</div>\n\n*{c_name}*\n<!-- {c_custkey}\n\n-->\n", "<div class=x>\n*{c_name}*\n</div>\n<p><em>{c_name}</em></p>\n<!-- {c_custkey}\n\n-->\n"),
    "html_disabled": (_CUSTOMER, lambda: Engine("default"), "<b>{c_name}</b>", "<p>&lt;b&gt;{c_name}&lt;/b&gt;</p>\n"),
    "setext_headings": (_PART, Engine, "{p_name}\nmore\n===\n{p_type}\n---\n# {p_type} #", "<h1>{p_name}\nmore</h1>\n<h2>{p_type}</h2>\n<h1>{p_type}</h1>\n"),
    "full_urls": (_CUSTOMER, lambda: Engine("gfm-like"), "see http://a.org/_{c_custkey}_x, *ok*", '<p>see <a href="http://a.org/_{c_custkey}_x">http://a.org/_{c_custkey}_x</a>, <em>ok</em></p>\n'),
    "fuzzy_links": (_CUSTOMER, lambda: Engine("gfm-like"), "www.c{c_custkey}.com or a.{c_custkey}@e.org, no.x1", '<p><a href="http://www.c{c_custkey}.com">www.c{c_custkey}.com</a> or <a href="mailto:a.{c_custkey}@e.org">a.{c_custkey}@e.org</a>, no.x1</p>\n'),
    "escapes": (_PART, Engine, "\\*{p_name}\\* \\\\ \\x \\[a](b)", "<p>*{p_name}* \\ \\x [a](b)</p>\n"),
    "code_spans": (_PART, Engine, "`` `{p_name}` `` and `a\nb` ``open", "<p><code>`{p_name}`</code> and <code>a b</code> ``open</p>\n"),
    "images": (_PART, Engine, '![{p_name} *b* [c](d)](/i/{p_partkey}.png "a t")', '<p><img src="/i/{p_partkey}.png" alt="{p_name} b c" title="a t" /></p>\n'),
    "autolinks": (_CUSTOMER, Engine, "<http://e.org/{c_custkey}?a=b&c> <c{c_custkey}@e.org> <no link>", '<p><a href="http://e.org/{c_custkey}?a=b&amp;c">http://e.org/{c_custkey}?a=b&amp;c</a> <a href="mailto:c{c_custkey}@e.org">c{c_custkey}@e.org</a> <no link></p>\n'),
    "inline_html": (_CUSTOMER, Engine, 'a <b class="x">{c_name}</b> <!-- {c_custkey} --> z < y', '<p>a <b class="x">{c_name}</b> <!-- {c_custkey} --> z &lt; y</p>\n'),
    "entities": (_CUSTOMER, Engine, "{c_name} &amp; &copy; &#35; &#x41; &nope; &lt;", "<p>{c_name} &amp; © # A &amp;nope; &lt;</p>\n"),
    "line_breaks": (_PART, Engine, "{p_name}  \nb\\\nc\n   d", "<p>{p_name}<br />\nb<br />\nc\nd</p>\n"),
    "breaks_option": (_PART, lambda: Engine("default").update(breaks=True), "{p_name}\nb  \nc", "<p>{p_name}<br>\nb<br>\nc</p>\n"),
    "smart_quotes": (_PART, typed, "\"{p_name}\" isn't '{p_type}' *\"x\"* 5\"", "<p>“{p_name}” isn’t ‘{p_type}’ <em>“x”</em> 5&quot;</p>\n"),
    "typographic_signs": (_PART, typed, "{p_name}... b--c d -- e---f (r) \\(tm) ?.... !!!!!", "<p>{p_name}… b–c d – e—f ® (tm) ?.. !!!</p>\n"),
    "loose_lists": (_PART, Engine, "- {p_name}\n\n- b\n  - c\n\n  d", "<ul>\n<li>\n<p>{p_name}</p>\n</li>\n<li>\n<p>b</p>\n<ul>\n<li>c</li>\n</ul>\n<p>d</p>\n</li>\n</ul>\n"),
    "list_starts": (_PART, Engine, "7. {p_name}\n8. b\n\n+ c\n- d", '<ol start="7">\n<li>{p_name}</li>\n<li>b</li>\n</ol>\n<ul>\n<li>c</li>\n</ul>\n<ul>\n<li>d</li>\n</ul>\n'),
    "lazy_quotes": (_CUSTOMER, Engine, "> {c_name}\nlazy\n>> deep\n\nout", "<blockquote>\n<p>{c_name}\nlazy</p>\n<blockquote>\n<p>deep</p>\n</blockquote>\n</blockquote>\n<p>out</p>\n"),
    "fences": (_PART, Engine, "~~~ {p_type} x\n<{p_name}>\n~~~~\n```\nopen", '<pre><code class="language-{p_type}">&lt;{p_name}&gt;\n</code></pre>\n<pre><code>open\n</code></pre>\n'),
    "highlighted_code": (_PART, lambda: Engine().update(highlight=highlighted), "```x\n{p_name}\n```\n```\n{p_type}\n```", '<pre><code class="language-x"><mark>{p_name}</mark></code></pre>\n<pre><code>{p_type}\n</code></pre>\n'),
    "tables": (
        _PART, lambda: Engine("gfm-like"), "a | *b*\n:-:|--:\n{p_name} | x \\| y\n`{p_type}`",
        '<table>\n<thead>\n<tr>\n<th style="text-align:center">a</th>\n<th style="text-align:right"><em>b</em></th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td style="text-align:center">{p_name}</td>\n'
        '<td style="text-align:right">x | y</td>\n</tr>\n<tr>\n<td style="text-align:center"><code>{p_type}</code></td>\n<td style="text-align:right"></td>\n</tr>\n</tbody>\n</table>\n',
    ),
    "tables_before_lists": (_PART, lambda: Engine("default"), "- {p_name}|b\n---|---\n", "<table>\n<thead>\n<tr>\n<th>- {p_name}</th>\n<th>b</th>\n</tr>\n</thead>\n</table>\n"),
    "single_tildes": (_PART, lambda: Engine("gfm-like2"), "~{p_name}~ ~~b~~ ~~~c~~~", "<p><s>{p_name}</s> <s>b</s> ~~~c~~~</p>\n"),
    "zero_preset": (_PART, lambda: Engine("zero"), "# *{p_name}*\n\n- `b`", "<p># *{p_name}*</p>\n<p>- `b`</p>\n"),
    "disabled_rules": (_PART, lambda: Engine().disable(["emphasis", "list"]), "*{p_name}* **b**\n\n- c", "<p>*{p_name}* **b**</p>\n<p>- c</p>\n"),
    "mapping_preset": (_PART, lambda: Engine({"options": {"html": False}, "components": {"block": {"rules": ["heading", "paragraph"]}, "inline": {"rules": ["text"], "rules2": []}}}), "# {p_name}\n> *b*", "<h1>{p_name}</h1>\n<p>&gt; *b*</p>\n"),
    "plugins": (_PART, lambda: Engine().use(loud), "*{p_type}* `x`", "<p><em>{p_type}</em> <code>x</code></p>\n"),
    "nested_emphasis": (_PART, Engine, "***{p_name}** b* _c_d_ **e*f**", "<p><em><strong>{p_name}</strong> b</em> <em>c_d</em> <strong>e*f</strong></p>\n"),
    "link_destinations": (_CUSTOMER, Engine, "[{c_name}](/c/{c_custkey}) [a](<b c> 'd') [e](f(g(h))) [i](javascript:j)", f'<p>{_LINK} <a href="b%20c" title="d">a</a> <a href="f(g(h))">e</a> [i](javascript:j)</p>\n'),
    "link_definitions": (
        _CUSTOMER, Engine, "[x]: </c/{c_custkey}>\n  \"a\n  t\"\n[y]: javascript:z\n\n[{c_name}][X] [x] [y]", '<p>[y]: javascript:z</p>\n<p><a href="/c/{c_custkey}" title="a\nt">{c_name}</a> <a href="/c/{c_custkey}" title="a\nt">x</a> [y]</p>\n',
    ),
    "task_boxes": (
        _PART, lambda: Engine("gfm-like2"), "- [x] {p_name}\n- [ ] {p_type}\n- c",
        '<ul class="contains-task-list">\n<li class="task-list-item"><input class="task-list-item-checkbox" disabled="" type="checkbox" checked=""> {p_name}</li>\n'
        '<li class="task-list-item"><input class="task-list-item-checkbox" disabled="" type="checkbox"> {p_type}</li>\n<li>c</li>\n</ul>\n',
    ),
    "validated_links": (_CUSTOMER, lambda: Engine().update(validate_link=lambda url: url.startswith("/c/")), "[{c_name}](/c/{c_custkey}) [b](/d)", f"<p>{_LINK} [b](/d)</p>\n"),
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    (source, key), engine, text, _ = CASES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{source}.parquet")
        return engine().render(rows.select(F.col(key).alias("doc_id"), filled(text).alias("text")))

    run.__name__ = f"html_{name}"
    return run


QUERIES = {f"html_{name}": _query(name) for name in CASES}
ORACLE_SQL = {f"html_{name}": f"SELECT {key} AS doc_id, {filled_sql(html)} AS html FROM {source}" for name, ((source, key), _, _, html) in CASES.items()}

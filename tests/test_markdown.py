import json
import time

import pytest
from pyspark.sql import functions as F

from inkwell.engine import Engine
from inkwell.functions import attrs, links
from inkwell.functions import text as fn
from inkwell.operators import blocks, inlines, relations, render
from inkwell.plans.config import Syntax
from inkwell.sources import files
from inkwell.streaming import markdown as streaming

# (preset, source, HTML); cases of our own after the CommonMark and GFM specifications.
CASES = [
    ("commonmark", "# Title #\n\ntext\nmore\n===\n", "<h1>Title</h1>\n<h1>text\nmore</h1>\n"),
    ("commonmark", "- a\n- b\n\n  c\n", "<ul>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n<p>c</p>\n</li>\n</ul>\n"),
    ("commonmark", "- a\n  - b\n1. x\n2. y\n", "<ul>\n<li>a\n<ul>\n<li>b</li>\n</ul>\n</li>\n</ul>\n<ol>\n<li>x</li>\n<li>y</li>\n</ol>\n"),
    ("commonmark", "3) x\n", '<ol start="3">\n<li>x</li>\n</ol>\n'),
    ("commonmark", "> a\nlazy\n> > deep\n\nout\n", "<blockquote>\n<p>a\nlazy</p>\n<blockquote>\n<p>deep</p>\n</blockquote>\n</blockquote>\n<p>out</p>\n"),
    ("commonmark", "```js x\na < b\n```\n", '<pre><code class="language-js">a &lt; b\n</code></pre>\n'),
    ("commonmark", "~~~\nopen\n", "<pre><code>open\n</code></pre>\n"),
    ("commonmark", "\tcode\n\n\tmore\n\n", "<pre><code>code\n\nmore\n</code></pre>\n"),
    ("commonmark", "- x\n\n\ty\n", "<ul>\n<li>\n<p>x</p>\n<p>y</p>\n</li>\n</ul>\n"),
    ("commonmark", "a\n***\n- - -\n", "<p>a</p>\n<hr />\n<hr />\n"),
    ("commonmark", "<div>\n*x*\n</div>\n\n*y*\n", "<div>\n*x*\n</div>\n<p><em>y</em></p>\n"),
    ("commonmark", "*a **b** c* _d_ e_f_g ***h***\n", "<p><em>a <strong>b</strong> c</em> <em>d</em> e_f_g <em><strong>h</strong></em></p>\n"),
    ("commonmark", "`a ``b` ``c ` d``\n", "<p><code>a ``b</code> <code>c ` d</code></p>\n"),
    ("commonmark", "[a *b*](/u \"t\") ![x *y*](i.png) [z](<a b>)\n", '<p><a href="/u" title="t">a <em>b</em></a> <img src="i.png" alt="x y" /> <a href="a%20b">z</a></p>\n'),
    ("commonmark", "[a][Ref] [ref][] [REF] [none]\n\n[ref]: /r 'T'\n[ref]: /second\n", '<p><a href="/r" title="T">a</a> <a href="/r" title="T">ref</a> <a href="/r" title="T">REF</a> [none]</p>\n'),
    ("commonmark", "[x](javascript:a) <http://a.b?c=d&e> <me@x.org>\n", '<p>[x](javascript:a) <a href="http://a.b?c=d&amp;e">http://a.b?c=d&amp;e</a> <a href="mailto:me@x.org">me@x.org</a></p>\n'),
    ("commonmark", "a\\*b\\\nc  \nd &copy; &#0; <b>x</b>\n", "<p>a*b<br />\nc<br />\nd © � <b>x</b></p>\n"),
    ("commonmark", "| a |\n| - |\n", "<p>| a |\n| - |</p>\n"),
    ("default", "| a | b |\n| :-: | -: |\n| 1 \\| 2 | *x* | no |\n| 3\n", '<table>\n<thead>\n<tr>\n<th style="text-align:center">a</th>\n<th style="text-align:right">b</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td style="text-align:center">1 | 2</td>\n<td style="text-align:right"><em>x</em></td>\n</tr>\n<tr>\n<td style="text-align:center">3</td>\n<td style="text-align:right"></td>\n</tr>\n</tbody>\n</table>\n'),
    ("default", "~~gone~~ <b>\n", "<p><s>gone</s> &lt;b&gt;</p>\n"),
    ("gfm-like2", "- [x] done\n- [ ] open\n- plain\n", '<ul class="contains-task-list">\n<li class="task-list-item"><input class="task-list-item-checkbox" disabled="" type="checkbox" checked=""> done</li>\n<li class="task-list-item"><input class="task-list-item-checkbox" disabled="" type="checkbox"> open</li>\n<li>plain</li>\n</ul>\n'),
    ("gfm-like2", "> [!tip]\n> text\n", '<div class="markdown-alert markdown-alert-tip">\n<p class="markdown-alert-title">Tip</p>\n<p>text</p>\n</div>\n'),
    ("gfm-like2", "~a~ ~~b~~ ~~~c~~~\n", "<p><s>a</s> <s>b</s> ~~~c~~~</p>\n"),
    ("zero", "# *a*\n\n- b\n", "<p># *a*</p>\n<p>- b</p>\n"),
    ("commonmark", "", ""),
    ("commonmark", "a\r\nb\rc\x00", "<p>a\nb\nc�</p>\n"),
]


def test_html_of_every_preset(spark):
    for preset in sorted({c[0] for c in CASES}):
        mine = [(i, s, h) for i, (p, s, h) in enumerate(CASES) if p == preset]
        docs = spark.createDataFrame([(i, s) for i, s, _ in mine], "doc_id long, text string")
        got = {r["doc_id"]: r["html"] for r in Engine(preset).render(docs).collect()}
        assert got == {i: h for i, _, h in mine}


def test_rules_and_presets():
    base = Syntax.preset()
    assert base.active_rules()["core"] == ["normalize", "block", "inline", "text_join"]
    assert not base.active("block", "table") and base.enable("table").active("block", "table")
    both = base.enable("strikethrough")
    assert both.active("inline", "strikethrough") and both.active("inline2", "strikethrough")
    assert not base.disable(["emphasis"]).active("inline2", "emphasis") and base.active("inline", "emphasis")
    with pytest.raises(ValueError):
        base.enable("nonsense")
    assert base.enable("nonsense", ignore_invalid=True) == base
    with pytest.raises(KeyError):
        Syntax.preset("nonsense")
    assert Syntax.all_rules()["block"][0] == "table" and Syntax.preset("default").active_rules() == Syntax.all_rules()
    assert base.set(breaks=True).options["breaks"] and not base.options["breaks"]
    assert Syntax.preset("default").set(breaks=True).options["maxNesting"] == 20 and Syntax.preset("default").update(breaks=True).options["maxNesting"] == 100
    assert base.enable_only("paragraph", "block").active_rules()["block"] == ["paragraph"]
    own = Syntax.preset({"options": {"html": False}, "components": {"block": {"rules": ["heading", "paragraph"]}, "inline": {"rules": ["text"], "rules2": []}}})
    assert own.active_rules()["block"] == ["heading", "paragraph"] and own.active_rules()["inline2"] == [] and not own.options["html"] and own.active("core", "linkify")
    with pytest.raises(ValueError):
        Syntax.preset("")


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_relations(spark):
    docs = docs_of(spark, "# A `b`\n\nSee [x *y*](/u).\n\n![i](j.png)\n\n> - one\n> - two\n\n```py\nz\n```\n\n[l]: /1\n[L]: /2\n\n[q][gone]", None)
    engine = Engine("gfm-like")
    tokens = engine.parse(docs)
    assert [(r["level"], r["text"]) for r in relations.headings(tokens).collect()] == [(1, "A b")]
    assert [(r["href"], r["text"]) for r in relations.links(tokens).collect()] == [("/u", "x y")]
    assert [(r["src"], r["alt"]) for r in relations.images(tokens).collect()] == [("j.png", "i")]
    assert [(r["lang"], r["content"]) for r in relations.code(tokens).collect()] == [("py", "z\n")]
    assert [r["content"] for r in relations.list_items(tokens).orderBy("item_pos").collect()] == ["one", "two"]
    assert sorted((r["label"], r["href"], r["rn"]) for r in engine.definitions(docs).collect()) == [("L", "/1", 1), ("L", "/2", 2)]
    assert [r["label"] for r in engine.unresolved_references(docs).collect()] == ["GONE"]
    tree = {r["node_id"]: r for r in relations.nodes(tokens).collect()}
    items = [r for r in tree.values() if r["type"] == "list_item"]
    assert all(tree[r["parent_id"]]["type"] == "bullet_list" and tree[tree[r["parent_id"]]["parent_id"]]["type"] == "blockquote" for r in items)
    assert sorted(r["child_idx"] for r in items) == [0, 1] and sorted(r["close_pos"] - r["node_id"] for r in items) == [4, 4]
    leveled = render.levels(tokens)
    assert leveled.where("sub = 0").groupBy("doc_id").agg(F.sum("nesting")).first()[1] == 0 and leveled.agg(F.min("level")).first()[0] == 0


def test_shared_definitions_inline_only_and_render_rules(spark):
    shared = spark.createDataFrame([("Glob", "", "/g")], "label string, title string, href string")
    engine = Engine()
    html = engine.render(docs_of(spark, "[glob] and [own]\n\n[own]: /o"), shared=shared).first()["html"]
    assert html == '<p><a href="/g">glob</a> and <a href="/o">own</a></p>\n'
    assert engine.render(docs_of(spark, "# *a*"), inline_only=True).first()["html"] == "# <em>a</em>"
    shout = engine.add_render_rule("text", lambda t: F.upper("content")).use(lambda e: e.disable("emphasis"))
    assert shout.render(docs_of(spark, "a *b*")).first()["html"] == "<p>A *B*</p>\n"
    typed = Engine("default", {"typographer": True})
    assert typed.render(docs_of(spark, "(c) (TM) a--b c -- d ... !!!!! +-")).first()["html"] == "<p>© ™ a–b c – d … !!! ±</p>\n"


LINKED = [
    ("see http://a.com/x_y_z*. **https://b.org/c**", '<p>see <a href="http://a.com/x_y_z">http://a.com/x_y_z</a>*. <strong><a href="https://b.org/c">https://b.org/c</a></strong></p>\n'),
    ("www.a.org b.c a@b.net", '<p><a href="http://www.a.org">www.a.org</a> b.c <a href="mailto:a@b.net">a@b.net</a></p>\n'),
    ("[http://a.com](/u) a\\.com", '<p><a href="/u">http://a.com</a> a.com</p>\n'),
    ("http://☃.net/%D1%8F", '<p><a href="http://xn--n3h.net/%D1%8F">http://☃.net/я</a></p>\n'),
]


def test_bare_links_and_smart_quotes(spark):
    docs = docs_of(spark, *[s for s, _ in LINKED])
    assert [r["html"] for r in Engine("gfm-like").render(docs).orderBy("doc_id").collect()] == [h for _, h in LINKED]
    quoted = docs_of(spark, "\"a 'b' c\" isn't *\"d\"* 5\"\"", "'x")
    got = [r["html"] for r in Engine("default", {"typographer": True}).render(quoted).orderBy("doc_id").collect()]
    assert got == ["<p>“a ‘b’ c” isn’t <em>“d”</em> 5&quot;&quot;</p>\n", "<p>'x</p>\n"]


def test_pretty_tree_and_attributes(spark):
    tokens = Engine().parse(docs_of(spark, "# A\n\n- b ![c](d)"))
    assert relations.pretty(tokens, show_text=True).first()["tree"].split("\n") == [
        "<root>", "  <heading>", "    <inline>", "      <text>", "        A", "  <bullet_list>", "    <list_item>", "      <paragraph>", "        <inline>", "          <text>", "            b ", "          <image src='d' alt='c'>",
    ]
    df = spark.createDataFrame([([("a", "1"), ("b", "2")],)], "attrs array<struct<key:string,value:string>>")
    c = F.col("attrs")
    row = df.select(
        attrs.attr_index(c, "b").alias("i"), attrs.attr_index(c, "z").alias("none"), attrs.attr_get(c, "a").alias("g"), attrs.attr_set(c, "a", F.lit(9)).alias("s"), attrs.attr_join(c, "b", F.lit("x")).alias("j"),
        attrs.attr_join(c, "n", F.lit("y")).alias("n"), attrs.attrs_from_map(attrs.attrs_to_map(c)).alias("m"),
    ).first()
    assert (row["i"], row["none"], row["g"]) == (1, -1, "1")
    assert [tuple(x) for x in row["s"]] == [("a", "9"), ("b", "2")] and [tuple(x) for x in row["j"]] == [("a", "1"), ("b", "2 x")]
    assert [tuple(x) for x in row["n"]][-1] == ("n", "y") and [tuple(x) for x in row["m"]] == [("a", "1"), ("b", "2")]


def test_text_functions(spark):
    row = spark.createDataFrame([(" JavaScript:x", "data:image/png;y", " ẞ  a\n")], "a string, b string, c string").select(
        fn.validate_link(F.col("a")).alias("a"), fn.validate_link(F.col("b")).alias("b"), fn.normalize_reference(F.col("c")).alias("c"), fn.is_link_open(F.lit("<A href>")).alias("d"), fn.is_link_close(F.lit("</a >")).alias("e")
    ).first()
    assert tuple(row) == (False, True, "SS A", True, True)


def test_deep_nesting_is_bounded():
    syntax = Syntax.preset()
    assert blocks.tokens(blocks.fold(">" * 500 + " x", syntax), syntax)
    assert inlines._Scan("*" * 2000 + "a" + "*" * 2000, {}, syntax).run()
    assert inlines._Scan("[" * 3000 + "a" + "]" * 3000, {}, syntax).run()


def test_sources(spark, tmp_path):
    (tmp_path / "b.md").write_bytes(b"# x\x80y\n")
    (tmp_path / "a.md").write_bytes(b"z")
    rows = files.read_files(spark, [str(tmp_path / "b.md"), str(tmp_path / "a.md")]).orderBy("ord").collect()
    assert [(r["ord"], r["text"]) for r in rows] == [(0, "# xy\n"), (1, "z")]
    read = files.read_files(spark, [str(tmp_path / "b.md"), str(tmp_path / "a.md")])
    html = Engine().render(read.select(F.col("ord").alias("doc_id"), "text")).withColumnRenamed("doc_id", "ord")
    files.write_concatenated(html, str(tmp_path / "html"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "html").glob("part-*"))) == "<h1>xy</h1>\n<p>z</p>\n"
    (tmp_path / "cases.txt").write_text("first\n.\nin\n.\nout\n.\n\nsecond\n.\na\n\nb\n.\n.\n")
    got = files.read_cases(spark, str(tmp_path / "cases.txt")).orderBy("line").collect()
    assert [(r["line"], r["title"], r["input"], r["expected"]) for r in got] == [(1, "first", "in\n", "out\n"), (8, "second", "a\n\nb\n", "")]
    tokens = Engine().parse(docs_of(spark, "*a*"))
    files.write_tokens(tokens, str(tmp_path / "tokens"))
    assert files.read_tokens(spark, str(tmp_path / "tokens")).count() == tokens.count()


def test_streaming(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(0, "# a", "2024-01-01 00:01:00"), (1, "- b\n- c", "2024-01-01 00:12:00")], "doc_id long, text string, at string").withColumn("at", F.to_timestamp("at")).write.parquet(source)
    stream = spark.readStream.schema("doc_id long, text string, at timestamp").parquet(source)
    query = streaming.stream_blocks(stream).writeStream.format("memory").queryName("md_blocks").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("md_blocks").where("type = 'list_item_open'").count() == 2
    query = streaming.count_by_window(stream, "at").writeStream.outputMode("complete").format("memory").queryName("md_counts").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r["type"], r["count"]) for r in spark.table("md_counts").collect()} >= {("heading_open", 1), ("list_item_open", 2)}


# Cases of our own for rules that meet: (options, source, HTML).
MEETING = [
    ("default", {}, "-   a|b\n---|---\nc|d\n", "<table>\n<thead>\n<tr>\n<th>-   a</th>\n<th>b</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>c</td>\n<td>d</td>\n</tr>\n</tbody>\n</table>\n"),
    ("default", {}, "> x\n> # | y\n> --|--\n", "<blockquote>\n<p>x</p>\n<table>\n<thead>\n<tr>\n<th>#</th>\n<th>y</th>\n</tr>\n</thead>\n</table>\n</blockquote>\n"),
    ("default", {}, "a | b\n- | -\n", "<p>a | b</p>\n<ul>\n<li>| -</li>\n</ul>\n"),
    ("commonmark", {}, "[a]: javascript:x\n\n[a]\n", "<p>[a]: javascript:x</p>\n<p>[a]</p>\n"),
    ("commonmark", {}, "[a]: /u\n===\n[a]\n", '<p>===\n<a href="/u">a</a></p>\n'),
    ("commonmark", {}, "> [a]: /u\n[a]\n", '<blockquote></blockquote>\n<p><a href="/u">a</a></p>\n'),
    ("commonmark", {}, "> [a]: /u\n'title'\n\n[a]\n", '<blockquote></blockquote>\n<p><a href="/u" title="title">a</a></p>\n'),
    ("commonmark", {}, "[x](a(b(c(d)))) [y](a(b)\n", '<p><a href="a(b(c(d)))">x</a> [y](a(b)</p>\n'),
    ("default", {"typographer": True}, "\\(c) &#40;r) (tm) +- a..... b?... c!!!!!, d,,, e -- f--g---h ---- \\-- <x@y.org> <http://xn--n3h.net/--a>\n", '<p>(c) (r) ™ ± a… b?.. c!!!, d, e – f–g—h ---- -- <a href="mailto:x@y.org">x@y.org</a> <a href="http://xn--n3h.net/--a">http://☃.net/--a</a></p>\n'),
    ("default", {"linkify": True}, "go //xn--n3h.net/x now\n", '<p>go <a href="//xn--n3h.net/x">//☃.net/x</a> now</p>\n'),
    ("default", {"linkify": True, "html": True}, "</a>[http://a.org](http://a.org)\n", '<p></a><a href="http://a.org"><a href="http://a.org">http://a.org</a></a></p>\n'),
    ("commonmark", {"validate_link": lambda url: url.startswith("/")}, "[a](/ok) [b](http://no)\n", '<p><a href="/ok">a</a> [b](http://no)</p>\n'),
    ("commonmark", {"highlight": lambda content, lang: F.when(lang == "up", F.concat(F.lit("<i>"), F.upper(content), F.lit("</i>")))}, "```up\na\n```\n\n```\nb\n```\n", '<pre><code class="language-up"><i>A\n</i></code></pre>\n<pre><code>b\n</code></pre>\n'),
]


def test_rules_that_meet(spark):
    for preset, options, source, html in MEETING:
        assert Engine(preset, options).render(docs_of(spark, source)).first()["html"] == html, source
    indented = Engine().disable("code").render(docs_of(spark, "     ```x\n     y\n      ```\nz")).first()["html"]
    assert indented == '<pre><code class="language-x">y\n</code></pre>\n<p>z</p>\n'
    own = Engine().update(normalize_link=lambda url: "/n" + url, normalize_link_text=str.upper)
    assert own.render(docs_of(spark, "[a](/b) [c] <http://d>\n\n[c]: /e")).first()["html"] == '<p><a href="/n/b">a</a> <a href="/n/e">c</a> <a href="/nhttp://d">HTTP://D</a></p>\n'
    assert Engine().render_inline(docs_of(spark, "# *a*")).first()["html"] == "# <em>a</em>"


def test_labels_and_definitions_as_tokens(spark):
    engine = Engine().update(store_labels=True, inline_definitions=True)
    tokens = engine.parse(docs_of(spark, "[x][Foo]\n\n[foo]: /u 't'"))
    assert [r["meta"] for r in tokens.where("type = 'link_open'").collect()] == [{"label": "FOO"}]
    assert [r["meta"] for r in tokens.where("type = 'definition'").collect()] == [{"id": "FOO", "title": "t", "url": "/u", "label": "foo"}]
    assert engine.render(docs_of(spark, "[x][Foo]\n\n[foo]: /u 't'")).first()["html"] == '<p><a href="/u" title="t">x</a></p>\n'


def test_url_and_escape_columns(spark):
    df = spark.createDataFrame([("http://☃.net/a b%zz", "a \\* &amp; &#0; \\q", "☃.net", 0x1F600)], "u string, e string, h string, c int")
    u, e, h, c = map(F.col, "uehc")
    row = df.select(
        links.normalized_link(u).alias("a"), links.normalized_link_text(links.normalized_link(u)).alias("b"), links.unescaped(e).alias("c"), links.host_to_ascii(h).alias("d"), links.host_to_unicode(links.host_to_ascii(h)).alias("e"),
        links.from_code(c).alias("f"), links.from_code(F.lit(0xD800)).alias("g"), links.is_valid_code(F.lit(9)).alias("h"), links.is_valid_code(F.lit(0xFFFE)).alias("i"), links.normalized_link(F.lit(None).cast("string")).alias("j"),
    ).first()
    assert tuple(row) == ("http://xn--n3h.net/a%20b%25zz", "http://☃.net/a b%25zz", "a * & &#0; \\q", "xn--n3h.net", "☃.net", "😀", "\ufffd", True, False, None)


def test_tree_and_tokens_round_trip(spark):
    source = "# A *b*\n\n- x\n- y `z`\n\n> [l](/u)\n\n| a |\n|---|\n| b |\n"
    tokens = Engine("default").parse(docs_of(spark, source, "p"))
    blocks_only = tokens.where("sub = 0").drop("sub")
    back = relations.to_tokens(relations.nodes(tokens))
    key = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    assert key(back) == key(blocks_only.select(*back.columns))
    tree = relations.nodes(tokens, inline=True)
    rows = {r["node_id"]: r for r in tree.where("doc_id = 0").collect()}
    code = next(r for r in rows.values() if r["type"] == "code_inline")
    path, at = [], code["node_id"]
    while at != -1:
        path.append(rows[at]["type"])
        at = rows[at]["parent_id"]
    assert path == ["code_inline", "inline", "paragraph", "list_item", "bullet_list"] and code["content"] == "z"
    top = next(r for r in rows.values() if r["type"] == "bullet_list")
    below = relations.subtree(relations.nodes(tokens), spark.createDataFrame([(0, top["node_id"])], "doc_id long, node_id int"))
    quote = next(r for r in rows.values() if r["type"] == "blockquote")
    assert quote["previous_id"] == top["node_id"]
    assert relations.badly_nested(tokens).count() == 0
    assert [tuple(r) for r in relations.badly_nested(tokens.where("not (type = 'em_close' or type = 'blockquote_open')")).orderBy("pos").collect()] == [(0, None), (0, 1)]
    assert below.where("type = 'list_item'").count() in (0, 2)


def test_token_dictionaries(spark):
    tokens = Engine().parse(docs_of(spark, "# A *b*\n\n- [x](/u \"t\")", "", "p"))
    dicts = files.to_dicts(tokens)
    first = json.loads(dicts.where("doc_id = 0").first()["tokens"])
    assert [t["type"] for t in first][:3] == ["heading_open", "inline", "heading_close"] and first[0]["map"] == [0, 1] and first[0]["children"] is None and first[0]["block"]
    assert [(c["type"], c["level"], c["block"]) for c in first[1]["children"]] == [("text", 0, False), ("em_open", 0, False), ("text", 1, False), ("em_close", 0, False)]
    assert next(c for t in first for c in t["children"] or () if c["type"] == "link_open")["attrs"] == [["href", "/u"], ["title", "t"]]
    key = lambda df: sorted(map(repr, df.select(*sorted(tokens.columns)).collect()))
    assert key(files.from_dicts(dicts)) == key(tokens)


def test_definitions_in_linear_time():
    many = "".join(f"[l{i}]: /u{i} 'title {i}'\n" for i in range(50_000))
    began = time.process_time()
    found = blocks.tokens(blocks.fold(many + "\ntext", Syntax.preset()), Syntax.preset())
    assert time.process_time() - began < 5 and sum(t[1] == blocks.DEFINITION for t in found) == 50_000
    began = time.process_time()
    blocks.fold("> [a\n" + "lazy\n" * 20_000, Syntax.preset())
    assert time.process_time() - began < 5


def test_cells_of_several_tables(spark):
    engine = Engine("default")
    docs = docs_of(spark, "| a | b |\n|:-|-:|\n| 1 | *2* |\n| 3 |\n\ntext\n\n> | c |\n> |---|\n\n- | d | e | f |\n  |--|--|:-:|\n  | 4 | 5 | 6 | 7 |\n", "no table", "")
    slow = relations.table_cells(engine.parse(docs))
    fast = relations.cells(engine.nested_blocks(docs))
    key = lambda df: sorted(tuple(r) for r in df.select(*slow.columns).collect())
    assert key(fast) == key(slow) and fast.count() == 6 + 1 + 6

"""The registered queries of the Markdown engine and the SQL that gives the same rows.

Documents with structure are made from the relational tables, so the SQL can
state what parsing has to recover.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import attrs
from ..functions import links as links_fn
from ..functions import text as fn
from ..operators import blocks, lines, relations, render
from ..sources import files, sql
from . import rendered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(df: DataFrame, key: str, order: str, line: Column, sep: str = "\n") -> DataFrame:
    """(doc_id, text): a document per key, of a line per row in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"])
    return df.groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.array_join(lines, sep).alias("text"))


def _escaped(text: Column) -> Column:
    """A text as Markdown that means just its characters: lines without blanks at their ends, every ASCII punctuation mark behind a backslash."""
    return F.regexp_replace(F.regexp_replace(text, r"(?m)^[ \t]+|[ \t]+$", ""), r"([!-/:-@\[-`{-~])", r"\\$1")


def md_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per customer that names its nation: its heading and its HTML, from one parse."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.concat(F.lit("# "), "n_name", F.lit("\n\n"), _escaped(F.col("c_name")), F.lit(" in region "), "r_name")
    engine = Engine()
    parsed = engine.nested(named.select(F.col("c_custkey").alias("doc_id"), text.alias("text")))
    opener = F.get(F.filter("tokens", lambda t: t["type"] == "heading_open"), 0)
    said = F.get("children", opener["pos"] + 1)  # the inline token follows its opener
    heading = F.array_join(F.transform(F.filter(said, lambda c: c["type"] == "text"), lambda c: c["content"]), "")
    return parsed.select("doc_id", heading.alias("heading"), F.substring(opener["tag"], 2, 1).cast("int").alias("level"), render.html(engine.config()).alias("html"))


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    raw = F.regexp_replace(F.col("text"), "\n", "\r\n")
    return docs.select("doc_id", F.md5(fn.normalize(raw)).alias("digest"))


def escape_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", fn.escape_html(F.col("html")).alias("escaped"))


def line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return docs.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.length("line").cast("long").alias("n_chars"), (F.length("line") - F.length(F.ltrim("line"))).cast("long").alias("indent"))


def validate_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array("url", F.concat(F.lit(" JavaScript:"), "url"), F.concat(F.lit("data:image/png;"), "url"))).alias("url"))
    return urls.select("page_id", "url", fn.validate_link(F.col("url")).alias("valid"))


def normalize_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", fn.normalize_reference(F.concat(F.lit("  "), "p_name", F.lit("\t \n"), "p_type", F.lit(" "))).alias("label"))


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    row = F.concat(F.lit("| "), F.col("l_linenumber").cast("string"), F.lit(" | "), "l_returnflag", F.lit(" | "), "l_linestatus", F.lit(" |"))
    docs = _joined(items, "l_orderkey", "l_linenumber", row).withColumn("text", F.concat(F.lit("| n | flag | status |\n| -: | :-- | --- |\n"), "text"))
    cells = relations.cells(Engine("gfm-like").nested_blocks(docs))
    return cells.where("not is_header").select("doc_id", (F.col("row") - 1).cast("long").alias("row_no"), F.col("col").cast("long").alias("col_no"), "align", "content")


def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _joined(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", F.concat(F.lit("- line "), F.col("l_linenumber").cast("string")))
    return relations.list_items(Engine().nested_blocks(docs)).select("doc_id", "content", "marker", "tight")


def ordered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    docs = _joined(items, "l_orderkey", "l_linenumber", F.concat(F.col("l_linenumber").cast("string"), F.lit(") part "), F.col("l_partkey").cast("string")))
    found = relations.list_items(Engine().nested_blocks(docs))
    return found.select("doc_id", F.col("number").cast("long").alias("number"), "marker", "content")


def task_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    line = F.concat(F.when(F.col("o_orderstatus") == "F", "- [x] ").otherwise("- [ ] "), F.col("o_orderkey").cast("string"))
    found = relations.list_items(Engine("gfm-like2").nested_blocks(_joined(orders, "o_custkey", "o_orderkey", line)))
    return found.select("doc_id", F.col("content").cast("long").alias("o_orderkey"), "checked")


def code_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    docs = parts.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("```"), "p_type", F.lit("\n"), "p_name", F.lit("\n```\n")).alias("text"))
    return relations.code(Engine().nested_blocks(docs)).select(F.col("doc_id").alias("p_partkey"), "info", F.rtrim(F.regexp_replace("content", "\n", "")).alias("content"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    line = F.concat(F.lit("See [order "), key, F.lit("](/o/"), key, F.lit(' "is '), "o_orderpriority", F.lit('").'))
    docs = _joined(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", line)
    return relations.links(Engine().nested(docs)).select("doc_id", "href", "title", "text")


def _referring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per customer whose reference definitions name each priority once per order."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey").cast("string")
    uses = F.concat(F.lit("[order "), key, F.lit("]["), F.lower("o_orderpriority"), F.lit("]"))
    defined = F.concat(F.lit("["), "o_orderpriority", F.lit("]: /p/"), key)
    lines = _joined(orders, "o_custkey", "o_orderkey", uses).withColumnRenamed("text", "uses").join(_joined(orders, "o_custkey", "o_orderkey", defined).withColumnRenamed("text", "defined"), "doc_id")
    return lines.select("doc_id", F.concat("uses", F.lit("\n\n"), "defined").alias("text"))


def reference_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.links(Engine().nested(_referring(spark, sf_dir))).select("doc_id", "text", "href")


def duplicate_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Engine().definitions(_referring(spark, sf_dir))
    return found.groupBy("doc_id", "label").agg(F.max(F.when(F.col("rn") == 1, F.col("href"))).alias("href"), F.sum((F.col("rn") > 1).cast("long")).alias("n_duplicates"))


def unresolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    text = F.concat(F.lit("[a]["), "o_orderpriority", F.lit("] and [b][gone "), F.col("o_custkey").cast("string"), F.lit("] but \\[c][no]\n\n["), "o_orderpriority", F.lit("]: /n"))
    return Engine().unresolved_references(orders.select(F.col("o_orderkey").alias("doc_id"), text.alias("text")))


def emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    text = F.concat(F.lit("*"), "o_orderstatus", F.lit("* **"), F.substring("o_orderpriority", 3, 20), F.lit("** ~~"), F.col("o_custkey").cast("string"), F.lit("~~"))
    docs = orders.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))
    return relations.emphasis(Engine("gfm-like").nested(docs)).select("doc_id", "kind", "content")


def blockquote_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    docs = _joined(items, "l_orderkey", "l_linenumber", F.concat(F.expr("repeat('> ', l_linenumber)"), F.lit("line "), F.col("l_linenumber").cast("string"), F.lit("\n"), F.expr("trim(trailing ' ' from repeat('> ', l_linenumber))")))
    leveled = relations.leveled(Engine().nested_blocks(docs))
    return leveled.where("sub = 0 and type = 'inline'").select("doc_id", F.col("level").cast("long").alias("level"), "content")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "WARNING").when(F.col("o_orderstatus") == "O", "note").otherwise("Tip")
    docs = orders.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("> [!"), kind, F.lit("]\n> order")).alias("text"))
    return relations.alerts(Engine("gfm-like2").nested_blocks(docs)).select("doc_id", "kind")


def token_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _joined(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", F.concat(F.lit("- "), F.col("o_orderkey").cast("string")))
    leveled = relations.leveled(Engine().nested_blocks(docs)).where("sub = 0")
    return leveled.groupBy("type", "level").agg(F.count(F.lit(1)).alias("n")).select("type", F.col("level").cast("long").alias("level"), "n")


def tree_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _joined(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", F.concat(F.lit("- "), F.col("o_orderkey").cast("string")))
    items = relations.nodes(Engine().nested_blocks(docs)).where("type = 'list_item'")
    return items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.count("next_id").alias("n_next"), F.count("previous_id").alias("n_previous"), F.max("child_idx").cast("long").alias("last_idx"))


def documents_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The HTML of every document, its text taken literally: its paragraphs, with what HTML has to escape."""
    return Engine().render(table(spark, sf_dir, "documents").select("doc_id", _escaped(F.col("text")).alias("text")))


def conversations_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a quote of its literal text."""
    turns = table(spark, sf_dir, "conversations")
    quoted = F.concat(F.lit("> "), F.regexp_replace(_escaped(F.coalesce("text", F.lit(""))), "\n", "\n> "))
    docs = turns.select(F.struct("conv_id", "turn", "role").alias("doc_id"), quoted.alias("text"))
    return Engine("gfm-like").render(docs).select("doc_id.*", "html")


def documents_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token types of every document, whatever it holds."""
    tokens = Engine("gfm-like2").parse(table(spark, sf_dir, "documents"))
    return tokens.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def pages_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages as Markdown sources: their block tokens by type."""
    parsed = blocks.parse(table(spark, sf_dir, "pages"), id_col="page_id", text_col="html")
    return parsed.groupBy(F.col("doc_id").alias("page_id"), "type").agg(F.count(F.lit(1)).alias("n"))


def conversations_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a document: a heading per turn, its text as a quote."""
    turns = table(spark, sf_dir, "conversations")
    line = F.concat(F.lit("## "), "role", F.lit("\n\n> "), F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "\n> "), F.lit("\n"))
    docs = _joined(turns, "conv_id", "turn", line)
    return Engine().render(docs).select(F.col("doc_id").alias("conv_id"), "html")


def typographer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat("c_name", F.lit(" (c) +-5 ... -- wait")).alias("text"))
    return Engine("default", {"typographer": True}).render(docs)


def link_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of the pages with a path to encode: normal form, what a reader sees, host in ASCII and back."""
    urls = table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit("/é b%zz")).alias("url"))
    host = links_fn.host_to_ascii(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".b\u00fccher.example")))
    return urls.select(
        "page_id", links_fn.normalized_link(F.col("url")).alias("normal"), links_fn.normalized_link_text(links_fn.normalized_link(F.col("url"))).alias("shown"), host.alias("ascii_host"), links_fn.host_to_unicode(host).alias("host")
    )


def unescaped_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    tag = F.concat(F.element_at(F.array(*map(F.lit, ("<A", "<a>", "</a", "</A ", "<ab", "a"))), (F.col("p_partkey") % 6 + 1).cast("int")), F.when(F.col("p_partkey") % 6 == 0, " href=x").otherwise(""), F.lit(">"))
    return parts.select(
        "p_partkey", links_fn.unescaped(F.concat(F.lit("\\* "), "p_name", F.lit(" &amp; &#33; &#x0; \\a"))).alias("text"), links_fn.from_code(F.col("p_partkey") % 26 + 65).alias("letter"),
        links_fn.is_valid_code(F.col("p_partkey") % 40).alias("valid"), fn.is_link_open(tag).alias("opens"), fn.is_link_close(tag).alias("closes"),
    )


def inline_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return Engine().render_inline(parts.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("# *"), "p_name", F.lit("*\n- x")).alias("text")))


def shared_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose links name their customer by definitions that all documents share; an own definition goes before."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    text = F.concat(F.lit("[buyer][c"), F.col("o_custkey").cast("string"), F.lit("] [own]\n\n[own]: /o/"), F.col("o_orderkey").cast("string"))
    shared = customers.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("label"), F.lit(None).cast("string").alias("title"), F.concat(F.lit("/c/"), F.col("c_custkey").cast("string")).alias("href"))
    return relations.links(Engine().nested(orders.select(F.col("o_orderkey").alias("doc_id"), text.alias("text")), shared=shared)).select("doc_id", "text", "href")


def stored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    text = F.concat(F.lit("[x]["), "o_orderpriority", F.lit("]\n\n["), "o_orderpriority", F.lit("]: /p 'named "), F.col("o_custkey").cast("string"), F.lit("'"))
    tokens = Engine().update(store_labels=True, inline_definitions=True).parse(orders.select(F.col("o_orderkey").alias("doc_id"), text.alias("text")))
    return tokens.where("type in ('link_open', 'definition')").select("doc_id", "type", F.element_at("meta", "label").alias("label"), F.element_at("meta", "title").alias("title"))


def _customer_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", F.concat(F.lit("- *"), F.col("o_orderkey").cast("string"), F.lit("*")))


def tree_to_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to tokens to trees and back to tokens."""
    back = relations.to_tokens(relations.nodes(Engine().nested_blocks(_customer_lists(spark, sf_dir))))
    return back.groupBy("doc_id", "type", "nesting").agg(F.count(F.lit(1)).alias("n"), F.min("pos").cast("long").alias("first"))


def tree_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by type with the type of their parent, down to the inline tokens."""
    tree = relations.nodes(Engine().nested(_customer_lists(spark, sf_dir)), inline=True)
    above = tree.select("doc_id", F.col("node_id").alias("parent_id"), F.col("type").alias("parent"))
    return tree.join(above, ["doc_id", "parent_id"], "left").groupBy("type", F.coalesce("parent", F.lit("root")).alias("parent")).agg(F.count(F.lit(1)).alias("n"))


def subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first list item of each document and what lies below it."""
    tree = relations.nodes(Engine().nested_blocks(_customer_lists(spark, sf_dir)))
    return relations.subtree(tree, tree.where("type = 'list_item' and child_idx = 0")).select("doc_id", F.col("node_id").cast("long").alias("node_id"), "type", "content")


def pretty_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    docs = parts.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("> ["), "p_name", F.lit("](/p)")).alias("text"))
    return relations.pretty(Engine().nested(docs), show_text=True)


def token_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens to dictionaries and back."""
    back = files.from_dicts(files.to_dicts(Engine().nested(_customer_lists(spark, sf_dir))))
    return back.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))


def token_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    made = F.array(F.struct(F.lit("class").alias("key"), F.col("p_type").alias("value")))
    joined = attrs.attr_set(attrs.attr_join(made, "class", F.lit("x")), "id", F.col("p_partkey"))
    return parts.select("p_partkey", attrs.attr_get(joined, "class").alias("class"), attrs.attr_index(joined, "id").alias("at"), render.attributes(joined).alias("html"))


def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document with what its first characters say of it, before any container is looked into."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return docs.select("doc_id", F.col("line_no").cast("long").alias("line_no"), lines.line_class(F.col("line")).alias("class"))


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share their id: an order's heading under its customer's key."""
    text = F.concat(F.expr("repeat('#', int(o_orderkey % 6) + 1)"), F.lit(" *Order* `"), F.col("o_orderkey").cast("string"), F.lit("` #\n\ntext"))
    docs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), text.alias("text"))
    return relations.headings(Engine().nested(docs)).select("doc_id", "level", "text")


def links_of_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per order under its customer's key, every seventh without an id: links stay with their documents."""
    key = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("[a "), key, F.lit("](/a/"), key, F.lit(") *and* [b "), key, F.lit("](/b/"), key, F.lit(")"))
    docs = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 7 > 0, F.col("o_custkey")).alias("doc_id"), text.alias("text"))
    return relations.links(Engine().nested(docs)).select("doc_id", "href", "text")


def rules_of_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with two render rules."""
    text = F.concat(F.lit("# *o* "), F.col("o_orderkey").cast("string"), F.lit("\n\n```sql\nx\n```"))
    docs = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 7 > 0, F.col("o_custkey")).alias("doc_id"), text.alias("text"))
    shown = lambda t: F.concat(F.lit("<pre data-lang='"), F.element_at(t["meta"], "lang"), F.lit("'></pre>\n"))
    return Engine().use(rendered.loud).add_render_rule("fence", shown).render(docs)


def nesting_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline tokens whose closing tags were exchanged (finished orders) or whose last one was lost (open ones)."""
    orders = table(spark, sf_dir, "orders")
    docs = orders.select(F.struct("o_orderkey", "o_orderstatus").alias("doc_id"), F.concat(F.lit("***"), F.col("o_orderkey").cast("string"), F.lit("***")).alias("text"))
    crossed = lambda c: F.concat(F.slice(c, 1, 3), F.array(c[4], c[3]))
    status = F.col("doc_id.o_orderstatus")
    broken = F.transform("children", lambda c: F.when((F.size(c) == 5) & (status == "F"), crossed(c)).when((F.size(c) == 5) & (status == "O"), F.slice(c, 1, 4)).otherwise(c))
    found = relations.nesting_errors(Engine().nested(docs).withColumn("children", broken))
    return found.select(F.col("doc_id.o_orderkey").alias("doc_id"), F.col("at").cast("long").alias("sub"), "type", "problem")


def token_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task lists as VARIANT dictionaries: booleans read by path, and all of them from the token rows that come back."""
    orders = table(spark, sf_dir, "orders")
    line = F.concat(F.when(F.col("o_orderstatus") == "F", "- [x] ").otherwise("- [ ] "), F.col("o_orderkey").cast("string"))
    kept = files.to_variants(Engine("gfm-like2").nested(_joined(orders, "o_custkey", "o_orderkey", line)))
    first = kept.select("doc_id", F.variant_get("tokens", "$[1].meta.checked", "boolean").alias("first_checked"), F.variant_get("tokens", "$[0].map[1]", "long").alias("n_lines"), "tokens")
    items = files.from_variants(first.select(F.struct("doc_id", "first_checked", "n_lines").alias("doc_id"), "tokens")).where("type = 'list_item_open'")
    done = F.sum(F.variant_get("typed_meta", "$.checked", "boolean").cast("long"))
    return items.groupBy("doc_id").agg(done.alias("n_checked")).select("doc_id.*", "n_checked")


def sql_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parser as a table function, in SQL alone."""
    sql.register(spark)
    return spark.sql(f"""
        SELECT p_partkey, t.pos, t.sub, t.type, t.level, t.content, get(t.attrs, 0).value AS href
        FROM parquet.`{sf_dir}/part.parquet`, LATERAL markdown_tokens(concat('> [', p_name, '](/p/', p_partkey, ') ~~', p_type, '~~'), 'gfm-like') t
        WHERE t.nesting >= 0
    """)


def section_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long document per nation, parsed in sections: every heading with its line, and where the reference below it leads; the definitions stand in other sections, and code has what looks like headings."""
    customers, key = table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string")
    own = F.concat(F.lit("# "), "c_name", F.lit("\n\nsee [the "), key, F.lit("]\n\n```\n\n# no "), key, F.lit("\n```\n"))
    body, ends = _joined(customers, "c_nationkey", "c_custkey", own), _joined(customers, "c_nationkey", "c_custkey", F.concat(F.lit("[the "), key, F.lit("]: /c/"), key))
    docs = body.join(ends.withColumnRenamed("text", "ends"), "doc_id").select("doc_id", F.concat("text", F.lit("\n\n"), "ends").alias("text"))
    parts = Engine().sections(docs, least=40)
    href = lambda i: relations.value_of(F.get(F.filter(F.get("children", i + 4), lambda c: c["type"] == "link_open"), 0)["attrs"], "href")
    found = F.transform("tokens", lambda t, i: F.when(t["type"] == "heading_open", F.struct(t["line_begin"].cast("long").alias("line"), F.get("tokens", i + 1)["content"].alias("text"), href(i).alias("href"))))
    return parts.select("doc_id", F.inline(F.filter(found, lambda x: x.isNotNull())))


def blocks_by_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without containers, parsed by expressions over their lines."""
    parts = table(spark, sf_dir, "part")
    text = F.concat(F.lit("# "), "p_name", F.lit(" #\n"), "p_type", F.lit("\nmore\n---\n\n    code "), "p_name", F.lit("\n***\n```sql x\n# "), "p_type", F.lit("\n\n```\n"), "p_name")
    found = Engine().nested_blocks(parts.select(F.col("p_partkey").alias("doc_id"), text.alias("text")), by_lines=True)
    return found.select("doc_id", F.inline("tokens")).where("nesting >= 0").select("doc_id", "pos", "type", "tag", "line_begin", "line_end", "content", F.element_at("meta", "lang").alias("lang"))


QUERIES = {
    f.__name__: f
    for f in (
        md_nations, normalize_text, escape_html, line_index, validate_link, normalize_reference, table_cells, list_items, ordered_items, task_list, code_fences, links, reference_links,
        duplicate_references, unresolved_references, emphasis, blockquote_nesting, alerts, token_levels, tree_siblings, documents_paragraphs, documents_tokens, pages_html_blocks, conversations_render,
        conversations_quotes, typographer, link_columns, unescaped_text, inline_only, shared_definitions, stored_labels, tree_to_tokens, tree_children, subtrees, pretty_trees, token_dictionaries,
        token_attributes, line_classes, headings, links_of_repeated_ids, rules_of_repeated_ids, nesting_errors, token_variants, sql_tokens,
        section_headings, blocks_by_lines,
    )
}

#: Paragraphs of a literal text: lines without blanks at their ends, cut at blank lines, escaped for HTML.
_PARAGRAPHS = "list_transform(list_filter(regexp_split_to_array(regexp_replace({text}, '(?m)^[ \\t]+|[ \\t]+$', '', 'g'), '\\n\\n+'), lambda x: trim(x, chr(10)) <> ''), lambda x: '<p>' || replace(replace(replace(replace(trim(x, chr(10)), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</p>' || chr(10))"
ORACLE_SQL = {
    "md_nations": "SELECT c_custkey AS doc_id, n_name AS heading, CAST(1 AS INTEGER) AS level, '<h1>' || n_name || '</h1>' || chr(10) || '<p>' || c_name || ' in region ' || r_name || '</p>' || chr(10) AS html FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "normalize_text": "SELECT doc_id, md5(text) AS digest FROM documents",
    "escape_html": "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages",
    "line_index": "SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, length(lines[i]) AS n_chars, length(lines[i]) - length(ltrim(lines[i], ' ')) AS indent FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)",
    "validate_link": "SELECT page_id, url, NOT starts_with(lower(ltrim(url)), 'javascript:') AS valid FROM (SELECT page_id, unnest([url, ' JavaScript:' || url, 'data:image/png;' || url]) AS url FROM pages)",
    "normalize_reference": "SELECT p_partkey, upper(p_name || ' ' || p_type) AS label FROM part",
    "table_cells": "SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey, c ORDER BY l_linenumber, l_returnflag, l_linestatus) - 1 AS row_no, CAST(c AS BIGINT) AS col_no, ['right', 'left', ''][c + 1] AS align, [CAST(l_linenumber AS VARCHAR), l_returnflag, l_linestatus][c + 1] AS content FROM lineitem, (SELECT unnest([0, 1, 2]) AS c)",
    "list_items": "SELECT l_orderkey AS doc_id, 'line ' || CAST(l_linenumber AS VARCHAR) AS content, '-' AS marker, true AS tight FROM lineitem",
    "ordered_items": "SELECT l_orderkey AS doc_id, CAST(min(l_linenumber) OVER (PARTITION BY l_orderkey) AS BIGINT) * 0 + l_linenumber AS number, ')' AS marker, 'part ' || CAST(l_partkey AS VARCHAR) AS content FROM lineitem",
    "task_list": "SELECT o_custkey AS doc_id, o_orderkey, o_orderstatus = 'F' AS checked FROM orders",
    "code_fences": "SELECT p_partkey, trim(p_type) AS info, rtrim(p_name) AS content FROM part",
    "links": "SELECT o_custkey AS doc_id, '/o/' || CAST(o_orderkey AS VARCHAR) AS href, 'is ' || o_orderpriority AS title, 'order ' || CAST(o_orderkey AS VARCHAR) AS text FROM orders",
    "reference_links": "SELECT o_custkey AS doc_id, 'order ' || CAST(o_orderkey AS VARCHAR) AS text, '/p/' || CAST(min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS VARCHAR) AS href FROM orders",
    "duplicate_references": "SELECT o_custkey AS doc_id, upper(o_orderpriority) AS label, '/p/' || CAST(min(o_orderkey) AS VARCHAR) AS href, count(*) - 1 AS n_duplicates FROM orders GROUP BY 1, 2",
    "unresolved_references": "SELECT o_orderkey AS doc_id, 'GONE ' || CAST(o_custkey AS VARCHAR) AS label FROM orders",
    "emphasis": "SELECT o_orderkey AS doc_id, ['em', 'strong', 's'][k] AS kind, [o_orderstatus, substr(o_orderpriority, 3, 20), CAST(o_custkey AS VARCHAR)][k] AS content FROM orders, (SELECT unnest([1, 2, 3]) AS k)",
    "blockquote_nesting": "SELECT l_orderkey AS doc_id, CAST(l_linenumber + 1 AS BIGINT) AS level, 'line ' || CAST(l_linenumber AS VARCHAR) AS content FROM lineitem",
    "alerts": "SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'warning' WHEN 'O' THEN 'note' ELSE 'tip' END AS kind FROM orders",
    "token_levels": "WITH n AS (SELECT count(*) AS items, count(DISTINCT o_custkey) AS lists FROM orders) SELECT t AS type, CAST(l AS BIGINT) AS level, CASE WHEN t LIKE 'bullet%' THEN lists ELSE items END AS n FROM n, (VALUES ('bullet_list_open', 0), ('bullet_list_close', 0), ('list_item_open', 1), ('list_item_close', 1), ('paragraph_open', 2), ('paragraph_close', 2), ('inline', 3)) v(t, l)",
    "tree_siblings": "SELECT o_custkey AS doc_id, count(*) AS n_items, count(*) - 1 AS n_next, count(*) - 1 AS n_previous, count(*) - 1 AS last_idx FROM orders GROUP BY 1",
    "documents_paragraphs": f"SELECT doc_id, coalesce(array_to_string({_PARAGRAPHS.format(text='text')}, ''), '') AS html FROM documents",
    "typographer": "SELECT c_custkey AS doc_id, '<p>' || c_name || ' © ±5 … – wait</p>' || chr(10) AS html FROM customer",
    "conversations_quotes": f"SELECT conv_id, turn, role, CASE WHEN trim(coalesce(text, ''), ' ' || chr(9) || chr(10)) = '' THEN '<blockquote></blockquote>' ELSE '<blockquote>' || chr(10) || array_to_string({_PARAGRAPHS.format(text='text')}, '') || '</blockquote>' END || chr(10) AS html FROM conversations",
    "link_columns": "SELECT page_id, url || '/%C3%A9%20b%25zz' AS normal, url || '/é b%25zz' AS shown, 'p' || CAST(page_id AS VARCHAR) || '.xn--bcher-kva.example' AS ascii_host, 'p' || CAST(page_id AS VARCHAR) || '.bücher.example' AS host FROM pages",
    "unescaped_text": "SELECT p_partkey, '* ' || p_name || ' & ! &#x0; \\a' AS text, chr(CAST(p_partkey % 26 + 65 AS INTEGER)) AS letter, p_partkey % 40 IN (9, 10, 12, 13) OR p_partkey % 40 >= 32 AS valid, p_partkey % 6 IN (0, 1) AS opens, p_partkey % 6 IN (2, 3) AS closes FROM part",
    "inline_only": "SELECT p_partkey AS doc_id, '# <em>' || p_name || '</em>' || chr(10) || '- x' AS html FROM part",
    "shared_definitions": "SELECT o_orderkey AS doc_id, 'buyer' AS text, '/c/' || CAST(o_custkey AS VARCHAR) AS href FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT o_orderkey, 'own', '/o/' || CAST(o_orderkey AS VARCHAR) FROM orders",
    "stored_labels": "SELECT o_orderkey AS doc_id, 'link_open' AS type, upper(o_orderpriority) AS label, CAST(NULL AS VARCHAR) AS title FROM orders UNION ALL SELECT o_orderkey, 'definition', o_orderpriority, 'named ' || CAST(o_custkey AS VARCHAR) FROM orders",
    "tree_to_tokens": "WITH n AS (SELECT o_custkey AS doc_id, count(*) AS k FROM orders GROUP BY 1) SELECT doc_id, t AS type, CAST(g AS INTEGER) AS nesting, CASE WHEN t LIKE 'bullet%' THEN 1 ELSE k END AS n, CAST(CASE t WHEN 'bullet_list_close' THEN 5 * k + 1 ELSE f END AS BIGINT) AS first FROM n, (VALUES ('bullet_list_open', 1, 0), ('bullet_list_close', -1, 0), ('list_item_open', 1, 1), ('paragraph_open', 1, 2), ('inline', 0, 3), ('paragraph_close', -1, 4), ('list_item_close', -1, 5)) v(t, g, f)",
    "tree_children": "WITH n AS (SELECT count(*) AS items, count(DISTINCT o_custkey) AS lists FROM orders) SELECT t AS type, p AS parent, CASE WHEN p = 'root' THEN lists ELSE items END AS n FROM n, (VALUES ('bullet_list', 'root'), ('list_item', 'bullet_list'), ('paragraph', 'list_item'), ('inline', 'paragraph'), ('em', 'inline'), ('text', 'em')) v(t, p)",
    "subtrees": "SELECT o_custkey AS doc_id, CAST(k AS BIGINT) AS node_id, ['list_item', 'paragraph', 'inline'][k] AS type, CASE WHEN k = 3 THEN '*' || CAST(min(o_orderkey) AS VARCHAR) || '*' ELSE '' END AS content FROM orders, (SELECT unnest([1, 2, 3]) AS k) GROUP BY o_custkey, k",
    "pretty_trees": "SELECT p_partkey AS doc_id, '<root>' || chr(10) || '  <blockquote>' || chr(10) || '    <paragraph>' || chr(10) || '      <inline>' || chr(10) || '        <link href=''/p''>' || chr(10) || '          <text>' || chr(10) || '            ' || p_name AS tree FROM part",
    "token_dictionaries": "WITH n AS (SELECT o_custkey AS doc_id, count(*) AS k FROM orders GROUP BY 1) SELECT doc_id, t AS type, CASE WHEN t LIKE 'bullet%' THEN 1 ELSE k END AS n FROM n, (SELECT unnest(['bullet_list_open', 'bullet_list_close', 'list_item_open', 'list_item_close', 'paragraph_open', 'paragraph_close', 'inline', 'em_open', 'em_close', 'text']) AS t)",
    "token_attributes": "SELECT p_partkey, p_type || ' x' AS class, CAST(1 AS INTEGER) AS at, ' class=\"' || p_type || ' x\" id=\"' || CAST(p_partkey AS VARCHAR) || '\"' AS html FROM part",
    "line_classes": f"SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, {lines.line_class_sql('lines[i]')} AS class FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)",
}
ORACLE_SQL |= {
    "blocks_by_lines": "SELECT p_partkey AS doc_id, CAST(p AS INTEGER) AS pos, t AS type, g AS tag, CAST(b AS INTEGER) AS line_begin, CAST(e AS INTEGER) AS line_end, CASE c WHEN 'name' THEN rtrim(p_name) WHEN 'type' THEN p_type || chr(10) || 'more' WHEN 'code' THEN 'code ' || p_name || chr(10) WHEN 'fence' THEN '# ' || p_type || chr(10) || chr(10) ELSE '' END AS content, CASE WHEN t = 'fence' THEN 'sql' END AS lang FROM part, (VALUES (0, 'heading_open', 'h1', 0, 1, ''), (1, 'inline', '', 0, 1, 'name'), (3, 'heading_open', 'h2', 1, 4, ''), (4, 'inline', '', 1, 4, 'type'), (6, 'code_block', 'code', 5, 6, 'code'), (7, 'hr', 'hr', 6, 7, ''), (8, 'fence', 'code', 7, 11, 'fence'), (9, 'paragraph_open', 'p', 11, 12, ''), (10, 'inline', '', 11, 12, 'name')) v(p, t, g, b, e, c)",
    "section_headings": "SELECT CAST(c_nationkey AS BIGINT) AS doc_id, 9 * (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) AS line, c_name AS text, '/c/' || CAST(c_custkey AS VARCHAR) AS href FROM customer",
    "headings": "SELECT o_custkey AS doc_id, CAST(o_orderkey % 6 + 1 AS INTEGER) AS level, 'Order ' || CAST(o_orderkey AS VARCHAR) AS text FROM orders",
    "links_of_repeated_ids": "SELECT CASE WHEN o_orderkey % 7 > 0 THEN o_custkey END AS doc_id, '/' || k || '/' || CAST(o_orderkey AS VARCHAR) AS href, k || ' ' || CAST(o_orderkey AS VARCHAR) AS text FROM orders, (SELECT unnest(['a', 'b']) AS k)",
    "rules_of_repeated_ids": "SELECT CASE WHEN o_orderkey % 7 > 0 THEN o_custkey END AS doc_id, '<h1><em>O</em> ' || CAST(o_orderkey AS VARCHAR) || '</h1>' || chr(10) || '<pre data-lang=''sql''></pre>' || chr(10) AS html FROM orders",
    "nesting_errors": "SELECT o_orderkey AS doc_id, CAST(s AS BIGINT) AS sub, t AS type, p AS problem FROM orders JOIN (VALUES ('F', 5, 'em_close', 'crossed'), ('F', 4, 'strong_close', 'crossed'), ('O', 1, 'em_open', 'unclosed')) v(k, s, t, p) ON o_orderstatus = k",
    "token_variants": "SELECT o_custkey AS doc_id, arg_min(o_orderstatus, o_orderkey) = 'F' AS first_checked, count(*) AS n_lines, sum(CAST(o_orderstatus = 'F' AS BIGINT))::BIGINT AS n_checked FROM orders GROUP BY 1",
    "sql_tokens": "SELECT p_partkey, CAST(p AS INTEGER) AS pos, CAST(s AS INTEGER) AS sub, t AS type, CAST(l AS INTEGER) AS level, CASE c WHEN 'all' THEN '[' || p_name || '](/p/' || CAST(p_partkey AS VARCHAR) || ') ~~' || p_type || '~~' WHEN 'name' THEN p_name WHEN 'type' THEN p_type ELSE c END AS content, CASE WHEN t = 'link_open' THEN '/p/' || CAST(p_partkey AS VARCHAR) END AS href FROM part, (VALUES (0, 0, 'blockquote_open', 0, ''), (1, 0, 'paragraph_open', 1, ''), (2, 0, 'inline', 2, 'all'), (2, 1, 'link_open', 0, ''), (2, 2, 'text', 1, 'name'), (2, 4, 'text', 0, ' '), (2, 5, 's_open', 0, ''), (2, 6, 'text', 1, 'type')) v(p, s, t, l, c)",
}
QUERIES |= rendered.QUERIES
ORACLE_SQL |= rendered.ORACLE_SQL

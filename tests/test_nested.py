"""Relations, rules and trees over nested documents: repeated and null ids, no shuffle, nesting errors, scans over long arrays."""

import re

import pytest
from pyspark.sql import functions as F

from inkwell.engine import Engine
from inkwell.functions import arrays
from inkwell.operators import relations
from inkwell.sources import files

TEXTS = [(1, "# a [x](/1) *em*"), (1, "# c [y](/2) *fm*"), (None, "# n [z](/3)"), (None, ""), (2, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").coalesce(1)


def loud(rule):
    return Engine().add_render_rule("text", rule)


@pytest.mark.parametrize("rule", [lambda t: F.upper(t["content"]), lambda t: F.upper("content")])
def test_rules_and_ids(docs, rule):
    """A rule over the token's fields, and one that names columns."""
    got = sorted(((r["doc_id"] or 0, r["html"]) for r in loud(rule).render(docs).collect()))
    line = '<h1>{} <a href="/{}">{}</a>{}</h1>\n'
    assert got == sorted([(1, line.format("A", 1, "X", " <em>EM</em>")), (1, line.format("C", 2, "Y", " <em>FM</em>")), (0, line.format("N", 3, "Z", "")), (0, ""), (2, "")])


def shuffles(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line and "REPARTITION_BY_NUM" not in line]


def test_no_shuffle(docs):
    engine = Engine("gfm-like2")
    nested = engine.nested(docs)
    found = [
        loud(lambda t: F.upper(t["content"])).render(docs), engine.render(docs), files.to_dicts(nested), relations.leveled(nested), relations.nodes(nested), relations.nodes(nested, inline=True), relations.pretty(nested), relations.nesting_errors(nested),
        *[f(nested) for f in (relations.links, relations.headings, relations.list_items, relations.images, relations.code, relations.alerts, relations.paragraphs, relations.cells, relations.emphasis, relations.plain_text)],
    ]
    assert [shuffles(df) for df in found] == [[]] * len(found)


def test_relations_of_repeated_and_null_ids(docs):
    nested = Engine().nested(docs)
    assert sorted((r["doc_id"] or 0, r["href"], r["text"]) for r in relations.links(nested).collect()) == [(0, "/3", "z"), (1, "/1", "x"), (1, "/2", "y")]
    assert sorted((r["doc_id"] or 0, r["level"], r["text"]) for r in relations.headings(nested).collect()) == [(0, 1, "n z"), (1, 1, "a x em"), (1, 1, "c y fm")]
    assert sorted(r["tree"].count("<link") for r in relations.pretty(nested).collect()) == [0, 1, 1, 1]
    assert relations.nodes(nested).where("type = 'heading' and parent_id = -1 and child_idx = 0 and close_pos = 2 and next_id is null").count() == 3
    dicts = [r["tokens"] for r in files.to_dicts(nested).collect()]
    assert len(dicts) == 4 and sum(d.count("link_open") for d in dicts) == 3


TEXT = "# A *b* [c **d**](/u 't') ![i](j)\n\n- one\n\n  - two `x`\n- [ ] three\n  > q\n\n1. a\n2.\n\nafter\n\n|h|\n|-|\n|c|\n"


def test_rows_give_what_documents_give(spark):
    docs = spark.createDataFrame([(i, TEXT * (i + 1)) for i in range(3)], "doc_id long, text string")
    engine = Engine("gfm-like2")
    nested, rows = engine.nested(docs), engine.parse(docs)
    for f in (relations.links, relations.headings, relations.list_items, relations.images, relations.cells, relations.plain_text, relations.leveled, relations.pretty, relations.nodes, lambda t: relations.nodes(t, inline=True)):
        assert sorted(map(str, f(nested).collect())) == sorted(map(str, f(rows).collect()))
    assert relations.nesting_errors(nested).count() == relations.nesting_errors(rows).count() == 0


def test_items_end_where_they_end(spark):
    docs = spark.createDataFrame([(1, "-\n\nno item\n\n- a\n  - b\n\n  c\n- d")], "doc_id long, text string")
    found = relations.list_items(Engine().nested_blocks(docs)).orderBy("item_pos").collect()
    assert [r["content"] for r in found] == ["", "a", "b", "d"]


def test_tree_links_every_token(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    nested = Engine("gfm-like2").nested(docs)
    tree = {r["node_id"]: r for r in relations.nodes(nested, inline=True).collect()}
    tokens = nested.selectExpr("aggregate(transform(tokens, (t, i) -> 1 + size(children[i])), 0, (n, k) -> n + k) AS n").first()["n"]
    closers = nested.selectExpr("size(filter(tokens, t -> t.nesting = -1)) + size(filter(flatten(children), t -> t.nesting = -1)) AS n").first()["n"]
    assert len(tree) == tokens - closers
    for i, r in tree.items():
        family = sorted(k for k, x in tree.items() if x["parent_id"] == r["parent_id"])
        at = family.index(i)
        assert r["child_idx"] == at and r["previous_id"] == (family[at - 1] if at else None) and r["next_id"] == (family[at + 1] if at + 1 < len(family) else None)
        if r["parent_id"] >= 0:
            above = tree[r["parent_id"]]
            assert above["node_id"] < i and (above["type"] == "inline" or i < above["close_pos"])


def broken(spark, tags):
    """A document with one paragraph whose inline tokens are these: em+ opens, em- closes."""
    kids = [(k, t[:-1] + ("_open" if t[-1] == "+" else "_close"), t[:-1], 1 if t[-1] == "+" else -1) for k, t in enumerate(tags, 1)]
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    made = F.array(*[F.struct(F.lit(k).alias("sub"), F.lit(t).alias("type"), F.lit(tag).alias("tag"), F.lit(n).alias("nesting")) for k, t, tag, n in kids])
    nested = Engine().nested(docs)
    kind = nested.schema["children"].dataType.elementType.elementType
    other = {f.name: F.lit(None).cast(f.dataType) for f in kind.fields}
    full = F.transform(made, lambda m: F.struct(*[(m[f.name] if f.name in ("sub", "type", "tag", "nesting") else other[f.name]).alias(f.name) for f in kind.fields]))
    return nested.withColumn("children", F.transform("children", lambda c, i: F.when(F.size(c) > 0, full).otherwise(c)))


@pytest.mark.parametrize(
    ("tags", "errors"),
    [
        (["em+", "strong+", "strong-", "em-"], []),
        (["em+", "strong+", "em-", "strong-"], [(3, "em_close", "crossed"), (4, "strong_close", "crossed")]),
        (["em+", "a+", "a-"], [(1, "em_open", "unclosed")]),
        (["em-", "em+", "em-", "s-"], [(1, "em_close", "unopened"), (4, "s_close", "unopened")]),
        (["em+", "em+", "em-"], [(1, "em_open", "unclosed")]),
    ],
)
def test_nesting_errors(spark, tags, errors):
    nested = broken(spark, tags)
    found = relations.nesting_errors(nested).collect()
    assert sorted((r["at"], r["type"], r["problem"]) for r in found) == errors and all(r["pos"] == 1 for r in found)
    assert [tuple(r) for r in relations.badly_nested(nested).collect()] == ([(1, 1)] if errors else [])


def test_scans_over_many_pieces(spark):
    n = arrays.PIECE * 5 + 3
    rows = spark.range(1).select(F.sequence(F.lit(1), F.lit(n)).alias("a"), F.array().cast("array<int>").alias("none"), F.lit(None).cast("array<int>").alias("null"))
    total = lambda c: arrays.scanned(F.col(c), F.lit(0), lambda s, x: s + x, lambda s, x: s, "int")
    got = rows.select(*[total(c).alias(c) for c in ("a", "none", "null")]).first()
    assert got["a"] == [k * (k + 1) // 2 for k in range(n)] and got["none"] == [] and got["null"] == []


def test_long_documents(spark):
    docs = spark.createDataFrame([(1, "- *a*\n\n" * 4000)], "doc_id long, text string")
    nested = Engine().nested(docs)
    assert relations.nodes(nested).where("type = 'list_item'").agg(F.max("child_idx")).first()[0] == 3999
    assert len(re.findall("<list_item", relations.pretty(nested).first()["tree"])) == 4000

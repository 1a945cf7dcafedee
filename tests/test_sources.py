"""Numbered files, VARIANT dictionaries, the table function, lookups of hot keys and definitions in a stream."""

import datetime

import pytest
from pyspark.sql import functions as F

from inkwell.engine import Engine
from inkwell.functions import joins
from inkwell.operators import inlines, relations
from inkwell.sources import files, sql
from inkwell.streaming import markdown


def no_single_task(df):
    return "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [100_000, 3])
def test_files_are_numbered_by_many_tasks(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(files, "MAX_BROADCAST_FILES", most)
    for folder, names in (("b", "xyz"), ("a", "pq")):
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / f"{n}.md").write_bytes(f"# {folder}{n}".encode() + b"\xff")
    found = files.read_files(spark, [str(tmp_path / "b"), str(tmp_path / "a")])
    assert no_single_task(found)
    assert [(r["ord"], r["text"]) for r in found.orderBy("ord").collect()] == list(enumerate(["# bx", "# by", "# bz", "# ap", "# aq"]))


def test_ranks_have_no_gaps(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("tie"))
    got = files.ranked(rows, ["tie", "k"])
    assert no_single_task(got)
    assert [(r["tie"], r["k"]) for r in got.orderBy("ord").collect()] == sorted((r["tie"], r["k"]) for r in rows.collect())
    assert sorted(r["ord"] for r in got.collect()) == list(range(1000))


TEXT = "- [x] *a* [l](u 't')\n- [ ] b\n\n```py x\ncode\n```\n\n![i](j)\n"


def test_variants_keep_types(spark):
    docs = spark.createDataFrame([(1, TEXT), (1, "again"), (None, "> q"), (2, "")], "doc_id long, text string")
    nested = Engine("gfm-like2").nested(docs)
    kept = files.to_variants(nested)
    assert dict(kept.dtypes)["tokens"] == "variant"
    first = kept.where(F.variant_get("tokens", "$[1].meta.checked", "boolean")).select(F.variant_get("tokens", "$[0].map[1]", "int").alias("lines"), F.schema_of_variant(F.variant_get("tokens", "$[1].meta", "variant")).alias("meta")).collect()
    assert [tuple(r) for r in first] == [(2, "OBJECT<checked: BOOLEAN>")]
    back = files.from_variants(kept)
    as_rows = lambda df: sorted(str(r.asDict()) for r in df.collect())
    columns = [c for c in inlines.rows(nested).columns if c != "doc_id"]
    assert as_rows(back.select("doc_id", *columns)) == as_rows(inlines.rows(nested).select("doc_id", *columns))
    assert back.where(F.variant_get("typed_meta", "$.checked", "boolean")).count() == 1


def test_variants_of_others(spark):
    """Objects written by another tool, with numbers and lists in ``meta``."""
    one = '[{"type":"x","tag":"t","nesting":0,"attrs":[["a","b"]],"map":[3,4],"level":0,"content":"c","markup":"","info":"","meta":{"n":5,"l":[1,2]},"block":true,"hidden":false,"children":null}]'
    rows = files.from_variants(spark.createDataFrame([(1, one)], "doc_id long, t string").select("doc_id", F.parse_json("t").alias("tokens")))
    got = rows.select("type", "line_begin", "attrs", F.variant_get("typed_meta", "$.n", "int").alias("n"), F.variant_get("typed_meta", "$.l[1]", "int").alias("l"), F.element_at("meta", "n").alias("said")).first()
    assert (got["type"], got["line_begin"], got["n"], got["l"], got["said"]) == ("x", 3, 5, 2, "5") and got["attrs"][0]["value"] == "b"


def test_table_function(spark):
    sql.register(spark, plain=Engine("gfm-like").disable("emphasis"))
    docs = spark.createDataFrame([(1, "# *a*\r\n\x00"), (1, TEXT), (None, "b"), (2, None), (3, "")], "id long, body string")
    docs.createOrReplaceTempView("sources")
    names = "pos, sub, type, tag, nesting, level, attrs, line_begin, line_end, content, markup, info, hidden, meta"
    got = spark.sql(f"SELECT d.id AS doc_id, t.* FROM sources d, LATERAL markdown_tokens(d.body, 'gfm-like2') t").select("doc_id", *names.split(", "))
    want = relations.leveled(Engine("gfm-like2").nested(docs, id_col="id", text_col="body")).select("doc_id", *names.split(", "))
    as_rows = lambda df: sorted(str(r.asDict()) for r in df.collect())
    assert as_rows(got) == as_rows(want) and got.where("content like '%�%'").count() > 0
    plain = spark.sql("SELECT t.type FROM sources d, LATERAL markdown_tokens(d.body, 'plain') t WHERE t.sub > 0 AND t.type LIKE 'em%'")
    assert plain.count() == 0
    with pytest.raises(Exception, match="no such preset"):
        spark.sql("SELECT * FROM markdown_tokens('a', 'nothing')").collect()


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys(spark, how):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(0, 16_000, 1, 8).select("id", F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 1001 != 0, F.concat(F.lit("k"), F.col("id") % 2003)).alias("label"))
        table = rows.select("label").distinct().where("label is not null and label <> 'k7'").withColumn("to", F.concat(F.lit("/"), "label"))
        got = joins.looked_up(rows, table, "label", how)
        plain = rows.join(table, "label", how).select("id", "label", "to")
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
        sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect())
        assert sizes[-1] <= 2 * sizes[len(sizes) // 2] + 200  # half of all rows have one label
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("most", [100_000, 0])
def test_shared_definitions_whatever_the_ids(spark, monkeypatch, most):
    monkeypatch.setattr(inlines, "MAX_BROADCAST_LABELS", most)
    docs = spark.createDataFrame([(1, "[x] [A b]"), (1, "[y]"), (None, "[x]"), (None, "[x]\n\n[X]: /own"), (3, "none")] + [(k, "[x] [n]") for k in range(10, 60)], "doc_id long, text string")
    shared = spark.createDataFrame([("X", "t", "/x"), ("a  B", None, "/ab"), ("y", None, "/y2"), ("Y", None, "/y1"), ("n", None, "javascript:1")], "label string, title string, href string")
    got = sorted((r["doc_id"] or 0, r["href"], r["title"]) for r in relations.links(Engine().nested(docs, shared=shared)).collect())
    assert got == sorted([(1, "/x", "t"), (1, "/ab", None), (1, "/y1", None), (0, "/x", "t"), (0, "/own", None)] + [(k, "/x", "t") for k in range(10, 60)])
    assert relations.links(Engine().nested(docs, shared=shared.limit(0))).count() == 1


def test_first_definition_wins_in_a_stream(spark, tmp_path):
    """Documents that arrive in another order than they were written; one comes too late."""
    at = lambda minute: datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=minute)
    source, key = str(tmp_path / "in"), "spark.sql.streaming.stateStore.providerClass"
    (tmp_path / "in").mkdir()
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("ts timestamp, name string, text string").option("maxFilesPerTrigger", 1).json(source)
    query = markdown.stream_definitions(stream, "ts", late="10 minutes", id_col="name").writeStream.format("memory").queryName("defined").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for rows in (
            [(at(10), "b", "[a]: /second\n\n[b]: /b\n[b]: /b-again"), (at(10), None, "no definition"), (None, "z", "[a]: /no-time")],
            [(at(5), "a", "[A]: /first 'T'")],
            [(at(8), "c", "[a]: /third")],
            [(at(40), "d", "[c]: /c\n\n[a]: /late")],
            [(at(2), "e", "[a]: /too-late\n\n[d]: /never")],
            [(at(80), "f", "[e]: /open")],
        ):
            spark.createDataFrame(rows, "ts timestamp, name string, text string").coalesce(1).write.mode("append").json(source)
            query.processAllAvailable()
        got = {(r["label"], r["href"], r["title"], r["doc_id"], r["ts"]) for r in spark.table("defined").collect()}
    finally:
        query.stop()
        spark.conf.unset(key)
    assert got == {("A", "/first", "T", "a", at(5)), ("B", "/b", "", "b", at(10)), ("C", "/c", "", "d", at(40))}

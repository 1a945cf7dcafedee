"""Sources and sinks of documents."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays
from ..functions.arrays import let
from ..operators import relations
from ..operators.blocks import DEFINITION


@F.pandas_udf(T.StringType())
def _decoded(data: pd.Series) -> pd.Series:
    return data.map(lambda x: bytes(x).decode("utf-8", "ignore"), na_action="ignore")


#: File lists up to this number of paths travel to the tasks that read the contents; with more, contents meet their numbers by a join.
MAX_BROADCAST_FILES = 100_000


def ranked(rows: DataFrame, order: list[str], name: str = "ord") -> DataFrame:
    """``rows`` numbered from 0 in the order of these columns, without gaps and by many tasks: rows are dealt out by ranges, counted by range, and a row's number is its place in its range behind the sum of the counts before.

    ``rows`` is read three times (for the ranges, the counts and the numbers) and has to give the same rows each time. Tied rows have some order.
    """
    dealt = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    counts = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}  # a number per task
    before, starts = 0, []
    for part in sorted(counts):
        starts.append((part, before))
        before += counts[part]
    offsets = rows.sparkSession.createDataFrame(starts, "_part int, _before long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_before") + place).cast("long")).drop("_part", "_before")


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(ord, path, text): one row per file, numbered in the order of the arguments, then by path. Bytes that are no UTF-8 are dropped.

    Only the list of paths is sorted, by many tasks. Its length is counted: up to MAX_BROADCAST_FILES it is sent to the tasks that read the
    contents, which stay where they are read; beyond, contents are shuffled once to meet their numbers.
    """
    parts = [spark.read.format("binaryFile").load(path).withColumn("arg", F.lit(k)) for k, path in enumerate(paths)]
    if not parts:
        return spark.createDataFrame([], "ord long, path string, text string")
    found = functools.reduce(DataFrame.unionByName, parts)
    listed = found.select("arg", "path")
    few = listed.limit(MAX_BROADCAST_FILES + 1).count() <= MAX_BROADCAST_FILES
    numbered = ranked(listed, ["arg", "path"])
    return found.join(F.broadcast(numbered) if few else numbered.hint("shuffle_hash"), ["arg", "path"]).select("ord", "path", _decoded("content").alias("text"))


def write_concatenated(rendered: DataFrame, path: str) -> None:
    """The HTML of files (ord, html) as text files that follow each other in the order of ``ord``; every HTML ends with a line end."""
    whole = rendered.where("html <> ''").repartitionByRange("ord").sortWithinPartitions("ord")
    whole.select(F.regexp_replace("html", r"\n\z", "").alias("value")).write.mode("overwrite").text(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(line, title, input, expected) of a fixture file: sections end at lines that are a single dot, three to a case."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return cases(lines)


def cases(lines: DataFrame) -> DataFrame:
    """The same for a DataFrame (line, value) of one file."""
    order = Window.orderBy("line")  # one fixture file
    dots = F.sum((F.col("value") == ".").cast("int")).over(order)
    rows = lines.withColumn("dots", dots).withColumn("title", F.lag("value").over(order))
    rows = rows.withColumns({"case": F.floor((F.col("dots") - 1) / 3), "part": F.pmod(F.col("dots") - 1, F.lit(3))}).where("dots > 0")
    text = lambda n: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("part") == n) & (F.col("value") != "."), F.struct("line", "value")))), lambda x: F.concat(x["value"], F.lit("\n"))), "")
    start: Column = (F.col("part") == 0) & (F.col("value") == ".")
    return rows.groupBy("case").agg(F.min(F.when(start, F.col("line"))).alias("line"), F.min_by("title", F.when(start, F.col("line"))).alias("title"), text(0).alias("input"), text(1).alias("expected"), F.max("part").alias("last")).where("last = 2").drop("last", "case")


def write_tokens(tokens: DataFrame, path: str) -> None:
    tokens.write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


#: A token as a dictionary; ``children`` of inline tokens are of the same form without children.
_CHILD = "type string, tag string, nesting int, attrs array<array<string>>, map array<int>, level int, content string, markup string, info string, meta map<string,string>, block boolean, hidden boolean"
_DICT_FIELDS = [field.split(" ")[0] for field in _CHILD.split(", ")]
_DICT = f"array<struct<{_CHILD.replace(', ', ',').replace(' ', ':')},children:array<struct<{_CHILD.replace(', ', ',').replace(' ', ':')}>>>>"


def _dict(t: Column, level: Column, block: bool) -> list[Column]:
    none = F.lit(None).cast("int")
    begin, end, hidden = (t["line_begin"], t["line_end"], t["hidden"]) if block else (none, none, F.lit(False))
    return [
        t["type"].alias("type"), t["tag"].alias("tag"), t["nesting"].alias("nesting"), F.when(F.size(t["attrs"]) > 0, F.transform(t["attrs"], lambda a: F.array(a["key"], a["value"]))).alias("attrs"),
        F.when(begin.isNotNull(), F.array(begin, end)).alias("map"), level.alias("level"), t["content"].alias("content"), t["markup"].alias("markup"), t["info"].alias("info"),
        F.coalesce(t["meta"], F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("meta"), F.lit(block).alias("block"), hidden.alias("hidden"),
    ]


def dictionaries(tokens: Column, children: Column) -> Column:
    """The tokens of a nested document as an array of dictionaries, inline tokens with their children: an expression, no shuffle."""
    kids = lambda c: let(arrays.levels(c), lambda deep: F.transform(c, lambda t, k: F.struct(*_dict(t, F.get(deep, k), False))))
    one = lambda t, c, level: F.struct(*_dict(t, level, True), F.when(t["type"] == "inline", kids(c)).alias("children"))
    every = let(arrays.levels(tokens), lambda deep: F.transform(tokens, lambda t, i: F.when(t["type"] != DEFINITION, one(t, F.get(children, i), F.get(deep, i)))))
    return F.filter(every, lambda d: d.isNotNull())


def to_dicts(tokens: DataFrame) -> DataFrame:
    """(doc_id, tokens): all tokens of a document as a JSON list of dictionaries, from nested documents or token rows."""
    every = dictionaries(F.col("tokens"), F.col("children"))
    return relations.gathered(tokens).select("doc_id", F.to_json(every, {"ignoreNullFields": "false"}).alias("tokens"))


def from_dicts(rows: DataFrame) -> DataFrame:
    """Token rows of (doc_id, tokens) as ``to_dicts`` gives them."""
    return _token_rows(rows.select("doc_id", F.posexplode(F.from_json("tokens", _DICT)).alias("pos", "d")))


def _token_rows(listed: DataFrame, typed: bool = False) -> DataFrame:
    """Token rows of (doc_id, pos, d): a dictionary and its children one after the other, without a shuffle."""
    meta = lambda d: F.coalesce(d["meta"].cast("map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))) if typed else d["meta"]
    fields = lambda d, sub: F.struct(
        sub.alias("sub"), d["type"].alias("type"), d["tag"].alias("tag"), d["nesting"].alias("nesting"),
        F.coalesce(F.transform(d["attrs"], lambda a: F.struct(a[0].alias("key"), a[1].alias("value"))), F.array().cast("array<struct<key:string,value:string>>")).alias("attrs"), d["map"][0].alias("line_begin"),
        d["map"][1].alias("line_end"), d["content"].alias("content"), d["markup"].alias("markup"), d["info"].alias("info"), d["hidden"].alias("hidden"), meta(d).alias("meta"), *([d["meta"].alias("typed_meta")] if typed else []),
    )
    first = F.array(fields(F.col("d"), F.lit(0)))
    kids = F.coalesce(F.transform("d.children", lambda c, k: fields(c, k + 1)), F.filter(first, lambda x: F.lit(False)))
    return listed.select("doc_id", "pos", F.inline(F.concat(first, kids)))


#: A dictionary read back from VARIANT: ``meta`` is an object of its own.
_TYPED = f"array<struct<{_CHILD.replace('meta map<string,string>', 'meta variant').replace(', ', ',').replace(' ', ':')},children:array<struct<{_CHILD.replace('meta map<string,string>', 'meta variant').replace(', ', ',').replace(' ', ':')}>>>>"


def to_variants(tokens: DataFrame) -> DataFrame:
    """(doc_id, tokens): what ``to_dicts`` gives, as a VARIANT: paths reach into it (``variant_get(tokens, '$[0].meta.checked', 'boolean')``), numbers stay numbers and booleans booleans, also in ``meta``."""
    typed = lambda meta: F.transform_values(meta, lambda k, v: F.when(k == "checked", F.try_parse_json(v)).otherwise(v.cast("variant")))
    one = lambda d, more: F.struct(*[(typed(d["meta"]) if c == "meta" else d[c]).alias(c) for c in _DICT_FIELDS], *more)
    every = F.transform(dictionaries(F.col("tokens"), F.col("children")), lambda d: one(d, [F.transform(d["children"], lambda c: one(c, [])).alias("children")]))
    return relations.gathered(tokens).select("doc_id", F.to_variant_object(every).alias("tokens"))


def from_variants(rows: DataFrame) -> DataFrame:
    """Token rows of (doc_id, tokens) as ``to_variants`` gives them, or any tool that writes such objects. ``meta`` holds strings as in all token rows, ``typed_meta`` the VARIANT itself."""
    read = F.variant_get("tokens", "$", _TYPED)
    return _token_rows(rows.select("doc_id", F.posexplode(read).alias("pos", "d")), typed=True)

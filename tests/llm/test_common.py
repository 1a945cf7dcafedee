from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from inkwell.llm import common


def test_lookup_with_hot_keys_equals_a_join(spark, monkeypatch):
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("key"))
    table = spark.range(800).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.col("id").alias("value")).unionByName(spark.createDataFrame([("hot", None)], "key string, value long"))
    for most in (1000, 2, 10**9):
        monkeypatch.setattr(common, "HOT_KEYS", most)
        found = common.looked_up(rows, table, ["key"])
        assert found.columns == ["id", "key", "value"]
        assert sorted(map(repr, found.collect())) == sorted(map(repr, rows.join(table, "key").select("id", "key", "value").collect()))
    assert common.looked_up(rows.limit(0), table, ["key"]).count() == 0


def test_packed_rows_come_back_whole(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a.b", "Row", "x`y"])
    out = common.unpacked(common.packed(df), df.columns, {"row": F.lit(9)}, {"a.b": F.lit(7)})
    assert out.columns == ["a.b", "x`y", "row"] and tuple(out.first()) == (7, 3, 9)


def test_a_cluster_without_a_shared_folder_is_an_error():
    conf = SimpleNamespace(get=lambda key: None)
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        common.shared_dir(SimpleNamespace(sparkContext=sc))


def test_scratch_deletes_what_was_written(spark):
    with common.scratch(spark):
        kept = common.materialise(spark.range(3), "test")
        assert kept.count() == 3
        path = kept.inputFiles()[0]
    with pytest.raises(Exception, match="(?i)not.exist"):
        spark.read.parquet(path).count()

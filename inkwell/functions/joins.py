"""A join that hot keys do not slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot above this share of all rows, so there are fewer hot keys than this.
SHARES = 1000


def looked_up(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table``, in which a key stands once, however many rows share a key; ``how`` is inner or left.

    Rows are counted by key (map-side first). Keys with more than a SHARES-th of all rows, so fewer than SHARES of them, travel to every task with
    their row of ``table``; only rows of other keys are shuffled. Rows without a key keep their place with ``left`` and go with ``inner``.
    """
    value = F.struct(*[c for c in table.columns if c != key])
    table = table.select(key, value.alias("_found"))
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    hot_keys = counts.where(F.col("_n") * SHARES > rows.count()).select(key)
    hot = hot_keys.join(table, key, "left").select(key, F.struct("_found").alias("_hot"))  # fewer than SHARES rows
    known = rows.join(F.broadcast(hot), key, "left")
    cold = known.where("_hot is null").drop("_hot").join(table, key, how)
    kept = known.where("_hot is not null").withColumn("_found", F.col("_hot._found")).drop("_hot")
    if how == "inner":
        kept = kept.where("_found is not null")
    return kept.unionByName(cold).select(*rows.columns, "_found.*")

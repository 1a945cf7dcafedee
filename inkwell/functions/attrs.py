"""A token's attributes (an array of key, value structs, in order) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def attr_index(attrs: Column, name: str) -> Column:
    """Position of the attribute from 0; -1 if it is missing."""
    return (F.array_position(F.transform(attrs, lambda a: a["key"]), name) - 1).cast("int")


def attr_get(attrs: Column, name: str) -> Column:
    return F.get(F.filter(attrs, lambda a: a["key"] == name), 0)["value"]


def attr_set(attrs: Column, name: str, value: Column) -> Column:
    """Overwritten where it stands, or appended."""
    pair = F.struct(F.lit(name).alias("key"), value.cast("string").alias("value"))
    return F.when(F.exists(attrs, lambda a: a["key"] == name), F.transform(attrs, lambda a: F.when(a["key"] == name, pair).otherwise(a))).otherwise(F.concat(attrs, F.array(pair)))


def attr_join(attrs: Column, name: str, value: Column) -> Column:
    """Joined to the present value by a space, or appended."""
    return attr_set(attrs, name, F.concat_ws(" ", attr_get(attrs, name), value.cast("string")))


def attrs_from_map(values: Column) -> Column:
    return F.coalesce(F.map_entries(values), F.array().cast("array<struct<key:string,value:string>>"))


def attrs_to_map(attrs: Column) -> Column:
    return F.map_from_entries(attrs)

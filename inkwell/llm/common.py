"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of the words ``[^\x20\x09-\x0D]+``.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as one struct column ``row``: whatever its columns are called, an operator's own names cannot clash with them."""
    return df.select(F.struct("*").alias("row"))


def of_row(name: str) -> Column:
    """A column of the packed row, whatever characters its name has."""
    return F.col("row").getField(name)


def unpacked(df: DataFrame, names: list[str], added: dict[str, Column], replaced: dict[str, Column] | None = None) -> DataFrame:
    """The columns ``names`` of the packed row, those in ``replaced`` with another value at their place, then ``added``: an input column with the name of an added one (case does not count) is replaced by it."""
    gone = {k.lower() for k in added}
    kept = [(replaced or {}).get(n, of_row(n)).alias(n) for n in names if n.lower() not in gone]
    return df.select(*kept, *[c.alias(k) for k, c in added.items()])


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Only a session in one process may go without the setting and gets a temporary folder (local tests); on a cluster that raises an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="inkwell-checkpoint-"))
    return sc.getCheckpointDir()


#: The tables that ``materialise`` has written within the innermost ``scratch``.
_written: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """What ``materialise`` writes inside, and other paths added to the list, are deleted at the end: write results elsewhere before."""
    held = _written.set([])
    try:
        yield _written.get()
    finally:
        for path in _written.get():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _written.reset(held)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs start from files that every executor can reach. They stay until a ``scratch`` around ends; without one, until the shared folder is cleared."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkwell-{label}-{uuid.uuid4().hex}"
    if _written.get() is not None:
        _written.get().append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot above this share of all rows, so there are at most so many hot keys.
HOT_KEYS = 1000


def looked_up(rows: DataFrame, table: DataFrame, key: list[str], keys: DataFrame | None = None) -> DataFrame:
    """The inner join of ``rows`` with ``table``, in which a key stands once, however many rows share a key.

    Keys of more than a HOT_KEYS-th of all rows, at most HOT_KEYS of them, are
    sent to every executor with their row of ``table``; the other rows are shuffled
    by key. Both inputs are read several times: materialise them first, or at least ``keys``, the keys of ``rows``, which are what is counted. Keys must not be null.
    """
    keys = rows if keys is None else keys
    value = F.struct(*[c for c in table.columns if c not in key])
    table = table.select(*key, value.alias("_found"))
    counts = keys.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    total = keys.count()
    hot = table.join(F.broadcast(counts.where(F.col("_n") * HOT_KEYS > total).select(*key)), key)  # fewer than HOT_KEYS rows
    known = rows.join(F.broadcast(hot), key, "left")
    cold = known.where("_found is null").drop("_found").join(table, key)
    return known.where("_found is not null").unionByName(cold).select(*rows.columns, "_found.*")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often and wherever (in lambdas, for each element) the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def n_words(text: Column) -> Column:
    """How many such words a text has, counted without building them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def row_digest(df: DataFrame, seed: int) -> Column:
    """A 64-bit hash of the whole row (columns with maps cannot be hashed and are left out)."""
    cols = [named(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.xxhash64(F.lit(seed), *cols)


def give_back() -> None:
    """At the end of a Python task: free memory goes back to the system, as workers live on beside the stages that follow."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)

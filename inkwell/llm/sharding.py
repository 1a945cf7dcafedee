"""Sharding: a uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows belong to sources (cells of a hash of the row). One pass counts them. The
driver then draws, for each source, how many of its rows go to each block of
each shard: a multivariate hypergeometric draw without replacement from the
places still free, so that every block gets exactly its size. Each source ranks
its rows in random order and deals them by these counts (local permutation),
the rows move (exchange), and each block puts them in random order again
(second permutation). A group of more than ``rows_per_task`` rows is put in order by pieces, equal
ranges of the random hash, so no task grows with the corpus. The outcome has the law of one uniform permutation of all
rows cut into shards. All randomness is a hash of seed and row, so a task that
is run again on another executor gives the same rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import named, row_digest, unpacked

#: Cells of the first hash; sources are sets of cells. Bounds what the driver gets.
CELLS = 4096
#: The matrix gets at most about so many sources, and so many blocks: some 8 MB.
MOST = 1000
#: numpy draws from urns of fewer; larger ones are drawn from by inversion, up to so many deviations from the mode.
URN, TAIL = 10**9, 12


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes of the shards: at most one apart, the larger ones first."""
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], dtype=np.int64)


def communication_matrix(counts: list[int], places: np.ndarray, seed: int) -> np.ndarray:
    """Rows of each source that go to each block; row sums are ``counts``, column sums ``places``."""
    rng = np.random.default_rng(seed)
    left = sum(map(int, places))
    free, out = places.astype(np.int64).copy(), np.zeros((len(counts), len(places)), dtype=np.int64)
    for p, n in enumerate(counts):
        if n and left < URN:
            out[p] = rng.multivariate_hypergeometric(free, n, method="marginals")
        elif n:
            rest, todo = left, n  # places behind the one in turn, rows not yet dealt
            for j, here in enumerate(free.tolist()):
                rest -= here
                out[p, j] = _hypergeometric(rng, here, rest, todo)
                todo -= int(out[p, j])
        free -= out[p]
        left -= n
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good, for urns of any size: by inversion, over all counts within TAIL deviations of the mode (what lies beyond has less weight than a double can tell)."""
    total, least, most = good + bad, max(0, n - bad), min(n, good)
    if least == most:
        return least
    if total < URN:
        return int(rng.hypergeometric(good, bad, n))
    mode = (n + 1) * (good + 1) // (total + 2)
    width = int(TAIL * (1 + (n * (good / total) * (bad / total) * ((total - n) / total)) ** 0.5)) + 50
    first, last = max(least, mode - width), min(most, mode + width)
    k = np.arange(first, last, dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(np.log((good - k) / (k + 1)) + np.log((n - k) / (bad - n + k + 1)))])
    sums = np.cumsum(np.exp(logs - logs.max()))
    return first + min(int(np.searchsorted(sums, rng.random() * sums[-1], "right")), len(sums) - 1)


def _ranked(rows: DataFrame, group: str, order: Column, pieces: int) -> DataFrame:
    """``rows`` with ``rank``, from 0 in each group in the order of a hash, then of key. With several pieces, equal ranges of the hash, a group is put in order by so many tasks: a rank is that in the piece behind the counts of the pieces before."""
    rows = rows.withColumn("random", order)
    if pieces == 1:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("random", "key")) - 1)
    # The high 31 bits of the hash, from 0: equal hashes are in one piece, smaller ones in no later one.
    rows = rows.withColumn("piece", F.floor((F.shiftright("random", 33) + 2**30) * pieces / 2**31).cast("int"))
    sizes = rows.groupBy(group, "piece").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(group).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(group, "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy(group, "piece").orderBy("random", "key")) - 1
    return rows.withColumn("within", within).join(sizes, [group, "piece"]).withColumn("rank", F.col("before") + F.col("within")).drop("piece", "within", "before")


def shard(docs: DataFrame, shards: int, *, seed: int = 42, rows_per_task: int = 4000) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Shard sizes differ by one row at most. Sources, and the blocks of which
    shards consist, have about ``rows_per_task`` rows, or a 1000th of all rows if that is
    more, so the matrix stays at about a million entries; those of more than ``rows_per_task`` rows are put
    in order by pieces of about so many, so no task handles a whole shard of a large corpus. Any number of rows is taken.

    Nulls, very long texts and repeated rows are rows like any other (repeated ones are
    exchangeable, so ties do not show); an empty table gives an empty one; input columns named
    ``shard`` or ``slot`` are replaced, all others kept.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    docs = docs.select(*[named(c) for c in docs.columns if c.lower() not in ("shard", "slot")])
    spark, names = docs.sparkSession, docs.columns
    key = row_digest(docs, seed)
    rows = docs.select(F.struct("*").alias("row"), key.alias("key")).withColumn("cell", F.pmod("key", F.lit(CELLS)).cast("int"))
    cells = {r["cell"]: r["count"] for r in docs.select(F.pmod(key, F.lit(CELLS)).cast("int").alias("cell")).groupBy("cell").count().collect()}
    total = sum(cells.values())
    rows_each = max(rows_per_task, -(-total // MOST))
    sources = min(CELLS, max(16, -(-total // rows_each)))
    counts = [0] * sources
    for cell, n in cells.items():
        counts[cell % sources] += n
    per_shard = max(1, -(-total // (shards * rows_each)))  # blocks of a shard
    sizes = shard_sizes(total, shards)
    places = np.concatenate([shard_sizes(int(n), per_shard) for n in sizes])
    ends = np.cumsum(communication_matrix(counts, places, seed), axis=1)
    dealt = spark.createDataFrame([(p, ends[p].tolist()) for p in range(sources)], "source int, ends array<bigint>")

    steps = max(1, int(len(places)).bit_length())  # of the binary search for the block whose range holds a rank
    middle = lambda s: ((s["lo"] + s["hi"]) / 2).cast("int")
    search = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(F.lit(0).alias("lo"), F.lit(len(places) - 1).alias("hi")),
        lambda s, _: F.struct(
            F.when((s["lo"] < s["hi"]) & (F.get("ends", middle(s)) <= F.col("rank")), middle(s) + 1).otherwise(s["lo"]).alias("lo"),
            F.when((s["lo"] < s["hi"]) & (F.get("ends", middle(s)) > F.col("rank")), middle(s)).otherwise(s["hi"]).alias("hi"),
        ),
        lambda s: s["lo"],
    )
    pieces = -(-rows_each // rows_per_task)
    local = _ranked(rows.withColumn("source", F.col("cell") % sources), "source", F.xxhash64(F.lit(seed + 1), "key"), pieces)
    placed = local.join(dealt, "source").withColumn("block", search).select("row", "key", "block")
    placed = _ranked(placed, "block", F.xxhash64(F.lit(seed + 2), "key"), pieces)
    shard_of, j = F.floor(F.col("block") / per_shard).cast("int"), F.col("block") % per_shard
    size = F.lit(total // shards) + F.when(shard_of < total % shards, 1).otherwise(0)
    offset = j * F.floor(size / per_shard) + F.least(j, size % per_shard)
    return unpacked(placed, names, {"shard": shard_of, "slot": (offset + F.col("rank")).cast("long")})

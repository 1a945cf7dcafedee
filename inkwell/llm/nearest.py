"""Approximate nearest neighbours by collision-counting hashing, windows centred at the query.

Unit vectors are projected on single random lines. ``index`` packs rows, where they are stored, into blocks:
for each line a block holds its vectors sorted by their projection. A query opens a window around its own projection on
every line; a vector in the window collides. Virtual rehashing: at the next radius the same arrays are read, the windows are wider,
and only what they have gained is counted. Two vectors at distance r fall within HALF_WIDTH * r of each other on a line with a
probability p that does not depend on r, so a vector within the radius collides on about p of the lines; those with more
collisions than the threshold, BELOW standard deviations under that number, are verified by their exact cosine. A query is done with a block when the radius reaches the
distance of the k-th nearest verified so far. If fewer than k are verified at the largest radius, the rest of the block is verified too:
no number of candidates is capped.

Every row is indexed. Null, empty or zero vectors and those with null or non-finite entries take no part, neither do vectors of another dimension than
most have (of equal counts the larger). Equal scores go to the smaller vec_id (null last). A query's candidates are all rows but
those with its own id; rows with the same id, as queries, are one query with the smallest of the vectors. Fewer candidates than ``k`` give fewer rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, named

LINES = 64
#: Half the width of a window as a multiple of the radius; how far the threshold is below the expected number of collisions.
HALF_WIDTH, BELOW = 0.8, 2.0
#: Radii: the first, the factor from one to the next, and the last (the diameter of the unit sphere).
FIRST_RADIUS, GROWTH, LAST_RADIUS = 0.25, 1.25, 2.0
#: A block has at most so many vectors, and at most so many bytes of them; queries are asked so many at a time.
BLOCK, BLOCK_BYTES, QUERIES = 8192, 1 << 23, 2048
_SEED = 13


def threshold(lines: int = LINES) -> int:
    p = math.erf(HALF_WIDTH / math.sqrt(2))
    return max(1, math.floor(lines * p - BELOW * math.sqrt(lines * p * (1 - p))))


def _lines(d: int) -> np.ndarray:
    return np.random.default_rng(_SEED).normal(size=(LINES, d))


def points(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v): rows that take part."""
    v = named(vec_col).cast("array<double>")
    finite = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(math.inf)), F.lit(False)))
    kept = vectors.where(F.coalesce(finite & F.exists(v, lambda c: c != 0), F.lit(False))).select(named(id_col).alias("vec_id"), v.alias("v"))
    sizes = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return kept.where(F.size("v") == (sizes[0]["d"] if sizes else 0))


def _norms(v: np.ndarray) -> np.ndarray:
    """Lengths; entries are scaled first, as squares may leave the range of doubles."""
    top = abs(v).max(axis=1)
    return top * np.sqrt(((v / top[:, None]) ** 2).sum(axis=1))


def index(usable: DataFrame) -> DataFrame:
    """(ids, vectors, order, projected): a row per block. Rows of a block are sorted by id; order and projected hold, line by line, the rows by projection and their projections. No shuffle."""
    kind = usable.schema["vec_id"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).sort_by("vec_id")  # nulls last
            ids, v = rows.column("vec_id").combine_chunks(), rows.column("v").combine_chunks()
            v = v.flatten().to_numpy().reshape(len(ids), -1)
            projected = (v / _norms(v)[:, None] @ _lines(v.shape[1]).T).T
            order = np.argsort(projected, axis=1, kind="stable")
            columns = v.tobytes(), order.astype(np.int32).tobytes(), np.take_along_axis(projected, order, 1).astype(np.float32).tobytes()
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([listed, *[pa.array([c], pa.binary()) for c in columns]], names=["ids", "vectors", "order", "projected"])

        n = 0
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                d = len(whole.column("v")[at])
                room = max(64, min(BLOCK, BLOCK_BYTES // (8 * d)))
                part = whole.slice(at, room - n)
                held.append(part)
                n, at = n + part.num_rows, at + part.num_rows
                if n >= room:
                    yield block()
                    held, n = [], 0
        if held:
            yield block()

    return usable.mapInArrow(packed, f"ids array<{kind}>, vectors binary, order binary, projected binary")


class _Block:
    """A block of the index, and how queries are searched in it."""

    def __init__(self, ids: list, vectors: bytes, order: bytes, projected: bytes):
        self.ids, n = ids, len(ids)
        self.v = np.frombuffer(vectors, np.float64).reshape(n, -1)
        self.order = np.frombuffer(order, np.int32).reshape(LINES, n)
        self.projected = np.frombuffer(projected, np.float32).reshape(LINES, n)
        self.norms = _norms(self.v)

    def cosines(self, rows: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
        """Row by row in the same order of operations, so that equal vectors have equal scores."""
        return (self.v[rows] / self.norms[rows, None] * (query / norm)).sum(axis=1)

    def search(self, queries: list[_Query], k: int) -> None:
        n, least, radius = len(self.ids), threshold(), FIRST_RADIUS
        active = queries
        centres = np.array([q.centres for q in queries])
        counts = np.zeros((len(queries), n), np.int16)
        low = high = None
        while active:
            place = np.array([q.place for q in active])
            edges = [np.stack([np.searchsorted(self.projected[j], centres[place, j] + sign * HALF_WIDTH * radius, side) for j in range(LINES)], axis=1) for sign, side in ((-1, "left"), (1, "right"))]
            if low is None:  # nothing is in the windows yet
                low, high = np.zeros((len(queries), LINES), np.int64), np.zeros((len(queries), LINES), np.int64)
                low[place] = high[place] = edges[0]
            going = []
            for q, lows, highs in zip(active, *edges):
                mine, was_low, was_high = counts[q.place], low[q.place], high[q.place]
                gained = [self.order[j, a:b] for j, (a, b) in enumerate(zip(lows.tolist(), was_low.tolist())) if a < b]
                gained += [self.order[j, a:b] for j, (a, b) in enumerate(zip(was_high.tolist(), highs.tolist())) if a < b]
                if gained:
                    mine += np.bincount(np.concatenate(gained), minlength=n).astype(np.int16)
                low[q.place], high[q.place] = lows, highs
                last = radius >= LAST_RADIUS
                (rows,) = np.nonzero(mine >= least)
                mine[rows] = -(1 << 14)  # verified once
                q.verify(self, rows, k)
                if last and len(q.best) < k:
                    q.verify(self, np.nonzero(mine >= 0)[0], k)
                elif not last and radius < q.distance(k):
                    going.append(q)
            active, radius = going, min(LAST_RADIUS, radius * GROWTH)


class _Query:
    def __init__(self, name, vector: list[float]):
        self.name, self.v = name, np.array(vector)
        self.norm = float(_norms(self.v[None])[0])
        self.centres = _lines(len(self.v)) @ (self.v / self.norm)
        self.best: list[tuple] = []  # (-score, id is null, id), best first
        self.place = 0

    def distance(self, k: int) -> float:
        """Of the k-th nearest so far, between unit vectors."""
        return math.sqrt(max(0.0, 2 + 2 * self.best[k - 1][0])) if len(self.best) >= k else math.inf

    def verify(self, block: _Block, rows: np.ndarray, k: int) -> None:
        if not len(rows):
            return
        scores = block.cosines(rows, self.v, self.norm)
        if len(self.best) >= k:
            near = scores >= -self.best[k - 1][0]
            rows, scores = rows[near], scores[near]
        found = []
        for i in np.lexsort((rows, -scores)).tolist():  # rows are in the order of ids
            name = block.ids[rows[i]]
            if name != self.name:
                found.append((-float(scores[i]), name is None, name))
                if len(found) == k:
                    break
        self.best = sorted(self.best + found, key=lambda x: (x[0], x[1], 0 if x[2] is None else x[2]))[:k]


def _asked(indexed: DataFrame, queries: list[tuple], k: int, kind: str) -> DataFrame:
    """(query_id, vec_id, score): the nearest that each task has found for each of these queries."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [_Query(name, vector) for name, vector in queries]
        for place, q in enumerate(asked):
            q.place = place
        ids_type = None
        for batch in batches:
            ids_type = batch.schema.field("ids").type.value_type
            for i in range(batch.num_rows):
                _Block(*[batch.column(c)[i].as_py() for c in ("ids", "vectors", "order", "projected")]).search(asked, k)
        if ids_type is not None:
            rows = [(q.name, name, -score) for q in asked for score, _, name in q.best]
            columns = [pa.array([x[0] for x in rows], ids_type), pa.array([x[1] for x in rows], ids_type), pa.array([x[2] for x in rows], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    return indexed.mapInArrow(found, f"query_id {kind}, vec_id {kind}, score double")


def search(indexed: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query (vec_id, v).

    ``indexed`` and ``queries`` are read once for every QUERIES queries: materialise them first. The driver holds so many queries at a time.
    """
    kind = queries.schema["vec_id"].dataType.simpleString()
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = -(-queries.count() // QUERIES)
    parts = []
    for block in range(blocks):
        own = [(r["vec_id"], r["v"]) for r in queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()]
        part = _asked(indexed, own, k, kind)
        parts.append(materialise(part, "nearest") if blocks > 1 else part)
    if not parts:
        return queries.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

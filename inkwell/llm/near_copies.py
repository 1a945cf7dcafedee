"""SimHash near copies by the rule of the pipeline: a Jaccard similarity of 0.8 or more over word shingles of five.

Equal sets of shingles are one node. A set's SimHash has 192 bytes, as sets of
similarity 0.8 differ in 15% of the bits, about ten of 64 with wide bounds. Its bytes are
indexed by position as in ``simhash``; posting lists of single bytes are intersected
three at a time (LISTS runs of three bytes). Bits whose vote was close are those that differ first, so
a set is posted under its three bytes and under those with one or both of the two closest bits of the run turned.
Pairs that meet in fewer than LEAST_LISTS runs are dropped by this count. At a similarity of
exactly 0.8 a pair meets in 8.5 runs on average, in fewer than two with a probability of
0.0003. The others are verified by their sets, so no link is below the rule.

Sets that meet in lists of more than LONG_LIST nodes are joined into clusters by these lists, and each
cluster is compared in pairs of blocks and gives edges with the same components, as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, materialise, of_row, row_digest
from .simhash import ROW_SEED, components, first_rows

WIDTH, PERCENT = 5, 80
#: Runs of three positional bytes; a pair to be verified meets in LEAST_LISTS of them.
LISTS, LEAST_LISTS = 64, 2
LONG_LIST, BLOCK = 64, 512
_WORDS, _RUN = LISTS * 3 // 8, 24
_MULTIPLIERS = np.random.default_rng(42).integers(0, 2**63, _WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: One bit of each byte: eight counters in a word hold the votes of 255 shingles.
_LANES, _CHUNK = np.uint64(0x0101010101010101), 255
_PLACES = np.int64(1) << np.arange(_RUN, dtype=np.int64)
#: So many texts are in work at a time.
_PIECE = 256


def shingles_of(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted (A-Z lower-cased, words between ASCII white space; fewer words are one shingle)."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: max(0, len(words) - width)].tolist()]
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops)], dtype=np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def votes_of(shingles: np.ndarray) -> np.ndarray:
    """For each bit of the fingerprint the number of shingles that set it, by runs of three bytes."""
    votes = np.zeros((8, 8 * _WORDS), dtype=np.int64)
    for at in range(0, len(shingles), _CHUNK):
        x = _mixed(shingles[at : at + _CHUNK, None] * _MULTIPLIERS)
        for bit in range(8):
            votes[bit] += (x >> np.uint64(bit) & _LANES).sum(axis=0).astype("<u8").view(np.uint8)
    return votes.T.reshape(LISTS, _RUN)


def runs_of(shingles: np.ndarray) -> list[int]:
    """Each run of three bytes of the SimHash (a bit is 1 if set in over half of the shingles), with the places of its two most doubtful bits in a byte each above; none without shingles."""
    if not len(shingles):
        return []
    votes = votes_of(shingles)
    doubts = np.argsort(np.abs(4 * votes - 2 * len(shingles) - 1), axis=1, kind="stable")
    return ((2 * votes > len(shingles)) @ _PLACES | doubts[:, 0] << _RUN | doubts[:, 1] << (_RUN + 8)).tolist()


def _node_of(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), 1) - 2**63


def _by_piece(keys: list[str], name: str, of: Callable[[np.ndarray], np.ndarray | list[int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches with ``keys`` and text to ``keys``, node, size and a list of longs from the shingles; a few texts at a time, so that memory stays small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _PIECE):
                part = batch.slice(at, _PIECE)
                sets = [shingles_of(t) for t in part.column("text").to_pylist()]
                lists = pa.array([of(s) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], pa.array(map(_node_of, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), lists], names=[*keys, "node", "size", name])
        give_back()

    return run


def _near(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= PERCENT * (F.size(a) + F.size(b) - both)


def _forest(group: pd.DataFrame) -> pd.DataFrame:
    """Edges with the components of the links within a group of two blocks of nodes at most. Sets are sorted arrays; those of too different a size are not compared."""
    group = group.drop_duplicates("node")
    nodes, sets = group["node"].to_numpy(), [np.sort(np.asarray(x, dtype=np.int64)) for x in group["held"]]
    sizes = np.array([len(s) for s in sets])
    root, todo = np.full(len(nodes), -1), np.arange(len(nodes))
    for first in range(len(nodes)):
        if root[first] >= 0:
            continue
        root[first], front = first, [first]
        while front:
            at = front.pop()
            here, n = sets[at], sizes[at]
            todo = todo[root[todo] < 0]
            for i in todo[(100 * sizes[todo] >= PERCENT * n) & (100 * n >= PERCENT * sizes[todo])]:
                place = np.searchsorted(here, sets[i])
                both = int((here[np.minimum(place, n - 1)] == sets[i]).sum()) if n else 0
                if 100 * both >= PERCENT * (n + sizes[i] - both):
                    root[i] = first
                    front.append(i)
    linked = root != np.arange(len(nodes))
    return pd.DataFrame({"a": nodes[root[linked]], "b": nodes[linked]})


def index_of(nodes: DataFrame) -> DataFrame:
    """(node, key, size, n, least): the posting lists of more than one of the ``nodes`` (node, size, runs), with their number of nodes and their least one.

    size is the class of the set's size, a logarithm by 1 / 0.8: sets of similarity 0.8 are in one class or in neighbouring ones.
    """
    kind = F.floor(F.log(100 / PERCENT, F.col("size"))).cast("short").alias("size")
    runs = nodes.select("node", kind, F.posexplode("runs").alias("run", "packed"))
    place = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("packed", at).bitwiseAND(255).cast("int"))
    plain, one, other = F.col("packed").bitwiseAND((1 << _RUN) - 1), place(_RUN), place(_RUN + 8)
    key = F.shiftleft(F.col("run").cast("long"), _RUN)
    turned = [key + plain, key + plain.bitwiseXOR(one), key + plain.bitwiseXOR(other), key + plain.bitwiseXOR(one).bitwiseXOR(other)]
    of_list = Window.partitionBy("key")
    posts = runs.select("node", "size", F.explode(F.array(*turned)).alias("key")).withColumn("n", F.count(F.lit(1)).over(of_list))
    return posts.withColumn("least", F.min("node").over(of_list)).where("n > 1")


def candidates(index: DataFrame) -> DataFrame:
    """(a, b): the pairs that meet in the lists of LEAST_LISTS runs; ``index`` has a column ``cluster``, and nodes of one cluster make no pair."""
    named = lambda node, size, of: index.select("key", F.col("node").alias(node), F.col("size").alias(size), F.col("cluster").alias(of))
    met = named("a", "x", "p").join(named("b", "y", "q"), "key").where("a < b and p <> q and abs(x - y) <= 1")
    run = F.shiftright("key", _RUN).cast("int")
    met = met.select("a", "b", F.call_function("shiftleft", F.lit(1).cast("long"), run).alias("run"))
    return met.groupBy("a", "b").agg(F.bit_or("run").alias("runs")).where(F.bit_count("runs") >= LEAST_LISTS).select("a", "b")


def edges(printed: DataFrame, texts: DataFrame, long_list: int = LONG_LIST, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) among the nodes of ``printed`` (id, node, size, runs); ``texts`` (id, text) gives their sets.

    A pair to be linked meets in two runs at least: both lists are short, and it is tallied, or one is long, and it is compared in the blocks of that list's cluster.
    """
    nodes = printed.groupBy("node").agg(F.first("size").alias("size"), F.first("runs").alias("runs"))
    index = materialise(index_of(nodes), "near-index")
    clusters = materialise(components(index.where(F.col("n") > long_list).select(F.col("least").alias("a"), F.col("node").alias("b"))), "near-clusters")
    short = index.where(F.col("n") <= long_list).join(clusters, "node", "left").withColumn("cluster", F.coalesce("root", "node"))
    pairs = materialise(candidates(short), "near-pairs")
    wanted = pairs.select(F.col("a").alias("of")).union(pairs.select("b")).union(clusters.select("node")).distinct()
    wanted = wanted.join(printed.groupBy("node").agg(F.min("id").alias("id")), F.col("of") == F.col("node")).select("of", "id")
    held = texts.join(wanted, "id").select("of", "text").mapInArrow(_by_piece(["of"], "held", lambda s: s.view(np.int64)), "of long, node long, size long, held array<long>")
    held = materialise(held.where("node = of").select("node", "held").dropDuplicates(["node"]), "near-sets")
    pairs = pairs.join(held.select(F.col("node").alias("a"), F.col("held").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("held").alias("y")), "b")
    pairs = pairs.where(_near(F.col("x"), F.col("y"))).select("a", "b")
    sizes = clusters.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    long = clusters.join(sizes, "root").select("root", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    long = long.select("root", "node", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).join(held, "node")
    return pairs.unionByName(long.groupBy("root", "lo", "hi").applyInPandas(_forest, "a long, b long")).distinct()


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", long_list: int = LONG_LIST, block: int = BLOCK) -> DataFrame:
    """``docs`` with one document of each component of near copies, the one with the smallest id.

    Different texts of one id are different documents. Of equal rows one stays; of rows that
    differ in other columns alone, the one with the least digest. A row with a null id is left as it is.
    Texts without words (null, empty) are copies of each other. All columns are kept, whatever their names. An empty table gives an empty one.
    """
    rows = docs.select(F.struct("*").alias("row"), row_digest(docs, ROW_SEED).alias("digest")).where(of_row(id_col).isNotNull())
    rows = rows.select(of_row(id_col).alias("id"), of_row(text_col).alias("text"), "digest")
    kind = rows.schema["id"].dataType.simpleString()
    printed = materialise(rows.mapInArrow(_by_piece(["id", "digest"], "runs", runs_of), f"id {kind}, digest long, node long, size long, runs array<long>"), "near")
    roots = components(edges(printed, rows.select("id", "text"), long_list, block))
    rooted = printed.select("id", "digest", "node").join(roots, "node", "left").select("id", "digest", F.coalesce("root", "node").alias("root"))
    return first_rows(docs, rooted, id_col)

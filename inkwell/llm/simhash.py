"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Equal fingerprints are one node. Two fingerprints within DISTANCE = 3 bits
differ in at most 3 of their 8 bytes, so at least 5 positional bytes are equal: the
guaranteed minimum. The posting lists of single bytes are long (n/256 fingerprints each); tallying
over them would emit n*n/64 pairs. They are therefore intersected four at a
time, by the blocks of two disjoint Steiner systems S(3, 4, 8), 14 blocks each. Any 5 of the 8 positions hold exactly one
block of each system, any 4 positions are a block of one system at most. So the tally of the lists in which a pair meets tells
how many positional bytes it shares: 0 or 1 lists for up to four, 2 for five, 6 for six, 14 for seven, 28 for all eight.
Pairs that meet in fewer than LEAST_LISTS = 2 lists are dropped by this count, with no look at their bytes; the rest are verified by their differing bits.
Lists of 4 equal bytes grow 256 times slower than lists of 3.

Four bytes that many fingerprints share (a large group of near copies)
are split into blocks; each task compares two blocks, and returns, in place of
all pairs, edges that keep the same components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, materialise, of_row, packed, row_digest, unpacked

#: Byte positions (0: highest) of the intersected posting lists: the two halves, and two positions of each half paired alike.
_PAIRINGS = [((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2))]
BLOCKS = [(0, 1, 2, 3), (4, 5, 6, 7), *[(*x, *(4 + i for i in y)) for pairs in _PAIRINGS for x in pairs for y in pairs]]
#: The second system: positions 3, 4, 5 and 6 of each block of the first moved on in a ring. No block is in both.
_RING = (0, 1, 2, 4, 5, 6, 3, 7)
LISTS = BLOCKS + [tuple(_RING[i] for i in b) for b in BLOCKS]
SHARED, DISTANCE = 5, 3
#: The lists in which a pair with SHARED equal positional bytes meets.
LEAST_LISTS = 2
#: A posting list of more fingerprints is compared by blocks of about BLOCK.
LONG_LIST, BLOCK = 64, 1024
_CHUNK = 1 << 15
#: Seed of the digest that tells rows of one id apart.
ROW_SEED = 7


def fingerprint_of(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles (A-Z lower-cased, words between ASCII white space)."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - width].tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    counts, n = np.zeros(64, dtype=np.int64), len(starts)
    for at in range(0, n, _CHUNK):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK])], dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint(text: Column, width: int = 3, seed: int = 42) -> Column:
    """``fingerprint_of`` as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, width, seed) for t in texts], dtype=np.uint64).view(np.int64))

    return of(text)


def _byte(fp: str, i: int) -> Column:
    return F.shiftrightunsigned(F.col(fp), 56 - 8 * i).bitwiseAND(255)


def counted(pairs: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b, lists) whose tally reaches the guaranteed minimum."""
    return pairs.where(F.col("lists") >= LEAST_LISTS)


def verified(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE).select("a", "b")


def _forest(group: pd.DataFrame) -> pd.DataFrame:
    """Edges with the components of the links within a group of two blocks of fingerprints at most."""
    fps = np.unique(group["fp"].to_numpy())
    bits = fps.view(np.uint64)
    per_byte = [bits >> np.uint64(8 * i) & np.uint64(255) for i in range(8)]
    root, todo = np.full(len(fps), -1), np.arange(len(fps))
    for first in range(len(fps)):
        if root[first] >= 0:
            continue
        root[first], front = first, [first]
        while front:  # breadth first; each fingerprint is compared with those not yet reached, once
            here = front.pop()
            todo = todo[root[todo] < 0]
            shared = sum((b[todo] == b[here]).astype(np.int8) for b in per_byte)
            near = todo[shared >= SHARED]
            near = near[np.bitwise_count(bits[near] ^ bits[here]) <= DISTANCE]
            root[near] = first
            front += near.tolist()
    linked = root != np.arange(len(fps))
    return pd.DataFrame({"a": fps[root[linked]], "b": fps[linked]})


def index_of(fingerprints: DataFrame) -> DataFrame:
    """(fp, key): the intersected posting lists of the distinct values of ``fp``."""
    byte = lambda i, place: F.shiftleft(_byte("fp", i), 8 * place)
    key = lambda k, t: F.lit(k).cast("long") * (1 << 32) + sum((byte(i, p) for p, i in enumerate(t)), F.lit(0).cast("long"))
    return fingerprints.select("fp", F.explode(F.array(*[key(k, t) for k, t in enumerate(LISTS)])).alias("key"))


def posted(index: DataFrame) -> DataFrame:
    """(key, fp, n): the posting lists of more than one fingerprint, with their number of fingerprints."""
    lengths = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return index.join(lengths.hint("merge"), "key")


def candidates(index: DataFrame) -> DataFrame:
    """(a, b, lists): the pairs that meet in a posting list, with the number of lists in which they do.

    Merge joins here and wherever a row stands for each fingerprint or more: Spark does not count what the explode adds, and takes a table for as large as its files, a seventh of its rows in memory. It would send them through the driver.
    """
    met = index.select("key", F.col("fp").alias("a")).join(index.select("key", F.col("fp").alias("b")).hint("merge"), "key").where("a < b")
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("lists"))


def edges(fingerprints: DataFrame, long_list: int = LONG_LIST, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) among the distinct values of ``fp``, with the components of all links within DISTANCE bits.

    A pair to be linked meets in two lists at least: both are short, and it is tallied, or one is long, and it is compared in the blocks of that list.
    """
    index = materialise(posted(index_of(fingerprints)), "simhash-index")
    pairs = verified(counted(candidates(index.where(F.col("n") <= long_list))))
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    long = index.where(F.col("n") > long_list).select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    long = long.select("key", "fp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    return pairs.unionByName(long.groupBy("key", "lo", "hi").applyInPandas(_forest, "a long, b long")).distinct()


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) of every node with a link; root is the smallest node of its component. Alternates large and small stars until nothing changes."""

    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        joined = both.join(least, "u")
        if large:
            joined = joined.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            joined = joined.select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b"))
        return joined.where("a <> b").distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())

    e = materialise(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "stars")
    before = state(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        e = materialise(stars(stars(e, True), False), "stars")
        after = state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _roots(printed: DataFrame, long_list: int, block: int) -> DataFrame:
    """(fp, least_id, root) of every distinct fingerprint in ``printed`` (id, fp): the smallest id with it, and the smallest fingerprint of its component."""
    nodes = materialise(printed.groupBy("fp").agg(F.min("id").alias("least_id")), "simhash-nodes")
    return nodes.join(components(edges(nodes, long_list, block)), F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))


def _classes(printed: DataFrame, long_list: int, block: int) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint in ``printed`` (id, fp)."""
    rooted = materialise(_roots(printed, long_list, block), "simhash-roots")
    least = materialise(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-least")
    return looked_up(rooted, least.hint("merge"), ["root"]).select("fp", "component_id")


def first_rows(docs: DataFrame, rooted: DataFrame, id_col: str) -> DataFrame:
    """One row of ``docs`` for each root in ``rooted`` (id, digest, root): that of the smallest id, then of the smallest digest of the row; and every row with a null id."""
    names = docs.columns
    stay = rooted.groupBy("root").agg(F.min(F.struct("id", "digest")).alias("first")).select("first.id", "first.digest").distinct()
    keyed = docs.select(F.struct("*").alias("row"), row_digest(docs, ROW_SEED).alias("digest")).withColumn("id", of_row(id_col))
    kept = keyed.where("id is not null").join(stay, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"])  # rows with one id and digest are equal
    return unpacked(kept.select("row").unionByName(keyed.where("id is null").select("row")), names, {})


def _hex(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def membership(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, long_list: int = LONG_LIST, block: int = BLOCK) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id), a row per document.

    component_id is the smallest id reachable over links, the document's own included. A null or wordless
    text has fingerprint zero and is linked like any other; a text of fewer
    than ``width`` words is one shingle; texts of any length are read whole. Null ids take part but name no
    component, so component_id is null only where a whole component has null
    ids. Repeated rows have equal fingerprints. Other columns are not read. An empty table gives an empty one.
    """
    printed = materialise(packed(docs).select(of_row(id_col).alias("id"), fingerprint(of_row(text_col), width).alias("fp")), "simhash")
    classes = materialise(_classes(printed, long_list, block), "simhash-classes")
    return looked_up(printed, classes.hint("merge"), ["fp"]).select(F.col("id").alias(id_col), _hex("fp").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, long_list: int = LONG_LIST, block: int = BLOCK) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id.

    Different texts of one id are different documents. Of equal rows one
    stays; of rows that differ in other columns alone, the one with the least digest. A row with a null id has no
    name in any component and is left as it is. All columns are kept, whatever their names. An empty table gives an empty one.
    """
    rows = docs.select(F.struct("*").alias("row"), row_digest(docs, ROW_SEED).alias("digest")).where(of_row(id_col).isNotNull())
    printed = materialise(rows.select(of_row(id_col).alias("id"), "digest", fingerprint(of_row(text_col), width).alias("fp")), "simhash")
    roots = materialise(_roots(printed, long_list, block).select("fp", "root"), "simhash-roots")
    return first_rows(docs, looked_up(printed, roots.hint("merge"), ["fp"]).select("id", "digest", "root"), id_col)

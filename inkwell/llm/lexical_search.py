"""Ranked lexical search by hashed max-sketches.

``index`` gives each document a row: its terms with their occurrences, and a sketch
of two hash rows. A document's impacts fold into coordinatewise maxima; as an impact grows
with the occurrences and all else in it is the document's own, the maximum of the occurrences says
the same and needs no statistics of the corpus, so an index can be extended. A sketch is as wide as its
document has terms (about four coordinates to a term, up to 65,536), so bounds of long texts stay sharp.

``search`` takes items in blocks. For a block every task looks up all its terms at once: of
both hash rows the smaller value bounds a term's occurrences, its impact times the term's weight is
summed over an item's terms by one matrix product. Documents are then scored exactly by descending
bound, until a bound falls below the lowest of the best exact scores so far. What remains of each task are the
best documents of each item; two levels of ranking make them one list.

Null and wordless documents have no terms and are never found. Repeated rows are documents of their own. Rows of one
item_id are one item with the terms of all; items without a term give no rows. Tied scores go to the smaller doc_id
(null last). An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, named

#: A block has about so many terms of items, and so many items.
BLOCK_TERMS, BLOCK_ITEMS = 8192, 1024
#: Documents whose bounds are held at a time.
PIECE = 256
#: Coordinates to a term in each of the two hash rows, and the least and the largest width of a row.
SPARSE, LEAST_WIDTH, MOST_WIDTH = 4, 64, 1 << 16
#: Occurrences that a coordinate can hold; it stands for any number from there on.
FULL = 255
#: What tasks found is ranked in so many groups to an item first.
GROUPS = 64
_CHUNK = 1 << 20
# Terms are the maximal matches of [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+, A-Z lower-cased: over the bytes of UTF-8 a table.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes | None) -> Counter[bytes]:
    """The terms of a text in UTF-8 with their occurrences; long texts are counted in pieces."""
    found: Counter[bytes] = Counter()
    at, end = 0, len(text or b"")
    while at < end:
        cut = at + _CHUNK
        while cut < end and _TABLE[text[cut]] != 32:
            cut += 1
        found.update(text[at:cut].translate(_TABLE).split())
        at = cut
    return found


def coordinates(terms: list[bytes]) -> np.ndarray:
    """(2, n): the two hashes of each term; a row of width 2**b takes the last b bits."""
    digests = np.fromiter(map(zlib.crc32, terms), np.int64, len(terms))
    return np.stack([digests & 0xFFFF, digests >> 16])


def _sketch(terms: list[bytes], counts: np.ndarray) -> bytes:
    width = min(MOST_WIDTH, max(LEAST_WIDTH, 1 << (SPARSE * len(terms) - 1).bit_length()))
    rows = np.zeros((2, width), np.uint8)
    for row, at in zip(rows, coordinates(terms) & (width - 1)):
        np.maximum.at(row, at, np.minimum(counts, FULL).astype(np.uint8))
    return rows.tobytes()


def index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, counts, sketch): a row per document that has a term; n is the number of its terms with repeats. No shuffle."""
    source = docs.select(named(id_col).alias("doc_id"), named(text_col).cast("binary").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    types = {"n": pa.int64(), "terms": pa.list_(pa.binary()), "counts": pa.list_(pa.int64()), "sketch": pa.binary()}

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, PIECE):
                batch = whole.slice(start, PIECE)
                keep, rows = [], []
                for i, text in enumerate(batch.column("text")):
                    found = terms_of(text.as_py())
                    if found:
                        keep.append(i)
                        counts = np.fromiter(found.values(), np.int64, len(found))
                        rows.append((int(counts.sum()), list(found), counts, _sketch(list(found), counts)))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types.values())] if rows else [pa.array([], t) for t in types.values()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(keep, pa.int64())), *columns], names=["doc_id", *types])

    return source.mapInArrow(indexed, f"doc_id {kind}, n long, terms array<binary>, counts array<long>, sketch binary")


def item_terms(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, terms): the different terms of each item row."""
    source = items.select(named(id_col).alias("item_id"), named(text_col).cast("binary").alias("text"))
    kind = source.schema["item_id"].dataType.simpleString()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = pa.array([list(terms_of(t.as_py())) for t in batch.column("text")], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), terms], names=["item_id", "terms"])

    return source.mapInArrow(listed, f"item_id {kind}, terms array<binary>").where(F.size("terms") > 0)


def document_frequencies(indexed: DataFrame, vocabulary: list[bytes]) -> np.ndarray:
    """How many documents of the index hold each of these terms: counts of each task, summed."""
    values = pa.array(vocabulary, pa.binary())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(values), np.int64)
        for batch in batches:
            at = pc.drop_null(pc.index_in(batch.column("terms").flatten(), value_set=values))
            total += np.bincount(at.to_numpy(), minlength=len(values))
        (some,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "df"])

    df = np.zeros(len(values), np.int64)
    for term, n in indexed.select("terms").mapInArrow(counted, "term long, df long").groupBy("term").sum("df").collect():  # a row per term of the block
        df[term] = n
    return df


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _bounds(batch: pa.RecordBatch, lengths: np.ndarray, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(documents, items): no score is above. Sums below 2**53 are exact in doubles."""
    sketches = batch.column("sketch")
    widths = pc.binary_length(sketches).to_numpy() // 2
    occurrences = np.arange(FULL + 1)
    impacts = np.concatenate([(10**9 * occurrences[:-1]) // (1000 * occurrences[:-1] + 8 * lengths[:, None]), np.full((len(lengths), 1), 10**6)], axis=1)
    most = np.empty((batch.num_rows, at.shape[1]), np.int64)
    for width in np.unique(widths):
        (rows,) = np.nonzero(widths == width)
        for part in np.array_split(rows, math.ceil(len(rows) * int(width) / (1 << 24))):  # bounded memory for the widest
            table = np.frombuffer(b"".join(sketches.take(pa.array(part)).to_pylist()), np.uint8).reshape(len(part), 2, width)
            most[part] = np.minimum(table[:, 0][:, at[0] & (width - 1)], table[:, 1][:, at[1] & (width - 1)])
    return np.take_along_axis(impacts, most, 1).astype(np.float64) @ weights


def _search_block(indexed: DataFrame, items: dict[object, list[bytes]], n_docs: int, n_terms: int, k: int, kind: str) -> DataFrame:
    """(item_id, doc_id, score): of each task the best documents of each item."""
    vocabulary = sorted({t for terms in items.values() for t in terms})
    weighs = [weight(n_docs, int(df)) for df in document_frequencies(indexed, vocabulary)]
    number = {t: i for i, t in enumerate(vocabulary)}
    names = list(items)
    weights = np.zeros((len(vocabulary), len(names)))
    for j, terms in enumerate(items.values()):
        for t in terms:
            weights[number[t], j] = weighs[number[t]]
    at = coordinates(vocabulary)
    values = pa.array(vocabulary, pa.binary())
    item_type, doc_type = (pa.array(names).type if names else pa.null()), indexed.schema["doc_id"].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in names]  # (-score, id is null, id), best first
        least = np.ones(len(names))  # a score below is of no use
        ids_type = pa.null()
        for whole in batches:
            ids_type = whole.schema.field("doc_id").type
            for start in range(0, whole.num_rows, PIECE):
                batch = whole.slice(start, PIECE)
                lengths = 10 + 90 * batch.column("n").to_numpy() * n_docs // n_terms
                bounds = _bounds(batch, lengths, at, weights)
                lists = batch.column("terms")
                ends = lists.offsets.to_numpy()
                terms = pc.index_in(lists.flatten(), value_set=values).fill_null(-1).to_numpy()
                counts = batch.column("counts").flatten().to_numpy()
                held: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # a document's terms of the block and their impacts
                for j in np.nonzero((bounds >= least).any(axis=0))[0]:
                    (rows,) = np.nonzero(bounds[:, j] >= least[j])
                    for r in rows[np.argsort(-bounds[rows, j], kind="stable")].tolist():
                        if bounds[r, j] < least[j]:
                            break
                        if r not in held:
                            own = slice(ends[r] - ends[0], ends[r + 1] - ends[0])
                            (asked,) = np.nonzero(terms[own] >= 0)
                            tf = counts[own][asked]
                            held[r] = terms[own][asked], 10**9 * tf // (1000 * tf + 8 * lengths[r])
                        score = int(held[r][1] @ weights[held[r][0], j])  # whole numbers below 2**53
                        if score < least[j]:
                            continue
                        name = batch.column("doc_id")[r].as_py()
                        bisect.insort(best[j], (-score, name is None, name))
                        if len(best[j]) > k:
                            best[j].pop()
                        if len(best[j]) == k:
                            least[j] = max(1, -best[j][-1][0])
        rows = [(j, name, -score) for j, own in enumerate(best) for score, _, name in own]
        items_of = pa.array([names[j] for j, _, _ in rows], item_type)
        yield pa.RecordBatch.from_arrays([items_of, pa.array([x for _, x, _ in rows], ids_type), pa.array([s for _, _, s in rows], pa.int64())], names=["item_id", "doc_id", "score"])

    return indexed.select("doc_id", "n", "terms", "counts", "sketch").mapInArrow(found, f"item_id {kind}, doc_id {doc_type}, score long")


def search(indexed: DataFrame, items: DataFrame, k: int = 10, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the ``k`` documents with the highest scores above 0.

    ``indexed`` is read several times: materialise it first. The driver holds a block of items at a time.
    """
    asked = materialise(item_terms(items, id_col=id_col, text_col=text_col), "items")
    kind = asked.schema["item_id"].dataType.simpleString()
    n_docs, n_terms = indexed.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_items, n_asked = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(-(-n_items // BLOCK_ITEMS), -(-n_asked // BLOCK_TERMS))
    parts = []
    for block in range(blocks if n_docs else 0):
        own: dict[object, list[bytes]] = {}
        for item, terms in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect():
            own[item] = sorted({*own.get(item, ()), *map(bytes, terms)})
        if own:
            part = _search_block(indexed, own, n_docs, n_terms, k, kind)
            parts.append(materialise(part, "ranked") if blocks > 1 else part)
    if not parts:
        return asked.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id {indexed.schema['doc_id'].dataType.simpleString()}, score long")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    first = every.withColumn("_group", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS)))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "_group").orderBy(*order))).where(F.col("rank") <= k)
    ranked = first.drop("_group").withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")

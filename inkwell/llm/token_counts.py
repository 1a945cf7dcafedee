"""Token counts with a digest cache.

A cache table holds (digest, version, n_tokens): the digest of the normalised
content and the digest of the tokenizer's file. Contents without an entry are
reduced to distinct ones, encoded once, and appended; then every document takes
its count from the cache by its digest. The cache lies in the shared folder and
lasts: later runs encode only what no run before has seen. Each run appends a folder of its own, so
runs at the same time do not disturb each other (what two of them encode stands there twice, with one count).
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import looked_up, materialise, of_row, packed, shared_dir, unpacked

CACHE_SCHEMA = "digest string, version string, n_tokens long"
#: Pieces of text whose count a worker remembers: at most so many, of at most so many characters, so that its memory stays bounded.
REMEMBERED, LONGEST = 400_000, 100
#: A single space between two characters that are no white space (by any definition) always begins a pre-token of a
#: byte-level BPE, so the counts of the pieces on its two sides add up.
_PIECES = re.compile(r"(?<=\S) (?=\S)")


def version_of(path: str) -> str:
    """The digest of a tokenizer's file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def normalised(text: Column) -> Column:
    """The content that decides the count: the text itself (this tokenizer has no normaliser), null as empty."""
    return F.coalesce(text, F.lit(""))


def counter(path: str):
    """A function from a list of texts to their token counts by the ``tokenizers`` library, without added special tokens."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    special = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
    by_piece = tokenizer.normalizer is None and "ByteLevel(add_prefix_space=False" in repr(tokenizer.pre_tokenizer) and "use_regex=True" in repr(tokenizer.pre_tokenizer)
    first: dict[str, int] = {}  # counts of pieces at the start of a text
    after: dict[str, int] = {}  # counts of pieces with the space before them

    def encode(texts: list[str]) -> list[int]:
        return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of(texts: list[str]) -> list[int]:
        if not by_piece or any(s in t for t in texts for s in special):  # special strings are cut out by the library before any rule of ours
            return encode(texts)
        split = [_PIECES.split(t) for t in texts]
        if len(first) + len(after) > REMEMBERED:
            first.clear()
            after.clear()
        long_first, long_after = {}, {}  # for this batch alone

        def learn(pieces: set[str], known: dict[str, int], passing: dict[str, int], before: str) -> None:
            new = list(pieces - known.keys())
            for piece, n in zip(new, encode([before + x for x in new])):
                (known if len(piece) <= LONGEST else passing)[piece] = n

        learn({p[0] for p in split}, first, long_first, "")
        learn({x for p in split for x in p[1:]}, after, long_after, " ")
        return [(first.get(p[0]) or long_first.get(p[0], 0)) + sum(after[x] if x in after else long_after[x] for x in p[1:]) for p in split]

    return of


#: Digests up to this number are sent to all tasks, which then pick the texts to encode where they are stored.
MAX_BROADCAST_MISSES = 200_000


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, *, text_col: str = "text", batch: int = 64) -> DataFrame:
    """``docs`` with n_tokens, from the cache at ``cache_path`` (made if absent, appended to otherwise).

    Counts are exact for whole texts of any length; null counts as empty (0 tokens). Copies
    are encoded once however many there are. Repeated rows and ties get equal
    counts. An input column ``n_tokens`` is replaced, all others are kept, whatever their names. An empty table gives an empty one.
    """
    names, spark, version = docs.columns, docs.sparkSession, version_of(tokenizer_path)
    content = normalised(of_row(text_col))
    docs = packed(docs)
    digest = F.sha2(content, 256)
    digests = materialise(docs.select(digest.alias("digest")), "digests")  # what follows asks for digests alone; texts are read again for the misses
    cache = read_cache(spark, cache_path).where(F.col("version") == version).select("digest")
    missing = materialise(digests.distinct().join(cache, "digest", "left_anti"), "misses")
    few = missing.limit(MAX_BROADCAST_MISSES + 1).count() <= MAX_BROADCAST_MISSES
    texts = docs.select(digest.alias("digest"), content.alias("content"))
    # With many misses copies are dropped before the shuffle, in each partition first.
    misses = texts.join(F.broadcast(missing), "digest", "left_semi").dropDuplicates(["digest"]) if few else texts.dropDuplicates(["digest"]).join(missing, "digest", "left_semi")

    @F.pandas_udf("long")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(tokenizer_path)
        for part in parts:
            texts, out = part.tolist(), []
            for at in range(0, len(texts), batch):
                out += count(texts[at : at + batch])
            yield pd.Series(out, dtype="int64")

    misses.select("digest", F.lit(version).alias("version"), encode("content").alias("n_tokens")).write.parquet(f"{cache_path}/run={uuid.uuid4().hex}")
    every = read_cache(spark, cache_path).where(F.col("version") == version)
    known = every.join(digests.distinct(), "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = docs.select("row", digest.alias("digest"))
    return unpacked(looked_up(rows, materialise(known, "known"), ["digest"], keys=digests), names, {"n_tokens": F.col("n_tokens")})


def compact(spark: SparkSession, path: str) -> None:
    """The runs of a cache as one run with each count once. For times when nothing else uses the cache: the runs found at the start are deleted at the end."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        return
    runs = [x.getPath() for x in store.listStatus(where) if not x.getPath().getName().startswith(("_", "."))]
    read_cache(spark, path).groupBy("digest", "version").agg(F.max("n_tokens").alias("n_tokens")).write.parquet(f"{path}/run={uuid.uuid4().hex}")
    for run in runs:
        store.delete(run, True)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache; empty if there is none yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).option("recursiveFileLookup", "true").parquet(path)


def cache_path(spark: SparkSession, corpus: str) -> str:
    """The place of the lasting cache of a corpus, by its path, in the shared folder."""
    return f"{shared_dir(spark)}/token-counts/{hashlib.sha256(corpus.rstrip('/').encode()).hexdigest()}"

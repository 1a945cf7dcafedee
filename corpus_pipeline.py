"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents. All but the last keep
the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import decontaminate, mixing, near_copies, quality, sharding
from inkwell.llm.common import scratch, shared_dir, table
from inkwell.llm.queries import SHARDS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and wordless texts are rejected; equal texts get one verdict; an empty table stays empty."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies by SimHash: fingerprints of 192 bytes over shingles of five words (op6's 64 bits are too narrow), their inverted index by byte position and the count of shared lists give the pairs, of which those with a similarity of 0.8 or more link. Texts without words (null, empty) are one group; different texts of one id are different documents, equal rows one; rows without an id stay; an empty table stays empty."""
    return near_copies.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly such passages go. n_chars follows the text. Null, empty and wordless texts stay as they are; equal texts are cut alike; an empty table stays empty."""
    cleaned = decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))
    if "n_chars" in docs.columns:
        from pyspark.sql import functions as F

        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that a document is taken. Null sources are one source; texts without words count nothing and are taken as often as their source as a whole; equal rows and ties by digest are taken together; an empty table stays empty."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there: nulls, empty texts and repeated rows as any other; columns named shard or slot are replaced; an empty table stays empty."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", mixing_sources),
    ("sharding", shards),
]

#: SQL expresses neither the fingerprints and components of stage 2 nor the automaton and draws of the later ones; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what stands between them goes to the shared folder and is deleted when the next stage is written."""
    docs = table(spark, sf_dir, "documents")
    base, before = f"{shared_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}", None
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark) as done:
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
            done += [before] if before else []
        docs, before = spark.read.parquet(f"{base}/{k}"), f"{base}/{k}"
    return docs

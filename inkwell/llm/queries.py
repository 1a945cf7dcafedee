"""The registered queries of the operators, with production parameters over whole tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, language_id, lexical_search, line_dedup, mixing, nearest, quality, sharding, simhash, token_counts, url_filter, whitening
from .common import materialise, table

SHARDS = 40
TOKEN_LIMIT = 512
BEST_DOCUMENTS = 10
NEIGHBOURS = 5


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    network = language_id.fit(docs)
    return language_id.identify(docs.drop("lang"), network).select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", n_bytes.alias("n_bytes"))  # so that the text need not come along to the last join
    counted = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), token_counts.cache_path(spark, sf_dir))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = decontaminate.find(docs, items).select("doc_id", "found.*")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.membership(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return quality.judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "n_toxic")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32")
    )
    return sharding.shard(docs, SHARDS).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.repetitions(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "source", "repeats")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_deleted", "text")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    return lexical_search.search(materialise(lexical_search.index(docs), "index"), items, BEST_DOCUMENTS)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = nearest.points(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    queries = materialise(usable.where(F.col("vec_id") % 50 == 0), "queries")
    return nearest.search(materialise(nearest.index(usable), "blocks"), queries, NEIGHBOURS)


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_html_extraction, op3_url_filters, op4_token_counts, op5_benchmark_decontamination,
        op6_simhash_near_dedup, op7_quality_rules, op8_sharding, op9_mixing, op10_line_dedup,
        op11_lexical_search, op12_embedding_whitening, op13_nearest_neighbours,
    )
}

#: The other queries have no SQL that gives their rows: they hold trained models, tokenizer counts, automata, hash-seeded draws, roots of polynomials, approximate search or graph components.
ORACLE_SQL: dict[str, str] = {
    "op11_lexical_search": r"""
        WITH document_terms AS (
            SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)
        ), item_terms AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark
        ), lengths AS (SELECT row, count(*) AS n FROM document_terms GROUP BY row
        ), corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths
        ), occurrences AS (
            SELECT row, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM document_terms SEMI JOIN item_terms USING (term) GROUP BY row, term
        ), weights AS (
            SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
            FROM (SELECT term, count(*) AS df FROM occurrences GROUP BY term), corpus
        ), scores AS (
            SELECT item_id, doc_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // terms)))))::BIGINT AS score
            FROM occurrences JOIN item_terms USING (term) JOIN weights USING (term) JOIN lengths USING (row), corpus GROUP BY item_id, doc_id, row
        ), ranked AS (
            SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
}

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkwell.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def slow(texts):
    t = Tokenizer.from_file(PATH)
    return [len(t.encode(x, add_special_tokens=False)) for x in texts]


def samples():
    rng = random.Random(4)
    odd = [" ", "  ", "\n", "\t", "a", "'s", "'", "<|endoftext|>", "é", "\u2009", "\u00a0", "\x1c", "\x85", "\u3000", "\u180e", "\u200b", "1", "-", ".", "日", "🙂", "<|end", "B"]
    return ["", " ", "a  b", "x \n y", "it's a <|endoftext|> b", "end ", " start"] + ["".join(rng.choice(odd) for _ in range(rng.randrange(1, 30))) for _ in range(600)] + ["word " * 5000]


def test_piecewise_counts_equal_the_library():
    texts = samples()
    assert token_counts.counter(PATH)(texts) == slow(texts)


def test_other_tokenizers_are_not_cut():
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = samples()[:50]
    assert token_counts.counter(path)(texts) == [len(t.encode(x, add_special_tokens=False)) for x in texts]


def test_cache_is_used_and_appended(spark, documents, tmp_path):
    cache = str(tmp_path / "cache")
    texts = ["one two", None, "", "one two", "three <|endoftext|>"]
    docs = documents(texts).withColumn("N_tokens", F.lit("x"))
    out = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, PATH, cache).collect()}
    assert out == dict(enumerate(slow([t or "" for t in texts])))
    assert token_counts.read_cache(spark, cache).count() == 3  # distinct contents
    more = token_counts.count_tokens(documents(["one two", "four"]), PATH, cache)
    assert sorted(r["n_tokens"] for r in more.collect()) == sorted(slow(["one two", "four"]))
    assert token_counts.read_cache(spark, cache).count() == 4
    version = token_counts.version_of(PATH)
    spark.createDataFrame([(spark.range(1).select(F.sha2(F.lit("five"), 256)).first()[0], version, 99)], token_counts.CACHE_SCHEMA).write.mode("append").parquet(cache)
    assert token_counts.count_tokens(documents(["five"]), PATH, cache).first()["n_tokens"] == 99  # read, not encoded again
    other = token_counts.count_tokens(documents(["five"]), public_tokenizers.path("word_bpe_49k.json"), cache)
    assert other.first()["n_tokens"] != 99  # another version


def test_empty(spark, documents, tmp_path):
    assert token_counts.count_tokens(documents(["a"]).limit(0), PATH, str(tmp_path / "c")).count() == 0


def test_memory_limit_does_not_change_counts(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    count, texts = token_counts.counter(PATH), samples()[:80]
    assert [c for t in texts for c in count([t])] == slow(texts)


@pytest.mark.parametrize("text", ["a" * 3000, "x" * 10 + "\n" * 50])
def test_long_runs(text):
    assert token_counts.counter(PATH)([text]) == slow([text])


@pytest.mark.parametrize("few", [True, False])
def test_op4_costs_the_same_whatever_other_corpora_were_counted(spark, documents, tmp_path, monkeypatch, few):
    from inkwell.llm import queries

    monkeypatch.setattr(token_counts, "MAX_BROADCAST_MISSES", 10 if few else 1)
    texts = {"one": ["one two", None, "x"], "two": ["one two", "x", "x", "", None, "y z"]}
    cached = lambda name: token_counts.read_cache(spark, token_counts.cache_path(spark, f"{tmp_path}/{name}")).count()
    for name, distinct in (("one", 3), ("two", 4)):
        documents(texts[name]).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _ in range(2):  # the second time from the cache
            out = {r["doc_id"]: r["n_tokens"] for r in queries.op4_token_counts(spark, f"{tmp_path}/{name}").collect()}
            assert out == dict(enumerate(slow([t or "" for t in texts[name]]))) and cached(name) == distinct

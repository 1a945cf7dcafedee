import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from inkwell.llm import near_copies


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def survivors(texts):
    """The smallest id of each component, by the Jaccard similarity of all pairs."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for b in range(len(texts)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted({find(i) for i in range(len(texts))})


def corpus(groups, size):
    rng = random.Random(5)
    texts = [None, "", "one two", "One two", "three"]
    for g in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    return texts


def test_edited_copies_go_and_others_stay(spark, documents):
    texts = corpus(20, 6)
    kept = corpus_pipeline.simhash_near_dedup(spark, documents(texts), "").collect()
    assert sorted(r["doc_id"] for r in kept) == survivors(texts)


def test_large_groups_by_blocks(spark, documents):
    texts = corpus(3, 40)
    kept = near_copies.keep_one(documents(texts), long_list=3, block=8).collect()
    assert sorted(r["doc_id"] for r in kept) == survivors(texts)


def test_votes_and_runs_are_a_simhash():
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 254, 255, 256, 1000):
        sets = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        x = near_copies._mixed(sets[:, None] * near_copies._MULTIPLIERS).astype("<u8")
        votes = np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=int)
        assert near_copies.votes_of(sets).ravel().tolist() == votes.tolist()
        bits = (2 * votes > n).reshape(-1, 24)
        runs = near_copies.runs_of(sets)
        assert [r & (1 << 24) - 1 for r in runs] == [sum(1 << i for i in np.flatnonzero(b).tolist()) for b in bits]
        for r, v in zip(runs, np.abs(2 * votes - n).reshape(-1, 24)):  # the other bits are no closer (odd and even by one)
            assert max(v[r >> 24 & 255], v[r >> 32]) <= np.sort(v)[1] + 1 and r >> 24 & 255 != r >> 32
    assert near_copies.runs_of(np.zeros(0, dtype=np.uint64)) == []


def test_the_index_finds_pairs_of_the_least_similarity(spark):
    rng, rows = np.random.default_rng(4), []
    for k in range(500):
        n = int(rng.integers(10, 400))
        own = max(1, int(2 * n * 0.2 / 1.8 / 2))  # of n shingles: a similarity from 0.8 up, as near to it as can be
        h = rng.integers(0, 2**64, n + own, dtype=np.uint64)
        rows += [(2 * k + i, n, near_copies.runs_of(s)) for i, s in enumerate((h[:n], h[own:]))]
    nodes = spark.createDataFrame(rows, "node long, size long, runs array<long>")
    found = {(r["a"], r["b"]) for r in near_copies.candidates(near_copies.index_of(nodes).withColumn("cluster", F.col("node"))).collect()}
    assert found <= {(2 * k, 2 * k + 1) for k in range(500)} and len(found) >= 495


def test_a_pair_that_meets_in_one_run_is_dropped_by_the_count(spark):
    runs = lambda shared, own: [1 << 24 | 2 << 32 | 8 * k + (0 if k in shared else own * 4096) for k in range(near_copies.LISTS)]
    index = lambda shared, size=20: near_copies.index_of(spark.createDataFrame([(1, 20, runs(shared, 1)), (2, size, runs(shared, 2))], "node long, size long, runs array<long>")).withColumn("cluster", F.col("node"))
    assert index({5}).count() == 8 and near_copies.candidates(index({5})).count() == 0  # four postings of each
    assert near_copies.candidates(index({5, 63})).collect() == [(1, 2)]
    assert near_copies.candidates(index({5, 63}, 40)).count() == 0  # sizes too different for the similarity
    assert near_copies.candidates(index({5, 63}).withColumn("cluster", F.lit(1))).count() == 0  # compared by the blocks of their cluster

import numpy as np
from pyspark.sql import functions as F

from inkwell.llm import sharding


def placed(df, shards):
    return sorted((r["shard"], r["slot"], r["doc_id"]) for r in sharding.shard(df, shards).select("shard", "slot", "doc_id").collect())


def check_exact(rows, n, shards):
    assert len(rows) == n
    sizes = [sum(1 for r in rows if r[0] == s) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert [r[1] for r in rows if r[0] == s] == list(range(sizes[s]))


def test_exact_sizes_and_gapless_slots(spark, documents):
    df = documents([f"text {i % 7}" for i in range(503)])
    rows = placed(df, 40)
    check_exact(rows, 503, 40)
    assert sorted(r[2] for r in rows) == list(range(503))
    assert rows == placed(df.repartition(7).orderBy(F.desc("doc_id")), 40)  # layout does not matter


def test_nulls_repeats_clashing_names_and_empty(spark, documents):
    df = documents(["a", None, "", "a"] * 5).withColumn("doc_id", F.lit(1).cast("long")).withColumn("SHARD", F.lit(9))
    out = sharding.shard(df, 3)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    check_exact(sorted((r["shard"], r["slot"], 0) for r in out.collect()), 20, 3)
    assert sharding.shard(documents(["x"]).limit(0), 5).count() == 0


def test_several_blocks_of_a_shard(spark, documents):
    df = documents([str(i) for i in range(200)])
    out = sharding.shard(df, 3, rows_per_task=10)
    check_exact(sorted((r["shard"], r["slot"], r["doc_id"]) for r in out.collect()), 200, 3)


def test_matrix_has_the_margins_and_the_hypergeometric_law():
    matrix = sharding.communication_matrix([10, 0, 25, 5], np.array([20, 15, 5]), 1)
    assert matrix.sum(axis=1).tolist() == [10, 0, 25, 5] and matrix.sum(axis=0).tolist() == [20, 15, 5]
    draws = [sharding.communication_matrix([4, 6], np.array([5, 5]), s)[0, 0] for s in range(4000)]
    expected = {0: 5, 1: 50, 2: 100, 3: 50, 4: 5}  # C(5,k) C(5,4-k) of 210
    for k, ways in expected.items():
        assert abs(draws.count(k) / 4000 - ways / 210) < 0.03


def test_pieces_give_the_same_places(spark, documents, monkeypatch):
    monkeypatch.setattr(sharding, "MOST", 4)
    df = documents([str(i) for i in range(200)])
    where = lambda n: sorted((r["shard"], r["slot"], r["doc_id"]) for r in sharding.shard(df, 3, rows_per_task=n).collect())
    assert where(7) == where(50)
    check_exact(where(1), 200, 3)


def test_large_urns_have_exact_margins_and_the_law(monkeypatch):
    places = np.full(10, 3 * 10**10 // 10)
    counts = [10**10 + 7, 0, 10**10, 10**10 - 7]
    matrix = sharding.communication_matrix(counts, places, 1)
    assert matrix.sum(axis=1).tolist() == counts and matrix.sum(axis=0).tolist() == places.tolist() and matrix.min() >= 0
    deviation = (10**10 * 0.1 * 0.9 * (2 / 3)) ** 0.5
    assert np.abs(matrix[[0, 2, 3]] - 10**9).max() < 6 * deviation and np.abs(matrix[[0, 2, 3]] - 10**9).max() > 0.2 * deviation
    monkeypatch.setattr(sharding, "URN", 1)
    draws = [sharding.communication_matrix([4, 6], np.array([5, 5]), s)[0, 0] for s in range(4000)]
    for k, ways in {0: 5, 1: 50, 2: 100, 3: 50, 4: 5}.items():
        assert abs(draws.count(k) / 4000 - ways / 210) < 0.03


def test_every_row_can_land_anywhere(spark, documents):
    df = documents([str(i) for i in range(60)])
    seen = {s: {r["doc_id"] for r in sharding.shard(df, 2, seed=s).where("shard = 0").collect()} for s in range(4)}
    assert len({frozenset(v) for v in seen.values()}) == 4

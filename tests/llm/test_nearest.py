"""Nearest neighbours against all pairs."""

import math

import numpy as np
import pytest

from inkwell.llm import nearest
from inkwell.llm.common import materialise

SCHEMA = "vec_id long, embedding array<float>, score double"


def found(spark, rows, k=5, every=10):
    usable = nearest.points(spark.createDataFrame([(i, v, 0.0) for i, v in rows], SCHEMA))
    queries = materialise(usable.where(f"vec_id % {every} = 0"), "queries")
    out = {}
    for r in nearest.search(materialise(nearest.index(usable), "blocks"), queries, k).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(x) for q, x in out.items()}


def brute(rows, k=5, every=10):
    ids, v = [i for i, _ in rows], np.array([np.float32(v) for _, v in rows], dtype=np.float64)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    out = {}
    for q, u in zip(ids, unit):
        if q % every == 0:
            out[q] = sorted(((-round(float(s), 12), i) for i, s in zip(ids, unit @ u) if i != q))[:k]
    return out


def recall(got, want):
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i in x}) for q, x in want.items())
    return hits / sum(map(len, want.values()))


def gaussian(n, d, seed, centres=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d))
    if centres:
        v = 0.3 * v + rng.normal(size=(centres, d))[rng.integers(0, centres, n)]
    return [(i, x) for i, x in enumerate(v.astype(np.float32).tolist())]


@pytest.mark.parametrize("centres", [0, 12])
def test_recall(spark, centres, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 500)
    rows = gaussian(1500, 24, 3, centres)
    got, want = found(spark, rows), brute(rows)
    assert got.keys() == want.keys() and all([r for r, _, _ in x] == [1, 2, 3, 4, 5] for x in got.values())
    assert recall(got, want) >= 0.95
    every = {q: {i: -t for t, i in x} for q, x in brute(rows, len(rows)).items()}
    for q, x in got.items():
        assert all(math.isclose(s, every[q][i], abs_tol=1e-10) for _, i, s in x)
        assert [(-s, i) for _, i, s in x] == sorted((-s, i) for _, i, s in x) and q not in {i for _, i, _ in x}


def test_a_third_are_copies(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 128)
    rows = gaussian(600, 16, 4)
    rows += [(1000 + i, rows[5][1]) for i in range(300)]
    got = found(spark, rows)
    for q in range(1000, 1300, 10):  # nearest to a copy are the copies with the smallest ids
        assert [i for _, i, _ in got[q]] == [i for i in (5, *range(1000, 1007)) if i != q][:5]
    assert recall(got, brute(rows)) >= 0.95


def test_what_takes_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0]), (10, None), (20, [0.0, 0.0]), (30, [math.nan, 1.0]), (40, [None, 1.0]), (50, [1.0]), (60, []), (70, [math.inf, 0.0]), (3, [2.0, 0.0])]
    got = found(spark, rows)
    assert got.keys() == {0} and [i for _, i, _ in got[0]] == [3, 1, 2] and got[0][0][2] == 1.0 and got[0][2][2] == -1.0


def test_empty_and_alone(spark):
    assert found(spark, []) == {} and found(spark, [(0, [1.0, 2.0])]) == {}


def test_blocks_of_queries_and_large_entries(spark, monkeypatch):
    monkeypatch.setattr(nearest, "QUERIES", 7)
    rows = [(i, (np.float32(1e30) * np.array(v, np.float32)).tolist()) for i, v in gaussian(300, 12, 9)]
    assert recall(found(spark, rows), brute([(i, (np.array(v) / 1e30).tolist()) for i, v in rows])) >= 0.95


def test_threshold():
    assert 1 <= nearest.threshold(1) < nearest.threshold() < nearest.LINES

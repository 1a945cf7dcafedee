"""Whitening against numpy's eigenvectors, and its exact parts against plain integers and fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest

from inkwell.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int"


def plain(rows, components=16):
    """The fit list's mean, eigenvalues and eigenvectors in doubles."""
    x = np.floor(64 * np.array([np.float32(v) for v in rows], dtype=np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return x, n, s, values[::-1][:components], vectors[:, ::-1][:, :components], values.sum()


def check(spark, rows, usable, components=16):
    out = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), components).collect()
    x, n, s, values, vectors, trace = plain([v for _, v in usable], components)
    count = int((values > 1e-9).sum())
    assert sorted((r["vec_id"], r["component"]) for r in out) == sorted((i, c) for i, _ in usable for c in range(1, count + 1))
    white = ((n * x - s) / n) @ vectors[:, :count] / np.sqrt(values[:count])
    place = {i: k for k, (i, _) in enumerate(usable)}
    for r in out:
        k, c = place[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[k], s))
        assert abs(abs(r["whitened"]) - abs(white[k, c])) < 1e-8 and math.isclose(r["explained"], values[c] / trace, rel_tol=1e-10)
        assert r["identity_error"] < 1e-9
    for c in range(count):  # one sign for all rows
        signs = {np.sign(r["whitened"]) * np.sign(white[place[r["vec_id"]], c]) for r in out if r["component"] == c + 1 and abs(r["whitened"]) > 1e-6}
        assert len(signs) == 1
    return out


def test_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 20)).astype(np.float32))]
    good += [(1000 + i, good[7][1]) for i in range(200)]  # copies count once
    bad = [(2000, None), (2001, [1.0, None] * 10), (2002, [math.nan] * 20), (2003, [math.inf] * 20), (2004, []), (2005, [1.0] * 19), (2006, [math.nan, None] * 10)]
    check(spark, good + bad, good)


def test_less_than_full_rank(spark):
    rng = np.random.default_rng(6)
    low = [(i, [*v, 0.5, v[0]]) for i, v in enumerate(rng.normal(size=(50, 3)).astype(np.float32).tolist())]  # a constant, and one dimension twice
    assert {r["component"] for r in check(spark, low, low)} == {1, 2, 3}


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_no_component(spark, rows):
    assert whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect() == []


def test_one_eigenvalue_of_many_components(spark):
    corners = [(k, [float(x) for x in np.eye(4)[k // 2] * (1 if k % 2 else -1)]) for k in range(8)]
    out = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in corners], SCHEMA)).collect()
    assert {r["component"] for r in out} == {1, 2, 3, 4} and all(r["identity_error"] < 1e-12 for r in out) and all(abs(r["explained"] - 0.25) < 1e-12 for r in out)


def test_entries_that_are_very_large(spark):
    out = whitening.whiten(spark.createDataFrame([(1, [1e30, 1.0], 0), (2, [-1e30, 2.0], 0), (3, [0.0, 3.0], 0)], SCHEMA)).collect()
    assert len(out) == 6 and all(r["identity_error"] < 1e-6 for r in out)


def test_polynomial_and_roots(spark):
    rng = np.random.default_rng(7)
    half = rng.integers(-9, 9, size=(6, 6))
    matrix = [[int(v) for v in row] for row in half @ half.T]
    found = whitening.characteristic_polynomial(spark, matrix)
    for t in (-3, 0, 2, 11):  # the determinant of t - matrix in fractions
        m = [[Fraction(t * (i == j) - matrix[i][j]) for j in range(6)] for i in range(6)]
        product = Fraction(1)
        for k in range(6):
            pivot = next((i for i in range(k, 6) if m[i][k]), None)
            if pivot is None:
                product = Fraction(0)
                break
            if pivot != k:
                m[k], m[pivot], product = m[pivot], m[k], -product
            product *= m[k][k]
            for i in range(k + 1, 6):
                f = m[i][k] / m[k][k]
                m[i] = [a - f * b for a, b in zip(m[i], m[k])]
        assert sum(c * t**k for k, c in enumerate(found)) == product
    roots = np.linalg.eigvalsh(np.array(matrix, float))[::-1]
    assert [whitening.roots_above(found, int(r) - 1) >= k for k, r in enumerate(roots, 1)] == [True] * 6
    assert [math.floor(r) for r in roots] == [whitening.isolated(found, k, 10**6) for k in range(1, 7)]


def test_hessenberg_with_zero_pivots():
    p = whitening._primes(1)[0]
    assert p == 2**31 - 1
    assert whitening.polynomial_modulo(np.array([[0, 0, 1], [0, 2, 0], [1, 0, 0]]), p).tolist() == [2, p - 1, p - 2, 1]  # (t*t - 1)(t - 2)
    assert whitening.polynomial_modulo(np.zeros((1, 1), np.int64), p).tolist() == [0, 1]

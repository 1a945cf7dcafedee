"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Entries become integers, so the scatter n*sum(x x') - S S' = n*n*V of the fit list is exact whatever the order of summation:
centred, as sums over a fixed shift are subtracted in integers. Each task reduces the matrix to Hessenberg form modulo
some primes and reads the polynomial there; Chinese remaindering joins the residues. All roots of the polynomial are
real, so by Descartes' rule the sign changes after a shift count the roots above it: each of the largest roots is isolated by
bisection, down to 2**-96 of the mean root. At such a root inverse iteration in integers gives the null space, the component.

Rows whose vector is null, empty, or holds null or non-finite entries are dropped, as are vectors of another dimension than most
rows have (of equal counts the larger). 64*c is kept within 32 bits. ``deviation`` is null where it exceeds a long. A constant dimension or
fewer vectors than dimensions lower the rank: there are as many components as eigenvalues above 0, so none for fewer than two
different vectors. Components of one eigenvalue are an orthonormal basis of its space. Repeated rows and rows of one id are all kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, named

#: x = floor(SCALE*c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Roots are found to this many bits below their mean.
ROOT_BITS = 96
#: Primes that one task works on.
PRIMES_PER_TASK = 8
_ROWS = 2048


def points(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, y): the usable rows with y = floor(SCALE*c) as 32-bit integers (x without its shift)."""
    vector = named(vec_col).cast("array<double>")
    usable = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(math.inf)), F.lit(False)))
    whole = F.transform(vector, lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-(2.0**31))), F.lit(2.0**31 - 1))).cast("int"))
    kept = vectors.where(F.coalesce(usable & (F.size(vector) > 0), F.lit(False))).select(named(id_col).alias("vec_id"), whole.alias("y"))
    sizes = kept.groupBy(F.size("y").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return kept.where(F.size("y") == (sizes[0]["d"] if sizes else 0))


def matrix_of(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("y")
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.int64) if len(column) else np.zeros((0, 0), np.int64)


def _products(y: np.ndarray) -> np.ndarray:
    """y' y in Python integers: products of 16-bit halves are exact in doubles."""
    halves = (y & 0xFFFF).astype(np.float64), (y >> 16).astype(np.float64)
    low, mixed, high = halves[0].T @ halves[0], halves[0].T @ halves[1], halves[1].T @ halves[1]
    whole = [x.astype(np.int64).astype(object) for x in (low, mixed + mixed.T, high)]
    return whole[0] + whole[1] * 2**16 + whole[2] * 2**32


def moments(fit: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, sums of products) of the distinct vectors y: exact sums of each task, summed by Spark. The driver gets an entry per pair of dimensions."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                y = matrix_of(whole.slice(start, _ROWS))
                y = np.concatenate([np.ones((len(y), 1), np.int64), y], axis=1)  # so the sums and n are products as well
                part = _products(y)
                for i, j in zip(*np.triu_indices(len(part))):
                    total[int(i), int(j)] = total.get((int(i), int(j)), 0) + int(part[i, j])
        keys = list(total)
        values = pa.array([Decimal(total[x]) for x in keys], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in keys], pa.int32()), pa.array([j for _, j in keys], pa.int32()), values], names=["i", "j", "v"])

    rows = fit.select("y").mapInArrow(summed, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    found = {(r["i"], r["j"]): int(r["v"]) for r in rows}
    d = max((j for _, j in found), default=0)
    n = found.get((0, 0), 0)
    return n, [found[0, j] for j in range(1, d + 1)], [[found[min(i, j), max(i, j)] for j in range(1, d + 1)] for i in range(1, d + 1)]


def _primes(count: int) -> list[int]:
    """The largest primes below 2**31, by Miller and Rabin's test with bases that decide all of them."""

    def prime(p: int) -> bool:
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 3, 5, 7):
            x = pow(base, odd, p)
            if x not in (1, p - 1) and all((x := x * x % p) != p - 1 for _ in range(twos - 1)):
                return False
        return True

    found, p = [], 2**31 - 1
    while len(found) < count:
        if prime(p):
            found.append(p)
        p -= 2
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """The coefficients, constant first, of det(t - matrix) modulo ``p``: reduction to Hessenberg form, then its recurrence."""
    h, d = matrix % p, len(matrix)
    for k in range(d - 2):
        (below,) = np.nonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:  # the same exchange of rows and columns
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factors = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factors[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factors % p).sum(axis=1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)  # of the leading blocks, a polynomial each
    minors[0, 0] = 1
    for k in range(1, d + 1):
        shares, product = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            shares[i] = int(h[i, k - 1]) * product % p
            product = product * int(h[i, i - 1]) % p if i else product
        minors[k, 1:] = minors[k - 1, :-1]
        minors[k] = (minors[k] - (shares[:, None] * minors[:k] % p).sum(axis=0)) % p
    return minors[d]


def characteristic_polynomial(spark: SparkSession, scatter: list[list[int]]) -> list[int]:
    """The integer coefficients, constant first, of a symmetric matrix without eigenvalues below 0."""
    d, trace = len(scatter), sum(scatter[i][i] for i in range(len(scatter)))
    # The k-th coefficient is a symmetric sum of roots: at most binomial(d, k) * (trace/d)**k in size.
    bits = max(math.log2(math.comb(d, k)) + k * math.log2(max(2, trace / d)) for k in range(d + 1)) + 2
    primes = _primes(math.ceil(bits / 30.9) + 1)
    tasks = -(-len(primes) // PRIMES_PER_TASK)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column("id").to_pylist():
                own = primes[task::tasks]
                found = [polynomial_modulo(np.array([[v % p for v in row] for row in scatter], np.int64), p).tolist() for p in own]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["p", "residues"])

    rows = spark.range(0, tasks, 1, tasks).mapInArrow(reduced, "p long, residues array<long>").collect()  # a row per prime
    values, modulus = [0] * (d + 1), 1
    for p, residues in rows:
        inverse = pow(modulus, -1, p)
        values = [v + modulus * ((r - v) * inverse % p) for v, r in zip(values, residues)]
        modulus *= p
    return [v - modulus if v > modulus // 2 else v for v in values]


def roots_above(coefficients: list[int], at: int) -> int:
    """How many roots, with multiplicity, lie above an integer: sign changes after the shift, exact as all roots are real."""
    c = list(coefficients)
    for i in range(len(c) - 1):
        carry = c[-1]
        for j in range(len(c) - 2, i - 1, -1):
            carry = c[j] = c[j] + at * carry
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def isolated(coefficients: list[int], k: int, above: int) -> int:
    """The largest integer with ``k`` roots above it, for roots between 0 and ``above``: the k-th root is less than 1 higher."""
    low, high = -1, above
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if roots_above(coefficients, middle) >= k else (low, middle)
    return low


def null_vector(matrix: list[list[int]], root: int, shift: int, seed: int) -> np.ndarray:
    """A unit vector of the null space of ``matrix - root/2**shift``: inverse iteration in integers with guard bits."""
    d, guard = len(matrix), 160
    m = np.array([[(v << (shift + guard)) for v in row] for row in matrix], dtype=object).reshape(d, d)
    for i in range(d):
        m[i, i] -= root << guard
    steps = []
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda i: abs(m[k + i, k]))
        if pivot != k:
            m[[k, pivot]] = m[[pivot, k]]
        if not m[k, k]:
            m[k, k] = 1
        factors = (m[k + 1 :, k] << (2 * guard)) // m[k, k]
        m[k + 1 :, k:] -= (factors[:, None] * m[k, k:]) >> (2 * guard)
        steps.append((pivot, factors))
    size = m[0, 0].bit_length() + 4 * guard
    x = np.array([int(v * 2**53) << size for v in np.random.default_rng(seed).normal(size=d)], dtype=object)
    for _ in range(4):
        for k, (pivot, factors) in enumerate(steps):
            x[[k, pivot]] = x[[pivot, k]]
            x[k + 1 :] -= (factors * x[k]) >> (2 * guard)
        for k in range(d - 1, -1, -1):
            x[k] = (x[k] - sum(m[k, k + 1 :] * x[k + 1 :])) // m[k, k]
        top = max(abs(v) for v in x) or 1
        x = np.array([(v << size) // top for v in x], dtype=object)
    unit = np.array([v / (1 << size) for v in x], np.float64)  # the quotient of two integers is rounded once
    return unit / math.sqrt(math.fsum(unit * unit))


def eigen(spark: SparkSession, scatter: list[list[int]], count: int) -> tuple[list[Fraction], np.ndarray]:
    """The largest eigenvalues above 0, at most ``count``, and unit eigenvectors as rows; a task for each."""
    d, trace = len(scatter), sum(scatter[i][i] for i in range(len(scatter)))
    if not trace:
        return [], np.zeros((0, d))
    c = characteristic_polynomial(spark, scatter)
    rank = d - next(k for k, v in enumerate(c) if v)
    shift = max(0, ROOT_BITS - (trace // d).bit_length())
    scaled = [v << (shift * (d - k)) for k, v in enumerate(c)]
    count = min(count, rank)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                root = isolated(scaled, k, (trace << shift) + 1)
                vector = null_vector(scatter, root, shift, k)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([str(root)]), pa.array([vector.tolist()], pa.list_(pa.float64()))], names=["k", "root", "vector"])

    rows = sorted(spark.range(1, count + 1, 1, count).mapInArrow(found, "k long, root string, vector array<double>").collect())
    vectors = np.array([r["vector"] for r in rows])
    for k, row in enumerate(rows):  # vectors of one root need not be orthogonal
        for other in range(k):
            if rows[other]["root"] == row["root"]:
                vectors[k] -= (vectors[k] @ vectors[other]) * vectors[other]
        vectors[k] /= np.linalg.norm(vectors[k])
    return [Fraction(2 * int(r["root"]) + 1, 2 << shift) for r in rows], vectors


class Fitted:
    """What rows are whitened by: n, sums of y, components as rows, eigenvalues of V and its trace."""

    def __init__(self, n: int, sums: list[int], components: np.ndarray, eigenvalues: list[float], trace: float):
        self.n, self.sums, self.components, self.eigenvalues, self.trace = n, sums, components, eigenvalues, trace
        self.identity_error: float | None = None

    def deviations(self, y: np.ndarray) -> np.ndarray:
        """n*x - S, exact; the shift of x cancels."""
        if (abs(y).max(initial=0) + 1) * self.n * 2 >= 2**63:
            y = y.astype(object)
        return y * self.n - np.array(self.sums, dtype=y.dtype)

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return (self.deviations(y) / self.n).astype(np.float64) @ self.components.T / np.sqrt(self.eigenvalues)

    def squares(self, y: np.ndarray) -> list[int | None]:
        x = self.deviations(y)
        if float(abs(x).max(initial=0)) ** 2 * x.shape[1] >= 2.0**62:
            x = x.astype(object)
        return [int(v) if v < 2**63 else None for v in (x * x).sum(axis=1)]


def fit(spark: SparkSession, distinct: DataFrame, components: int = COMPONENTS) -> Fitted | None:
    """``distinct``: the fit list, a row per different y; it is read three times. None if there is no component."""
    n, sums, products = moments(distinct)
    scatter = [[n * v - a * b for v, b in zip(row, sums)] for row, a in zip(products, sums)]
    roots, vectors = eigen(spark, scatter, components)
    if not roots:
        return None
    trace = sum(scatter[i][i] for i in range(len(scatter)))
    fitted = Fitted(n, sums, vectors, [float(r / n**2) for r in roots], float(Fraction(trace, n**2)))
    fitted.identity_error = identity_error(distinct, fitted)
    return fitted


def identity_error(distinct: DataFrame, fitted: Fitted) -> float:
    """The largest absolute entry of the whitened fit list's covariance, centred before multiplying, minus the identity."""
    k = len(fitted.eigenvalues)

    def sums(value) -> np.ndarray:
        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for whole in batches:
                for start in range(0, whole.num_rows, _ROWS):
                    total = total + value(fitted.whitened(matrix_of(whole.slice(start, _ROWS))))
            if not isinstance(total, int):
                yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel(), pa.float64())], names=["i", "v"])

        rows = distinct.select("y").mapInArrow(summed, "i int, v double").groupBy("i").sum("v").collect()  # a row per pair of components
        return np.array([v for _, v in sorted(rows)])

    mean = sums(lambda w: w.sum(axis=0)) / fitted.n
    covariance = sums(lambda w: (w - mean).T @ (w - mean)).reshape(k, k) / fitted.n
    return float(abs(covariance - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per usable row and component."""
    spark = vectors.sparkSession
    usable = points(vectors, id_col=id_col, vec_col=vec_col)
    fitted = fit(spark, materialise(usable.select("y").distinct(), "fit"), components)
    kind = usable.schema["vec_id"].dataType.simpleString()
    if fitted is None:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                y = matrix_of(batch)
                if len(y):
                    columns = pa.array(fitted.squares(y), pa.int64()), pa.array(list(fitted.whitened(y)), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *columns], names=["vec_id", "deviation", "whitened"])

    shares = F.array(*[F.lit(e / fitted.trace) for e in fitted.eigenvalues])
    each: Column = F.posexplode("whitened").alias("_at", "whitened")
    rows = usable.mapInArrow(projected, f"vec_id {kind}, deviation long, whitened array<double>").select("vec_id", "deviation", each)
    return rows.select(
        "vec_id", (F.col("_at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("_at")).alias("explained"), F.lit(fitted.identity_error).alias("identity_error"),
    )

"""Embedding whitening (operator 11): principal components of integer vectors from an exact characteristic polynomial.

Entries become integers, so the scatter matrix C = n * sum(x x') - S S' is exact (C / n^2 is the covariance). Its
characteristic polynomial is found modulo enough 31-bit primes (Hessenberg reduction, one Spark row a prime) and put
together by Chinese remaindering. All its roots are real, so the sign changes of the polynomial moved to a count the roots
above a exactly: bisection isolates the largest roots, and signs narrow them to 160 bits. The null space of C - e I is
found by inverse iteration in 100 digits; roots that 160 bits don't tell apart share one space. What the driver holds
is bounded by the square of the dimension, whatever the number of rows.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

SCALE, SHIFT = 64, 1_000_000
CLIP = float(1 << 61)  # entries whose scaled value is larger count as this one
BITS = 160  # relative precision of eigenvalues
DIGITS = 100  # of the inverse iteration


# ------------------------------------------------------------------ vectors


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, scale: int = SCALE) -> DataFrame:
    """(vec_id, y) with y = floor(scale * c) of each entry, of the rows whose vector is there, isn't empty, and has only
    finite entries. Vectors of another length than the commonest (the shortest of equally common ones) go."""
    v = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    v = v.where(F.size("v") > 0).where(F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf")))))
    common = v.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    whole = lambda c: F.floor(F.least(F.greatest(c * float(scale), F.lit(-CLIP)), F.lit(CLIP))).cast("bigint")
    return v.where(F.size("v") == (common.d if common else 1)).select("vec_id", F.transform("v", whole).alias("y"))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index(name))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


# ------------------------------------------------------------------ exact moments

LIMB = 20


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a' b of int64 matrices of at most 4,096 rows, exact, as Python integers: in double precision while every sum is
    below 2^53, else by limbs of 20 bits."""
    if not a.size:
        return np.zeros((a.shape[1], b.shape[1]), object)
    if max(np.abs(a).max(), 1) <= 1 << LIMB and max(np.abs(b).max(), 1) <= 1 << LIMB:
        return (a.astype(float).T @ b.astype(float)).astype(np.int64).astype(object)
    if np.abs(a).max() < np.abs(b).max():
        return _product(b, a).T
    high, low = a >> LIMB, a & ((1 << LIMB) - 1)
    return _product(high, b) * (1 << LIMB) + _product(low, b)


PART = 40  # bits of a part of a sum; parts are added by Spark, so that sums of any size are exact


def _parts(value: int) -> list[int]:
    """Signed parts of PART bits, the lowest first."""
    out, sign, value = [], (-1 if value < 0 else 1), abs(value)
    while value:
        out.append(sign * (value & ((1 << PART) - 1)))
        value >>= PART
    return out


def moments(fit: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """Number of rows of fit(y), their sums, and the sums of products, all exact. One pass; each task gives a row for
    every part of every sum, which Spark adds up."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, 0, 0
        for batch in batches:
            y = _matrix(batch, "y")
            for k in range(0, len(y), 4096):
                part = y[k : k + 4096]
                n += len(part)
                s = s + _product(np.ones((len(part), 1), np.int64), part)[0]
                g = g + _product(part, part)
        if n:
            d = len(s)
            cells = [(-2, 0, n), *((-1, j, int(s[j])) for j in range(d)), *((i, j, int(g[i, j])) for i in range(d) for j in range(i, d))]
            rows = [(i, j, k, v) for i, j, x in cells for k, v in enumerate(_parts(x))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["i", "j", "k", "v"])

    rows = fit.select("y").mapInArrow(sums, "i int, j int, k int, v long").groupBy("i", "j", "k").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v")).collect()
    total: dict[tuple[int, int], int] = {}
    for r in rows:
        total[r.i, r.j] = total.get((r.i, r.j), 0) + (int(r.v) << (PART * r.k))
    first = fit.select(F.size("y").alias("d")).first() if total else None
    d = first.d if first else 0
    at = lambda i, j: total.get((i, j) if i <= j else (j, i), 0)
    return total.get((-2, 0), 0), [total.get((-1, j), 0) for j in range(d)], [[at(i, j) for j in range(d)] for i in range(d)]


# ------------------------------------------------------------------ characteristic polynomial


def _is_prime(n: int) -> bool:
    """Exact below 3.2e9 with these bases."""
    if n < 2 or n % 2 == 0:
        return n == 2
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7):
        if n == a:
            return True
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        if not any((x := x * x % n) == n - 1 for _ in range(r - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2^31, the largest first, whose product is above bound."""
    out, p, product = [], (1 << 31) - 1, 1
    while product <= bound:
        if _is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def polynomial_mod(c: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x I - c) modulo p, the highest first: c is brought to Hessenberg form by similar steps, whose
    leading minors follow one another by a recurrence."""
    h, d = c % p, len(c)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        q = k + 1 + int(below[0])
        if q != k + 1:
            h[[k + 1, q]] = h[[q, k + 1]]
            h[:, [k + 1, q]] = h[:, [q, k + 1]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u % p).sum(1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)  # lowest coefficient first
    minors[0, 0] = 1
    for m in range(1, d + 1):
        row = np.zeros(d + 1, np.int64)
        row[1:] = minors[m - 1, :-1]
        row = (row - int(h[m - 1, m - 1]) * minors[m - 1]) % p
        t = 1
        for i in range(m - 1, 0, -1):
            t = t * int(h[i, i - 1]) % p
            if not t:
                break
            row = (row - t * int(h[i - 1, m - 1]) % p * minors[i - 1]) % p
        minors[m] = row
    return [int(x) for x in minors[d][::-1]]


def characteristic(spark: SparkSession, c: list[list[int]]) -> list[int]:
    """Coefficients of det(x I - c), the highest first, of a positive semi-definite integer matrix.

    A coefficient is the sum of products of k eigenvalues, so it is at most binom(d, k) (trace / d)^k. Each prime is a row
    that one task works on; the driver joins the residues.
    """
    d, trace = len(c), sum(c[i][i] for i in range(len(c)))
    bound = max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    primes = primes_beyond(2 * bound)

    def residues(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for p in df.p:
                m = np.array([[x % int(p) for x in row] for row in c], np.int64)
                yield pd.DataFrame({"p": [p], "r": [polynomial_mod(m, int(p))]})

    tasks = min(len(primes), 4 * spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInPandas(residues, "p long, r array<long>").collect()
    product = math.prod(primes)
    out = [0] * (d + 1)
    for r in rows:
        rest = product // r.p
        unit = rest * pow(rest % r.p, -1, r.p)
        for k in range(d + 1):
            out[k] += unit * r.r[k]
    return [x - product if 2 * x > product else x for x in (v % product for v in out)]


# ------------------------------------------------------------------ roots


def roots_above(poly: list[int], m: int, s: int) -> int:
    """Roots above m / 2^s, with their multiplicity, of a polynomial whose roots are all real: the sign changes of its
    coefficients after a move by that number (the rule of Descartes is exact for them)."""
    b = [c << (s * k) for k, c in enumerate(poly)]
    for end in range(len(b), 1, -1):
        for j in range(1, end):
            b[j] += m * b[j - 1]
    signs = [x > 0 for x in b if x]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def _sign(poly: list[int], m: int, s: int) -> int:
    acc = 0
    for k, c in enumerate(poly):
        acc = acc * m + (c << (s * k))
    return (acc > 0) - (acc < 0)


def top_roots(poly: list[int], most: int, bits: int = BITS) -> list[tuple[int, int, int]]:
    """(m, s, multiplicity) of the `most` largest positive roots m / 2^s, falling, to `bits` bits; roots that these bits
    don't tell apart come as one, with all their multiplicity."""
    high = max(-poly[1], 0) + 1 if len(poly) > 1 else 1
    todo, out, found = [(0, high, 0, roots_above(poly, 0, 0), 0)], [], 0
    while todo and found < most:
        lo, hi, s, above_lo, above_hi = todo.pop()
        if above_lo == above_hi:
            continue
        if lo and (hi - lo) << bits <= lo:
            out.append((lo + hi, s + 1, above_lo - above_hi))
            found += above_lo - above_hi
            continue
        lo, hi, s = 2 * lo, 2 * hi, s + 1
        mid = (lo + hi) // 2
        if above_lo - above_hi == 1 and lo:  # one root, and signs at both ends differ or it is an end
            if (at := _sign(poly, mid, s)) == 0:
                out.append((mid, s, 1))
                found += 1
            else:  # above the k-th root the sign is (-1)^k
                goes_up = at == (-1) ** above_lo
                todo.append((mid, hi, s, above_lo, above_hi) if goes_up else (lo, mid, s, above_lo, above_hi))
            continue
        above = roots_above(poly, mid, s)
        todo.append((lo, mid, s, above_lo, above))
        todo.append((mid, hi, s, above, above_hi))
    return out


# ------------------------------------------------------------------ components


def _factored(a: np.ndarray, tiny: Decimal) -> tuple[np.ndarray, list[int]]:
    """LU of a matrix of Decimals, rows exchanged for the largest pivot; a pivot of 0 counts as tiny."""
    d, order = len(a), []
    for k in range(d):
        q = max(range(k, d), key=lambda i: abs(a[i, k]))
        order.append(q)
        a[[k, q]] = a[[q, k]]
        if abs(a[k, k]) < tiny:
            a[k, k] = tiny
        a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
        a[k + 1 :, k + 1 :] -= np.multiply.outer(a[k + 1 :, k], a[k, k + 1 :])
    return a, order


def _solved(lu: np.ndarray, order: list[int], b: np.ndarray) -> np.ndarray:
    b, d = b.copy(), len(b)
    for k, q in enumerate(order):
        b[[k, q]] = b[[q, k]]
    for k in range(d):
        b[k + 1 :] -= np.multiply.outer(lu[k + 1 :, k], b[k])
    for k in range(d - 1, -1, -1):
        b[k] = b[k] / lu[k, k]
        b[:k] -= np.multiply.outer(lu[:k, k], b[k])
    return b


def _orthonormal(b: np.ndarray) -> np.ndarray:
    for j in range(b.shape[1]):
        for _ in range(2):
            for i in range(j):
                b[:, j] -= b[:, i] * (b[:, i] * b[:, j]).sum()
        b[:, j] = b[:, j] / (b[:, j] * b[:, j]).sum().sqrt()
    return b


def null_space(c: list[list[int]], value: Decimal, size: int) -> np.ndarray:
    """`size` orthonormal vectors (columns) of the space of c - value I that is next to null, by inverse iteration."""
    d = len(c)
    a = np.array([[Decimal(x) - (value if i == j else 0) for j, x in enumerate(row)] for i, row in enumerate(c)], object).reshape(d, d)
    largest = max(max(abs(x) for x in a.ravel()), Decimal(1))
    lu, order = _factored(a, largest * Decimal(10) ** (10 - DIGITS))
    b = np.array([[Decimal((7919 * (i + 1) * (j + 2) + 104729 * (i + 3) ** 2) % 1009 - 504) for j in range(size)] for i in range(d)], object).reshape(d, size)
    for _ in range(3):
        b = _orthonormal(_solved(lu, order, b))
    return b


@dataclass
class Whitening:
    """n rows of a fit, the sums of their y, and for each component its eigenvalue of the covariance, its share of the
    trace, and the vector that projects a centred row and divides it by the eigenvalue's root (columns of `matrix`)."""

    n: int
    sums: list[int]
    values: list[float]
    explained: list[float]
    matrix: np.ndarray
    identity_error: float | None = None


def fit_whitening(fit: DataFrame, most: int = 16) -> Whitening:
    """The `most` first components of fit(y: array<bigint>), rows of equal length. Components of eigenvalue 0 don't count, so
    there are as many as the rank at most, and none for fewer than two rows."""
    spark = fit.sparkSession
    n, s, g = moments(fit)
    d = len(s)
    c = [[n * g[i][j] - s[i] * s[j] for j in range(d)] for i in range(d)]
    trace = sum(c[i][i] for i in range(d))
    if not trace:
        return Whitening(n, s, [], [], np.zeros((d, 0)))
    poly = characteristic(spark, c)
    values, shares, columns = [], [], []
    with decimal.localcontext(decimal.Context(prec=DIGITS)):
        for m, scale, size in top_roots(poly, most):
            value = Decimal(m) / Decimal(2) ** scale
            space = null_space(c, value, size)
            for j in range(min(size, most - len(values))):
                v = space[:, j]
                up = 1 if v[max(range(d), key=lambda i: abs(v[i]))] > 0 else -1
                values.append(float(value / n / n))
                shares.append(float(value / trace))
                columns.append([float(up * x * n / value.sqrt()) for x in v])
    found = Whitening(n, s, values, shares, np.array(columns).reshape(len(columns), d).T)
    found.identity_error = _identity_error(fit, found)
    return found


def _deviations(y: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n y - S, exact: int64 where it fits, else Python integers."""
    if y.size and n * int(np.abs(y).max()) + max(map(abs, sums)) < 1 << 62:
        return n * y - np.array(sums, np.int64)
    return n * y.astype(object) - np.array(sums, object)


def _whitened(u: np.ndarray, w: Whitening) -> np.ndarray:
    return (u / w.n).astype(float) @ w.matrix


def _squares(u: np.ndarray) -> pa.Array:
    """Sums of squares of the rows of u as decimals; those of more than 38 digits are null."""
    if u.dtype != object and len(u) and float(np.abs(u).max()) ** 2 * u.shape[1] < 2.0**62:
        return pa.array((u * u).sum(1)).cast(pa.decimal128(38, 0))
    total = (u.astype(object) ** 2).sum(1) if len(u) else []
    return pa.array([Decimal(int(x)) if x < 10**38 else None for x in total], pa.decimal128(38, 0))


def _identity_error(fit: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows of fit minus the identity, measured on the rows."""
    k = len(w.values)
    at = [(i, j) for i in range(-1, k) for j in range(max(i, 0), k)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            z = _whitened(_deviations(_matrix(batch, "y"), w.n, w.sums), w)
            total += z.T @ z
            mean += z.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in at], pa.int32()), pa.array([j for _, j in at], pa.int32()), pa.array([mean[j] if i < 0 else total[i, j] for i, j in at], pa.float64())], ["i", "j", "v"])

    got = {(r.i, r.j): r.v for r in fit.select("y").mapInArrow(sums, "i int, j int, v double").groupBy("i", "j").agg((F.sum("v") / w.n).alias("v")).collect()}
    return max(abs(v - got[-1, i] * got[-1, j] - (i == j)) for (i, j), v in got.items() if i >= 0)


def apply_whitening(vectors: DataFrame, w: Whitening) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of vectors(vec_id, y): a row for each
    component. deviation is the sum of (n y - S)^2, a decimal; null if it has more than 38 digits."""
    kind = dict(vectors.dtypes)["vec_id"]
    k = len(w.values)
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not k:
        return vectors.limit(0).select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "decimal(38,0)"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            u = _deviations(_matrix(batch, "y"), w.n, w.sums)
            m = batch.num_rows
            every = pa.array(np.repeat(np.arange(m), k))
            columns = [batch.column(0).take(every), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n, np.int64)), _squares(u).take(every), pa.array(_whitened(u, w).ravel()), pa.array(np.tile(w.explained, m)), pa.array(np.full(m * k, w.identity_error))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select("vec_id", "y").mapInArrow(run, schema)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, most: int = 16, scale: int = SCALE) -> DataFrame:
    """Whitened rows of df, fitted on each distinct vector once; columns as apply_whitening's.

    Rows whose vector is null or empty, has a null, NaN or infinite entry, or isn't of the commonest length go; null and
    repeated ids stay, a row each. Entries beyond 2^61 / scale count as that. Components of eigenvalue 0 are left out; a
    single distinct vector, or no row at all, gives no rows. Adding a constant to the entries changes neither
    covariance nor deviations, so none is added. Other columns of df aren't read.
    """
    rows = integer_vectors(df, id_col, vector_col, scale=scale)
    fit = written(rows.select("y").distinct())
    return apply_whitening(rows, fit_whitening(fit, most))

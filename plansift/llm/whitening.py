"""Embedding whitening by the exact characteristic polynomial of an integer scatter matrix.

1. Entries are quantised to integers.  Each different vector counts once; Spark sums n, the vectors and their products,
   exactly, so that the scatter ``n * sum(x x') - S S'`` (n squared times the covariance) is a matrix of integers.
2. Its characteristic polynomial is taken modulo as many 31-bit primes as a proven bound of its coefficients asks for,
   one Spark row a prime, by reduction to Hessenberg form, and put together by Chinese remaindering: no rounding at all.
3. All roots are real, so the sign changes of the polynomial moved by ``a`` count the roots above ``a`` (Budan and
   Fourier): bisection by that count isolates the largest roots to 80 bits of their own size, multiple ones included.
4. Inverse iteration with 80 decimal digits on ``scatter - root`` gives each component; roots that agree to 80 bits share
   a null space, of which the iteration takes orthogonal vectors.

Scale: the rows are read for the different vectors, once for the sums, once for the check of the result and once for
the output; a task sends its sums only, and copies are combined before the shuffle.  The driver holds numbers by
dimension (d * d integers), whatever the rows.

Stated results: null vectors and vectors with a null or non-finite entry go, also vectors of another length than most
(of equally frequent lengths the greater counts).  Entries beyond 2**63 / 256 become the nearest long.  Components whose
eigenvalue is zero do not exist, so a table with one different vector, or none, gives no rows.  Rows with equal ids or
null ids each give their own rows.  ``deviation`` is null where it does not fit a long.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plansift.llm.common import col, saved

SCALE, COMPONENTS = 256, 4
LIMB, BLOCK = 20, 8192  # products of 20-bit parts over 8192 rows stay below 2**53, exact in doubles
ROOT_BITS, DIGITS = 80, 80


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """``id, x`` of the rows that take part, and the length of their vectors."""
    v = rows.select(col(id_col).alias("id"), col(vector_col).cast("array<double>").alias("v"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    v = v.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite))
    x = v.select("id", F.transform("v", lambda c: F.floor(c * SCALE)).alias("x"))
    top = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = top["d"] if top else 0
    return x.where(F.size("x") == d), d


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def products(x: np.ndarray) -> np.ndarray:
    """``x' x`` of any longs as exact Python integers."""
    top = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    parts = [x] if top < 1 << LIMB else [x >> LIMB * k & (1 << LIMB) - 1 for k in range(63 // LIMB)] + [x >> LIMB * (63 // LIMB)]
    out = np.zeros((x.shape[1],) * 2, object)
    for lo in range(0, len(x), BLOCK):
        cut = [p[lo : lo + BLOCK].astype(np.float64) for p in parts]
        for i, a in enumerate(cut):
            for j, b in enumerate(cut):
                out += (a.T @ b).astype(np.int64).astype(object) * (1 << LIMB * (i + j))
    return out


def _sums(d: int) -> Callable:
    """Of a task: n, sums and upper products, in 32-bit limbs."""
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(d, object), np.zeros((d, d), object)
        for b in batches:
            x = _matrix(b.column(0), d)
            n += len(x)
            q += products(x)
            for k in range(2):  # halves, so that no sum passes 64 bits
                s += (x >> 32 * k & 0xFFFFFFFF if k == 0 else x >> 32).sum(axis=0).astype(object) * (1 << 32 * k)
        if not n:
            return
        left, limb = np.concatenate([np.array([n], object), s, q[upper]]), 0
        while True:
            last = all(-(1 << 31) <= v < 1 << 31 for v in left)
            value = left if last else left & 0xFFFFFFFF
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(left))), pa.array([limb] * len(left), pa.int64()), pa.array([int(v) for v in value], pa.int64())], ["at", "limb", "value"])
            if last:
                return
            left, limb = left >> 32, limb + 1

    return run


def scatter(fit: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S and ``n * sum(x x') - S S'`` of a table of vectors ``x``."""
    parts = fit.mapInArrow(_sums(d), "at long, limb long, value long").groupBy("at", "limb").agg(F.sum("value").alias("value"))
    total = [0] * (1 + d + d * (d + 1) // 2)
    for r in parts.collect():  # by dimension, not by rows
        total[r["at"]] += r["value"] << 32 * r["limb"]
    n, s = total[0], total[1 : d + 1]
    q = np.zeros((d, d), object)
    q[np.triu_indices(d)] = total[d + 1 :]
    q = q + np.triu(q, 1).T
    return n, s, n * q - np.outer(np.array(s, object), np.array(s, object))


def _prime(n: int) -> bool:
    """Miller and Rabin's test with bases that decide every number below 3 * 10**9."""
    if n % 2 == 0 or n < 9:
        return n in (2, 3, 5, 7)
    two = (n - 1 & 1 - n).bit_length() - 1
    for a in (2, 3, 5, 7):
        y = pow(a, n - 1 >> two, n)
        if y not in (1, n - 1) and not any((y := y * y % n) == n - 1 for _ in range(two - 1)):
            return False
    return True


def primes(bound: int) -> list[int]:
    """31-bit primes, from the greatest down, whose product passes ``bound``."""
    out, product, p = [], 1, (1 << 31) + 1
    while product <= bound:
        p -= 2
        if _prime(p):
            out.append(p)
            product *= p
    return out


def polynomial_mod(a: np.ndarray, p: int) -> list[int]:
    """The characteristic polynomial modulo a prime below 2**31, constant term first."""
    h = (a % p).astype(np.int64)
    d = len(h)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        i = k + 1 + below[0]
        h[[i, k + 1]] = h[[k + 1, i]]
        h[:, [i, k + 1]] = h[:, [k + 1, i]]
        f = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - f[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * f % p).sum(axis=1)) % p
    poly = np.zeros((d + 1, d + 1), np.int64)
    poly[0, 0] = 1
    for k in range(1, d + 1):
        row = np.r_[0, poly[k - 1, :-1]] - h[k - 1, k - 1] * poly[k - 1] % p
        chain, t = np.zeros(k - 1, np.int64), 1
        for i in range(k - 1, 0, -1):
            t = t * int(h[i, i - 1]) % p
            chain[i - 1] = t * int(h[i - 1, k - 1]) % p
        poly[k] = (row - (chain[:, None] * poly[: k - 1] % p).sum(axis=0)) % p
    return poly[d].tolist()


def characteristic(spark: SparkSession, m: np.ndarray) -> list[int]:
    """Exact coefficients of ``det(z - m)``, constant term first, of a positive semidefinite integer matrix.

    The k-th coefficient is at most ``C(d, k) * (trace / d) ** k`` in size, since no eigenvalue is negative.
    """
    d, trace = len(m), int(np.trace(m))
    bound = max(math.comb(d, k) * (trace**k // d**k + 1) for k in range(d + 1))
    moduli = primes(2 * bound + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ps = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int64()), pa.array([polynomial_mod(m, p) for p in ps], pa.list_(pa.int64()))], ["p", "c"])

    todo = spark.createDataFrame([(p,) for p in moduli], "p long")
    found = {r["p"]: r["c"] for r in todo.mapInArrow(run, "p long, c array<long>").collect()}
    product = math.prod(moduli)
    weight = {p: product // p * pow(product // p, -1, p) for p in moduli}
    out = [sum(weight[p] * found[p][k] for p in moduli) % product for k in range(d + 1)]
    return [c - product if 2 * c > product else c for c in out]


def roots_above(poly: list[int], a: int) -> int:
    """How many roots of a polynomial with real roots only are greater than ``a``: sign changes after moving it."""
    c = list(poly)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def largest_roots(poly: list[int], wanted: int) -> list[Fraction]:
    """The greatest positive roots, falling, multiple ones repeated, each to `ROOT_BITS` bits of its size."""
    d = len(poly) - 1
    positive = d - next(k for k, c in enumerate(poly) if c)
    out: list[Fraction] = []
    for nth in range(1, min(wanted, positive) + 1):
        c, shift = poly, 0
        lo, hi = 0, -poly[d - 1] + 1  # the trace bounds every root
        while hi - lo > lo >> ROOT_BITS:
            if hi - lo == 1:
                c, lo, hi, shift = [v << 32 * (d - k) for k, v in enumerate(c)], lo << 32, hi << 32, shift + 32
            middle = (lo + hi) // 2
            if roots_above(c, middle) >= nth:
                lo = middle
            else:
                hi = middle
        out.append(Fraction(lo + hi, 2 << shift))
    return out


def _solve(a: np.ndarray, tiny: decimal.Decimal) -> Callable:
    """Elimination with pivots, once; a pivot of zero counts as ``tiny``."""
    a, d, swaps = a.copy(), len(a), []
    for k in range(d):
        i = k + max(range(d - k), key=lambda j: abs(a[k + j, k]))
        a[[i, k]] = a[[k, i]]
        swaps.append(i)
        if a[k, k] == 0:
            a[k, k] = tiny
        a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
        a[k + 1 :, k + 1 :] = a[k + 1 :, k + 1 :] - np.outer(a[k + 1 :, k], a[k, k + 1 :])

    def run(y: np.ndarray) -> np.ndarray:
        y = y.copy()
        for k, i in enumerate(swaps):
            y[[i, k]] = y[[k, i]]
            y[k + 1 :] = y[k + 1 :] - a[k + 1 :, k] * y[k]
        for k in range(d - 1, -1, -1):
            y[k] = (y[k] - (a[k, k + 1 :] * y[k + 1 :]).sum()) / a[k, k]
        return y

    return run


def components(m: np.ndarray, roots: list[Fraction]) -> np.ndarray:
    """Unit vectors of the roots' null spaces, a row each, to double precision; the greatest entry is positive."""
    d = len(m)
    with decimal.localcontext() as ctx:
        ctx.prec = DIGITS
        dec = np.vectorize(decimal.Decimal, otypes=[object])(m) if d else m
        out: list[np.ndarray] = []
        for nth, root in enumerate(roots):
            z = decimal.Decimal(root.numerator) / decimal.Decimal(root.denominator)
            step = _solve(dec - z * np.identity(d, object), z.scaleb(-DIGITS))
            seed, y = nth + 1, np.zeros(d, object)
            for i in range(d):
                seed = (seed * 1103515245 + 12345) % (1 << 31)
                y[i] = decimal.Decimal(seed - (1 << 30))
            before = y
            for _ in range(50):
                for _again in range(2):
                    for v in out:
                        y = y - v * (v * y).sum()
                y = y / (y * y).sum().sqrt()
                top = max(range(d), key=lambda j: abs(y[j]))  # noqa: B023
                y = y if y[top] > 0 else -y
                if max(abs(y - before)) < decimal.Decimal(10) ** -25:
                    break
                before, y = y, step(y)
            out.append(before)
    return np.array([[float(v) for v in y] for y in out]).reshape(len(out), d)


class Whitening(NamedTuple):
    """What was fitted: n, sums, components (rows), eigenvalues of the covariance, their shares of its trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: list[float]
    shares: list[float]


def fitted(fit: DataFrame, d: int, wanted: int = COMPONENTS) -> Whitening:
    """The whitening of a table of different vectors ``x`` of ``d`` longs."""
    if not d:
        return Whitening(0, [], np.zeros((0, 0)), [], [])
    n, s, m = scatter(fit, d)
    trace = int(np.trace(m))
    roots = largest_roots(characteristic(fit.sparkSession, m), wanted) if trace else []
    return Whitening(n, s, components(m, roots), [float(r / n**2) for r in roots], [float(r / trace) for r in roots])


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, exact: longs where they suffice for the squares' sum too, else Python integers."""
    top = max(int(x.max(initial=0)), -int(x.min(initial=0))) * n + max(map(abs, sums))
    if top * top * x.shape[1] < 1 << 63:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _projected(c: np.ndarray, w: Whitening) -> np.ndarray:
    return (c.astype(np.float64) / w.n) @ w.components.T / np.sqrt(np.array(w.values))


def identity_error(fit: DataFrame, w: Whitening, d: int) -> float:
    """Greatest entry of the whitened vectors' covariance minus the identity, over the vectors themselves."""
    k = len(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = _projected(centred(_matrix(b.column(0), d), w.n, w.sums), w)
            if len(y):
                mean = y.mean(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int64()), pa.array([mean.tolist()]), pa.array([((y - mean).T @ (y - mean)).ravel().tolist()])], ["n", "mean", "m2"])

    parts = fit.mapInArrow(run, "n long, mean array<double>, m2 array<double>")
    # sums over equal parts of the means and products, then around the common mean
    at = lambda c, size: [F.sum(F.col("n") * F.col(c)[i] if c == "mean" else F.col(c)[i]) for i in range(size)]
    first = parts.agg(F.array(*at("mean", k)).alias("mean")).first()
    mean = np.array(first["mean"]) / w.n
    off = F.array(*(F.col("mean")[i] - F.lit(float(mean[i])) for i in range(k)))
    moved = parts.select("n", off.alias("o"), "m2")
    both = moved.agg(F.array(*(F.sum(F.col("m2")[i * k + j] + F.col("n") * F.col("o")[i] * F.col("o")[j]) for i in range(k) for j in range(k))).alias("c")).first()
    return float(np.abs(np.array(both["c"]).reshape(k, k) / w.n - np.identity(k)).max())


def whiten(rows: DataFrame, wanted: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    x, d = quantised(rows, id_col, vector_col)
    fit = saved(x.select("x").distinct(), "different")
    w = fitted(fit, d, wanted)
    schema = T.StructType([
        T.StructField("vec_id", rows.select(col(id_col)).schema[0].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
        T.StructField("identity_error", T.DoubleType()),
    ])
    k = len(w.values)
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(fit, w, d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = centred(_matrix(b.column(1), d), w.n, w.sums)
            far = [v if v < 1 << 63 else None for v in (c * c).sum(axis=1).tolist()]
            each, size = np.repeat(np.arange(len(c)), k), len(c) * k
            arrays = [
                b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(c))), pa.array(np.full(size, w.n, np.int64)),
                pa.array(far, pa.int64()).take(pa.array(each)), pa.array(_projected(c, w).ravel()), pa.array(np.tile(np.array(w.shares), len(c))), pa.array(np.full(size, error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return x.mapInArrow(run, schema)

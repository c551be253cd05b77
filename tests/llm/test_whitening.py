"""Whitening against exact fractions, eigenvalues of numpy, and its own identity."""

import math
from fractions import Fraction

import numpy as np
import pytest

from plansift.llm import whitening as op

SCHEMA = "vec_id long, embedding array<float>, label int, x int, id string"


def rows_of(vectors):
    return [(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, "z") for i, v in enumerate(vectors)]


def determinant(m):
    """Fraction-free elimination."""
    m, sign, last = [list(map(int, r)) for r in m], 1, 1
    for k in range(len(m) - 1):
        if not m[k][k]:
            i = next((i for i in range(k + 1, len(m)) if m[i][k]), None)
            if i is None:
                return 0
            m[k], m[i], sign = m[i], m[k], -sign
        for i in range(k + 1, len(m)):
            for j in range(k + 1, len(m)):
                m[i][j] = (m[i][j] * m[k][k] - m[i][k] * m[k][j]) // last
        last = m[k][k]
    return sign * m[-1][-1]


@pytest.mark.parametrize("d", [1, 2, 3, 7, 12])
def test_polynomial_is_exact(spark, d):
    x = np.random.default_rng(d).integers(-10**6, 10**6, (max(d - 2, 1), d)).astype(object)  # rank below d: zero roots
    m = x.T @ x
    poly = op.characteristic(spark, m)
    for z in (0, 1, -3, 10**13 + 7):
        assert sum(c * z**k for k, c in enumerate(poly)) == determinant(z * np.identity(d, object).astype(int).astype(object) - m)


def test_primes_and_hessenberg_swaps():
    found = op.primes(2**200)
    assert len(set(found)) == len(found) and all(all(p % q for q in range(2, 2000)) for p in found) and math.prod(found) > 2**200
    assert op.polynomial_mod(np.array([[0, 0, 5], [0, 0, 0], [1, 0, 0]], object), 7) == [0, 2, 0, 1]


def test_roots_with_multiples():
    poly = [1]
    for r in (0, 0, 3, 8, 8, 8, 10**20, 10**20 + 1):
        poly = [(poly[k - 1] if k else 0) - r * (poly[k] if k < len(poly) else 0) for k in range(len(poly) + 1)]
    got = op.largest_roots(poly, 10)
    assert len(got) == 6
    for a, b in zip(got, (10**20 + 1, 10**20, 8, 8, 8, 3), strict=True):
        assert abs(a - b) <= Fraction(b, 2**78)
    assert op.roots_above(poly, 8) == 2 and op.roots_above(poly, 7) == 5


def test_components_with_equal_and_near_roots():
    rng = np.random.default_rng(1)
    q = rng.integers(-9, 9, (6, 6)).astype(object)
    m = q.T @ q
    roots = op.largest_roots(_poly(m), 4)
    v = op.components(m, roots)
    for z, y in zip(roots, v, strict=True):
        assert np.abs(m.astype(float) @ y - float(z) * y).max() < 1e-13 * float(roots[0])
    assert np.abs(v @ v.T - np.identity(4)).max() < 1e-15
    same = np.diag([5, 5, 5, 2]).astype(object)
    v = op.components(same, op.largest_roots(_poly(same), 4))
    assert np.abs(v @ v.T - np.identity(4)).max() < 1e-15 and np.abs(v[:3, 3]).max() < 1e-20
    near = np.array([[10**18, 1], [1, 10**18]], object)
    assert np.abs(np.abs(op.components(near, op.largest_roots(_poly(near), 2))) - 0.5**0.5).max() < 1e-15


def _poly(m):
    """Faddeev and Le Verrier, in integers."""
    d, c, k = len(m), [1], np.zeros_like(m)
    one = np.array([[int(i == j) for j in range(d)] for i in range(d)], object)
    for n in range(1, d + 1):
        k = m @ k + c[-1] * one
        c.append(-int(np.trace(m @ k)) // n)
    return c[::-1]


def check(spark, vectors, dtype="float"):
    df = spark.createDataFrame(rows_of(vectors), SCHEMA.replace("float", dtype))
    got = op.whiten(df).collect()
    kind = np.float32 if dtype == "float" else np.float64
    ok = {i: [math.floor(256 * float(kind(c))) for c in v] for i, v in enumerate(vectors) if v is not None and len(v) and all(c is not None and math.isfinite(kind(c)) for c in v)}
    fit = sorted(set(map(tuple, ok.values())))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    cov = np.array([[float(Fraction(sum(n * a[i] * a[j] for a in fit) - s[i] * s[j], n * n)) for j in range(len(s))] for i in range(len(s))])
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(4, int((e > 1e-9 * e[0]).sum()))
    assert sorted((r["vec_id"], r["component"]) for r in got) == [(i, c) for i in sorted(ok) for c in range(1, k + 1)]
    sign = {}
    for r in got:
        x, c = ok[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        assert abs(r["explained"] - e[c] / np.trace(cov)) < 1e-9 * r["explained"] and r["identity_error"] < 1e-9
        want = (np.array(x, float) - np.array(s) / n) @ v[:, c] / e[c] ** 0.5
        if abs(want) > 1e-3:
            sign.setdefault(c, math.copysign(1, want * r["whitened"]))
            assert abs(want * sign[c] - r["whitened"]) < 1e-6
    return got


def test_random_vectors(spark):
    v = np.random.default_rng(2).normal(0, 0.1, (300, 8)) * np.arange(1, 9)
    vectors = [list(x) for x in v] + [list(v[0])] * 100 + [None, [], [None] * 8, [float("nan")] * 8, [float("inf")] + [0.0] * 7]
    check(spark, vectors)


def test_few_dimensions_and_large_entries(spark):
    rng = np.random.default_rng(4)
    check(spark, [list(x) for x in rng.normal(0, 1, (40, 2))])
    check(spark, [list(x) for x in rng.normal(0, 1e4, (40, 3))], "double")


def test_products_of_any_longs():
    x = np.random.default_rng(6).integers(-(2**62), 2**62, (50, 3))
    x[0] = [-(2**63), 2**63 - 1, 0]
    assert (op.products(x) == x.astype(object).T @ x.astype(object)).all()


def test_nothing_to_whiten(spark):
    df = spark.createDataFrame(rows_of([[1.0, 2.0], [1.0, 2.0], None]), SCHEMA)
    assert op.whiten(df).collect() == [] and op.whiten(df.limit(0)).collect() == []
    got = op.whiten(spark.createDataFrame(rows_of([[1.0, 2.0], [2.0, 2.0], [9.0]]), SCHEMA)).collect()
    assert [(r["vec_id"], r["component"]) for r in got] == [(0, 1), (1, 1)] and {abs(r["whitened"]) for r in got} == {1.0}
    huge = op.whiten(spark.createDataFrame([(1, [3e300, 0.0]), (2, [-3e300, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert [r["deviation"] for r in huge] == [None, None]


def test_embeddings(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    check(spark, [r["embedding"] for r in df.orderBy("vec_id").collect()])

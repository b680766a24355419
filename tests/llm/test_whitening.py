"""Whitening against numpy's eigenvectors, and its exact parts against plain integer arithmetic."""

import random
from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import pytest

from lendlens.llm import queries, whitening

SF_DIR = "/root/testdata/sf0.001"


def embeddings(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")


def by_hand(rows: list[tuple]) -> tuple[list[list[int]], list[int], int]:
    """n * sum(x x') - S S' from integers with the offset in."""
    xs = [[floor(Fraction(c) * 1024) + 100000 for c in v] for _, v, _ in rows]
    n, d = len(xs), len(xs[0])
    sums = [sum(x[k] for x in xs) for k in range(d)]
    return [[n * sum(x[i] * x[j] for x in xs) - sums[i] * sums[j] for j in range(d)] for i in range(d)], sums, n


def vectors(seed: int, n: int, d: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(i, [float(np.float32(rng.gauss(0.1 * k, 0.05 * (k + 1)))) for k in range(d)], 0) for i in range(n)]


@pytest.mark.parametrize("d", [1, 2, 5, 12])
def test_against_numpy(spark, d):
    rows = vectors(d, 60, d)
    a, sums, n = by_hand(rows)
    found = whitening.report(embeddings(spark, rows)).collect()
    count = min(8, d)
    assert len(found) == n * count
    covariance = np.array(a, float) / n**2
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    xs = np.array([[floor(c * 1024) + 100000 for c in v] for _, v, _ in rows])
    white = (xs - np.array(sums) / n) @ axes / np.sqrt(values)
    for k in range(count):
        got = {r.vec_id: r.whitened for r in found if r.component == k + 1}
        mine = np.array([got[i] for i in range(n)])
        sign = np.sign(mine @ white[:, k])
        assert np.allclose(mine * sign, white[:, k], atol=1e-9)
    for r in found:
        assert r.n == n
        assert r.deviation == sum((n * int(x) - int(s)) ** 2 for x, s in zip(xs[r.vec_id], sums))
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9
        assert r.identity_error < 1e-9


def test_the_polynomial_is_exact(spark):
    rng = random.Random(3)
    d = 9
    b = [[rng.randrange(-(10**12), 10**12) for _ in range(d)] for _ in range(d)]
    a = [[sum(b[i][k] * b[j][k] for k in range(d)) for j in range(d)] for i in range(d)]
    # Leverrier's recurrence in fractions.
    wanted, power = [1], [[int(i == j) for j in range(d)] for i in range(d)]
    for k in range(1, d + 1):
        power = [[sum(a[i][m] * power[m][j] for m in range(d)) for j in range(d)] for i in range(d)]
        c = Fraction(-sum(power[i][i] for i in range(d)), k)
        assert c.denominator == 1
        wanted.append(int(c))
        power = [[v + (int(c) if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(power)]
    assert whitening.characteristic_polynomial(spark.range(1), a) == wanted


def test_roots_with_multiplicity():
    polynomial = [1]
    for r in (5, 5, 2, 0):  # (x - 5)^2 (x - 2) x
        polynomial = [x - r * y for x, y in zip([*polynomial, 0], [0, *polynomial])]
    assert [whitening.roots_above(polynomial, at, 0) for at in (-1, 0, 1, 2, 4, 5)] == [4, 3, 3, 2, 2, 0]
    assert whitening.roots_above(polynomial, 9, 1) == 2
    for k, r in ((1, 5), (2, 5), (3, 2), (4, 0)):
        m, shift = whitening.root(polynomial, k, 3)
        assert Fraction(m, 1 << shift) < r <= Fraction(m + 1, 1 << shift)


def test_close_and_equal_roots_keep_orthonormal_components():
    a = [[10**15, 1, 0], [1, 10**15, 0], [0, 0, 10**15 + 3]]
    same = [[7, 0, 0], [0, 7, 0], [0, 0, 2]]
    polynomial = [1, -16, 77, -98]
    at = whitening.root(polynomial, 1, 4)
    basis = np.array(whitening.null_space(same, at, 2))
    assert np.allclose(basis @ basis.T, np.eye(2), atol=1e-15)
    assert np.allclose(basis[:, 2], 0, atol=1e-15)
    exact = [(10**15 + 3), (10**15 + 1), (10**15 - 1)]
    polynomial = [1]
    for r in exact:
        polynomial = [x - r * y for x, y in zip([*polynomial, 0], [0, *polynomial])]
    for k, want in enumerate(([0, 0, 1], [0.5**0.5, 0.5**0.5, 0], [0.5**0.5, -(0.5**0.5), 0])):
        (v,) = whitening.null_space(a, whitening.root(polynomial, k + 1, 60), 1)
        assert abs(abs(np.dot(v, want)) - 1) < 1e-15


def test_products_of_large_entries_are_exact():
    rng = np.random.default_rng(1)
    for top in (10, 1 << 26, 1 << 40, whitening.LARGEST):
        x = rng.integers(-top, top, (50, 4))
        y = x.astype(object)
        assert (whitening.product(x) == y.T @ y).all()


def test_limbs():
    for v in (0, 1, -1, 10**40, -(10**40), (1 << 63) - 1, -(1 << 100)):
        assert sum(p << (whitening.LIMB * k) for k, p in enumerate(whitening.limbs(v))) == v


def test_what_is_dropped(spark):
    good = [(1, [0.5, 0.25], 1), (2, [0.75, 0.5], 1), (2, [0.75, 0.5], 1), (None, [0.0, 1.0], None)]
    bad = [(3, None, 1), (4, [], 1), (5, [nan, 0.5], 1), (6, [inf, 0.5], 1), (7, [None, 0.5], 1), (8, [1.0], 1), (9, [1.0, -inf], 1)]
    found = whitening.report(embeddings(spark, good + bad)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in found) == sorted(2 * [(v is None, v or 0) for v, *_ in good])
    assert {r.n for r in found} == {4}


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [1.0, 2.0], 0)], [(i, [1.0, 2.0], 0) for i in range(5)]])
def test_without_a_positive_eigenvalue_there_are_no_rows(spark, rows):
    assert whitening.report(embeddings(spark, rows)).collect() == []


def test_fewer_components_than_dimensions(spark):
    rows = [(i, [0.1 * i, 0.5, 0.2 * i * i, 0.5], 0) for i in range(10)]
    found = whitening.report(embeddings(spark, rows, "double")).collect()
    assert {r.component for r in found} == {1, 2}
    assert max(r.identity_error for r in found) < 1e-9


def test_a_deviation_beyond_a_long(spark):
    rows = [(i, [float((i % 7) * 2**30), float(i)], 0) for i in range(50)]
    found = whitening.report(embeddings(spark, rows, "double")).where("component = 1").collect()
    xs = [[floor(c * 1024) for c in v] for _, v, _ in rows]
    sums = [sum(x[k] for x in xs) for k in range(2)]
    for r in found:
        exact = sum((50 * x - s) ** 2 for x, s in zip(xs[r.vec_id], sums))
        assert int(r.deviation_exact) == exact
        assert r.deviation == (exact if exact < 2**63 else None)
    assert any(r.deviation is None for r in found)


def test_clashing_columns_and_many_rows(spark):
    rows = vectors(2, 3 * whitening.BLOCK, 3)
    table = embeddings(spark, rows).selectExpr("*", "1 AS n", "'x' AS whitened", "2 AS component", "3 AS deviation", "1 AS d", "2 AS i", "3 AS p0")
    found = whitening.report(table.coalesce(1)).where("component = 1").collect()
    assert len(found) == len(rows)
    assert found[0].identity_error < 1e-9


def test_the_query_against_numpy(spark):
    found = queries.QUERIES["op13_whitening"](spark, SF_DIR).collect()
    rows = [(r.vec_id, r.embedding, 0) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    a, sums, n = by_hand(rows)
    values, axes = np.linalg.eigh(np.array(a, float) / n**2)
    assert len(found) == 8 * n
    xs = {i: np.array([floor(c * 1024) + 100000 for c in v]) - np.array(sums) / n for i, v, _ in rows}
    for r in found:
        k = len(values) - r.component
        assert abs(abs(r.whitened) - abs(xs[r.vec_id] @ axes[:, k] / values[k] ** 0.5)) < 1e-7
        assert r.identity_error < 1e-9

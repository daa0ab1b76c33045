import math
import random
from fractions import Fraction

import numpy as np
import pytest

from winnow.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, n long, component string, whitened int"


def rows_of(vectors):
    return [(k, v, 7, "x", None) for k, v in enumerate(vectors)]


def determinant(matrix):
    a, sign, d = [[Fraction(x) for x in row] for row in matrix], 1, len(matrix)
    product = Fraction(1)
    for k in range(d):
        pivot = next((r for r in range(k, d) if a[r][k]), None)
        if pivot is None:
            return 0
        if pivot != k:
            a[k], a[pivot], sign = a[pivot], a[k], -sign
        product *= a[k][k]
        for r in range(k + 1, d):
            f = a[r][k] / a[k][k]
            a[r] = [x - f * y for x, y in zip(a[r], a[k])]
    return int(sign * product)


@pytest.mark.parametrize("d, top", [(1, 5), (2, 3), (5, 10**12), (7, 10**25)])
def test_polynomial_is_the_determinant(spark, d, top):
    rng = random.Random(d)
    half = [[rng.randint(-top, top) for _ in range(d)] for _ in range(d + 1)]
    scatter = [[sum(r[i] * r[j] for r in half) for j in range(d)] for i in range(d)]
    found = whitening.polynomial(spark, scatter)
    for t in (0, 1, -3, 10**9 + 7):
        assert sum(c * t**k for k, c in enumerate(found)) == determinant(
            [[(t if i == j else 0) - scatter[i][j] for j in range(d)] for i in range(d)])


def product(*given):
    out = [1]
    for r in given:
        out = [a - r * b for a, b in zip([0, *out], [*out, 0])]
    return out


def test_roots_near_and_repeated():
    close = [10**30, 10**30, 10**30 - 1, 7, 7, 7, 2, 0, 0]
    found = whitening.roots(product(*close), 9)
    assert [(round(r.value()), r.times) for r in found] == [(10**30, 2), (10**30 - 1, 1), (7, 3), (2, 1)]
    # t^2 - 3t + 1
    golden = [float(r.value()) for r in whitening.roots([1, -3, 1], 2)]
    assert golden == pytest.approx([(3 + math.sqrt(5)) / 2, (3 - math.sqrt(5)) / 2], rel=1e-15)
    assert whitening.roots([0, 0, 1], 2) == []


def brute(vectors):
    """x, covariance and eigenvalues by numpy, for vectors small enough for doubles."""
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)) + 1_000_000
    v = np.cov(x.T, bias=True).reshape(x.shape[1], -1)
    return x, v, np.linalg.eigvalsh(v)[::-1]


def check(got, vectors, keep=32):
    x, v, values = brute(vectors)
    n, count = len(x), int((values > 1e-9 * max(values)).sum())
    count = min(count, keep)
    table = {(r.vec_id, r.component): r for r in got}
    assert len(table) == len(got) == n * count
    z = np.array([[table[i, c + 1].whitened for c in range(count)] for i in range(n)])
    for i in range(n):
        row = table[i, 1]
        assert row.n == n and row.deviation == sum(int(n * a - b)**2 for a, b in zip(x[i], x.sum(axis=0)))
    shares = np.array([table[0, c + 1].explained for c in range(count)])
    assert np.allclose(shares, values[:count] / values.sum(), rtol=1e-9)
    assert got[0].identity_error < 1e-9 and np.allclose(z.T @ z / n, np.eye(count), atol=1e-9)
    # Each component is an eigenvector: the scores' covariance with the vectors is sqrt(e) times it.
    axes = (x - x.mean(axis=0)).T @ z / n / np.sqrt(values[:count])
    assert np.allclose(v @ axes, axes * values[:count], atol=1e-6 * max(values))
    assert np.allclose(axes.T @ axes, np.eye(count), atol=1e-8)


def test_query_equals_brute_force(spark, sf_dir):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    order = sorted(vectors)
    got = queries.LLM_QUERIES["op11_embedding_whitening"](spark, sf_dir).collect()
    assert {r.vec_id for r in got} == set(order)
    place = {k: i for i, k in enumerate(order)}
    check([r.__class__(**{**r.asDict(), "vec_id": place[r.vec_id]}) for r in got], [vectors[k] for k in order])


def test_repeated_variances_and_dependent_dimensions(spark):
    square = [[a, b, 0.0, a + b] for a in (-1.0, 1.0) for b in (-1.0, 1.0)] * 2
    check(whitening.whiten(spark.createDataFrame(rows_of(square), SCHEMA)).collect(), square)
    cross = [[1.0, 0.0, 0.0], [-1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, -1.0, 0.0], [0.0, 0.0, 1.0], [0.0, 0.0, -1.0]]
    check(whitening.whiten(spark.createDataFrame(rows_of(cross), SCHEMA), most=3).collect(), cross)


def test_odd_vectors(spark):
    good = [[0.1, 0.2], [0.3, -0.5], [0.3, -0.5], [-0.7, 0.25]]
    odd = [None, [], [0.1, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0, 3.0]]
    docs = spark.createDataFrame(rows_of(good + odd), SCHEMA)
    check(whitening.whiten(docs).collect(), good)
    assert whitening.whiten(docs.where("vec_id < 0")).collect() == []
    assert whitening.whiten(docs.where("vec_id in (1, 2)")).collect() == []
    assert whitening.whiten(docs.where("vec_id = 5")).collect() == []
    nulls = whitening.whiten(docs.selectExpr("if(vec_id > 1, null, vec_id) as vec_id", "embedding")).collect()
    assert sorted(str(r.vec_id) for r in nulls) == sorted(["0", "0", "1", "1"] + ["None"] * 4)
    far = spark.createDataFrame(rows_of([[1e30, 1.0], [-1e30, 0.0], [5e9, 0.5], [0.0, 0.25]]), SCHEMA)
    wide = whitening.whiten(far).collect()
    assert len(wide) == 8 and wide[0].identity_error < 1e-4 and all(r.deviation is None for r in wide if r.vec_id < 2)

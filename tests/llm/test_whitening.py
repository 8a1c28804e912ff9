import numpy as np
import pytest

from lurewatch.llm import whitening

KIND = "vec_id long, embedding array<float>"


def by_hand(vectors):
    """n, deviations, whitened columns (up to their signs) and shares of the variance, by the library's solver."""
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    centred = x - s / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    return n, ((n * x - s) ** 2).sum(1), centred @ q[:, ::-1] / np.sqrt(np.maximum(e[::-1], 1e-300)), e[::-1] / e.sum()


def table_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    return out


def test_whitening_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(700, 12)) @ np.diag(3.0 ** -np.arange(12)) @ rng.normal(size=(12, 12))).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)]
    odd = [(9000, None), (9001, [None] + [0.5] * 11), (9002, [float("nan")] * 12), (9003, [float("inf")] + [0.0] * 11), (9004, [])]
    df = spark.createDataFrame(rows + odd, KIND).selectExpr("*", "1 AS x", "2 AS component", "3 AS n").repartition(5)
    got, (n, deviation, z, share) = table_of(whitening.whiten(df)), by_hand(vectors)
    assert sorted(got) == list(range(700)) and all(sorted(r) == list(range(1, 9)) for r in got.values())
    mine = np.array([[got[i][c]["whitened"] for c in range(1, 9)] for i in range(700)])
    sign = np.sign((mine * z[:, :8]).sum(0))
    assert np.allclose(mine, sign * z[:, :8], atol=1e-6)
    assert all(got[i][1]["deviation"] == deviation[i] and got[i][1]["n"] == n for i in range(700))
    assert np.allclose([got[0][c]["explained"] for c in range(1, 9)], share[:8], rtol=1e-9)
    assert np.abs(np.cov(mine.T, bias=True) - np.eye(8)).max() <= 1e-9 and got[0][1]["identity_error"] <= 1e-9


def test_one_model_for_each_length_and_repeated_rows(spark):
    rng = np.random.default_rng(6)
    short, long = rng.normal(size=(50, 3)).tolist(), rng.normal(size=(60, 9)).tolist()
    rows = [(i, v) for i, v in enumerate(short)] + [(100 + i, v) for i, v in enumerate(long)] + [(None, short[0]), (0, short[0])]
    found = whitening.whiten(spark.createDataFrame(rows, KIND)).collect()
    assert len(found) == 52 * 3 + 60 * 8 and {r["n"] for r in found} == {52, 60}
    assert len([r for r in found if r["vec_id"] == 0]) == 6 and len([r for r in found if r["vec_id"] is None]) == 3


def test_no_variance_and_no_rows(spark):
    alone = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25])], KIND)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in alone] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)]
    flat = whitening.whiten(spark.createDataFrame([(i, [i / 4, 1.0]) for i in range(8)], KIND)).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in flat) and flat[0]["identity_error"] < 1e-9
    assert whitening.whiten(spark.createDataFrame([], KIND)).collect() == [] and whitening.fit(spark.createDataFrame([(1, None)], KIND)) == {}


def test_far_vectors_are_exact_or_refused(spark):
    rows = [(i, [float(np.float32(2.0**30 * i)), float(i % 3)]) for i in range(12)]
    x = [[int(np.floor(1024 * v)) + 100_000 for v in vec] for _, vec in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((12 * v - s) ** 2 for v, s in zip(vec, sums, strict=True)) for vec in x]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, KIND)).collect()}
    assert [got[i] for i in range(12)] == [w if w < 2**63 else None for w in want] and None in got.values()
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e30])], KIND)).collect()


def test_jacobi_keeps_small_eigenvalues():
    d = 10.0 ** -np.arange(0, 16, 2.0)
    unit = np.linalg.qr(np.random.default_rng(1).normal(size=(8, 8)))[0]
    e, q = whitening.jacobi(unit @ np.diag(d) @ unit.T)
    assert np.allclose(e[:4], d[:4], rtol=1e-8) and np.allclose(q.T @ q, np.eye(8), atol=1e-12)
    graded = np.outer(d, d) * (np.eye(8) + 0.1)  # small eigenvalues that a solver by norm would lose
    e, q = whitening.jacobi(graded)
    assert (np.abs(graded @ q - q * e) <= 1e-13 * np.outer(d, np.ones(8)) * np.abs(graded).max()).all() and np.prod(e / d**2) == pytest.approx(np.linalg.det(np.eye(8) + 0.1), rel=1e-9)


def test_largest_component_is_positive_and_order_of_rows_does_not_matter(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(200, 6)).tolist())], KIND)
    a, b = whitening.fit(df.repartition(3)), whitening.fit(df.repartition(7))
    assert a[6].sums == b[6].sums and np.array_equal(a[6].vectors, b[6].vectors) and np.array_equal(a[6].values, b[6].values)
    assert (a[6].vectors[np.abs(a[6].vectors).argmax(0), np.arange(6)] > 0).all()

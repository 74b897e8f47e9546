import numpy as np
import pytest

from tidemark.llm import whitening
from tidemark.llm.queries import op13_whitening

SCHEMA = "vec_id long, embedding array<float>, x string, n int, component int, whitened string"


def plain(rows, k):
    """(n, sums, eigenvalues, {row: (deviation, projections)}) by one dense eigendecomposition."""
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows], object)
    distinct = np.array(sorted({tuple(r) for r in x}), object)
    n, sums = len(distinct), distinct.sum(axis=0)
    y = (n * distinct - sums).astype(float) / n
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    w = ((n * x - sums).astype(float) / n) @ vectors / np.sqrt(values)
    return n, values, np.trace(v), [int(((n * r - sums) ** 2).sum()) for r in x], w


@pytest.mark.parametrize(("d", "n", "k", "copies"), [(24, 900, 16, 300), (6, 200, 16, 0), (40, 60, 16, 20)])
def test_equals_a_dense_decomposition(spark, d, n, k, copies):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((n, d)) * np.geomspace(3, 0.3, d) + rng.standard_normal(d) * 5
    a[:copies] = a[0]
    rows = [(i, [float(c) for c in np.float32(r)]) for i, r in enumerate(a)]
    odd = [(9_000, None), (9_001, [1.0] * (d - 1) + [None]), (9_002, [float("nan")] * d), (9_003, [float("-inf")] * d), (None, None)]
    more = [(None, rows[1][1]), rows[2]]
    df = spark.createDataFrame([(i, v, "x", 1, 2, "w") for i, v in rows + more + odd], SCHEMA).repartition(5)
    got, model = whitening.whiten(df, components=k)
    n_, values, trace, deviations, w = plain(rows, k)
    assert model.n == n_ == n - max(0, copies - 1) and np.allclose(model.values, values, rtol=1e-10) and model.identity_error < 1e-9
    assert np.allclose(model.explained, values / trace, rtol=1e-10)
    out = {r.vec_id: r for r in got.collect()}
    assert set(out) == set(range(n)) | {None} and got.count() == n + 2
    mine = np.array([out[i].whitened for i in range(n)])
    assert [out[i].deviation for i in range(n)] == deviations and out[None].deviation == deviations[1]
    assert np.allclose(np.abs(mine), np.abs(w), atol=1e-6)


@pytest.mark.parametrize("values", [[5, 5, 5, 1, 1, 1, 1], np.ones(20), np.geomspace(1e6, 1e-3, 40), np.r_[np.full(18, 3.0), 1, 0, 0], np.r_[1.0, 1 - 1e-9, 1 - 1e-6, np.zeros(5)], np.linspace(1, 2, 90), [0.0, 0.0], [4.0]])
def test_feast_misses_none(values):
    rng = np.random.default_rng(len(values))
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    v = (q * np.array(values, float)) @ q.T
    v = (v + v.T) / 2
    e, u = whitening.feast(v, 16)
    want = sorted((x for x in values if x > 1e-10 * np.sum(values)), reverse=True)[:16]
    assert np.allclose(e, want, rtol=1e-9, atol=1e-13 * max(values))
    assert np.allclose(u.T @ u, np.eye(len(want)), atol=1e-12) and np.allclose(v @ u, u * e, atol=1e-11 * max(1, max(values)))


def test_inertia_counts():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((30, 30))
    v, t = a + a.T, whitening.tridiagonal(a + a.T)
    e = np.linalg.eigvalsh(v)
    assert [whitening.count_above(t, s) for s in np.linspace(-12, 12, 50)] == [int((e > s).sum()) for s in np.linspace(-12, 12, 50)]


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(x), float(y)]) for i, (x, y) in enumerate([(1e9, 1.0), (-1e9, 2.0), (3e12, -4.0), (1.0, 1e30)])]
    got, model = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    x = [[int(min(64 * c, float(1 << 53))) + 1_000_000 for c in v] for _, v in rows]
    n, sums = 4, [sum(c) for c in zip(*x)]
    assert model.sums == sums
    want = [min(sum((n * c - s) ** 2 for c, s in zip(r, sums)), (1 << 63) - 1) for r in x]
    assert [r.deviation for r in sorted(got.collect())] == want


def test_alike_short_and_no_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, model = whitening.whiten(make([(1, [1.0, 2.0])] * 5))
    assert model.n == 1 and {(r.vec_id, r.deviation, tuple(r.whitened)) for r in got.collect()} == {(1, 0, ())}
    got, model = whitening.whiten(make([(1, [1.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, [])]))
    assert model.n == 3 and got.count() == 4 and len(model.values) == 2
    got, model = whitening.whiten(make([]))
    assert model.n == 0 and got.collect() == []


def test_query(spark):
    df = op13_whitening(spark, "/root/testdata/sf0.001")
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = df.collect()
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert len(rows) == 16 * n and {r.component for r in rows} == set(range(1, 17)) and max(r.identity_error for r in rows) < 1e-9

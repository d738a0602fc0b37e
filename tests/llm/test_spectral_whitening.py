"""op11 against a direct eigendecomposition, the incremental spectrum, edge cases."""

import math

import numpy as np
import pytest

from fleetscope.llm.q_spectral_whitening import op11_spectral_whitening, whitened
from fleetscope.llm.spectral_whitening import Spectrum, Whitening, combined, rank_one, secular_roots, spectra

SF = "/root/testdata/sf0.01"


def brute(vectors, k=8):
    """(n, deviations, whitened up to sign, explained) of usable vectors, by numpy in long doubles."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(0)
    away = x * n - sums
    y = (away / n).astype(float)
    cov = (y.T @ y) / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, (away ** 2).sum(1).tolist(), y @ u / np.sqrt(e), e / np.trace(cov)


def check(rows, ids, vectors):
    n, deviations, w, explained = brute(vectors)
    k = w.shape[1]
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(vectors) * k
    signs = [np.sign(sum(got[i, c + 1].whitened * w[j, c] for j, i in enumerate(ids))) for c in range(k)]
    for j, i in enumerate(ids):
        for c in range(k):
            r = got[i, c + 1]
            assert (r.n, r.deviation) == (n, deviations[j])
            assert abs(r.whitened - signs[c] * w[j, c]) < 1e-8 and abs(r.explained - explained[c]) < 1e-10 * explained[c]
            assert r.identity_error < 1e-10


def test_whole_table_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check(op11_spectral_whitening(spark, SF).collect(), [r.vec_id for r in table], [r.embedding for r in table])


def test_edge_cases(spark):
    rng = np.random.default_rng(8)
    good = [[float(np.float32(v)) for v in row] for row in rng.normal(size=(40, 3)) * [3, 1, 0.2]]
    bad = [None, [1.0, None, 2.0], [math.nan, 0.0, 0.0], [math.inf, 0.0, 0.0], [], [1.0, 2.0], [1e30, 0.0, 0.0]]
    rows = [(i, v, 0) for i, v in enumerate(good)] + [(100 + i, v, 0) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int").repartition(5)
    check(whitened(df).collect(), range(40), good)
    twice = df.where("vec_id < 40").unionByName(df.where("vec_id < 40").selectExpr("vec_id + 1000 AS vec_id", "embedding", "n"))
    check(whitened(twice).collect(), [*range(40), *range(1000, 1040)], good * 2)
    assert whitened(df.limit(0)).count() == 0 and whitened(df.where("vec_id = 100")).count() == 0
    same = whitened(df.selectExpr("CAST(NULL AS long) AS vec_id", "array(1.5f, 2f) AS embedding")).collect()
    assert len(same) == 2 * 47 and {(r.vec_id, r.whitened, r.explained, r.identity_error, r.deviation) for r in same} == {(None, None, None, None, 0)}
    flat = whitened(df.where("vec_id < 40").selectExpr("vec_id", "array(get(embedding, 0), 1f, get(embedding, 0)) AS embedding")).collect()
    assert {r.component for r in flat if r.whitened is not None} == {1} and max(r.identity_error for r in flat) < 1e-9


def test_deviation_beyond_64_bits(spark):
    vectors = [[float(v), 0.0] for v in (1e11, -1e11, 5.0, 7.0)] * 3
    fit = Whitening(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"))
    got = {(r.id, r.component): int(r.deviation) for r in fit.transform().collect()}
    want = brute(vectors, 1)[1]
    assert [got[i, 1] for i in range(12)] == want and max(want) > 2 ** 63
    rows = whitened(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in rows} == {None} | {w for w in want if w < 2 ** 63}


@pytest.mark.parametrize("dim, n, kind", [(1, 9, 0), (3, 40, 1), (8, 120, 0), (24, 200, 2), (24, 200, 3)])
def test_spectrum_of_added_and_merged_vectors(dim, n, kind):
    rng = np.random.default_rng(dim + kind)
    x = rng.normal(size=(n, dim)) * np.linspace(1, 9, dim) * 1000
    if kind == 1:
        x[:, dim // 2:] = 5  # no variance at all in some dimensions
    if kind == 2:
        x = np.floor(x / 2000)  # many coinciding values
    if kind == 3:
        x = np.repeat(x[:6], n // 6, axis=0)  # few different rows
    scatter = np.cov(x.T, bias=True).reshape(dim, dim) * len(x)
    whole, left, right = Spectrum(dim), Spectrum(dim), Spectrum(dim)
    for i, v in enumerate(x):
        whole.add(v)
        (left if i < n // 3 else right).add(v)
    left.merge(right)
    left.merge(Spectrum(dim))
    for s in (whole, left):
        top = max(1.0, s.values[-1])
        assert s.n == len(x) and np.abs(s.mean - x.mean(0)).max() < 1e-9
        assert np.abs(s.basis.T @ s.basis - np.eye(dim)).max() < 1e-11
        assert np.abs(s.basis * s.values @ s.basis.T - scatter).max() < 1e-11 * top
        assert np.all(np.diff(s.values) >= 0)


def test_secular_roots_interlace_and_deflation_keeps_vectors():
    d, z2 = np.array([0.0, 1e-9, 1.0, 1.0 + 1e-10, 50.0]), np.array([1e-12, 0.3, 2.0, 1e-6, 4.0])
    near, t = secular_roots(d, z2)
    roots = np.linalg.eigvalsh(np.diag(d) + np.sqrt(np.outer(z2, z2)))
    assert np.abs(np.sort(d[near] + t) - roots).max() < 1e-12 * 60
    values, basis = rank_one(np.array([1.0, 2.0, 3.0]), np.eye(3), np.array([0.0, 5.0, 0.0]), 1.0)
    assert np.abs(values - [1.0, 3.0, 27.0]).max() < 1e-13 and np.abs(basis).tolist() == np.eye(3)[:, [0, 2, 1]].tolist()


def test_parts_are_combined_whatever_their_number(spark):
    x = [[int(v) for v in row] for row in np.random.default_rng(2).integers(-900, 900, (300, 5))]
    df = spark.createDataFrame([(v,) for v in x], "x array<long>")
    total = combined(spectra(df, 5, 7), at_once=3)
    scatter = np.cov(np.array(x).T, bias=True) * 300
    assert total.n == 300 and np.abs(total.basis * total.values @ total.basis.T - scatter).max() < 1e-10 * total.values[-1]

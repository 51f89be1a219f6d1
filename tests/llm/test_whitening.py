"""Whitening against a plain eigendecomposition."""

import numpy as np
import pytest

from quillgrid.llm import whitening as W

ROWS = "vec_id long, embedding array<float>, component int, n string, dim int, x string"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 7, "n", 3, "x") for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, ROWS)


def plain(vectors, components=4):
    """Rows of (n, deviation, |whitened|, explained) for each vector, and the components' number."""
    x = [[int(np.floor(256 * float(np.float32(c)))) for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[float(a) - s / n for a, s in zip(v, sums)] for v in fit])
    cov = y.T @ y / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    k = min(components, int((e > len(e) * W.EPS * e[0]).sum()) if e[0] > 0 else 0)
    out = []
    for v in x:
        p = (np.array([float(a) - s / n for a, s in zip(v, sums)]) @ q[:, :k]) / np.sqrt(e[:k])
        out.append((n, sum((n * a - s) ** 2 for a, s in zip(v, sums)), p, e[:k] / np.trace(cov)))
    return out, k


def check(got, vectors, ids, tolerance=1e-9):
    want, k = plain(vectors)
    rows = {}
    for r in got:
        rows.setdefault(r["vec_id"], []).append(r)
    sign = None
    for i, (n, deviation, whitened, explained) in zip(ids, want):
        mine = sorted(rows[i], key=lambda r: r["component"])
        assert [r["component"] for r in mine] == list(range(1, k + 1))
        assert {(r["n"], r["deviation"]) for r in mine} == {(n, deviation)}
        assert np.allclose([r["explained"] for r in mine], explained, rtol=1e-9)
        assert all(r["identity_error"] < 1e-9 for r in mine)
        p = np.array([r["whitened"] for r in mine])
        if sign is None and (np.abs(whitened) > 1e-3).all():
            sign = np.sign(p * whitened)
    assert sign is not None
    for i, (_, _, whitened, _) in zip(ids, want):
        p = np.array([r["whitened"] for r in sorted(rows[i], key=lambda r: r["component"])])
        assert np.allclose(p, sign * whitened, atol=tolerance, rtol=tolerance)


@pytest.mark.parametrize("k", [1, 2, 3, 17, 64])
def test_rank_one_updates(k):
    rng = np.random.default_rng(k)
    for case in range(60):
        d, z, rho = np.sort(rng.random(k) * 10), rng.normal(size=k), float(rng.random() * 10.0 ** rng.integers(-3, 4)) + 1e-9
        if case % 4 == 1:  # ties and zeros
            d, z = np.round(d), np.where(rng.random(k) < 0.3, 0, z)
        if case % 4 == 2:  # many magnitudes
            d, z = np.sort(d * 10.0 ** rng.integers(-8, 8, k)), z * 10.0 ** rng.integers(-8, 2, k)
        if case % 4 == 3:  # clusters
            d = np.sort(np.round(d)[rng.integers(0, k, k)] + rng.random(k) * 1e-14)
        values, vectors = W.rank_one(d, z, rho)
        whole = np.diag(d) + rho * np.outer(z, z)
        assert np.abs(vectors @ np.diag(values) @ vectors.T - whole).max() <= 1e-12 * np.abs(whole).max()
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() <= 1e-12
        assert (np.diff(values) >= 0).all()


def test_spectra_of_parts_combine():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.integers(-60, 60, (300, 20)), np.tile(rng.integers(-60, 60, 20), (50, 1))]).astype(float)
    scatter = np.cov(x.T, bias=True) * len(x)
    parts = [W.Spectrum(20) for _ in range(3)]
    for part, rows in zip(parts, np.split(x, [10, 200])):
        for row in rows:
            part.add(row)
    whole = parts[1]
    whole.merge(parts[0])
    whole.merge(parts[2])
    assert whole.n == len(x) and np.allclose(whole.mean, x.mean(0))
    assert np.abs(whole.basis @ np.diag(whole.values) @ whole.basis.T - scatter).max() < 1e-12 * scatter.max()
    narrow = W.Spectrum(20, 3)
    for row in x:
        narrow.add(row)
    assert narrow.basis.shape == (20, 3) and np.allclose(narrow.basis.T @ narrow.basis, np.eye(3))


def test_query_matches_plain_eigenvectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(W.op12_embedding_whitening(spark, sf_dir).collect(), [r[1] for r in rows], [r[0] for r in rows])


def test_truncated_spectra_are_refined(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(200, 40)) * np.linspace(1, 1.2, 40)).astype(np.float32)
    monkeypatch.setattr(W.Spectrum, "__init__", lambda self, dim, rank=6, init=W.Spectrum.__init__: init(self, dim, rank))
    check(W.whiten(table(spark, vectors).repartition(7)).collect(), vectors, range(200))


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = rng.normal(size=(40, 6)).astype(np.float32).tolist()
    vectors = [*good, *good[:10], [-0.0, 0, 0, 0, 0, -1e-9], None, [], [1, None, 2, 3, 4, 5], [float("nan")] * 6, [float("inf"), 0, 0, 0, 0, 0]]
    ids = [*range(50), None, *range(51, 56)]
    got = W.whiten(table(spark, vectors, ids)).collect()
    assert {r["vec_id"] for r in got} == {*range(50), None}
    check(got, vectors[:51], ids[:51])
    # a repeated row comes back as often as it is there
    twice = W.whiten(table(spark, vectors, ids).unionByName(table(spark, vectors, ids))).collect()
    assert sorted(map(repr, got + got), key=lambda r: r[:60]) and len(twice) == 2 * len(got)
    assert {(r["n"], r["deviation"]) for r in twice} == {(r["n"], r["deviation"]) for r in got}


def test_lengths_are_fits_of_their_own(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(30, 3)).astype(np.float32), rng.normal(size=(30, 5)).astype(np.float32)
    got = W.whiten(table(spark, [*a.tolist(), *b.tolist()])).collect()
    check([r for r in got if r["vec_id"] < 30], a, range(30))
    check([r for r in got if r["vec_id"] >= 30], b, range(30, 60))


def test_nothing_to_fit(spark):
    assert W.whiten(table(spark, [[1, 2]]).filter("false")).count() == 0
    assert W.whiten(table(spark, [[1, 2]] * 5)).count() == 0
    line = W.whiten(table(spark, [[1, 2], [2, 3], [4, 5]])).collect()
    assert {r["component"] for r in line} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in line)


def test_large_entries_stay_exact(spark):
    vectors = [[1e15, 1.0], [2e15, -3.0], [0.0, 0.5], [1e30, 0.0]]
    got = {r["vec_id"]: r["deviation"] for r in W.whiten(table(spark, vectors)).collect()}
    assert got[3] is None and len(got) == 4
    near = [[1e5, 1.0], [2e5, -3.0], [0.0, 0.5]]
    check(W.whiten(table(spark, near)).collect(), near, range(3), 1e-7)

"""Nearest neighbours and whitening against brute force, on odd rows."""

import math

import numpy as np
import pytest

from runlake.llm import cross_polytope, spectral, whitening

SCHEMA = "vec_id long, embedding array<double>, v string, x long, norm string, hashes int, label int"


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "a", 1, "b", 2, 3) for i, v in rows], SCHEMA).repartition(parts)


def fine(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


def odd_rows(n=300, dims=12, seed=1):
    """Clusters, copies, null and non-finite entries, zeros, other dimensions, repeated and null ids, lengths that differ widely."""
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(dims) * (1 + i % 3)) for i in range(n)]
    rows += [(1000 + i, np.ones(dims) + rng.standard_normal(dims) / 100) for i in range(n // 2)]
    rows += [(2000 + i, np.arange(dims) + 1.0) for i in range(60)]
    rows += [(3000, None), (3020, []), (3040, [None] * dims), (3060, [math.nan] * dims), (3080, [math.inf] * dims), (3100, [0.0] * dims), (None, np.ones(dims)), (3120, [1.0, 2.0]), (3140, [1.0, 2.5]), (3160, [9.0])]
    rows += [(40, np.ones(dims)), (3180, np.ones(dims) * 1e6), (3200, rng.standard_normal(dims) / 1e6)]
    return [(i, None if v is None else list(v)) for i, v in rows]


def brute(rows, k, step):
    usable = [(i, np.array(v)) for i, v in rows if i is not None and fine(v) and any(v)]
    out = []
    for i, q in usable:
        if i % step == 0:
            near = sorted((float(np.sqrt(((q - v) ** 2).sum())), j) for j, v in usable if j != i and len(v) == len(q))
            out += [(i, rank, j, d) for rank, (d, j) in enumerate(near[:k], 1)]
    return out


def neighbours(spark, rows, k=10, step=20, **more):
    vectors = cross_polytope.finite(frame(spark, rows), "vec_id", "embedding")
    return [tuple(r) for r in cross_polytope.nearest_neighbours(vectors, vectors.where(f"vec_id % {step} = 0"), k=k, **more).collect()]


def exact(rows):
    return sorted((q, r, v, round(d, 9)) for q, r, v, d in rows)


def test_neighbours_of_odd_rows(spark, monkeypatch):
    """With every axis probed the search is exact, over many slabs and blocks."""
    monkeypatch.setattr(cross_polytope, "SLAB", 50)
    monkeypatch.setattr(cross_polytope, "BLOCK_BYTES", 800)
    rows = odd_rows()
    assert exact(neighbours(spark, rows, probed=1 << 10)) == exact(brute(rows, 10, 20))


def test_neighbours_are_found(spark):
    rows = [(i, v) for i, v in odd_rows(900, 24, 5) if i != 40]
    got, want = neighbours(spark, rows), brute(rows, 10, 20)
    assert [(q, r) for q, r, _, _ in sorted(got)] == [(q, r) for q, r, _, _ in sorted(want)]
    # copies tie, so what counts is the distance
    far = {(q, r): d for q, r, _, d in want}
    assert np.mean([d <= far[q, r] + 1e-9 for q, r, _, d in got]) >= 0.9
    true = {(q, v): d for q, _, v, d in brute(rows, 1 << 30, 20)}
    assert all(abs(true[q, v] - d) < 1e-9 * (1 + d) for q, _, v, d in got)


def test_a_query_with_few_candidates_is_searched_over_all_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, list(rng.standard_normal(30))) for i in range(90)]
    got = neighbours(spark, rows, tables=1, probed=1)
    assert [(q, r) for q, r, _, _ in sorted(got)] == [(q, r) for q, r, _, _ in sorted(brute(rows, 10, 20))]
    few = [(i, list(rng.standard_normal(30))) for i in range(4)]
    assert exact(neighbours(spark, few)) == exact(brute(few, 10, 20)) and len(brute(few, 10, 20)) == 3
    assert neighbours(spark, []) == [] and neighbours(spark, [(20, None)]) == [] and neighbours(spark, [(20, [1.0])]) == []


def test_rotations_keep_lengths_and_hashes_are_the_nearest_axes():
    rng = np.random.default_rng(3)
    x, rounds = rng.standard_normal((70, 5)), cross_polytope.signs(5, 3)
    u = cross_polytope.lifted(x, 3.0)
    y = cross_polytope.turned(u, rounds[1])
    assert u.shape == (8, 70) and np.allclose(np.linalg.norm(y, axis=0), 1, atol=1e-5)
    axes = np.concatenate([np.eye(8), -np.eye(8)])
    nearest = (axes @ y).argmax(0)
    assert (cross_polytope.hashes(x, 3.0, rounds)[:, 1] == 2 * (nearest % 8) + nearest // 8).all()
    assert (cross_polytope.probes(x, 3.0, rounds, 1)[:, :, 0] == cross_polytope.hashes(x, 3.0, rounds)).all()


def whitened(spark, rows, most=16):
    return [tuple(r) for r in whitening.whiten(whitening.integers(frame(spark, rows), "vec_id", "embedding"), most).collect()]


def check_whitening(spark, rows, dims, most=16):
    used = [(i, np.floor(64 * np.array(v)).astype(np.int64) + 1_000_000) for i, v in rows if fine(v) and len(v) == dims]
    fit = np.unique(np.array([x for _, x in used]), axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = min(most, int((values > 1e-9 * values[0]).sum()))
    got = whitened(spark, rows, most)
    assert len(got) == rank * len(used)
    by = {}
    for i, component, *rest in got:
        by.setdefault((i, rest[1]), {})[component] = rest
    for i, x in used:
        deviation = sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s, strict=True))
        mine = by[i, deviation]
        assert sorted(mine) == list(range(1, rank + 1))
        for k, (n_, _, w, explained, error) in mine.items():
            assert n_ == n and error < 1e-4 and abs(explained - values[k - 1] / values.sum()) < 1e-9
            if rank == len(values) or k < rank:  # single eigenvalues have one direction
                assert abs(abs(w) - abs((x - s / n) @ vectors[:, k - 1]) / np.sqrt(values[k - 1])) < 1e-6
    return got


def test_whitening_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "SLAB", 7)
    rows = [(i, v) for i, v in odd_rows() if i not in (3180,)]
    check_whitening(spark, rows, 12)


def test_whitening_of_fewer_vectors_than_dimensions(spark):
    rng = np.random.default_rng(4)
    check_whitening(spark, [(i, list(rng.standard_normal(20))) for i in range(6)], 20)


def test_whitening_without_variance(spark):
    assert whitened(spark, []) == [] and whitened(spark, [(1, None), (2, [])]) == []
    assert whitened(spark, [(i, [1.0, 2.0]) for i in range(5)]) == []


def test_deviation_beyond_a_long_is_null():
    centre = whitening.Centre(2, [1 << 60, 0])
    assert centre.deviations(np.array([[1 << 60, 0], [0, 0]])) == [None, None]
    assert whitening.Centre(3, [10, -5]).deviations(np.array([[4, -2], [1, 0]])) == [2**2 + 1, 7**2 + 5**2]


@pytest.mark.parametrize("spectrum", ([5, 5, 5, 1], [6, 5, 4], [1] * 8, list(1 / np.arange(1, 41) ** 2), [1e6] + [1] * 20, list(10.0 ** -np.arange(20)), [3], [7, 7, 7, 3, 3], list(np.linspace(60, 61, 50))))
def test_components(spectrum):
    spectrum = np.array(spectrum, float)
    q = np.linalg.qr(np.random.default_rng(6).standard_normal((len(spectrum),) * 2))[0]
    for v in (np.diag(spectrum), q @ np.diag(spectrum) @ q.T):
        values, vectors = spectral.top_components(v, 16)
        k = min(16, int((spectrum > 1e-13 * spectrum.max()).sum()))
        assert abs(len(values) - k) <= 1 and np.allclose(values, np.sort(spectrum)[::-1][: len(values)], rtol=1e-12, atol=1e-13 * spectrum.max())
        assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-13) and np.abs(v @ vectors.T - vectors.T * values).max() < 1e-13 * spectrum.max()


def test_the_polar_factor():
    a = np.random.default_rng(8).standard_normal((30, 30)) @ np.diag(10.0 ** -np.linspace(0, 12, 30))
    u = spectral.polar_factor(a)
    left, _, right = np.linalg.svd(a)
    assert np.allclose(u @ u.T, np.eye(30), atol=1e-13) and np.abs(u - left @ right).max() < 1e-3

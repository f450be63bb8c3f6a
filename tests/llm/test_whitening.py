import numpy as np
import pytest

import brute
from tidebar.llm import spectra, whitening

SCHEMA = "x int, vec_id long, embedding array<float>, label int, whitened string"


def frame(spark, vectors, schema=SCHEMA):
    return spark.createDataFrame([(1, i, None if v is None else [None if c is None else float(c) for c in v], 0, "w") for i, v in enumerate(vectors)], schema).repartition(3)


def whole(v):
    return [int(np.floor(np.float64(np.float32(c)) * 64)) + 1_000_000 for c in v]


def check(spark, vectors, top=16, tol=1e-9):
    rows = [(r.id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.whiten_embeddings(frame(spark, vectors), top).collect()]
    xs = [whole(v) for v in vectors]
    n, sums, values, axes, trace = brute.whitened(xs, top)
    keep = int((values > 1e-12 * values[0]).sum())
    assert sorted(r[:2] for r in rows) == [(i, k + 1) for i in range(len(vectors)) for k in range(keep)]
    got = np.zeros((len(vectors), keep))
    for i, k, size, deviation, y, explained, error in rows:
        got[i, k - 1] = y
        assert (size, deviation) == (n, sum((n * a - int(s)) ** 2 for a, s in zip(xs[i], sums)))
        assert abs(explained - values[k - 1] / trace) <= 1e-10 * explained and error < 1e-9
    x = np.array(xs)
    want = ((x - x[0]) - (sums - n * x[0]) / n) @ axes[:, :keep] / np.sqrt(values[:keep])
    sign = np.sign((got * want).sum(0))
    assert np.abs(got - want * sign).max() < tol


def test_random_vectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "VECTORS", 20)
    monkeypatch.setattr(whitening, "FAN", 3)  # a tree of three levels
    rng = np.random.default_rng(1)
    check(spark, (rng.normal(size=(300, 24)) * rng.uniform(0.2, 3, 24)).tolist())


def test_hot_vector_and_few_dimensions(spark):
    rng = np.random.default_rng(2)
    check(spark, rng.normal(size=(40, 5)).tolist() + [[1, 2, 3, 4, 5]] * 200)


def test_flat_directions_are_no_components(spark):
    rng = np.random.default_rng(3)
    a = np.round(rng.normal(size=(60, 2)), 1)
    check(spark, np.column_stack([a, a[:, 0] * 2, np.full(60, 7.0)]).tolist(), tol=1e-7)


def test_bad_vectors_are_left_out(spark):
    rng = np.random.default_rng(4)
    good = rng.normal(size=(30, 3)).tolist()
    bad = [None, [None, 1, 2], [float("nan"), 0, 0], [float("inf"), 0, 0], [0, 0, -float("inf")]]
    rows = whitening.whiten_embeddings(frame(spark, good + bad)).collect()
    assert {r.id for r in rows} == set(range(30)) and {r.n for r in rows} == {30}


def test_edge_tables(spark):
    for vectors in ([], [None], [[]], [[1, 2]], [[1, 2]] * 5):
        assert whitening.whiten_embeddings(frame(spark, vectors)).count() == 0
    with pytest.raises(ValueError):
        whitening.whiten_embeddings(frame(spark, [[1, 2], [1, 2, 3]]))


def test_deviations_beyond_a_double_are_exact():
    x = np.array([[10**9, 3], [-(10**9), 5]], np.int64)
    assert whitening._deviations(x, 10**9 + 7, (12345, 8)) == [sum(((10**9 + 7) * int(a) - s) ** 2 for a, s in zip(r, (12345, 8))) for r in x]


@pytest.mark.parametrize("kind", range(5))
def test_spectra_against_a_dense_solver(kind):
    """Vectors of whole numbers, of one line, of very different sizes, repeated ones: with all sorts of deflation."""
    rng = np.random.default_rng(kind)
    for _ in range(30):
        d, n = int(rng.integers(1, 16)), int(rng.integers(1, 50))
        x = rng.normal(size=(n, d)) * 10
        if kind == 1:
            x = rng.integers(-2, 3, (n, d)).astype(float)
        elif kind == 2:
            x = np.outer(rng.normal(size=n), rng.normal(size=d)) * 100
        elif kind == 3:
            x *= 10.0 ** rng.integers(-8, 8, d)
        elif kind == 4:
            x = x[rng.integers(0, min(n, 3), n)]
        whole_, parts = spectra.Spectrum.empty(d), [spectra.Spectrum.empty(d) for _ in range(3)]
        for i, row in enumerate(x):
            whole_, parts[i % 3] = spectra.add_vector(whole_, row), spectra.add_vector(parts[i % 3], row)
        joined = spectra.add_spectrum(spectra.add_spectrum(parts[0], parts[1]), parts[2])
        off = x - x.mean(0)
        want = off.T @ off
        for s in (whole_, joined):
            assert s.n == n and np.abs(s.vectors.T @ s.vectors - np.eye(d)).max() < 1e-12
            assert np.abs((s.vectors * s.values) @ s.vectors.T - want).max() <= 1e-11 * max(1e-300, np.abs(want).max())
            assert (np.diff(s.values) >= 0).all()


def test_secular_roots_lie_between_the_poles():
    rng = np.random.default_rng(9)
    for k in (2, 3, 9, 40):
        d, z = np.cumsum(10.0 ** rng.uniform(-6, 2, k)), 10.0 ** rng.uniform(-7, 0, k)
        delta = spectra.secular_roots(d, z, 3.0)
        assert (np.diag(delta) > 0).all() and (delta[np.arange(k - 1), np.arange(1, k)] < 0).all()
        assert np.allclose(d + np.diag(delta), np.linalg.eigvalsh(np.diag(d) + 3 * np.outer(z, z)), rtol=1e-12, atol=1e-12 * d[-1])

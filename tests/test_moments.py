"""Moments of wide vectors and of vectors far from zero, added on the driver and in trees of tasks."""

import numpy as np
import pytest

from embedlens.operators import moments as G


def pair(spark, x, z, parts=6):
    return spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, z))], "crop_id long, x array<double>, z array<double>").repartition(parts)


@pytest.fixture(params=["driver", "tree"])
def way(request, monkeypatch):
    if request.param == "tree":
        monkeypatch.setattr(G, "DRIVER_BYTES", 0)
        monkeypatch.setattr(G, "FAN", 2)
        monkeypatch.setattr(G, "STRIPE", 1000)
        monkeypatch.setattr(G, "ROWS", 7)
    return request.param


def test_moments_far_from_zero(spark, way):
    rng = np.random.default_rng(1)
    x, z = 1e6 + rng.normal(size=(150, 9)), -1e6 + rng.normal(size=(150, 4))
    m = G.moments(pair(spark, x, z))
    xc, zc = x - x.mean(0), z - z.mean(0)
    assert m.n == 150 and np.allclose(m.mean_x, x.mean(0), rtol=1e-12) and np.allclose(m.mean_z, z.mean(0), rtol=1e-12)
    for got, want in zip(m.centred(), (xc.T @ xc, xc.T @ zc, zc.T @ zc)):
        assert np.allclose(got, want, rtol=1e-6, atol=1e-6)
    near = pair(spark, x - 1e6, z + 1e6)
    for f in (G.hsic_biased, G.cka, G.procrustes):
        assert f(pair(spark, x, z)) == pytest.approx(f(near), rel=1e-6)


def test_small_variances_keep_their_digits(spark, way):
    """A direction with a deviation of 1e-9 beside one of 1: products would lose it."""
    rng = np.random.default_rng(2)
    d = rng.normal(size=(60, 3)) * [1, 1e-5, 1e-9]
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    base = rng.normal(size=(60, 3))
    df = pair(spark, base * 0 + d @ turn, base * 0)
    v, share = G.delta_pca(df, 3)
    s = np.linalg.svd(d - d.mean(0), compute_uv=False)
    assert np.sqrt(share) == pytest.approx(s / np.sqrt((s**2).sum()), rel=1e-5)
    assert np.allclose(v.T @ v, np.eye(3), atol=1e-9)


def test_fewer_rows_than_dimensions(spark, way):
    rng = np.random.default_rng(3)
    x, z = rng.normal(size=(5, 12)), rng.normal(size=(5, 12))
    v, share = G.delta_pca(pair(spark, x, z, 3), 12)
    assert v.shape == (12, 12) and share.sum() == pytest.approx(1) and np.allclose(share[5:], 0)
    with pytest.raises(ValueError):
        G.moments(pair(spark, x, z).limit(0))


def test_wide_vectors(spark):
    """1,500 dimensions in partials of several stripes; each row of a shuffle is bounded."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 1500))
    m = G.moments(pair(spark, x, x[:, :2], 2))
    xc = x - x.mean(0)
    assert m.cxx.shape == (1500, 1500) and np.allclose(m.cxx, xc.T @ xc)

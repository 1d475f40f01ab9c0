"""The noise edge of a patch: level and rank found together."""

import fixtures
import numpy as np
import pytest

from quietfield.functions.geometry import Geometry
from quietfield.operators import kernels
from quietfield.plans.denoise import DenoiseOptions, denoise


def slow(values, rows):
    """Take the largest values away one by one until the rest spreads no wider than its mean allows."""
    values = values / rows
    for n in range(len(values), 0, -1):
        if values[n - 1] - values[0] <= 4 * np.sqrt(n / rows) * values[:n].mean():
            return np.sqrt(values[:n].mean()), n


@pytest.mark.parametrize(("n", "extent"), [(12, 5), (36, 7)])
def test_pure_noise(n, extent):
    g = Geometry((40, 40, 40), n, extent, "cube")
    y = np.random.default_rng(0).normal(0, 7, (300, g.rows, n))
    d = kernels.decompose(y, g, "mppca")
    # the largest value of pure noise lies above the edge in one patch in fifteen or so, whatever the size
    assert abs(np.median(d.sigma) / 7 - 1) < 0.02 and (d.rank == 0).mean() > 0.9 and (d.rank <= 1).mean() >= 0.99
    assert (kernels.restored(y, d)[d.rank == 0] == 0).all()


def test_signal_over_noise_and_the_slow_form():
    g, rng = Geometry((40, 40, 40), 20, 5, "cube"), np.random.default_rng(1)
    signal = rng.normal(0, 40, (100, g.rows, 2)) @ rng.normal(0, 1, (100, 2, 20))
    y = signal + rng.normal(0, 5, signal.shape)
    d = kernels.decompose(y, g, "mppca")
    assert (d.rank == 2).mean() >= 0.9 and abs(np.median(d.sigma) / 5 - 1) < 0.05
    assert np.linalg.norm(kernels.restored(y, d) - signal) < 0.5 * np.linalg.norm(y - signal)
    for values in np.linalg.eigvalsh(kernels.gram(y)):
        sigma, noise = kernels.edge_estimate(values[None], g.rows)
        assert (sigma[0], noise[0]) == (pytest.approx(slow(values, g.rows)[0]), slow(values, g.rows)[1])
    flat = kernels.edge_estimate(np.zeros((2, 5)), 27)
    assert (flat[0] == 0).all() and (flat[1] == 5).all()


def test_a_run_with_the_edge_filter(spark):
    """Each voxel from its own patch, against the slow form."""
    a, spacing = fixtures.image("big48")
    done = denoise(fixtures.voxels(spark, a), a.shape[:3], spacing, DenoiseOptions(filter="mppca", shape="cube", aggregator="exclusive", vst=False))
    rows, g = done.voxels.toPandas().set_index("v"), done.geometry
    for x, y, z in np.random.default_rng(0).integers(0, a.shape[:3], (20, 3)):
        at = g.patch_rows(np.array([[x, y, z]]))[0]
        patch = a[at[:, 0], at[:, 1], at[:, 2]].astype(float)
        values, vectors = np.linalg.eigh(patch.T @ patch)
        sigma, noise = slow(np.maximum(values, 0), g.rows)
        kept = vectors[:, noise:]
        own = rows.loc[x + a.shape[0] * (y + a.shape[1] * z)]
        assert own["rank"] == a.shape[3] - noise and own.sigma == pytest.approx(sigma, rel=1e-5)
        np.testing.assert_allclose(own.ts, kept @ (kept.T @ a[x, y, z].astype(float)), rtol=1e-4, atol=1e-2)

"""Refusals before any job, and scalars of geometry and random-matrix theory."""

import math

import numpy as np
import pytest

from quietfield.functions import geometry as G
from quietfield.functions import randommatrix as R
from quietfield.functions.stabilise import stabiliser
from quietfield.operators.unring import check_unring
from quietfield.plans.denoise import DenoiseOptions

REFUSED = [
    {"real": True}, {"degibbs": "o", "filter": "truncate"}, {"degibbs": "o", "noise": True}, {"degibbs": "y", "mask": True}, {"partial_fourier": 1.0}, {"vst": True, "phase": True},
    {"aggregator": "uniform", "aggregator_fwhm": 2.0}, {"stride": 2, "aggregator": "exclusive"}, {"bvals": (0.0, 0.0)}, {"phaseunits": "turns"}, {"demean": True}, {"noise_dof": 2, "vst": False},
    {"preserve_noise_bias": True, "vst": False}, {"noise_dof": 65}, {"stride": 3}, {"filter": "median"}, {"degibbs": "o", "partial_fourier": 0.8}, {"aggregator_fwhm": -1.0},
]


@pytest.mark.parametrize("options", REFUSED, ids=str)
def test_refused(options):
    with pytest.raises(ValueError):
        DenoiseOptions(**options).validate()


def test_accepted():
    DenoiseOptions(degibbs="o", partial_fourier=0.75).validate()
    DenoiseOptions(aggregator="exclusive", stride=1, phase=True, real=True, phaseunits="cycles").validate()


def test_random_matrix_scalars():
    assert R.lambda_star(1.0) == pytest.approx(4 / math.sqrt(3))
    assert math.isnan(R.lambda_star(0)) and math.isnan(R.lambda_star(1.5))
    for beta in (0.05, 0.3, 1.0):
        assert R.mp_cdf((1 + math.sqrt(beta)) ** 2, beta) == 1 and R.mp_cdf(R.mp_median(beta), beta) == pytest.approx(0.5, abs=1e-9)
    assert (R.shrink_weight(np.array([10.0, 3.0]), 0.5) <= 1).all()


def test_geometry():
    assert [G.auto_extent(n) for n in (8, 26, 27, 48, 125)] == [3, 3, 5, 5, 7]
    assert [G.Geometry((20, 20, 20), 8, k).rows for k in (3, 5)] == [27, 147] and G.Geometry((9, 9, 3), 8, 3, spacing=(1, 1, 2.5)).rows == 31
    assert G.sane_spacing((1, 0, 1)) == (1, 1, 1) == G.sane_spacing((1, 1, 2000)) and G.sane_spacing((1, 2, 3)) == (1, 2, 3)
    assert G.sigma_extent(48, 5, 9) == 5 and G.sigma_extent(100, 5, 5) == 5 and G.coarse_axis(9) == (2, 2) and G.coarse_axis(3) == (1, 1)
    for bad in ({"extent": 4}, {"extent": 29}, {"extent": 3, "nvol": 40, "shape": "cube"}, {"extent": 5, "shape": "cube"}):
        with pytest.raises(ValueError):
            G.Geometry((9, 9, 3), bad.get("nvol", 8), bad["extent"], bad.get("shape", "sphere"))


def test_every_sphere_patch_is_full_and_nearest():
    g = G.Geometry((7, 6, 4), 8, 3, spacing=(1, 1.5, 2))
    every = np.array([(x, y, z) for z in range(4) for y in range(6) for x in range(7)])
    rows = g.patch_rows(every)
    assert rows.shape == (len(every), g.rows, 3) and (rows[:, 0] == every).all()
    for c, own in zip(every, rows, strict=True):
        d2 = (((every - c) * g.spacing) ** 2).sum(axis=1)
        assert sorted((((own - c) * g.spacing) ** 2).sum(axis=1)) == pytest.approx(sorted(d2)[: g.rows])
    assert (np.abs(rows - every[:, None]).max(axis=(0, 1)) <= g.reach).all()


def test_stabiliser_round_trip_and_spread():
    for channels in (1, 4):
        t = stabiliser(channels)
        x = np.linspace(0, 60, 500)
        np.testing.assert_allclose(t.inverse(t.forward(x), unbiased=False), x, atol=2e-2)
        assert (np.diff(t.means) > 0).all()
    rng = np.random.default_rng(0)
    for theta in (0.0, 1.0, 3.0, 10.0):
        m = np.hypot(theta + rng.normal(size=200_000), rng.normal(size=200_000))
        f = stabiliser(1).forward(m)
        assert f.std() == pytest.approx(1, abs=0.06) and stabiliser(1).inverse(f.mean()) == pytest.approx(theta, abs=0.1)


def test_unring_dimensions():
    check_unring(9, 10, 0.75)
    for nx, ny, pf in ((4, 9, 1.0), (9, 9, 0.75), (9, 8, 0.75), (9, 6, 0.875), (9, 9, 0.9)):
        with pytest.raises(ValueError):
            check_unring(nx, ny, pf)

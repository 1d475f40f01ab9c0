"""The low-pass over frequencies against a slow transform and the seven taps, and slices cut into runs of volumes."""

from dataclasses import replace

import fixtures
import numpy as np
import pytest
from test_anchors import LEGACY, run

from quietfield.operators import rotate
from quietfield.plans.denoise import DenoiseOptions


@pytest.mark.parametrize(("ny", "nx"), [(6, 9), (8, 5), (1, 4)])
def test_fourier_filter_equals_a_slow_transform(ny, nx):
    rng = np.random.default_rng(0)
    p = rng.normal(size=(2, ny, nx)) + 1j * rng.normal(size=(2, ny, nx))
    window = lambda n: (np.array([np.sin(np.pi * k / (n - 1)) ** 2 for k in range(n)]) ** 3) if n > 1 else np.ones(1)
    wy, wx = window(ny), window(nx)
    out = np.zeros_like(p)
    for a in range(ny):
        for b in range(nx):  # frequency (a - ny // 2, b - nx // 2), of which the window's middle is 0
            wave = np.exp(2j * np.pi * ((a - ny // 2) * np.arange(ny)[:, None] / ny + (b - nx // 2) * np.arange(nx) / nx))
            part = (p * wave).sum(axis=(1, 2)) / (ny * nx)
            out += (wy[a] * wx[b] * part)[:, None, None] * wave.conj()
    np.testing.assert_allclose(rotate.smooth_fourier(p), out, atol=1e-6)


def test_taper_of_other_shares():
    assert (rotate.taper(7, 0) == 1).all() and rotate.taper(1)[0] == 1
    np.testing.assert_allclose(rotate.taper(5), [0, 0.5, 1, 0.5, 0], atol=1e-15)
    half = rotate.taper(101, 0.5)
    assert half[0] == 0 and (half[25:76] == 1).all() and (half == half[::-1]).all()


def phase_like(nx=48, ny=40, nz=2, nt=4):
    """A smooth object with slowly varying phase and a little noise."""
    rng = np.random.default_rng(2)
    z, y, x, t = np.meshgrid(np.arange(nz), np.arange(ny), np.arange(nx), np.arange(nt), indexing="ij")
    mag = 500 * np.exp(-(((x - nx / 2) / 15) ** 2) - ((y - ny / 2) / 12) ** 2) * (1 - 0.1 * t) + 20
    turn = 0.3 * np.sin(2 * np.pi * x / nx + t) + 0.2 * np.cos(2 * np.pi * y / ny) + z
    whole = mag * np.exp(1j * turn) + rng.normal(0, 2, mag.shape) + 1j * rng.normal(0, 2, mag.shape)
    to = lambda a: np.ascontiguousarray(a.transpose(2, 1, 0, 3)).astype(np.float32)
    return to(np.abs(whole)), to(np.angle(whole))


def test_filters_agree_and_runs_change_nothing(spark):
    a, ph = phase_like()
    mag, phase = fixtures.voxels(spark, a), fixtures.voxels(spark, ph)
    get = lambda **o: np.stack(rotate.rotate_to_real(mag, phase, a.shape[0], a.shape[1], "radians", **o).toPandas().sort_values("v").ts)
    taps, fourier, cut = get(), get(phase_filter="fourier"), get(group_bytes=a.shape[0] * a.shape[1] * 8 * 12 * 3)
    assert np.corrcoef(taps.ravel(), fourier.ravel())[0, 1] >= 0.99999
    np.testing.assert_array_equal(taps, cut)


def test_filter_as_an_option(spark):
    phase = fixtures.voxels(spark, fixtures.image("phase-rad")[0])
    frame, done = run(spark, "mag", replace(LEGACY, real=True, phaseunits="radians", phase_filter="fourier"), phase=phase)
    assert len(frame) and done.real is not None
    for bad in ({"phase_filter": "fourier"}, {"phase": True, "phase_filter": "box"}):
        with pytest.raises(ValueError):
            DenoiseOptions(**bad).validate()

"""Affines and quaternions, both ways, and the transform that is written from an affine."""

import numpy as np
import pytest

from quietfield.functions import affine as A
from quietfield.sources import nifti


def turns(n=300, seed=0):
    rng = np.random.default_rng(seed)
    for k in range(n):
        q, r = np.linalg.qr(rng.normal(size=(3, 3)))
        q = q * np.sign(np.diag(r))
        yield q if k % 2 else q * [1, 1, -1], rng.uniform(0.5, 4, 3), rng.normal(0, 100, 3)


def test_round_trips_over_rotations_and_mirrors():
    halves = [np.diag(d).astype(float) for d in ([1, -1, -1], [-1, 1, -1], [-1, -1, 1], [1, 1, 1], [-1, -1, -1], [1, 1, -1])]
    for turn, sizes, offset in [*turns(), *((h, np.array([1, 2, 3.0]), np.zeros(3)) for h in halves)]:
        m = np.eye(4)
        m[:3, :3], m[:3, 3] = turn * sizes, offset
        b, c, d, o, s, qfac = A.to_quaternion(m.ravel())
        assert qfac == np.sign(np.linalg.det(turn)) and b * b + c * c + d * d <= 1 + 1e-12
        np.testing.assert_allclose(np.reshape(A.from_quaternion(b, c, d, o, s, qfac), (4, 4)), m, atol=1e-6)
        np.testing.assert_allclose(np.reshape(A.inverse(m.ravel()), (4, 4)) @ m, np.eye(4), atol=1e-9)


def test_sheared_grids_take_the_nearest_rotation():
    rng = np.random.default_rng(1)
    for turn, _, _ in turns(20):
        m = turn + rng.normal(0, 0.1, (3, 3))
        near = A.nearest_rotation(m)
        np.testing.assert_allclose(near.T @ near, np.eye(3), atol=1e-12)
        best = np.linalg.norm(m - near)
        for _ in range(50):
            other = A.nearest_rotation(near + rng.normal(0, 0.2, (3, 3)))
            assert np.linalg.det(other) * np.linalg.det(near) < 0 or np.linalg.norm(m - other) >= best - 1e-12


def test_flat_grids_are_refused_or_filled():
    flat = [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 5, 0, 0, 0, 1]
    with pytest.raises(ValueError):
        A.inverse(flat)
    assert A.to_quaternion(flat)[3:] == ([0, 0, 5], [1, 1, 1], 1.0)


@pytest.mark.parametrize("version", [1, 2])
def test_written_transform_of_a_new_header(version):
    for turn, sizes, offset in list(turns(6, 3)):
        m = np.eye(4)
        m[:3, :3], m[:3, 3] = turn * sizes, offset
        head = nifti.Header([4, 3, 2, 2], [1.0, *sizes, 1, 1, 1, 1], affine=m.ravel().tolist(), xform_code=1, version=version)
        raw = bytearray(nifti.encode(head))
        assert nifti.decode(bytes(raw)).affine == pytest.approx(head.affine, abs=1e-4)
        at, size = (254, 2) if version == 1 else (348, 4)
        raw[at : at + size] = bytes(size)  # no code for the rows
        assert nifti.decode(bytes(raw)).affine == pytest.approx(head.affine, abs=1e-3)  # without rows, from the quaternion

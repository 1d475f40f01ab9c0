"""Golden numbers: RMS of outputs over deterministic fixtures."""

from dataclasses import replace

import fixtures
import numpy as np
import pytest

from quietfield.functions.geometry import Geometry
from quietfield.operators import compare, lattice, rotate
from quietfield.plans.denoise import DenoiseOptions, denoise, zero_share

LEGACY = DenoiseOptions(filter="optthresh", aggregator="exclusive", shape="cube", vst=False)
DEFAULT = DenoiseOptions()
BVALS = (0, 5, 995, 1000, 1005, 2000, 2010, 3000)

CASES = {
    "exclusive": ("big48", LEGACY, {"ts": 1061.54322, "rank": 5.74348799}),
    "optshrink": ("big48", replace(LEGACY, filter="optshrink"), {"ts": 1050.76197, "sigma": 326.854857}),
    "truncate": ("big48", replace(LEGACY, filter="truncate"), {"ts": 1076.92601}),
    "sphere": ("mag", replace(LEGACY, shape="sphere"), {"ts": 614.250794}),
    "sphere optshrink": ("big48", replace(LEGACY, shape="sphere", filter="optshrink"), {"ts": 1050.45481, "sigma": 330.26322}),
    "gaussian sphere": ("mag", replace(LEGACY, shape="sphere", aggregator="gaussian", stride=2), {"ts": 614.241667}),
    "gaussian cube": ("big48", replace(LEGACY, aggregator="gaussian", stride=2, filter="optshrink"), {"ts": 1049.44369, "rank": 8.37028843, "sigma": 326.568655}),
    "underflow": ("mag-slab", replace(DEFAULT, aggregator_fwhm=0.5), {"ts": 613.319384}),
    "uniform": ("mag", replace(LEGACY, aggregator="uniform", stride=2), {"ts": 614.244489}),
    "narrow": ("mag", replace(DEFAULT, aggregator_fwhm=1.0), {"ts": 613.309137}),
    "channels": ("rician", replace(DEFAULT, noise_dof=2), {"ts": 88.060271}),
    "stabilised": ("rician", replace(LEGACY, filter="optshrink", vst=True), {"ts": 182.797846, "sigma": 101.459479}),
    "default": ("big48", DEFAULT, {"ts": 1049.27494, "sigma": 329.844936, "rank": 8.90914359}),
    "zeros": ("rician-zero", DEFAULT, {"ts": 158.896087}),
    "demean": ("mag", replace(LEGACY, demean=True, bvals=BVALS), {"ts": 614.498087, "sigma": 30.3373923}),
    "unring": ("mag", replace(DEFAULT, degibbs="o"), {"ts": 614.68488}),
    "unring 7/8": ("mag", replace(DEFAULT, degibbs="o", partial_fourier=0.875), {"ts": 614.525105}),
    "unring 6/8": ("mag-even", replace(DEFAULT, degibbs="o", partial_fourier=0.75), {"ts": 421.277497}),
    "unring signed": ("mag-signed", replace(DEFAULT, degibbs="o", partial_fourier=0.875), {"ts": 413.200122}),
}


def run(spark, kind, options, partitions=4, **more):
    a, spacing = fixtures.image(kind)
    done = denoise(fixtures.voxels(spark, a, partitions=partitions), a.shape[:3], spacing, options, **more)
    return done.voxels.toPandas().sort_values("v").reset_index(drop=True), done


def rms(frame, column):
    x = np.stack(frame.ts.to_numpy()) if column == "ts" else frame[column].to_numpy(float)
    return float(np.sqrt((x.astype(float) ** 2).mean()))


@pytest.mark.parametrize("name", CASES)
def test_anchor(spark, name):
    kind, options, wants = CASES[name]
    frame, _ = run(spark, kind, options)
    for column, want in wants.items():
        assert rms(frame, column) == pytest.approx(want, rel=2e-6), column


def test_rotation(spark):
    options = replace(LEGACY, real=True, phaseunits="radians")
    phase = fixtures.voxels(spark, fixtures.image("phase-rad")[0])
    frame, done = run(spark, "mag", options, phase=phase)
    assert rms(done.real.toPandas(), "ts") == pytest.approx(507.123958, rel=1e-6)
    assert rms(frame, "ts") == pytest.approx(402.549863, rel=1e-6)


def test_phase_encodings_agree(spark):
    out = []
    for kind, units in (("phase-rad", "radians"), ("phase-int", "auto"), ("phase-turns", "turns"), ("phase-deg", "degrees")):
        phase = fixtures.voxels(spark, fixtures.image(kind)[0])
        out.append(np.stack(run(spark, "mag", replace(LEGACY, phaseunits=units), phase=phase)[0].ts.to_numpy()))
    for other in out[1:]:
        np.testing.assert_allclose(other, out[0], rtol=1e-4, atol=1e-2)


def test_masked_equals_unmasked_inside(spark):
    a, _ = fixtures.image("mag")
    inside = [(v,) for v in range(a[..., 0].size) if v % 3]
    mask = spark.createDataFrame([("img", v) for (v,) in inside], "img string, v long")
    whole, part = run(spark, "mag", DEFAULT)[0], run(spark, "mag", DEFAULT, mask=mask)[0]
    keep = [v for (v,) in inside]
    np.testing.assert_allclose(np.stack(part.ts[keep]), np.stack(whole.ts[keep]), rtol=1e-6)
    assert not np.stack(part.ts.drop(keep)).any()


@pytest.mark.parametrize("edge", [4, 12])
def test_tiles_do_not_matter(spark, monkeypatch, edge):
    """A wide image in many small tiles and in one: halos and the merge over tiles."""
    whole = replace(DEFAULT, vst=False)
    monkeypatch.setattr(Geometry, "tile", lambda self, stride=1, budget=0: (64, 64, 64))
    one = run(spark, "mag-wide", whole)[0]
    monkeypatch.setattr(Geometry, "tile", lambda self, stride=1, budget=0: (edge,) * 3)
    many = run(spark, "mag-wide", whole)[0]
    np.testing.assert_allclose(np.stack(many.ts), np.stack(one.ts), rtol=1e-6)
    np.testing.assert_allclose(many.sigma, one.sigma, rtol=1e-6)
    assert (many["rank"] == one["rank"]).all()


@pytest.mark.parametrize("kind", ["mag-tiny", "mag-thin", "mag-slab", "mag-pair"])
def test_no_voxel_is_lost(spark, kind):
    frame, _ = run(spark, kind, replace(DEFAULT, aggregator_fwhm=0.07) if kind == "mag-tiny" else DEFAULT)
    assert np.stack(frame.ts).any(axis=1).all()


def test_tall_series_caps_the_noise_patch(spark):
    frame, done = run(spark, "mag-tall", DEFAULT)
    assert done.geometry.rows > 100 and np.isfinite(np.stack(frame.ts)).all() and (frame.sigma > 0).all()


def test_rotations_that_change_nothing(spark):
    phases = {k: fixtures.voxels(spark, fixtures.image(k)[0]) for k in ("phase-const", "phase-halfturns", "phase-rad")}
    whole = fixtures.voxels(spark, np.round(fixtures.image("phase-int")[0]))
    assert rotate.changes_nothing(whole, "turns") and not rotate.changes_nothing(phases["phase-rad"], "radians") and not rotate.changes_nothing(phases["phase-halfturns"], "turns")
    a, _ = fixtures.image("mag")
    voxels = fixtures.voxels(spark, a)
    real = rotate.rotate_to_real(voxels, phases["phase-const"], 9, 9).toPandas().sort_values("v")
    assert np.isfinite(np.stack(real.ts)).all()


def test_each_image_has_its_own_phase_range(spark):
    mag, rad = (fixtures.voxels(spark, fixtures.image(k)[0]) for k in ("mag", "phase-rad"))
    other = fixtures.voxels(spark, fixtures.image("phase-int")[0], img="other")
    both = rotate.rotate_to_real(mag.unionByName(fixtures.voxels(spark, fixtures.image("mag")[0], img="other")), rad.unionByName(other), 9, 9).toPandas()
    for img in ("img", "other"):
        assert rms(both[both.img == img], "ts") == pytest.approx(507.123958, rel=1e-5)


def test_voxels_that_a_table_lacks(spark):
    a, _ = fixtures.image("mag")
    whole = fixtures.voxels(spark, a)
    frame = denoise(whole.where("v % 11 <> 0"), a.shape[:3]).voxels.toPandas()
    assert sorted(frame.v) == [v for v in range(243) if v % 11] and np.stack(frame.ts).any(axis=1).all()


def test_planes_there_and_back_in_small_groups(spark, monkeypatch):
    a, _ = fixtures.image("mag-even")
    voxels = fixtures.voxels(spark, a)
    for size in (1 << 26, 1000, 1):
        monkeypatch.setattr(lattice, "GROUP_BYTES", size)
        planes = lattice.to_planes(voxels, 9, 10, 8)
        got = {(r.z, r.t): r.px for r in planes.collect()}
        assert len(got) == 24 and all(np.array_equal(px, a[:, :, z, t].T.ravel()) for (z, t), px in got.items())
        back = lattice.from_planes(planes, 9, 10, 8).toPandas().sort_values("v")
        np.testing.assert_array_equal(np.stack(back.ts), a.transpose(2, 1, 0, 3).reshape(-1, 8))


def test_partitions_do_not_matter(spark):
    a, b = (run(spark, "mag", DEFAULT, partitions=p)[0] for p in (1, 8))
    assert np.stack(a.ts).tobytes() == np.stack(b.ts).tobytes() and (a["rank"] == b["rank"]).all()


def test_filters_get_closer_to_the_truth(spark):
    clean = fixtures.image("big48-clean")[0].transpose(2, 1, 0, 3).reshape(-1, 48)
    away = lambda o: np.sqrt(((np.stack(run(spark, "big48", o)[0].ts) - clean) ** 2).mean())
    assert away(DEFAULT) < away(replace(LEGACY, filter="optshrink")) < away(LEGACY)


def test_two_volumes_fall_back_and_refuse_a_noise_map(spark):
    frame, done = run(spark, "mag-pair", DEFAULT)
    assert not done.vst and np.stack(frame.ts).all()
    with pytest.raises(ValueError, match="noise columns"):
        run(spark, "mag-pair", replace(DEFAULT, noise=True))


def test_bad_samples_and_masks_are_refused(spark):
    a, _ = fixtures.image("mag")
    a = a.copy()
    a[0, 0, 0, 0] = np.nan
    with pytest.raises(ValueError, match="finite, the first at voxel 0 of volume 0"):
        denoise(fixtures.voxels(spark, a), a.shape[:3])
    good = fixtures.image("mag")[0]
    with pytest.raises(ValueError, match="mask"):
        denoise(fixtures.voxels(spark, good), good.shape[:3], mask=spark.createDataFrame([], "img string, v long"))


def test_comparison_of_images(spark):
    a, b = fixtures.image("mag")[0], fixtures.image("mag")[0].copy()
    b[2, 3, 1, 4] += 7
    b[5, 5, 2, 6] -= 7
    a[..., 3] = a[..., 2]
    a[8, 8, 2] = 0
    left, right = fixtures.voxels(spark, a), fixtures.voxels(spark, b)
    r = compare.compare(left, right, threshold=0.5).first()
    d = a.astype(float) - b
    at = np.unravel_index(np.abs(d).argmax(), d.shape)
    assert r.n == a.size and r.max_abs == np.abs(d).max() and (r.max_v, r.max_t) == (at[0] + 9 * (at[1] + 9 * at[2]), at[3])
    assert r.rel_l2 == pytest.approx(np.sqrt((d**2).sum() / (b.astype(float) ** 2).sum())) and r.rms == pytest.approx(np.sqrt((a.astype(float) ** 2).mean()))
    assert r.zero_voxels == 1 and r.negative == 0 and not r.equal and r.odd == 0 and r.unmatched == 0 and r.distinct_volumes == 7
    assert r.over_share == pytest.approx((np.abs(d) > 0.5 * np.sqrt((b.astype(float) ** 2).mean())).mean())
    assert compare.compare(left, left).first().equal
    mask = spark.createDataFrame([("img", v, float(v % 3)) for v in range(9)], "img string, v long, value double")
    assert compare.same_mask(mask, mask).first().equal and not compare.same_mask(mask, mask.where("v < 8")).first().equal
    assert compare.window(left, 0.5).first().level == pytest.approx(np.median(a), rel=1e-6)


def test_share_of_zeros_counts_live_input(spark):
    a, _ = fixtures.image("rician-zero")
    voxels = fixtures.voxels(spark, a)
    zero = voxels.selectExpr("img", "v", "transform(ts, x -> CAST(0 AS FLOAT)) AS ts")
    assert zero_share(zero, voxels) == 1 and zero_share(voxels, voxels) == pytest.approx((a == 0).mean(), rel=1e-6)
    _, done = run(spark, "rician", replace(DEFAULT, noise_dof=4))
    assert zero_share(done.voxels, fixtures.voxels(spark, fixtures.image("rician")[0])) > 0.5

"""Images on disk: round trips, other writers' headers, refusals, and the command line."""

import gzip
import struct

import fixtures
import numpy as np
import pytest

from quietfield.operators import shells
from quietfield.plans import cli
from quietfield.sources import nifti


def plain(path, a, dtype="<f4", code=16, slope=0.0, inter=0.0, order="<", magic=b"n+1\0", spacing=(1, 1, 1)):
    """A file written by hand, so that a fault of the library's writer cannot cancel one of its reader."""
    head = bytearray(352)
    struct.pack_into(order + "i", head, 0, 348)
    struct.pack_into(order + "8h", head, 40, 4, *a.shape, 1, 1, 1)
    struct.pack_into(order + "hh", head, 70, code, np.dtype(dtype).itemsize * 8)
    struct.pack_into(order + "8f", head, 76, 1, *spacing, 1, 1, 1, 1)
    struct.pack_into(order + "3f", head, 108, 352, slope, inter)
    head[123] = 2
    struct.pack_into(order + "h", head, 254, 1)
    struct.pack_into(order + "12f", head, 280, spacing[0], 0, 0, 0, 0, spacing[1], 0, 0, 0, 0, spacing[2], 0)
    head[344:348] = magic
    raw = bytes(head) + a.transpose(3, 2, 1, 0).astype(np.dtype(dtype).newbyteorder(order)).tobytes()
    with gzip.open(path, "wb") if str(path).endswith(".gz") else open(path, "wb") as f:
        f.write(raw)
    return str(path)


def array_of(frame, a):
    return np.stack(frame.sort_values("v").ts.to_numpy()).reshape(a.shape[2], a.shape[1], a.shape[0], a.shape[3]).transpose(2, 1, 0, 3)


@pytest.mark.parametrize("name", ["a.nii", "a.nii.gz"])
def test_read_and_write(spark, tmp_path, name):
    a, _ = fixtures.image("mag-aniso")
    path = plain(tmp_path / name, a, spacing=(1, 1, 2.5))
    head, _ = nifti.read_header(path)
    assert head.shape == a.shape and head.pixdim[1:4] == [1, 1, 2.5]
    voxels = nifti.read_nifti(spark, path)
    np.testing.assert_array_equal(array_of(voxels.toPandas(), a), a)
    planes = nifti.read_nifti(spark, path, "planes").toPandas()
    assert len(planes) == 24 and all(np.array_equal(p.px, a[:, :, p.z, p.t].T.ravel()) for p in planes.itertuples())
    head.extensions = [(4, b"hello world, this")]
    for out in (f"out-{name}", "pair.hdr"):
        nifti.write_nifti(voxels, str(tmp_path / out), head)
        again, _ = nifti.read_header(str(tmp_path / out))
        assert again.shape == a.shape and again.affine == head.affine and again.extensions[0][1].startswith(b"hello world, this")
        np.testing.assert_array_equal(array_of(nifti.read_nifti(spark, str(tmp_path / out)).toPandas(), a), a)


@pytest.mark.parametrize(("dtype", "code"), [("u1", 2), ("i2", 4), ("i4", 8), ("f8", 64), ("i1", 256), ("u2", 512), ("u4", 768), ("i8", 1024), ("u8", 1280)])
def test_sample_types_scaling_and_byte_order(spark, tmp_path, dtype, code):
    a = np.arange(5 * 4 * 3 * 2).reshape(5, 4, 3, 2) % 120
    for order in "<>":
        path = plain(tmp_path / f"x{ord(order)}.nii", a, dtype, code, 0.5, 3.0, order)
        np.testing.assert_array_equal(array_of(nifti.read_nifti(spark, path).toPandas(), a), (0.5 * a + 3).astype(np.float32))


def test_other_versions(tmp_path):
    head = nifti.Header([40000, 4, 3, 2], [1.0] * 8, version=2)
    raw = nifti.encode(head)
    assert nifti.decode(raw).shape == (40000, 4, 3, 2) and nifti.decode(raw).version == 2
    head.version = 1
    with pytest.raises(ValueError):
        nifti.encode(head)
    a = np.zeros((3, 3, 3, 2))
    analyze = plain(tmp_path / "old.hdr", a, magic=b"\0\0\0\0")
    with open(analyze, "rb") as f:
        assert nifti.decode(f.read()).version == 0


def test_refusals(spark, tmp_path):
    a = np.zeros((3, 3, 3, 2), np.float32)
    for code in (32, 128, 1536, 0):
        path = plain(tmp_path / f"c{code}.nii", a, code=code)
        with pytest.raises(ValueError, match="not supported"):
            nifti.read_header(path)
    short = plain(tmp_path / "short.nii", a)
    with open(short, "r+b") as f:
        f.truncate(400)
    with pytest.raises(Exception, match="shorter"):
        nifti.read_nifti(spark, short).count()
    with pytest.raises(FileNotFoundError):
        nifti.read_header(str(tmp_path / "none.nii"))


def test_grids():
    a, b = (nifti.Header([9, 9, 3, 8], [1.0] * 8) for _ in range(2))
    assert nifti.grid_distance(a, b) == 0
    b.affine = [2.0, *a.affine[1:]]
    assert nifti.grid_distance(a, b) == 8
    b.affine = [float("nan"), *a.affine[1:]]
    assert nifti.grid_distance(a, b) == float("inf")
    b.affine, b.xyz_units = [v / 1000 for v in a.affine], 1
    assert nifti.grid_distance(a, b) == pytest.approx(0, abs=1e-9)


def test_bvals(spark, tmp_path):
    (tmp_path / "x.bval").write_text("0 5 995 1000\n1005 2000\t2010 3000\n")
    rows = shells.read_bvals(spark, str(tmp_path / "x.bval"))
    found = {r.t: (r.grp, r.shell_b, r.shell_n) for r in shells.shells(rows).collect()}
    assert [found[t][0] for t in range(8)] == [0, 0, 1, 1, 1, 2, 2, None] and found[2][1:] == (1000.0, 3) and found[6][1:] == (2005.0, 2)
    four = spark.createDataFrame([("i", t, float(b)) for t, b in enumerate((0, 0, 1000, 1000, 1080, 1080, 2000, 2000))], "img string, t int, b double")
    assert {r.grp for r in shells.shells(four).collect()} == {0, 1, 2, 3}
    assert shells.sidecar("a/B.NII.gz") == "a/B.bval"
    for bad in ([0.0], [0.0, None], [0.0, -1.0], [0.0, float("inf")]):
        with pytest.raises(ValueError):
            shells.check_bvals(bad, 2)


def test_command_line(spark, tmp_path):
    a, _ = fixtures.image("mag")
    path = plain(tmp_path / "in.nii", a)
    out = {k: str(tmp_path / f"{k}.nii.gz") for k in ("out", "noise", "rank")}
    legacy = ["-filter", "optthresh", "-aggregator", "exclusive", "-shape", "cube", "-vst", "n"]
    cli.run(spark, cli.parser().parse_args([path, out["out"], "-noise", out["noise"], "-rank", out["rank"], *legacy, "-shape", "sphere"]))
    ts = np.stack(nifti.read_nifti(spark, out["out"]).toPandas().ts)
    assert np.sqrt((ts.astype(float) ** 2).mean()) == pytest.approx(614.250794, rel=1e-6)
    assert nifti.read_header(out["rank"])[0].datatype == 512
    for bad in ([path, path], [path, out["out"], "-noise", out["out"]], [path, "-"]):
        with pytest.raises(ValueError):
            cli.run(spark, cli.parser().parse_args(bad))


def test_fields_of_the_input_are_kept(spark, tmp_path):
    a, _ = fixtures.image("mag")
    path = plain(tmp_path / "in.nii", a)
    with open(path, "r+b") as f:
        for at, raw in ((39, b"\x2b"), (68, struct.pack("<h", 1001)), (56, struct.pack("<3f", 1, 2, 3)), (74, struct.pack("<h", 1)), (120, struct.pack("<hBB", 2, 3, 10)), (132, struct.pack("<2f", 0.5, 7)), (148, b"made by hand"), (252, struct.pack("<hh", 1, 2)), (256, struct.pack("<6f", 0.1, 0.2, 0.3, 4, 5, 6)), (328, b"shells")):
            f.seek(at)
            f.write(raw)
        f.seek(124)
        f.write(struct.pack("<2f", 900.0, 10.0))
    head, _ = nifti.read_header(path)
    for name in ("out.nii", "out.nii.gz", "pair.hdr"):
        nifti.write_nifti(nifti.read_nifti(spark, path), str(tmp_path / name), head)
        again, _ = nifti.read_header(str(tmp_path / name))
        assert again.kept == head.kept and again.affine == head.affine and again.kept["descrip"][0].startswith(b"made by hand") and again.kept["units"] == (10,)
        with nifti.opened(nifti.input_names(str(tmp_path / name))[0]) as f:
            raw = f.read(348)
        assert struct.unpack_from("<2f", raw, 124) == (0, 0) and struct.unpack_from("<2f", raw, 112) == (1, 0)


def test_gzip_in_members(spark, tmp_path):
    raw = np.random.default_rng(1).integers(0, 255, 100_000, dtype=np.uint8).tobytes()
    (tmp_path / "x.whole").write_bytes(raw)
    nifti.packed(spark, str(tmp_path / "x.whole"), str(tmp_path / "x.gz"), run_bytes=7000)
    assert gzip.decompress((tmp_path / "x.gz").read_bytes()) == raw and [p.name for p in tmp_path.iterdir()] == ["x.gz"]


def test_paths_that_collide(tmp_path):
    for name in ("a.nii", "b.nii", "p.hdr", "p.img", "x.bval"):
        (tmp_path / name).write_bytes(b"")
    (tmp_path / "link.nii").symlink_to(tmp_path / "a.nii")
    at = lambda *names: [str(tmp_path / n) for n in names]
    cli.check_paths(at("a.nii", "b.nii"), at("out.nii"), files=at("x.bval"))
    cli.check_paths(["-"], at("out.nii"))
    for images, outputs, files in ((at("a.nii", "a.nii"), at("o.nii"), []), (at("a.nii", "link.nii"), at("o.nii"), []), (at("a.nii"), at("x.bval.nii", "o.nii"), at("x.bval.nii")), (at("a.nii"), at("o.nii"), at("a.nii")), (at("p"), at("p.hdr"), []), (at("a.nii"), at("o.nii", "o"), [])):
        with pytest.raises(ValueError, match="same file"):
            cli.check_paths(images, outputs, files=files)


def test_version_and_help(capsys):
    for option in ("-version", "--version", "-help", "--help", "-h"):
        with pytest.raises(SystemExit) as e:
            cli.parser().parse_args([option])
        assert e.value.code == 0 and "quietfield" in capsys.readouterr().out


def test_standard_input_and_warnings(spark, tmp_path, monkeypatch, capsys):
    import io
    import types

    a, _ = fixtures.image("mag")
    raw = open(plain(tmp_path / "in.nii", a), "rb").read()
    monkeypatch.setattr("sys.stdin", types.SimpleNamespace(buffer=io.BytesIO(raw)))
    phase = plain(tmp_path / "phase.nii", np.round(fixtures.image("phase-int")[0]))
    legacy = ["-filter", "optthresh", "-aggregator", "exclusive", "-shape", "sphere"]
    cli.run(spark, cli.parser().parse_args(["-", str(tmp_path / "out.nii"), "-phase", phase, "-phaseunits", "turns", *legacy]))
    said = capsys.readouterr().err
    assert "whole number of turns" in said and "sphere radius 1.73 mm = 27 voxels" in said
    ts = np.stack(nifti.read_nifti(spark, str(tmp_path / "out.nii")).toPandas().ts)
    assert np.sqrt((ts.astype(float) ** 2).mean()) == pytest.approx(614.250794, rel=1e-6)
    with pytest.raises(ValueError, match="bval"):
        cli.run(spark, cli.parser().parse_args(["-", str(tmp_path / "out.nii"), "-demean", "y"]))
    nan = plain(tmp_path / "nan.nii", fixtures.image("phase-rad")[0])
    with open(nan, "r+b") as f:
        f.seek(280 + 12)
        f.write(struct.pack("<f", float("nan")))
    with pytest.raises(ValueError, match="grid"):
        cli.run(spark, cli.parser().parse_args([str(tmp_path / "in.nii"), str(tmp_path / "o2.nii"), "-phase", nan]))

"""Many images at once, their headers, filters that reach the reader, and packed images read by many tasks."""

import gzip
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, StringContains
from test_nifti import array_of, plain

from quietfield.operators import shells
from quietfield.sources import nifti


def image(seed, shape):
    return np.random.default_rng(seed).integers(0, 100, shape).astype(np.float32)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("images")
    (top / "sub").mkdir()
    made = {"a": (image(1, (5, 4, 3, 2)), "<f4", 16), "sub/b": (image(2, (3, 3, 2, 4)), "<i2", 4), "sub/a": (image(3, (2, 2, 2, 1)), "<u1", 2)}
    for (name, (a, dtype, code)), ext in zip(made.items(), (".nii", ".nii.gz", ".nii"), strict=True):
        plain(top / f"{name}{ext}", a, dtype, code)
    (top / "notes.txt").write_text("no image")
    return top, {k: v[0] for k, v in made.items()}


def test_images_of_folders_lists_and_patterns(spark, folder):
    top, made = folder
    rows = nifti.read_nifti(spark, [str(top), str(top / "sub")]).toPandas()
    assert set(rows.img) == set(made)
    for name, a in made.items():
        np.testing.assert_array_equal(array_of(rows[rows.img == name], a), a)
    planes = nifti.read_nifti(spark, f"{top}/sub/*.nii*", "planes").toPandas()
    assert len(planes) == 2 * 4 + 2 and set(planes.img) == {"a", "b"}
    assert nifti.read_nifti(spark, str(top)).select("img").distinct().first().img == "img"  # a folder of one image
    os.makedirs(top / "empty", exist_ok=True)
    assert nifti.read_nifti(spark, str(top / "empty")).count() == 0


def test_a_pair_is_one_image(spark, tmp_path):
    a = image(4, (3, 2, 2, 2))
    nifti.write_nifti(nifti.read_nifti(spark, plain(tmp_path / "x.nii", a)), str(tmp_path / "pair.hdr"), nifti.Header([3, 2, 2, 2], [1.0] * 8, two_file=True))
    assert [os.path.basename(p) for p in nifti.image_paths(str(tmp_path))] == ["pair.hdr", "x.nii"]
    rows = nifti.read_nifti(spark, str(tmp_path)).toPandas()
    np.testing.assert_array_equal(array_of(rows[rows.img == "pair"], a), a)


def test_headers_as_rows(spark, folder, tmp_path):
    top, made = folder
    head = nifti.Header([2, 2, 2, 3], [1.0, 2.0, 3.0, 4.0] + [1.0] * 4, extensions=[(6, b"a comment of some length")])
    with open(tmp_path / "ext.nii", "wb") as f:
        f.write(nifti.encode(head) + bytes(4 * 24))
    (tmp_path / "bad.nii").write_bytes(b"no header")
    got = {r.img: r for r in nifti.read_headers(spark, [str(top), str(top / "sub"), str(tmp_path)]).collect()}
    assert len(got) == 5
    for r in got.values():
        name = os.path.basename(r.path)
        if name == "bad.nii":
            assert r.error and r.nx is None
        elif name == "ext.nii":
            assert r.ext[0].code == 6 and bytes(r.ext[0].data).startswith(b"a comment of some length") and (r.dx, r.dy, r.dz) == (2, 3, 4)
        else:
            a = made[next(k for k in made if r.path.endswith(f"{k}.nii") or r.path.endswith(f"{k}.nii.gz")) if name != "a.nii" else ("sub/a" if "/sub/" in r.path else "a")]
            assert (r.nx, r.ny, r.nz, r.nvol) == a.shape and r.error is None


def test_only_wanted_bytes_are_read(tmp_path):
    a = image(5, (6, 5, 8, 10))
    path = plain(tmp_path / "x.nii", a)

    def read(layout, filters, volumes=None):
        reader = nifti.NiftiReader([path], layout, volumes=volumes)
        left = list(reader.pushFilters(filters))
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        return reader.bytes_read, rows, left

    plane = 6 * 5 * 4
    n, rows, left = read("planes", [In(("t",), (2, 7)), GreaterThanOrEqual(("z",), 3), LessThan(("z",), 5), StringContains(("img",), "i")])
    assert n == 2 * 2 * plane and sorted((r["z"], r["t"]) for r in rows) == [(3, 2), (3, 7), (4, 2), (4, 7)] and len(left) == 1
    assert all(np.array_equal(r["px"], a[:, :, r["z"], r["t"]].T.ravel()) for r in rows)
    n, rows, left = read("voxels", [EqualTo(("z",), 6), GreaterThan(("v",), 3)], volumes=[9, 1])
    assert n == 2 * plane and len(rows) == 30 and len(left) == 1 and rows[0]["ts"] == a[0, 0, 6, [9, 1]].tolist()
    assert read("planes", [EqualTo(("img",), "other")])[0] == 0 and read("planes", [GreaterThan(("t",), 99)])[:2] == (0, [])
    with pytest.raises(ValueError, match="10 volumes"):
        read("voxels", [], [10])


def test_filters_reach_the_reader(spark, tmp_path):
    a = image(6, (6, 5, 8, 10))
    path = plain(tmp_path / "x.nii", a)
    df = nifti.read_nifti(spark, path, "planes").where((F.col("z") == 2) & F.col("t").isin(shells.volumes_from([0, 5, 990, 1000, 1010, 0, 2000, 0, 0, 3000], 1000)))
    assert [(r.z, r.t) for r in df.orderBy("t").collect()] == [(2, 3), (2, 4), (2, 6), (2, 9)]
    assert "Filter " not in df._jdf.queryExecution().executedPlan().toString()
    assert nifti.read_nifti(spark, path, volumes=[4, 0]).where("z = 1").count() == 30


def block_gzip(raw, step=1000):
    out = b""
    for k in range(0, len(raw), step):
        pack = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = pack.compress(raw[k : k + step]) + pack.flush()
        out += b"\x1f\x8b\x08\x04" + bytes(4) + b"\0\xff" + struct.pack("<HccHH", 6, b"B", b"C", 2, 12 + 6 + len(body) + 8 - 1) + body + struct.pack("<II", zlib.crc32(raw[k : k + step]), len(raw[k : k + step]))
    return out


@pytest.mark.parametrize("kind", ["sized", "block", "members", "one"])
def test_packed_images_equal_gzip(spark, tmp_path, kind):
    a = image(7, (20, 10, 6, 4))
    raw = open(plain(tmp_path / "x.nii", a), "rb").read()
    cuts = [raw[k : k + 3000] for k in range(0, len(raw), 3000)]
    data = {"sized": b"".join(map(nifti.sized_member, cuts)), "block": block_gzip(raw), "members": b"".join(map(gzip.compress, cuts)), "one": gzip.compress(raw)}[kind]
    path = tmp_path / "y.nii.gz"
    path.write_bytes(data)
    assert gzip.decompress(data) == raw
    stated = nifti.members(str(path))
    assert (stated is not None) == (kind in ("sized", "block"))
    if stated:
        assert sum(m[3] for m in stated) == len(raw) and len(stated) > 5
    where = nifti.unpacked(spark, [str(path)], run_bytes=4000)[str(path)]
    assert open(where, "rb").read() == raw
    np.testing.assert_array_equal(array_of(nifti.read_nifti(spark, str(path)).toPandas(), a), a)

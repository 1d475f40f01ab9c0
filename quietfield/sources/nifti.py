"""NIfTI-1, NIfTI-2 and ANALYZE images as a Spark data source.

`read_nifti(spark, path)` gives voxels (img, v, x, y, z, ts) or planes (img, z, t, px) of an image, of several, of all in a
folder or of a pattern; `read_headers` gives their headers, a row each. Images are cut into slabs of slices that tasks read by
seeking to the slab in each volume, so no shuffle is needed for either layout. Filters on img, z and, for planes, t reach the
reader: it opens, seeks and reads only what they leave. A .gz image is unpacked first into the shared folder: all at once by
tasks where its gzip members state their sizes (this writer's and block gzip files), else by one task as a stream.
Writing places each slab at its offsets in a file of full size that the commit moves into place; for .gz, tasks then pack
runs of it as gzip members, which are put together."""

from __future__ import annotations

import glob
import gzip
import json
import math
import os
import shutil
import struct
import sys
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from quietfield.functions.affine import from_quaternion, to_quaternion
from quietfield.tables import scratch_path

#: Codes of the format (fixed values): sample types that are read, and units of length in mm.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
REFUSED = {0: "unknown", 1: "binary", 32: "complex64", 128: "RGB24", 1536: "float128", 1792: "complex128", 2048: "complex256", 2304: "RGBA32"}
MM = {1: 1000.0, 2: 1.0, 3: 0.001}
#: Fields that an image written like another takes over: where they lie in NIfTI-1 and NIfTI-2 (fixed values).
FIELDS = {
    "dim_info": ("39", "B", "524", "B"), "intent_p": ("56", "3f", "80", "3d"), "intent_code": ("68", "h", "504", "i"), "slice_start": ("74", "h", "224", "q"), "slice_end": ("120", "h", "232", "q"),
    "slice_code": ("122", "B", "496", "i"), "slice_duration": ("132", "f", "208", "d"), "toffset": ("136", "f", "216", "d"), "descrip": ("148", "80s", "240", "80s"), "aux_file": ("228", "24s", "320", "24s"),
    "intent_name": ("328", "16s", "508", "16s"), "codes": ("252", "2h", "344", "2i"), "quaternion": ("256", "6f", "352", "6d"), "rows": ("280", "12f", "400", "12d"), "units": ("123", "B", "500", "i"),
}
#: Largest .gz image, unpacked, whose voxels one task builds; read_nifti has no such bound.
GZ_BYTES = 1 << 28
EXTENSIONS = (".nii.gz", ".nii", ".hdr.gz", ".img.gz", ".hdr", ".img")


@dataclass
class Header:
    dims: list[int]
    pixdim: list[float]
    datatype: int = 16
    slope: float = 1.0
    inter: float = 0.0
    offset: int = 352
    affine: list[float] = field(default_factory=lambda: [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0])
    xform_code: int = 0
    xyz_units: int = 2
    version: int = 1
    two_file: bool = False
    swapped: bool = False
    extensions: list[tuple[int, bytes]] = field(default_factory=list)
    kept: dict[str, tuple] = field(default_factory=dict)
    orient: int | None = None  # of ANALYZE

    @property
    def shape(self) -> tuple[int, int, int, int]:
        d = [*self.dims, 1, 1, 1, 1]
        return d[0], d[1], d[2], math.prod(d[3:])

    @property
    def dtype(self) -> np.dtype:
        order = ">" if (sys.byteorder == "little") == self.swapped else "<"
        return np.dtype(TYPES[self.datatype]).newbyteorder(order)


def is_gz(path: str) -> bool:
    return path.lower().endswith(".gz")


def split_extension(path: str) -> tuple[str, str]:
    """(base, extension) with the extension as written; none if it is not an image's."""
    low = path.lower()
    for e in EXTENSIONS:
        if low.endswith(e):
            return path[: -len(e)], path[-len(e) :]
    return path, ""


def input_names(path: str) -> tuple[str, str]:
    """(header file, data file) of an image named with or without an extension."""
    base, ext = split_extension(path)
    two = ext.lower().startswith((".hdr", ".img"))
    pairs = [(".hdr", ".img")] if two else [(".nii", ".nii"), (".hdr", ".img")]
    if ext and not two and os.path.exists(path):
        return path, path
    for header, data in pairs:
        found = [next((base + e + z for z in ("", ".gz") if os.path.exists(base + e + z)), None) for e in (header, data)]
        if all(found):
            return found[0], found[1]
    raise FileNotFoundError(path)


def opened(path: str):
    return gzip.open(path, "rb") if is_gz(path) else open(path, "rb")


def decode(raw: bytes, two_file: bool = False) -> Header:
    """A header from the first bytes of a file; raises ValueError for what is no image or no supported one."""
    if len(raw) < 348:
        raise ValueError("too short for a header")
    for order in ("<", ">"):
        size = struct.unpack_from(order + "i", raw)[0]
        if size in (348, 540):
            break
    else:
        raise ValueError("no NIfTI or ANALYZE header")
    swapped = (order == ">") == (sys.byteorder == "little")
    if size == 540:
        if raw[4:8] not in (b"n+2\0", b"ni2\0") or len(raw) < 540:
            raise ValueError("no NIfTI-2 magic")
        version, two_file = 2, raw[4:8] == b"ni2\0"
        datatype = struct.unpack_from(order + "h", raw, 12)[0]
        dim = struct.unpack_from(order + "8q", raw, 16)
        pix = struct.unpack_from(order + "8d", raw, 104)
        offset, slope, inter = struct.unpack_from(order + "qdd", raw, 168)
        qcode, scode = struct.unpack_from(order + "ii", raw, 344)
        quat = struct.unpack_from(order + "6d", raw, 352)
        rows = struct.unpack_from(order + "12d", raw, 400)
        units = struct.unpack_from(order + "i", raw, 500)[0]
    else:
        magic = raw[344:348]
        version = 1 if magic in (b"n+1\0", b"ni1\0") else 0
        two_file = magic == b"ni1\0" if version else True
        dim = struct.unpack_from(order + "8h", raw, 40)
        datatype = struct.unpack_from(order + "h", raw, 70)[0]
        pix = struct.unpack_from(order + "8f", raw, 76)
        offset, slope, inter = struct.unpack_from(order + "3f", raw, 108)
        units = raw[123]
        qcode, scode = struct.unpack_from(order + "hh", raw, 252)
        quat = struct.unpack_from(order + "6f", raw, 256)
        rows = struct.unpack_from(order + "12f", raw, 280)
        if not version:
            slope, inter, qcode, scode, offset = 1.0, 0.0, 0, 0, 0
    if not 1 <= dim[0] <= 7:
        raise ValueError(f"{dim[0]} dimensions")
    if datatype not in TYPES:
        raise ValueError(f"sample type {REFUSED.get(datatype, datatype)} is not supported")
    dims = [max(1, int(v)) for v in dim[1 : dim[0] + 1]]
    if sum(v > 1 for v in dims[4:]):
        raise ValueError("more than four dimensions")
    pixdim = [float(p) if i == 0 or (math.isfinite(p) and p > 0) else 1.0 for i, p in enumerate(pix)]
    scale = float(slope) if slope and math.isfinite(slope) else None
    head = Header(dims, pixdim, datatype, scale or 1.0, float(inter) if scale and math.isfinite(inter) else 0.0, int(offset), version=version, two_file=two_file, swapped=swapped)
    head.offset = int(offset) if two_file else max(int(offset), 352 if version == 1 else 544 if version == 2 else 348)
    head.xyz_units = units & 7
    if version:
        at, kind = (0, 1) if version == 1 else (2, 3)
        head.kept = {k: struct.unpack_from(order + f[kind], raw, int(f[at])) for k, f in FIELDS.items()}
    elif raw[252] <= 5:
        head.orient = raw[252]
    if scode > 0:
        head.affine, head.xform_code = [*map(float, rows), 0.0, 0.0, 0.0, 1.0], scode
    elif qcode > 0:
        head.affine, head.xform_code = from_quaternion(*quat[:3], list(quat[3:]), pixdim[1:4], pixdim[0]), qcode
    else:
        head.affine = np.diag([*pixdim[1:4], 1.0]).ravel().tolist()
    return head


def read_header(path: str) -> tuple[Header, str]:
    """(header, data file) of an image, with its extensions."""
    header, data = input_names(path)
    with opened(header) as f:
        raw = f.read(544)
        head = decode(raw, header != data)
        at = 348 if head.version < 2 else 540
        f.seek(at)
        flag = f.read(4)
        if head.version and len(flag) == 4 and flag[0]:
            at, order = at + 4, ">" if head.dtype.byteorder == ">" else "<"
            end = None if head.two_file else head.offset
            while end is None or at + 16 <= end:
                part = f.read(8)
                if len(part) < 8:
                    break
                size, code = struct.unpack(order + "ii", part)
                if size < 16 or size % 16 or (end is not None and at + size > end):
                    break
                head.extensions.append((code, f.read(size - 8)))
                at += size
    return head, data


def encode(head: Header) -> bytes:
    """Header bytes, with extensions, up to the first sample."""
    nx, ny, nz, nt = head.shape
    dims = [3, nx, ny, nz, 1, 1, 1, 1] if nt == 1 else [4, nx, ny, nz, nt, 1, 1, 1]
    bits = np.dtype(TYPES[head.datatype]).itemsize * 8
    pix = ([*head.pixdim, *[1.0] * 8])[:8]
    kept = head.kept
    if "quaternion" not in kept:  # not read from a file: the nearest grid that a quaternion can say
        *turn, offset, _, pix[0] = to_quaternion(head.affine)
        kept = {**kept, "quaternion": (*turn, *offset), "codes": (head.xform_code or 1, head.xform_code or 1)}
    ext = b"".join(struct.pack("<ii", 8 + len(e) + (-len(e) - 8) % 16, c) + e + b"\0" * ((-len(e) - 8) % 16) for c, e in head.extensions)
    start = (348 if head.version == 1 else 540) + 4 + len(ext)
    start += -start % 16
    offset = 0 if head.two_file else start
    code = head.xform_code or 1
    if head.version == 1:
        if max(dims) > 32767:
            raise ValueError("an axis is too long for NIfTI-1")
        out = bytearray(348)
        struct.pack_into("<i", out, 0, 348)
        struct.pack_into("<8h", out, 40, *dims)
        struct.pack_into("<hh", out, 70, head.datatype, bits)
        struct.pack_into("<8f", out, 76, *pix)
        struct.pack_into("<3f", out, 108, offset, 1.0, 0.0)
        out[123] = head.xyz_units
        struct.pack_into("<hh", out, 252, 0, code)
        struct.pack_into("<12f", out, 280, *head.affine[:12])
        out[344:348] = b"ni1\0" if head.two_file else b"n+1\0"
    else:
        out = bytearray(540)
        struct.pack_into("<i", out, 0, 540)
        out[4:12] = (b"ni2\0" if head.two_file else b"n+2\0") + b"\r\n\x1a\n"
        struct.pack_into("<hh", out, 12, head.datatype, bits)
        struct.pack_into("<8q", out, 16, *dims)
        struct.pack_into("<8d", out, 104, *pix)
        struct.pack_into("<qdd", out, 168, offset, 1.0, 0.0)
        struct.pack_into("<ii", out, 344, 0, code)
        struct.pack_into("<12d", out, 400, *head.affine[:12])
        struct.pack_into("<i", out, 500, head.xyz_units)
    at, kind = (0, 1) if head.version == 1 else (2, 3)
    for name, values in kept.items():
        f = FIELDS[name]
        struct.pack_into("<" + f[kind], out, int(f[at]), *values)
    flag = bytes([1 if ext else 0, 0, 0, 0])
    body = bytes(out) + flag + ext
    return body + b"\0" * ((start if not head.two_file else len(body)) - len(body))


def scaled(raw: np.ndarray, head: Header) -> np.ndarray:
    """Samples as float32, by way of double and rounded once."""
    return (head.slope * raw.astype(np.float64) + head.inter).astype(np.float32)


#: Headers that the driver reads to cut images into slabs; of more images, tasks read whole ones. Samples of a slab, in bytes.
PLANNED, SLAB_BYTES = 1000, 16 << 20


def image_paths(path: str | Sequence[str]) -> list[str]:
    """Images of a path, of a list of paths, of a pattern, or of a folder (those in it, a pair once), in order."""
    if not isinstance(path, str):
        return [p for one in path for p in image_paths(one)]
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        found = sorted(os.path.join(path, n) for n in os.listdir(path) if split_extension(n)[1] and not n.startswith("."))
    elif glob.has_magic(path) and not os.path.exists(path):
        found = sorted(p for p in glob.glob(path) if split_extension(p)[1])
    else:
        return [path]
    data = {split_extension(p)[0] for p in found if split_extension(p)[1].lower().startswith(".hdr")}
    return [p for p in found if not (split_extension(p)[1].lower().startswith(".img") and split_extension(p)[0] in data)]


def image_names(paths: Sequence[str], one: str = "img") -> list[str]:
    """`one` for a single image; else the paths without what all folders share and without extensions, in full where that is not unique."""
    if len(paths) == 1:
        return [one]
    top = os.path.commonpath([os.path.dirname(os.path.abspath(p)) for p in paths]) if paths else ""
    names = [split_extension(os.path.relpath(os.path.abspath(p), top))[0] for p in paths]
    return names if len(set(names)) == len(names) else [os.path.relpath(os.path.abspath(p), top) for p in paths]


@dataclass
class Slab(InputPartition):
    """Slices first to end of one image."""

    img: str
    path: str
    first: int
    end: int


@dataclass
class Images(InputPartition):
    """Whole images (name, path), whose headers the task reads."""

    named: list[tuple[str, str]]


class Nifti(DataSource):
    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> str:
        if self.options.get("layout", "voxels") == "planes":
            return "img string, z int, t int, px array<float>"
        return "img string, v long, x int, y int, z int, ts array<float>"

    def reader(self, schema):
        paths = json.loads(self.options["paths"]) if "paths" in self.options else image_paths(self.options["path"])
        return NiftiReader(paths, self.options.get("layout", "voxels"), self.options.get("img", "img"), json.loads(self.options.get("volumes", "null")), json.loads(self.options.get("unpacked", "{}")))

    def writer(self, schema, overwrite):
        return NiftiWriter(self.options)


@lru_cache(maxsize=64)
def _header_once(path: str, changed: int) -> tuple[Header, str]:
    return read_header(path)


def _known_header(path: str) -> tuple[Header, str]:
    """read_header, once for each state of the file and process."""
    return _header_once(path, os.stat(input_names(path)[0]).st_mtime_ns)


class NiftiReader(DataSourceReader):
    """volumes: those to read of each image, in order (voxels' series hold only these). unpacked: where a .gz image's bytes lie unpacked."""

    def __init__(self, paths: list[str], layout: str = "voxels", img: str = "img", volumes: list[int] | None = None, unpacked: dict[str, str] | None = None):
        self.paths, self.layout, self.volumes, self.unpacked = paths, layout, volumes, unpacked or {}
        self.names = image_names(paths, img)
        self.wanted: list[tuple[str, str, object]] = []  # (column, operator, value) of the filters that the reader applies
        self.bytes_read = 0

    def pushFilters(self, filters: list[Filter]):
        """Takes comparisons of img, z and, for planes, t with values; leaves the others to Spark."""
        kinds = {EqualTo: "==", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        columns = {("img",), ("z",)} | ({("t",)} if self.layout == "planes" else set())
        for f in filters:
            if isinstance(f, IsNotNull) and f.attribute in columns:
                continue  # they never are
            if type(f) in kinds and f.attribute in columns and f.value is not None:
                self.wanted.append((f.attribute[0], kinds[type(f)], f.value))
            else:
                yield f

    def _takes(self, column: str, value) -> bool:
        tests = {"==": lambda a, b: a == b, "in": lambda a, b: a in b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
        return all(tests[op](value, v) for c, op, v in self.wanted if c == column)

    def partitions(self):
        named = [(n, p) for n, p in zip(self.names, self.paths, strict=True) if self._takes("img", n)]
        if len(named) > PLANNED:
            each = max(1, len(named) // 4096)
            return [Images(named[k : k + each]) for k in range(0, len(named), each)]
        return [slab for n, p in named for slab in self._slabs(n, p)] or [Images([])]

    def _slabs(self, name: str, path: str) -> list[Slab]:
        head, data = _known_header(path)
        nx, ny, nz, nt = head.shape
        z = [k for k in range(nz) if self._takes("z", k)]
        if not z:
            return []
        each = 1 << 62 if is_gz(self.unpacked.get(path, data)) else max(1, SLAB_BYTES // (nx * ny * nt * 4))
        return [Slab(name, path, a, min(z[-1] + 1, a + each)) for a in range(z[0], z[-1] + 1, each)]

    def read(self, partition):
        if partition is None:
            return
        for slab in [s for n, p in partition.named for s in self._slabs(n, p)] if isinstance(partition, Images) else [partition]:
            yield from self._slab(slab)

    def _slab(self, slab: Slab) -> Iterator[pa.RecordBatch]:
        self.img = slab.img
        self.head, self.data = _known_header(slab.path)
        self.data = self.unpacked.get(slab.path, self.data)
        nx, ny, nz, nt = self.head.shape
        volumes = range(nt) if self.volumes is None else self.volumes
        if bad := [t for t in volumes if not 0 <= t < nt]:
            raise ValueError(f"{slab.path} has {nt} volumes, not a volume {bad[0]}")
        volumes = [t for t in volumes if self.layout != "planes" or self._takes("t", t)]
        with opened(self.data) as f:
            if is_gz(self.data) and self.layout == "planes":
                yield from self._stream(f, set(volumes))
                return
            if is_gz(self.data) and 4 * nx * ny * nz * nt > GZ_BYTES:
                raise ValueError(f"{self.data} is too large for the voxels of a .gz image in one task; use read_nifti or unpack it")
            for z, block in self._slices(f, slab.first, slab.end, volumes):
                if self._takes("z", z) and len(volumes):
                    yield self._planes(z, block, volumes) if self.layout == "planes" else self._voxels(z, block, nx)

    def _raw(self, f, size: int) -> bytes:
        raw = f.read(size)
        self.bytes_read += len(raw)
        if len(raw) < size:
            raise ValueError(f"{self.data} is shorter than its header says")
        return raw

    def _stream(self, f, volumes: set[int]) -> Iterator[pa.RecordBatch]:
        """One plane after the other, in the order of the file."""
        nx, ny, nz, _ = self.head.shape
        f.seek(self.head.offset)
        for t in range(max(volumes, default=-1) + 1):
            for z in range(nz):
                raw = self._raw(f, nx * ny * self.head.dtype.itemsize)
                if t not in volumes or not self._takes("z", z):
                    continue
                px = pa.array(scaled(np.frombuffer(raw, self.head.dtype), self.head))
                yield pa.RecordBatch.from_arrays([pa.array([self.img], pa.string()), pa.array([z], pa.int32()), pa.array([t], pa.int32()), pa.ListArray.from_arrays(pa.array([0, nx * ny], pa.int32()), px)], names=["img", "z", "t", "px"])

    def _slices(self, f, a: int, b: int, volumes: Sequence[int]):
        nx, ny, nz, _ = self.head.shape
        n, size = nx * ny, self.head.dtype.itemsize
        out = np.empty((b - a, len(volumes), n), np.float32)
        for k, t in enumerate(volumes):
            f.seek(self.head.offset + (t * nz + a) * n * size)
            out[:, k] = scaled(np.frombuffer(self._raw(f, (b - a) * n * size), self.head.dtype), self.head).reshape(b - a, n)
        for k in range(b - a):
            yield a + k, out[k]

    def _voxels(self, z: int, block: np.ndarray, nx: int) -> pa.RecordBatch:
        nt, n = block.shape
        p = np.arange(n)
        ts = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * nt, pa.int32()), pa.array(np.ascontiguousarray(block.T).ravel()))
        cols = [pa.array([self.img] * n, pa.string()), pa.array(p + z * n), pa.array((p % nx).astype(np.int32)), pa.array((p // nx).astype(np.int32)), pa.array(np.full(n, z, np.int32)), ts]
        return pa.RecordBatch.from_arrays(cols, names=["img", "v", "x", "y", "z", "ts"])

    def _planes(self, z: int, block: np.ndarray, volumes: Sequence[int]) -> pa.RecordBatch:
        nt, n = block.shape
        px = pa.ListArray.from_arrays(pa.array(np.arange(nt + 1) * n, pa.int32()), pa.array(block.ravel()))
        return pa.RecordBatch.from_arrays([pa.array([self.img] * nt, pa.string()), pa.array(np.full(nt, z, np.int32)), pa.array(np.array(volumes, np.int32)), px], names=["img", "z", "t", "px"])


@dataclass
class Done(WriterCommitMessage):
    samples: int


class NiftiWriter(DataSourceArrowWriter):
    """Rows (v long, ts array) in any order; options path, header (hex), shape and dtype."""

    def __init__(self, options):
        self.path, self.part = options["path"], options["part"]
        self.header = bytes.fromhex(options["header"])
        self.shape = tuple(int(x) for x in options["shape"].split(","))
        self.dtype = np.dtype(options["dtype"])
        self.inline = options["two_file"] != "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        n3, nt, done = math.prod(self.shape[:3]), self.shape[3], 0
        start = len(self.header) if self.inline else 0
        with open(self.part, "r+b") as f:
            for b in iterator:
                if not b.num_rows:
                    continue
                v = b.column(0).to_numpy(zero_copy_only=False)
                ts = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(v), nt)
                order = np.argsort(v)
                v, ts = v[order], ts[order]
                runs = np.split(np.arange(len(v)), np.flatnonzero(np.diff(v) != 1) + 1)
                for t in range(nt):
                    for r in runs:
                        f.seek(start + (t * n3 + int(v[r[0]])) * self.dtype.itemsize)
                        f.write(ts[r, t].astype(self.dtype).tobytes())
                done += ts.size
        return Done(done)

    def commit(self, messages) -> None:
        got = sum(m.samples for m in messages if m is not None)
        if got != math.prod(self.shape):
            os.remove(self.part)
            raise ValueError(f"{got} samples for an image of {math.prod(self.shape)}")
        os.replace(self.part, self.path)

    def abort(self, messages) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


def output_names(path: str, two_file: bool) -> tuple[str, str]:
    """(header file, data file) to write; a name without an extension takes that of the input's kind."""
    base, ext = split_extension(path)
    if not ext:
        ext = ".hdr" if two_file else ".nii"
    low, gz = ext.lower(), ".gz" if is_gz(ext) else ""
    return (base + ext, base + ext) if low.startswith(".nii") else (base + ".hdr" + gz, base + ".img" + gz)


def write_nifti(voxels: DataFrame, path: str, like: Header, datatype: int = 16, column: str = "ts") -> None:
    """Write voxels (v and a series, or one number) as an image with the geometry of `like`.

    The folder must be one that all executors share. A file is replaced only when all samples are there."""
    from pyspark.sql import functions as F

    path = path.removeprefix("file://")
    if path == "-":
        raise ValueError("an image cannot be written to standard output")
    series = F.col(column) if "array" in dict(voxels.dtypes)[column] else F.array(F.col(column))
    nx, ny, nz, _ = like.shape
    nt = len(voxels.select(series.alias("s")).first().s)
    header, data = output_names(path, like.two_file)
    head = Header([nx, ny, nz, nt], like.pixdim, datatype, kept=like.kept, affine=like.affine, xform_code=like.xform_code, xyz_units=like.xyz_units, version=like.version or 1, two_file=header != data, extensions=like.extensions)
    raw = encode(head)
    dtype = np.dtype(TYPES[datatype]).newbyteorder("<")
    part = f"{os.path.dirname(os.path.abspath(data))}/.{os.path.basename(data)}.part"
    with open(part, "wb") as f:
        f.write(b"" if head.two_file else raw)
        f.truncate((0 if head.two_file else len(raw)) + nx * ny * nz * nt * dtype.itemsize)
    if head.two_file:
        with gzip.open(header, "wb") if is_gz(header) else open(header, "wb") as f:
            f.write(raw)
    spark = voxels.sparkSession
    register(spark)
    out = voxels.select("v", series.alias("ts")).repartitionByRange("v").sortWithinPartitions("v")
    whole = f"{part}.whole" if is_gz(data) else data
    out.write.format("nifti").mode("append").options(part=part, header=raw.hex(), shape=f"{nx},{ny},{nz},{nt}", dtype=dtype.str, two_file=str(head.two_file).lower()).save(whole)
    if whole != data:
        packed(spark, whole, data)


#: Subfield of a gzip header in which this writer states a member's sizes, packed and not; and that of block gzip files (its packed size less one).
SIZES, BLOCK_SIZE = b"QF", b"BC"


def sized_member(raw: bytes) -> bytes:
    """raw as a gzip member that states its sizes in its header."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(raw) + pack.flush()
    extra = SIZES + struct.pack("<HQQ", 16, 12 + 20 + len(body) + 8, len(raw))
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def members(path: str) -> list[tuple[int, int, int, int]] | None:
    """(place, size, place unpacked, size unpacked) of each gzip member, from their headers alone; None where a member does not state its size."""
    found, at, out, end = [], 0, 0, os.path.getsize(path)
    with open(path, "rb") as f:
        while at < end:
            f.seek(at)
            head = f.read(12)
            if len(head) < 12 or head[:3] != b"\x1f\x8b\x08" or not head[3] & 4:
                return None
            extra, sizes = f.read(struct.unpack_from("<H", head, 10)[0]), None
            k = 0
            while k + 4 <= len(extra):
                name, n = extra[k : k + 2], struct.unpack_from("<H", extra, k + 2)[0]
                if name == SIZES and n == 16:
                    sizes = struct.unpack_from("<QQ", extra, k + 4)
                elif name == BLOCK_SIZE and n == 2:
                    size = struct.unpack_from("<H", extra, k + 4)[0] + 1
                    f.seek(at + size - 4)
                    sizes = (size, struct.unpack("<I", f.read(4))[0])
                k += 4 + n
            if sizes is None or at + sizes[0] > end:
                return None
            found.append((at, sizes[0], out, sizes[1]))
            at, out = at + sizes[0], out + sizes[1]
    return found


def local_scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, which must lie in a file system that is mounted."""
    path = scratch_path(spark, name).removeprefix("file://")
    if "://" in path:
        raise ValueError("image files need a shared folder (spark.checkpoint.dir) in a file system that is mounted")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return path


def unpacked(spark: SparkSession, paths: Sequence[str], run_bytes: int = 16 << 20) -> dict[str, str]:
    """Where the bytes of each .gz file lie unpacked in the shared folder. Members that state their sizes are unpacked by many tasks,
    each at its place; a file without such sizes by one. A task that is run again writes the same bytes at the same place."""
    rows, out = [], {}
    for path in paths:
        out[path] = local_scratch(spark, "unpacked")
        stated = members(path)
        with open(out[path], "wb") as f:
            f.truncate(sum(m[3] for m in stated or []))
        if stated is None:
            rows.append((path, out[path], -1, 0, 0))
            continue
        first = 0
        for k, m in enumerate(stated):  # runs of members of about run_bytes
            if k + 1 == len(stated) or m[2] + m[3] - stated[first][2] >= run_bytes:
                rows.append((path, out[path], stated[first][0], m[0] + m[1] - stated[first][0], stated[first][2]))
                first = k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, target, at, size, place in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at < 0:
                    new = f"{target}.{os.getpid()}"
                    with gzip.open(path, "rb") as src, open(new, "wb") as dst:
                        shutil.copyfileobj(src, dst, 1 << 20)
                    os.replace(new, target)
                    continue
                with open(path, "rb") as src, open(target, "r+b") as dst:
                    src.seek(at)
                    dst.seek(place)
                    dst.write(gzip.decompress(src.read(size)))
            yield b

    if rows:
        todo = spark.createDataFrame(rows, "path string, target string, at long, size long, place long")
        todo.repartition(min(len(rows), 1000)).mapInArrow(run, todo.schema).write.format("noop").mode("overwrite").save()
    return out


def packed(spark: SparkSession, whole: str, path: str, run_bytes: int = 16 << 20) -> None:
    """path as the gzip file of `whole`, which is removed: tasks pack runs of bytes as members beside it, and these are joined in order."""
    size = os.path.getsize(whole)
    count = max(1, -(-size // run_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                with open(whole, "rb") as src:
                    src.seek(k * run_bytes)
                    member = sized_member(src.read(run_bytes))
                with open(f"{whole}.{k}.new", "wb") as out:
                    out.write(member)
                os.replace(f"{whole}.{k}.new", f"{whole}.{k}")
            yield b

    spark.range(0, count, 1, min(count, 1000)).mapInArrow(run, "id long").write.format("noop").mode("overwrite").save()
    with open(f"{whole}.gz", "wb") as out:
        for k in range(count):
            with open(f"{whole}.{k}", "rb") as src:
                shutil.copyfileobj(src, out, 1 << 20)
            os.remove(f"{whole}.{k}")
    os.remove(whole)
    os.replace(f"{whole}.gz", path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Nifti)
    spark.dataSource.register(NiftiHeaders)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_nifti(spark: SparkSession, path: str | Sequence[str], layout: str = "voxels", img: str = "img", volumes: Sequence[int] | None = None) -> DataFrame:
    """Voxels or planes of an image, of a list, of a pattern or of a folder of images, which may differ in size and sample type.

    img names a single image; of several, each is named by its path without what all share. volumes: those to read of each
    image; voxels' series hold only these, in that order. An empty folder gives no rows."""
    paths = image_paths(path)
    data = {p: input_names(p)[1] for p in paths}
    gz = sorted({d for d in data.values() if is_gz(d)})
    raw = unpacked(spark, gz) if gz else {}
    register(spark)
    options = {"paths": json.dumps(paths), "layout": layout, "img": img, "unpacked": json.dumps({p: raw[d] for p, d in data.items() if d in raw})}
    if volumes is not None:
        options["volumes"] = json.dumps([int(t) for t in volumes])
    return spark.read.format("nifti").options(**options).load()


HEADERS = (
    "img string, path string, nx int, ny int, nz int, nvol int, dx double, dy double, dz double, affine array<double>, xform_code int, xyz_units int, datatype int, "
    "slope double, inter double, nifti_version int, two_file boolean, ext array<struct<code: int, data: binary>>, error string"
)


class NiftiHeaders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "nifti_headers"

    def schema(self) -> str:
        return HEADERS

    def reader(self, schema):
        return HeaderReader(json.loads(self.options["paths"]), self.options.get("img", "img"))


class HeaderReader(DataSourceReader):
    def __init__(self, paths: list[str], img: str):
        self.named = list(zip(image_names(paths, img), paths, strict=True))

    def partitions(self):
        each = max(1, -(-len(self.named) // 1024))
        return [Images(self.named[k : k + each]) for k in range(0, len(self.named), each)] or [Images([])]

    def read(self, partition):
        for name, path in partition.named if partition else []:
            try:
                h, _ = read_header(path)
            except (ValueError, OSError, struct.error) as e:
                yield (name, path, *[None] * 16, str(e))
                continue
            yield (name, path, *h.shape, *h.pixdim[1:4], list(h.affine), h.xform_code, h.xyz_units, h.datatype, h.slope, h.inter, h.version, h.two_file, [(c, d) for c, d in h.extensions], None)


def read_headers(spark: SparkSession, path: str | Sequence[str], img: str = "img") -> DataFrame:
    """A row for each image of a path, list, pattern or folder with what its header says; of one that is no image, the error. Tasks read the headers."""
    register(spark)
    return spark.read.format("nifti_headers").options(paths=json.dumps(image_paths(path)), img=img).load()


def grid_distance(a: Header, b: Header) -> float:
    """Largest distance in mm between the corners of two grids of the same dimensions; infinite if it is no number."""
    nx, ny, nz, _ = a.shape
    corners = np.array([[x, y, z, 1] for x in (0, nx - 1) for y in (0, ny - 1) for z in (0, nz - 1)], float)
    place = lambda h: corners @ np.array(h.affine, float).reshape(4, 4)[:3].T * MM.get(h.xyz_units, 1.0)
    away = np.sqrt(((place(a) - place(b)) ** 2).sum(axis=1)).max()
    return float(away) if math.isfinite(away) else math.inf

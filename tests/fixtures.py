"""Deterministic synthetic images, written from their formulas in numpy."""

from __future__ import annotations

import numpy as np

#: Scalars of the integer hash that all fixtures draw from (fixed values).
MULTIPLY, ADD, FIRST, SECOND = 2654435761, 1013904223, 2246822519, 3266489917


def rng(i) -> np.ndarray:
    """A number in 0..1 from each index."""
    x = (np.asarray(i, np.uint64) * MULTIPLY + ADD).astype(np.uint32)
    x ^= x >> np.uint32(16)
    x = (x.astype(np.uint64) * FIRST).astype(np.uint32)
    x ^= x >> np.uint32(13)
    x = (x.astype(np.uint64) * SECOND).astype(np.uint32)
    x ^= x >> np.uint32(16)
    return x / 2.0**32


def image(kind: str) -> tuple[np.ndarray, tuple[float, float, float]]:
    """(float32 array x, y, z, t; spacing)."""
    shape = {"mag-even": (9, 10, 3, 8), "rician": (9, 9, 5, 48), "big48": (9, 9, 5, 48), "mag-pair": (9, 9, 3, 2), "mag-thin": (40, 40, 1, 30), "mag-wide": (40, 40, 6, 8), "mag-tall": (9, 9, 3, 100)}
    nx, ny, nz, nt = next((s for k, s in shape.items() if kind == k or kind.startswith(k + "-")), (9, 9, 3, 8))
    n3 = nx * ny * nz
    v, t = np.meshgrid(np.arange(n3), np.arange(nt), indexing="ij")
    i = t * n3 + v
    spacing = (1.0, 1.0, {"mag-aniso": 2.5, "mag-slab": 20.0, "mag-tiny": 11.0}.get(kind, 1.0))
    if kind in ("mag", "mag-aniso", "mag-slab", "mag-tiny"):
        out = np.where(t == 0, 900.0, 500.0) + 100 * rng(i)
        out = out * (1e-19 if kind == "mag-tiny" else 1)
    elif kind in ("mag-pair", "mag-thin", "mag-tall"):
        out = 500 + 100 * rng(i)
    elif kind == "mag-wide":
        out = 500 + 200 * np.sin(0.05 * v + 0.7 * t) + 100 * rng(i)
    elif kind.startswith("phase"):
        rad = np.where(i == 0, -np.pi, np.where(i == 1, np.pi, (rng(i + 7777) - 0.5) * 2 * np.pi))
        out = {"phase-rad": rad, "phase-int": rad * 4096 / np.pi, "phase-turns": rad / (2 * np.pi), "phase-deg": rad * 180 / np.pi, "phase-const": np.full(rad.shape, 1234.0), "phase-halfturns": 0.5 * (np.floor(rng(i) * 17) - 8)}[kind]
    elif kind.startswith("rician"):
        clean = 100 * (1.75 + 0.75 * np.sin(0.21 * v + 0.4 * t) + 0.5 * np.cos(0.37 * v))
        j = 4 * i
        r1, r2 = np.sqrt(-2 * np.log(1 - rng(j))), np.sqrt(-2 * np.log(1 - rng(j + 2)))
        a, c = 100 * r1 * np.cos(2 * np.pi * rng(j + 1)), 100 * r2 * np.cos(2 * np.pi * rng(j + 3))
        out = clean if kind == "rician-clean" else np.sqrt((clean + a) ** 2 + c**2)
        if kind == "rician-zero":
            out = np.where(i % 37 == 5, 0.0, out)
    elif kind.startswith("big48"):
        out = 1000 + sum(400 / c * np.sin(0.13 * c * v + 0.31 * c * t) for c in (1, 2, 3))
        if kind == "big48":
            out = out + (20 + 1980 * (v % 9) / 8) * (rng(i) - 0.5)
    elif kind == "mag-even":
        x, y = v % nx, v // nx % ny
        out = np.where((x - (nx - 1) / 2) ** 2 + (y - (ny - 1) / 2) ** 2 < 6, 900.0, 200.0) + 40 * rng(i)
    elif kind in ("mag-signed", "mag-clamped"):
        out = np.where((v // 9) % 4 < 2, 600.0, -600.0) + 80 * rng(i)
        out = np.maximum(out, 0) if kind == "mag-clamped" else out
    else:
        raise KeyError(kind)
    return out.astype(np.float32).reshape(nz, ny, nx, nt).transpose(2, 1, 0, 3), spacing


def voxels(spark, a: np.ndarray, img: str = "img", partitions: int = 4):
    """A voxel table of an x, y, z, t array."""
    import pyarrow as pa

    nx, ny, nz, nt = a.shape
    v = np.arange(nx * ny * nz)
    ts = a.transpose(2, 1, 0, 3).reshape(-1, nt)
    table = pa.table({"img": pa.array([img] * len(v)), "v": pa.array(v), "x": pa.array((v % nx).astype(np.int32)), "y": pa.array((v // nx % ny).astype(np.int32)), "z": pa.array((v // (nx * ny)).astype(np.int32)), "ts": pa.array(list(ts), pa.list_(pa.float32()))})
    return spark.createDataFrame(table).repartition(partitions)

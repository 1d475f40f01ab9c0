"""Local low-rank denoising and array analytics as PySpark pipelines."""

from __future__ import annotations

import os

#: Python workers stay alive between tasks; these let them give memory back.
SMALL_WORKERS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "1000000", "MALLOC_MMAP_THRESHOLD_": "1000000"}
#: Rows that go to a Python worker at once.
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ready(spark):
    """Let Python workers of this session find the package, from wherever the driver was started."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):  # tasks share the cores; their linear algebra must not
        env.setdefault(name, "1")
    for name, value in SMALL_WORKERS.items():
        env.setdefault(name, value)
    if spark.conf.get(ROWS) == "10000":  # the default: rows may hold whole texts
        spark.conf.set(ROWS, "1000")
    return spark

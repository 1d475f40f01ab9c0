"""Registered queries against their SQL, and the streaming form of a batch operator."""

import os

import numpy as np
import pytest
from helpers import DATA, same_rows

from quietfield.operators import unring
from quietfield.plans import relational
from quietfield.streaming.planes import SCHEMA, unring_stream

SF = f"{DATA}/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


@pytest.mark.parametrize("name", relational.ORACLE_SQL)
def test_against_sql(spark, duck, name):
    assert same_rows(relational.QUERIES[name](spark, SF).toPandas(), duck(relational.ORACLE_SQL[name], SF))


@pytest.mark.parametrize("name", sorted(set(relational.QUERIES) - set(relational.ORACLE_SQL)))
def test_without_sql_runs(spark, name):
    rows = relational.QUERIES[name](spark, SF).toPandas()
    assert len(rows) and not rows.isna().any().any()


def test_gram_invariants(spark):
    """The trace of the Gram matrix is the sum of squares, and so of the squared singular values."""
    rows = relational.ref_gram(spark, SF).toPandas()
    g = np.zeros((64, 64))
    g[rows.i, rows.j] = g[rows.j, rows.i] = rows.g
    y = np.stack(spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().embedding).astype(float)
    assert np.trace(g) == pytest.approx((y**2).sum(), rel=1e-6)
    np.testing.assert_allclose(np.linalg.eigvalsh(g)[::-1], np.linalg.svd(y, compute_uv=False) ** 2, rtol=1e-4, atol=1e-4)


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [("a", z, t, rng.normal(100, 10, 70).astype(np.float32).tolist()) for z in range(2) for t in range(3)]
    planes = spark.createDataFrame(rows, SCHEMA)
    planes.write.parquet(f"{tmp_path}/in")
    unring_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", 7, 10).awaitTermination()
    key = lambda f: f.sort_values(["z", "t"]).px.tolist()
    got, want = key(spark.read.parquet(f"{tmp_path}/out").toPandas()), key(unring.unring(planes, 7, 10).toPandas())
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))


def test_entry_and_names(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 500


@pytest.mark.parametrize("name", ["ref_rotate", "ref_overlap_mean"])
def test_slices_that_are_not_full(spark, duck, tmp_path, name):
    """The last slice is filled to a third, and others have holes."""
    import pandas as pd

    rows = pd.read_parquet(f"{SF}/embeddings.parquet")
    rows[(rows.vec_id < 436) & ~rows.vec_id.isin([0, 44, 122, 123, 399])].to_parquet(f"{tmp_path}/embeddings.parquet")
    got = relational.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert len(got) and same_rows(got, duck(relational.ORACLE_SQL[name], str(tmp_path)))

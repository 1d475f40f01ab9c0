"""Quantiles by counting against numpy's over all numbers."""

import numpy as np
import pytest

from quietfield.operators import compare, select
from quietfield.plans.denoise import filled


@pytest.mark.parametrize("kind", ["f4", "f8"])
def test_keys_sort_as_floats(kind):
    x = np.array([-np.inf, -3e30, -1.5, -1e-40, -0.0, 0.0, 1e-40, 2, 3e30, np.inf], kind)
    key = select.sortable(x)
    assert (np.diff(key.astype(float)) >= 0).all() and key[4] == key[5]
    assert (select.number(key, x.dtype.itemsize * 8) == x.astype(float)).all()


@pytest.mark.parametrize("kind", ["float", "double"])
def test_quantiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(0)
    one = np.round(rng.normal(0, 100, (300, 4)), 1).astype(np.float32 if kind == "float" else np.float64)
    one[:40] = 7.5  # many ties
    rows = [("a", x.tolist()) for x in one] + [("b", [1.0, 2.0]), ("b", [None, float("nan")]), ("c", [5.0]), ("d", [None]), ("e", []), ("f", None), ("g", [-0.0, 0.0, -1.0])]
    df = spark.createDataFrame(rows, f"img string, ts array<{kind}>").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.995, 1.0]
    got = {(r.img, r.share): r.level for r in select.quantiles(df, shares).collect()}
    assert {i for i, _ in got} == {"a", "b", "c", "g"}
    for img, x in (("a", one.ravel()), ("b", [1, 2]), ("c", [5]), ("g", [0, 0, -1])):
        assert [got[img, s] for s in shares] == pytest.approx(np.quantile(np.asarray(x, float), shares), abs=1e-9)


def test_only_counts_are_sent(spark):
    df = spark.range(0, 40_000, 1, 4).selectExpr("'a' AS img", "array(cast(id % 1000 AS float), cast(id AS float)) AS ts")
    plan = select.quantiles(df, [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "percentile" not in plan
    assert select.quantiles(df, [0.5]).first().level == float(np.median(np.concatenate([np.arange(40_000) % 1000, np.arange(40_000)])))


def test_window_and_fill_of_many_images(spark):
    rows = [(f"i{k % 5}", float(k - 20)) for k in range(100)] + [("none", 0.0)]
    sigma = spark.createDataFrame(rows, "img string, sigma float")
    assert filled(sigma) is None and filled(sigma.limit(0)) is None
    good = filled(sigma.where("img <> 'none'")).toPandas()
    for k in range(5):
        x = np.array([v for i, v in rows if i == f"i{k}"])
        own = np.sort(good[good.img == f"i{k}"].sigma)
        assert own.tolist() == sorted(np.where(x > 0, x, np.float32(np.median(x[x > 0]))).tolist())
    assert compare.window(spark.createDataFrame([("a", [1.0, 2.0, 3.0, 5.0])], "img string, ts array<float>"), 0.5).first().level == 2.5

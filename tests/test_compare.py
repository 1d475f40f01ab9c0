"""Where differing samples lie, over several images and tasks, against numpy."""

import numpy as np
import pytest

from quietfield.operators import compare


@pytest.mark.parametrize("relative_to", ["a", "b"])
def test_clusters_of_differences(spark, relative_to):
    rng, want, rows = np.random.default_rng(0), {}, ([], [])
    for img in ("p", "q"):
        a = rng.normal(0, 10, (60, 5)).astype(np.float32)
        b = np.where(rng.random(a.shape) < 0.02, a + 9, a + 0.001).astype(np.float32)
        a[:, 3], a[7] = a[:, 1], 0
        b[9, 2] = np.nan
        d = np.abs(a.astype(float) - b)
        level = np.sqrt(np.nanmean((a if relative_to == "a" else b).astype(float) ** 2))
        over = d > 0.3 * level
        want[img] = (int(over.sum()), int(over.any(1).sum()), int(over.any(0).sum()), 4, 1, np.nanmax(d), divmod(int(np.nanargmax(d)), 5))
        for side, x in zip(rows, (a, b), strict=True):
            side += [(img, v, s) for v, s in enumerate(x.tolist())]
    schema = "img string, v long, ts array<float>"
    left, right = (spark.createDataFrame(r, schema).repartition(5) for r in rows)
    for r in compare.compare(left, right, 0.3, relative_to).collect():
        assert (round(r.over_share * 300), r.over_voxels, r.over_volumes, r.distinct_volumes, r.odd, r.max_abs, (r.max_v, r.max_t)) == want[r.img]
    part = compare.compare(left.where("v < 50"), right.where("v > 3"), 0.3).where("img = 'p'").first()
    assert part.n == 46 * 5 and part.unmatched == 14
    assert compare.compare(left.limit(0), right.limit(0)).count() == 0


def test_series_of_other_lengths_are_refused(spark):
    one, two = (spark.createDataFrame([("i", 0, [1.0] * n)], "img string, v long, ts array<float>") for n in (2, 3))
    with pytest.raises(Exception, match="differ in length"):
        compare.compare(one, two).collect()
    with pytest.raises(ValueError):
        compare.compare(one, one, relative_to="c")

"""Counters come with the job that does the work."""

from dataclasses import replace

import fixtures
import numpy as np
from test_anchors import DEFAULT, LEGACY, run

from quietfield.operators import patches


def test_counters_equal_what_is_counted_afterwards(spark):
    frame, done = run(spark, "mag", replace(DEFAULT, vst=False))
    a = fixtures.image("mag")[0]
    assert done.counters["wanted"] == a[..., 0].size and done.counters["fallbacks"] == done.fallbacks
    assert done.counters["without_signal"] == sum(not np.any(t) for t in frame.ts)
    assert abs(done.counters["rank_sum"] - frame["rank"].sum()) <= done.fallbacks * a.shape[3]
    assert run(spark, "mag", replace(LEGACY))[1].counters == {}


def test_counters_of_masked_runs_and_fallbacks(spark):
    a, _ = fixtures.image("mag-slab")
    n = a[..., 0].size
    mask = spark.createDataFrame([("img", v) for v in range(0, n, 2)], "img string, v long")
    done = run(spark, "mag-slab", replace(DEFAULT, vst=False, aggregator_fwhm=0.5), mask=mask)[1]
    assert done.counters["wanted"] == len(range(0, n, 2)) and done.fallbacks == done.counters["fallbacks"] > 0
    assert patches.MISSING != patches.DONE

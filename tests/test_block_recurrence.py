"""Cross-recurrence of bounded trials: the measures of the join of points, and no point is shuffled."""

import math

import numpy as np
import pytest

from pairwave.operators import dependence, signal
from pairwave.plans import catalog


@pytest.mark.parametrize("n, dim, delay, radius", [(50, 3, 1, 0.1), (168, 3, 1, 0.4), (80, 2, 3, 0.3), (60, 1, 1, 0.01)])
def test_is_the_picture_line_by_line(n, dim, delay, radius):
    r = np.random.default_rng(n)
    a, b = np.cumsum(r.normal(size=(2, n)), axis=1)
    got = dependence.block_recurrence(signal.standardised(a), signal.standardised(b), dim, delay, radius)
    want = signal.cross_recurrence(a, b, dim, delay, radius)
    if want["rr"]:
        assert {k: got.get(k, 0.0) for k in want} == pytest.approx(want)
    else:
        assert got == {"rr": 0.0} and math.isnan(want["det"])


def test_no_point_is_shuffled(spark, sf):
    plan = catalog.QUERIES["cross_recurrence"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "strip" not in plan and plan.count("Exchange hashpartitioning") <= 6

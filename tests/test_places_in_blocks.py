"""Permutations of places in blocks that fit the cache: those of the plain network, without an array as large as the job."""

import tracemalloc

import numpy as np
import pytest

from pairwave.operators import halves


@pytest.mark.parametrize("n, unit", [(2, 0), (4, 7), (66, 3), (100, 2**31 + 5), (3000, 11), (1 << 27, 5)])
def test_is_the_plain_network(n, unit, monkeypatch):
    places = np.arange(n) if n <= 3000 else np.random.default_rng(1).integers(0, n, 500)
    iterations = np.arange(1, 601)
    got = halves.new_places(unit, n, places, iterations, 448)
    monkeypatch.setattr(halves, "WIDE", 0)
    want = halves.new_places(unit, n, places, iterations, 448)
    assert (got == want).all()
    if n <= 3000:
        assert (np.sort(got, axis=0) == np.arange(n)[:, None]).all()


def test_work_stays_small():
    places, iterations = np.arange(2000), np.arange(1, 1001)
    halves.new_places(1, 2000, places[:10], iterations, 448)
    tracemalloc.start()
    halves.new_places(1, 2000, places, iterations, 448)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the result has 8 MB; before, each of some thirty steps made 16 MB
    assert peak < 12e6

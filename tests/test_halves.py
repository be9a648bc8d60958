"""Keyed permutations: every place once, halves like random ones, sums whatever the pieces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwave.operators import halves, mixed


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 128])
def test_every_place_once(n):
    new = halves.new_places(5, n + n % 2, np.arange(n + n % 2), np.arange(1, 60), 448)
    assert all(sorted(new[:, c]) == list(range(n + n % 2)) for c in range(new.shape[1]))
    assert (halves.odd_half(5, n, np.arange(n), np.arange(1, 60), 448).sum(axis=0) == (n + 1) // 2).all()


@pytest.mark.parametrize("n", [40, 41])
def test_halves_are_like_random_ones(n):
    times, half = 4000, (n + 1) // 2
    even = halves.odd_half(7, n, np.arange(n), np.arange(1, times + 1), 3)
    # each sample, and each pair of samples, is in the odd half as often as chance has it
    assert abs(even.mean(axis=1) - half / n).max() < 4.5 * 0.5 / np.sqrt(times)
    both = (even.astype(float) @ even.T) / times
    want = half * (half - 1) / (n * (n - 1))
    off = both[~np.eye(n, dtype=bool)]
    assert abs(off.mean() - want) < 1e-9 and abs(off - want).max() < 5.5 * np.sqrt(want * (1 - want) / times)
    # means of a half spread as those of samples without replacement
    x = np.arange(n, dtype=float)
    means = x @ even / half
    assert means.var() == pytest.approx(x.var(ddof=1) * (1 / half - 1 / n), rel=0.1)
    # iterations don't follow each other
    assert abs(np.corrcoef(means[:-1], means[1:])[0, 1]) < 0.06


@pytest.mark.parametrize("piece,at_once", [(65_536, 2_000_000), (3, 50)])
def test_sums_do_not_depend_on_pieces(spark, monkeypatch, piece, at_once):
    monkeypatch.setattr(halves, "PIECE", piece)
    monkeypatch.setattr(halves, "AT_ONCE", at_once)
    rng = np.random.default_rng(1)
    data = {None: rng.normal(size=7), 1: rng.normal(size=12), 2: rng.normal(size=3)}
    rows = [(k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k long, p long, x double").repartition(5)
    got = {(r.k, r.iteration): r for r in halves.random_halves(df, ["k"], F.coalesce("k", F.lit(0)), "x", "p", 9, 448).collect()}
    assert set(got) == {(k, i) for k in (None, 1) for i in range(1, 10)}
    for (k, i), r in got.items():
        x, n = data[k], len(data[k])
        odd = halves.odd_half(k or 0, n, np.arange(n), np.array([i]), 448)[:, 0]
        assert (r.n_samples, r.n_odd, r.n_even) == (n, (n + 1) // 2, n // 2)
        assert r.odd_half_mean == pytest.approx(x[odd].mean()) and r.even_half_mean == pytest.approx(x[~odd].mean())


def test_sums_of_persons(spark):
    rows = [(p, u, i, float(p + 10 * u + (i * 7) % 5)) for p in range(3) for u in range(3) for i in range(5 + u)]
    df = spark.createDataFrame(rows, "person long, unit long, sample long, v double")
    for span in (None, 2):
        got = {(r.person, r.iteration): r for r in mixed.random_half_sums(df, ["unit"], "person", "v", "sample", 20, 5, span).collect()}
        assert len(got) == 60 and all(r.m == 3 for r in got.values()) and len({r.x for (p, _), r in got.items() if p == 1}) > 5
        for (p, _), r in got.items():
            whole = [np.array([v for q, w, _, v in rows if (q, w) == (p, u)]) for u in range(3)]
            assert abs(r.x - sum(w.mean() for w in whole)) < 6 and abs(r.y - sum(w.mean() for w in whole)) < 6


def test_sizes_are_the_persons_sums(spark):
    """Units of one piece and of many, added up without rows for persons and iterations."""
    rows = [(u // 3, u, i, float((u * 7919 + i * 104729) % 97) - 40) for u in range(12) for i in range(5 + u % 4)]
    df = spark.createDataFrame(rows, "person long, unit long, sample long, v double")
    persons = mixed.random_half_sums(df, ["unit"], "person", "v", "sample", 20, 5)
    near = lambda d: sorted(tuple(round(r[c], 6) for c in ("iteration", "m", *mixed.SUMS)) for r in d.collect())
    want = near(mixed.by_size(persons, ["iteration"]))
    assert near(mixed.random_half_sizes(df, ["unit"], "person", "v", "sample", 20, 5)) == want and len(want) == 20
    whole = halves.PIECE
    halves.PIECE = 6
    try:
        assert near(mixed.random_half_sizes(df, ["unit"], "person", "v", "sample", 20, 5)) == want
    finally:
        halves.PIECE = whole


def test_remainders_without_division():
    x = np.concatenate((np.arange(5), halves.PRIME + np.arange(-2, 3), np.array([2**62 - 1, 2**62, 2**63 - 1]), np.random.default_rng(1).integers(0, 2**63 - 1, 10_000)))
    assert (halves._rest(x) == x % halves.PRIME).all()

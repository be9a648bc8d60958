"""Trials of one length at once: causes as of each pair alone, and no call of a pair's kernel for a trial."""

import numpy as np

from pairwave.operators import signal, trial


def _series(r, m, n):
    """Random walks, lines between few points, and one of two lines."""
    a, b = np.cumsum(r.normal(size=(2, m, n)), axis=2) + 60
    for i in range(0, m, 2):
        knots = np.sort(r.choice(np.arange(1, n - 1), r.integers(1, 6), replace=False))
        a[i] = np.interp(np.arange(n), [0, *knots, n - 1], r.exponential(50, len(knots) + 2))
    return a, b


def test_as_one_by_one():
    r = np.random.default_rng(4)
    for n in (17, 18, 21, 48):
        a, b = _series(r, 30, n)
        want = np.array([[signal.granger(u, v)[k] for k in ("p_ab", "p_ba")] for u, v in zip(a, b)])
        np.testing.assert_allclose(signal.many_granger(a, b), want, atol=1e-8)


def test_distributions_of_arrays():
    r = np.random.default_rng(5)
    x, a, b = r.random(200), r.integers(1, 12, 200) / 2, r.integers(1, 60, 200) / 2
    x[:2] = 0, 1
    np.testing.assert_allclose(signal.beta_cdfs(x, a, b), [signal.beta_cdf(*v) for v in zip(x, a, b)], atol=1e-12)


def test_no_kernel_is_called_for_a_trial(monkeypatch):
    calls = []
    for name in ("phases", "granger", "coherence", "cross_recurrence"):
        monkeypatch.setattr(signal, name, lambda *a, **k: calls.append(1))
    r = np.random.default_rng(6)
    a, b = np.cumsum(r.normal(size=(2, 20, 48)), axis=2) + 60
    a[3] = np.arange(48)
    place = np.broadcast_to(np.arange(48), a.shape)
    out = trial._all(place, place * 3600.0, a, b, fs=4.0, radius=0.1, least=20, most_lag=10, width=86_400.0, step=43_200.0, least_window=20)
    assert not calls and out["kernel_error"][3] == "ValueError: a constant series" and np.isnan(out["p_ab"][3]) and not np.isnan(np.delete(out["p_ab"], 3)).any()

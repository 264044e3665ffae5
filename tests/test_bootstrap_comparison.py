"""Draws of all trials side by side against one trial and one bar at a time."""

from __future__ import annotations

import numpy as np

from tapeloom.operators import weights as W


def _one_by_one(lo, hi, n, rng):
    count, picks = np.zeros(hi.max() + 1), []
    for _ in range(n):
        u = np.array([(1.0 / (count[a : b + 1] + 1)).mean() for a, b in zip(lo, hi)])
        picks.append(rng.choice(len(lo), p=u / u.sum()))
        count[lo[picks[-1]] : hi[picks[-1]] + 1] += 1
    u = [np.mean(1.0 / count[a : b + 1]) for a, b in zip(lo[picks], hi[picks])]
    return picks, np.mean(u)


def test_trials_side_by_side():
    rng = np.random.default_rng(2)
    lo = np.sort(rng.integers(0, 90, 40))
    hi = lo + rng.integers(0, 60, 40)
    got = W._sequential_draws(lo, hi, 40, [np.random.default_rng(t) for t in range(4)])
    want = [_one_by_one(lo, hi, 40, np.random.default_rng(t)) for t in range(4)]
    assert got.tolist() == [p for p, _ in want]
    assert np.allclose(W._mean_uniqueness(lo, hi, got), [u for _, u in want], rtol=1e-12)


def test_event_between_two_bars_is_never_drawn():
    lo, hi = np.array([0, 3, 3]), np.array([4, 2, 5])
    picks = W._sequential_draws(lo, hi, 50, [np.random.default_rng(1)])
    assert set(picks[0]) == {0, 2}

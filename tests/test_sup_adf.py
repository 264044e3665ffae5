"""The sup unit-root statistic far from the origin, with a trend, and with tiles left out by their bound."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tapeloom.operators import breaks as K


def brute(y, end, lags, constant, min_length):
    d = np.diff(y)
    x = np.column_stack([y[lags:-1], *[d[lags - i : len(d) - i] for i in range(1, lags + 1)]])
    top, best = end - lags, -np.inf
    for s in range(0, top + lags - min_length + 1):
        n = top - s
        t = np.arange(n) / n
        z = np.column_stack([x[s:top], *[t**k for k in range({"nc": 0, "c": 1, "ct": 2, "ctt": 3}[constant])]])
        q, r = np.linalg.qr(z)
        b = np.linalg.solve(r, q.T @ d[lags:][s:top])
        e, inv = d[lags:][s:top] - z @ b, np.linalg.inv(r)
        best = max(best, b[0] / np.sqrt(e @ e / (n - z.shape[1]) * (inv[0] @ inv[0])))
    return best


@pytest.mark.parametrize("lags, constant", [(1, "nc"), (0, "c"), (1, "ct"), (2, "ctt")])
def test_sup_adf_against_orthogonal_fits(spark, lags, constant):
    rng = np.random.default_rng(5)
    n = 320
    made = {"walk": np.cumsum(rng.normal(0, 0.1, n)) + 4, "noise": rng.normal(4, 1, n), "burst": np.exp(np.arange(n) / 150) + rng.normal(0, 0.02, n)}
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"instrument": k, "pos": np.arange(n), "y": v}) for k, v in made.items()]))
    got = K.sup_adf(df, min_length=20, lags=lags, constant=constant, size=16).toPandas().set_index(["instrument", "pos"])["sadf"]
    for k, y in made.items():
        for end in (60, 199, n - 1):
            assert got[k, end] == pytest.approx(brute(y, end, lags, constant, 20), rel=1e-6, abs=1e-6)


def test_bound_holds_and_leaves_blocks_out():
    rng = np.random.default_rng(6)
    size, blocks, p = 16, 40, 3
    y = rng.normal(4, 1, size * blocks + 2)
    d = np.diff(y)
    raw = np.stack([y[1:-1], d[:-1], d[1:]])
    cells = [K._cells(K._around(raw[:, b * size : (b + 1) * size], 0, 4.0, "c", size)) for b in range(blocks)]
    upto, ends = np.cumsum(cells[-1], axis=1), np.arange(size)
    since = np.cumsum(np.array([c.sum(axis=1) for c in cells[:-1]])[::-1], axis=0)[::-1]
    best, far = K._open_blocks(upto, since, ends, np.full(size, -1.0), p, 19, size)
    assert len(far) < blocks - 2
    for a in sorted(set(range(blocks - 2)) - set(far)):
        back = np.cumsum(cells[a][:, ::-1], axis=1)[:, ::-1] + since[a + 1][:, None]
        assert (K._tile_best(upto, back, ends, np.arange(size) + (a - blocks + 1) * size, np.ones(size, bool), p, 19) < best).all()


def test_bound_of_parts_leaves_most_of_an_open_block_out():
    """A block that its own bound leaves open is met only in the parts whose bound is open too; the others hold nothing better."""
    rng = np.random.default_rng(8)
    size, blocks, p, part = 64, 12, 3, 4
    y = rng.normal(4, 1, size * blocks + 2)
    d = np.diff(y)
    raw = np.stack([y[1:-1], d[:-1], d[1:]])
    cells = [K._cells(K._around(raw[:, b * size : (b + 1) * size], 0, 4.0, "c", size)) for b in range(blocks)]
    upto, ends = np.cumsum(cells[-1], axis=1), np.arange(size)
    since = np.cumsum(np.array([c.sum(axis=1) for c in cells[:-1]])[::-1], axis=0)[::-1]
    best, far = K._open_blocks(upto, since, ends, np.full(size, -1.0), p, 19, size)
    backs = [np.cumsum(cells[a][:, ::-1], axis=1)[:, ::-1] + since[a + 1][:, None] for a in far]
    at = np.array([np.vstack((b[:, ::part].T, since[a + 1])) for a, b in zip(far, backs)])
    left = K._open_parts(upto, at, ends, (blocks - 1 - np.array(far)) * size, best, p, part)
    assert far and sum(map(len, left)) < len(far) * (size // part) / 2
    for a, back, kept in zip(far, backs, left):
        closed = np.flatnonzero(~np.isin(np.arange(size) // part, kept))
        if len(closed):
            found = K._tile_best(upto, back[:, closed], ends, closed + (a - blocks + 1) * size, np.ones(len(closed), bool), p, 19)
            assert (found < best).all()


def test_level_shift_tiles_leave_in_slices():
    """A batch of many tiles is answered slice by slice, with arrays and not an object per end."""
    rng = np.random.default_rng(7)
    size, n = 32, 200
    ye, ys = rng.normal(size=(n, size)), rng.normal(size=(n, size))
    batch = pd.DataFrame({"instrument": "a", "blk": 2, "_sblk": 1, "y": list(ye), "_s_y": list(ys)})
    parts = [*K._departures("y", size)(iter([batch]))]
    assert max(map(len, parts)) <= 64 and sum(map(len, parts)) == n
    out = pd.concat(parts)
    gap = size + np.subtract.outer(np.arange(size), np.arange(size))
    for k in (0, 77, n - 1):
        val = (ye[k][:, None] - ys[k][None, :]) / np.sqrt(gap)
        assert isinstance(out["_v"].iloc[k], np.ndarray) and np.array_equal(out["_v"].iloc[k], val.max(axis=1))
        assert np.array_equal(out["_n"].iloc[k], size + val.argmax(axis=1))

"""Rows waiting for the watermark: few entries, released in order and in bounded pieces."""

from __future__ import annotations

import numpy as np
import pandas as pd

from tapeloom.operators import bars as B
from tapeloom.streaming import online as O


class Entries(dict):
    keys = lambda self: iter([*super().keys()])
    updateValue, getValue = dict.__setitem__, dict.__getitem__  # noqa: N815

    def removeKey(self, key):  # noqa: N802
        del self[key]


class Handle:
    def __init__(self):
        self.timers = []

    def listTimers(self):  # noqa: N802
        return [*self.timers]

    def deleteTimer(self, t):  # noqa: N802
        self.timers.remove(t)

    def registerTimer(self, t):  # noqa: N802
        self.timers.append(t)


class Kept(O._Ordered):
    def release(self, key, rows):
        return rows


def test_waiting_rows_leave_in_order_and_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(O, "RELEASED", 4000)
    monkeypatch.setattr(O, "STORED", 20000)
    rng = np.random.default_rng(2)
    n, t0 = 60000, pd.Timestamp("2024-01-01")
    secs = rng.permutation(n) * 40  # 28 days: a bucket of one minute would hold one or two rows
    rows = pd.DataFrame({"instrument": "a", "ts": (t0 + pd.to_timedelta(secs, unit="s")).astype("datetime64[us]"), "seq": secs})
    held = Kept(spark.createDataFrame(rows[:1]).schema, ["ts", "seq"])
    held.handle, held.waiting = Handle(), Entries()
    assert not [*held._advance(("a",), (rows[i : i + 5000] for i in range(0, n, 5000)), 0)] and held.handle.timers == [t0.value // 1_000_000 + 1]
    assert len(held.waiting) < 300
    middle, end = t0 + pd.Timedelta(seconds=30000 * 40), t0 + pd.Timedelta(seconds=n * 40)
    got = [*held._advance(("a",), [], middle.value // 1_000_000)]
    assert max(map(len, got)) < 7000 and pd.concat(got)["seq"].tolist() == list(range(0, 30000 * 40, 40))
    assert held.handle.timers == [middle.value // 1_000_000 + 1]
    got = [*held._advance(("a",), [], end.value // 1_000_000)]
    assert pd.concat(got)["seq"].tolist() == list(range(30000 * 40, n * 40, 40)) and not held.waiting and not held.handle.timers


def test_bar_step_is_the_same_in_pieces():
    rng = np.random.default_rng(4)
    n = 500
    rows = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=n, freq="s"), "price": rng.integers(100, 900, n) / 4, "qty": rng.integers(1, 9, n), "one": 1})
    step, whole = O._bar_step(B.threshold_marker("one", 7.0)), []
    want = step(rows, [0.0], [])[0]
    nums, opened = [0.0], []
    for a, b in zip([0, 3, 7, 8, 200], [3, 7, 8, 200, n]):
        out, nums, opened = step(rows[a:b].reset_index(drop=True), nums, opened)
        whole.append(out)
    got = pd.concat(whole, ignore_index=True)
    assert len(want) == n // 7 and np.allclose(got.drop(columns="ts").astype(float), want.drop(columns="ts").astype(float)) and got["ts"].tolist() == want["ts"].tolist()
    first = rows[:7]
    assert want.loc[0, "open"] == first["price"][0] and want.loc[0, "high"] == first["price"].max() and want.loc[0, "close"] == first["price"][6]
    assert np.isclose(want.loc[0, "vwap"], (first["price"] * first["qty"]).sum() / first["qty"].sum())

"""Trade features of bars come from one pass and equal the single operators."""

from __future__ import annotations

import numpy as np
import pandas as pd

from tapeloom.operators import micro as M

LEVELS = (1, 5, 10)


def test_one_pass_equals_the_single_operators(spark, monkeypatch):
    rng = np.random.default_rng(8)
    n, blocks = 400, "tapeloom.series.block_rows"
    ids = np.cumsum(rng.random(n) < 0.06)
    rows = [
        pd.DataFrame({"instrument": k, "pos": np.arange(n), "bar_id": ids, "price": 100 + np.cumsum(rng.integers(-1, 2, n)).astype(float), "qty": rng.integers(1, 12, n), "side": rng.choice([-1, 1], n)})
        for k in "ab"
    ]
    trades = spark.createDataFrame(pd.concat(rows))
    want = M.kyle_lambda(trades, min_trades=5)
    want = want.join(M.round_sizes(trades, levels=LEVELS, by=M.BAR).select(*M.BAR, "round_fraction"), list(M.BAR))
    want = want.join(M.serial_correlation(trades, by_bar=True), list(M.BAR)).join(M.bar_tick_accuracy(trades), list(M.BAR)).toPandas()
    spark.conf.set(blocks, "37")
    try:
        got = M.trade_features(trades, levels=LEVELS).toPandas()
    finally:
        spark.conf.unset(blocks)
    order = list(M.BAR)
    a, b = (x.sort_values(order).reset_index(drop=True).iloc[:, 2:].astype(float).to_numpy() for x in (want, got))
    assert len(a) == 2 * (ids[-1] - ids[0] + 1) and np.isnan(a).any() and np.allclose(a, b, atol=1e-12, equal_nan=True)


def test_feature_table_orders_no_trades_anew(spark, monkeypatch):
    """No positions inside bars are dealt and written."""
    def refuse(*a, **k):
        raise AssertionError("position")

    bars = spark.createDataFrame([("a", 0, 0, 1.0, 2.0, 0.5, 1.5, 3.0, 2, 1)], "instrument string, bar_id long, pos long, open double, high double, low double, close double, dollar double, buy_volume long, sell_volume long")
    trades = spark.createDataFrame([("a", i, 0, 1.0 + i % 2, 2, 1) for i in range(6)], "instrument string, pos long, bar_id long, price double, qty long, side int")
    monkeypatch.setattr(M, "position", refuse)
    out = M.feature_table(bars.withColumn("ts", bars["pos"].cast("timestamp")), trades).collect()
    assert len(out) == 1 and out[0]["tick_rule_accuracy"] == 4 / 6

"""Hand-traced values per operator; a shifted second instrument catches a missing partition key."""

from __future__ import annotations

import datetime as dt
import math
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import T0, col, days, series, trades
from tapeloom.functions.gaussian import with_norm_cdf, with_norm_ppf
from tapeloom.operators import bars as B
from tapeloom.operators import bets, breaks, cv, entropy, fracdiff, labels, micro, rolls, stats
from tapeloom.operators import risk, ticks, weights

approx = pytest.approx


def test_normal_functions(spark):
    df = spark.createDataFrame([(x / 7.0,) for x in range(-60, 61)], "x double")
    for r in with_norm_cdf(df, "x", "p").collect():
        assert r.p == approx(0.5 * math.erfc(-r.x / math.sqrt(2)), abs=1e-13)
    ps = spark.createDataFrame([(p,) for p in (1e-9, 0.001, 0.02, 0.3, 0.5, 0.77, 0.99, 1 - 1e-6)], "p double")
    for r in with_norm_ppf(ps, "p", "z").collect():
        assert r.z == approx(statistics.NormalDist().inv_cdf(r.p), abs=1e-8)


def test_ewma(spark):
    df = series(spark, [10, 12, 8], name="x")
    assert col(ticks.ewma(df, x="x", window=3), "ewma")[-1] == approx(9.5)


@pytest.mark.parametrize("prices,want", [([100, 102, 102, 99], [1, 1, 1, -1]), ([100, 101, 101, 99, 99, 100], [1, 1, 1, -1, -1, 1])])
def test_tick_rule(spark, prices, want):
    assert col(ticks.tick_rule(series(spark, prices, name="price")), "tick") == want


def test_side_probabilities(spark):
    r = ticks.side_probabilities(trades(spark, [1, 1, 1, 1], side=[1, 1, 1, -1])).where("instrument = 'a'").first()
    assert (r.p_buy, r.p_sell) == (0.75, 0.25)


def test_cusum(spark):
    df = series(spark, [100, 101, 102, 103, 104, 110, 111, 112, 113, 114, 120])
    got = [t.day for t in col(B.cusum_filter(df, h=5.0), "ts")]
    assert got == [6, 11]


def test_tick_and_dollar_bars(spark):
    t = trades(spark, [100, 101, 102, 103, 104, 105, 106])
    assert len(col(B.tick_bars(t, n=3), "close", "bar_id")) == 2
    v = B.tick_bars(trades(spark, [100, 200, 100], qty=[10, 1, 1]), n=3)
    assert col(v, "vwap", "bar_id") == [approx(1300 / 12)]
    d = B.dollar_bars(trades(spark, [100, 200, 100, 200]), threshold=300.0).where("instrument = 'a'").orderBy("bar_id").collect()
    assert len(d) == 2 and (d[0].open, d[0].high, d[0].low, d[0].close, d[0].vwap) == (100, 200, 100, 200, 150)


def test_large_trade_closes_one_bar(spark):
    b = B.volume_bars(trades(spark, [1, 1, 1], qty=[1, 50, 1]), threshold=10)
    assert col(b, "n_trades", "bar_id") == [2]


def test_empty_and_short(spark):
    t = trades(spark, [1.0, 2.0]).where("pos > 5")
    assert B.tick_bars(t, n=2).count() == 0
    assert B.dollar_bars(trades(spark, [1.0]), threshold=5.0).count() == 0


def test_rolls(spark):
    rows = [("A", 100, 101), ("A", 101, 102), ("A", 102, 103), ("B", 105.5, 106), ("B", 106, 107), ("B", 107, 108)]
    pdf = pd.DataFrame([{"instrument": i, "pos": k, "contract": c, "open": float(o), "close": float(x)} for k, (c, o, x) in enumerate(rows) for i in ("a", "z")])
    f = spark.createDataFrame(pdf)
    assert col(rolls.roll_gaps(f), "gap") == [-2.5, -2.5, -2.5, 0, 0, 0]
    out = rolls.rolled_prices(f)
    assert col(out, "rolled_close") == [103.5, 104.5, 105.5, 106, 107, 108]
    idx = col(rolls.non_negative_index(f), "r_price")
    assert idx[0] is None
    k, want = 1.0, []
    raw, rc = [r[2] for r in rows], [103.5, 104.5, 105.5, 106, 107, 108]
    for i in range(1, 6):
        k *= 1 + (rc[i] - rc[i - 1]) / raw[i - 1]
        want.append(k)
    assert idx[1:] == [approx(v) for v in want]


def test_daily_volatility(spark):
    closes = [100, 102, 101, 105, 103, 107, 110, 108, 112, 115]
    got = col(labels.daily_volatility(series(spark, closes), span=3), "vol")
    # previous close: last bar strictly before t - 1 day
    rets = pd.Series([closes[i] / closes[i - 2] - 1 for i in range(2, 10)])
    want = rets.ewm(span=3).std().tolist()
    assert got[0] is None and got[1:] == [approx(v) for v in want[1:]]


def test_barriers_and_labels(spark):
    b = series(spark, [100, 101, 102, 103, 104, 105, 106, 107, 108, 109])
    ev = spark.createDataFrame([("a", T0 + dt.timedelta(days=i)) for i in (1, 3, 5)], "instrument string, t0 timestamp")
    t1 = [r.t1.day for r in labels.vertical_barrier(b, ev, days=2).orderBy("t0").collect()]
    assert t1 == [4, 6, 8]
    path = series(spark, [100, 100, 103, 98.5, 97, 99])  # -1.5% on day 4 is inside the barrier
    e = spark.createDataFrame([("a", T0, None, 0.02, 1)], "instrument string, t0 timestamp, t1 timestamp, trgt double, side int")
    hit = labels.first_touch(path, e, pt=1, sl=1, size=2).first()
    assert (hit.pt_ts.day, hit.sl_ts.day) == (3, 5)
    off = labels.first_touch(path, e, pt=0, sl=1).first()
    assert off.pt_ts is None and off.sl_ts.day == 5


def _spans(spark):
    b = series(spark, [100, 105, 110, 108, 120, 125])
    ev = spark.createDataFrame(
        [("a", days(6)[i], days(6)[j]) for i, j in ((0, 2), (2, 3), (4, 5))], "instrument string, t0 timestamp, t1 timestamp"
    )
    return b, ev


def test_concurrency_uniqueness_attribution(spark):
    b, ev = _spans(spark)
    assert col(weights.concurrency(b, ev), "c") == [1, 1, 2, 1, 1, 1]
    tw = [r.tw for r in weights.average_uniqueness(b, ev).orderBy("t0").collect()]
    assert tw == [approx(5 / 6), approx(0.75), approx(1.0)]
    w = [r.w for r in weights.return_attribution(b, ev, scaled=False).orderBy("t0").collect()]
    assert w == [approx(0.07205, abs=1e-5), approx(0.004911, abs=1e-6), approx(0.146183, abs=1e-6)]
    scaled = [r.w for r in weights.return_attribution(b, ev).collect()]
    assert sum(scaled) == approx(3)


@pytest.mark.parametrize("last,want", [(0.5, [0.6, 0.7, 0.8, 0.9, 1.0]), (0.0, [0.2, 0.4, 0.6, 0.8, 1.0]), (-0.5, [0, 0, 0.2, 0.6, 1.0])])
def test_time_decay(spark, last, want):
    w = spark.createDataFrame([("a", t, 1.0) for t in days(5)], "instrument string, t0 timestamp, tw double")
    got = [r.decay for r in weights.time_decay(w, last=last).orderBy("t0").collect()]
    assert got == [approx(v) for v in want]


def test_bootstrap_prefers_unique(spark):
    b, ev = _spans(spark)
    out = weights.bootstrap_comparison(b, ev, trials=60).first()
    assert out.mean_seq > out.mean_std


def test_bootstrap_draws_over_the_whole_series(spark):
    """Every draw follows the probabilities given all draws before it, over all events of the series."""
    rng = np.random.default_rng(3)
    lo = np.sort(rng.integers(0, 900, 300))
    hi = lo + rng.integers(0, 40, 300)
    count, u01, want = np.zeros(hi.max() + 1), np.random.default_rng(5), []
    for _ in range(300):
        p = np.array([np.mean(1 / (count[a : b + 1] + 1)) for a, b in zip(lo, hi)])
        k = int(np.searchsorted(np.cumsum(p), u01.random() * p.sum(), side="right"))
        want.append(k)
        count[lo[k] : hi[k] + 1] += 1
    assert weights._draws_by_blocks(lo, hi, 300, np.random.default_rng(5)).tolist() == want
    b = series(spark, [100.0] * 1000)
    ev = spark.createDataFrame([("a", T0 + dt.timedelta(days=int(x)), T0 + dt.timedelta(days=int(y))) for x, y in zip(lo, hi)], "instrument string, t0 timestamp, t1 timestamp")
    got = weights.sequential_bootstrap(b, ev, trials=2).groupBy("window", "trial").agg(F.count("*"), F.max("draw")).collect()
    assert sorted(tuple(r) for r in got) == [(0, 0, 300, 299), (0, 1, 300, 299)]


def test_fracdiff_weights(spark):
    assert list(fracdiff.weights(0.4, 5)) == [approx(v) for v in (1, -0.4, -0.12, -0.064, -0.0416)]
    w = fracdiff.weights_until(0.4, 0.05)
    assert len(w) == 4 and abs(w[-1]) >= 0.05
    x = [math.log(100 + i * 1.7 + (i % 5)) for i in range(40)]
    df = series(spark, x, name="x")
    got = col(fracdiff.frac_diff_ffd(df, x="x", d=0.4, thres=0.05), "value")
    want = [sum(w[k] * x[i - k] for k in range(4)) for i in range(3, 40)]
    assert got == [approx(v) for v in want]
    full = col(fracdiff.frac_diff(df, x="x", d=0.4, thres=1.0, size=7), "value")
    ww = fracdiff.weights(0.4, 40)
    assert full == [approx(sum(ww[k] * x[i - k] for k in range(i + 1))) for i in range(40)]


def test_wide_window_matches_short(spark):
    x = [math.sin(i / 3) + i * 0.01 for i in range(150)]
    df = series(spark, x, name="x")
    thres = 2e-4
    w = fracdiff.weights_until(0.4, thres)
    assert len(w) > 64
    got = col(fracdiff.frac_diff_ffd(df, x="x", d=0.4, thres=thres), "value")
    assert got == [approx(sum(w[k] * x[i - k] for k in range(len(w)))) for i in range(len(w) - 1, 150)]


def test_cv_groups_and_paths():
    assert len(cv.enumerate_splits(6, 2)) == 15 and cv.n_paths(6, 2) == 5
    assert cv.enumerate_splits(6, 2)[0] == (0, 1) and cv.enumerate_splits(6, 2)[-1] == (4, 5)


def test_cv_group_sizes(spark):
    obs = series(spark, range(88), name="v").withColumn("t0", F.col("ts")).withColumn("t1", F.col("ts") + F.expr("INTERVAL 3 DAYS"))
    g = cv.with_groups(obs, n_groups=6).where("instrument='a'").groupBy("grp").count().orderBy("grp").collect()
    assert [r["count"] for r in g] == [14, 14, 14, 14, 14, 18]
    m = cv.purged_kfold(obs, n_splits=4, pct_embargo=0.05).where("instrument='a'")
    test = m.where("role='test'").groupBy("split").count().orderBy("split").collect()
    assert [r["count"] for r in test] == [22] * 4
    # no training label may overlap a test label
    j = m.where("role='train'").alias("x").join(m.where("role='test'").alias("y"), "split")
    assert j.where("x.t0 < y.t1 AND y.t0 < x.t1").count() == 0


def test_signals(spark):
    df = spark.createDataFrame([("a", T0, T0 + dt.timedelta(days=1), 0.7, 1)], "instrument string, t0 timestamp, t1 timestamp, prob double, pred int")
    out = bets.bet_signal(df, n_classes=2, step=0.01).orderBy("t").collect()
    assert [r.signal for r in out] == [approx(0.34), 0.0]
    p = spark.createDataFrame([(115.0, 100.0, 100, 0)], "forecast double, price double, max_pos long, pos long")
    p = p.withColumn("w", bets.scale_for(F.lit(10.0), F.lit(0.95)))
    r = bets.limit_price(bets.target_position(p)).first()
    assert r.w == approx(10.803324, abs=1e-6) and r.target_pos == 97 and r.limit_price == approx(112.365739, abs=1e-6)


def test_sharpe_and_cscv(spark):
    rows = [("s", f"t{j}", i, math.sin(i * (j + 1) * 0.7) + 0.05 * j) for j in range(4) for i in range(40)]
    t = spark.createDataFrame(rows, "study string, trial string, pos long, pnl double")
    one = spark.createDataFrame([("x", float(v)) for v in (1, 2, 3, 4)], "k string, pnl double")
    assert stats.sharpe_by(one, ["k"]).first().sharpe == approx(1.9364916731)
    for s in (4, 6, 8):
        assert stats.cscv(t, blocks=s).count() == math.comb(s, s // 2)
    p = stats.pbo(stats.cscv(t, blocks=6)).first().pbo
    assert 0 <= p <= 1
    with pytest.raises(ValueError):
        stats.cscv(t, blocks=5)


def test_bets_timing_and_holding(spark):
    p = series(spark, [1, 1, 0, -1, -1, 1], name="position", shift=0.0)
    assert col(stats.bet_timing(p), "pos") == [2, 5]
    assert stats.holding_period(series(spark, [0, 1, 1, 1, 0], name="position", shift=0.0)).first().holding_days == approx(3)
    h = stats.holding_period(series(spark, [0, 2, 0, 0, 1, 1, 1, 0], name="position", shift=0.0)).first().holding_days
    assert h == approx(5 / 3)


def test_drawdown(spark):
    dd = stats.drawdowns(series(spark, [100, 110, 90, 105], name="equity", shift=0.0)).where("instrument='a'").collect()
    assert len(dd) == 1 and dd[0].drawdown == approx(1 - 90 / 110) and dd[0].tuw_years is None


def test_failure_probability(spark):
    r = spark.createDataFrame([("a", v) for v in (0.02, 0.03, 0.015, 0.01, 0.025, -0.01, -0.02, -0.005)], "k string, ret double")
    p = risk.payoff_table(r, ["k"]).withColumns({"freq": F.lit(260.0), "target": F.lit(1.0)})
    assert risk.probability_of_failure(p).first().p_fail == approx(0.3201562453, abs=1e-9)
    up = risk.payoff_table(r.where("ret > 0"), ["k"]).withColumns({"freq": F.lit(260.0), "target": F.lit(1.0)})
    assert risk.probability_of_failure(up).first().p_fail is None


def test_ou_parameters(spark):
    paths = [([100, 102, 101, 100.5], 100), ([50, 47, 48.5, 49.2], 50)]
    rows = [("a", float(p[i] - c), float(p[i + 1] - c)) for p, c in paths for i in range(len(p) - 1)]
    r = risk.ou_parameters(spark.createDataFrame(rows, "instrument string, x double, y double")).first()
    assert r.phi == approx(0.4881889764) and r.sigma == approx(1.4615366020)


def test_micro(spark):
    r = micro.roll_measure(series(spark, [10, 12, 9, 11, 8, 10, 7, 9])).where("instrument='a'").first()
    assert (r.c, r.sigma_u, r.cov_dp) == (approx(2.7386127876), approx(0.0), approx(-7.5))
    flow = series(spark, [0] * 5, extra={"buy_volume": [10, 20, 5, 15, 25], "sell_volume": [5, 15, 20, 10, 5]})
    v = col(micro.vpin(flow, window=2, name="v"), "v")
    assert v[0] is None and v[1:] == [approx(x) for x in (0.2, 1 / 3, 0.4, 5 / 11)]
    q = trades(spark, [1] * 7).drop("qty").join(
        spark.createDataFrame(list(enumerate([0.001, 0.00123, 0.01, 0.5, 0.499999, 1.0, 0.0037])), "pos long, qty double"), "pos"
    )
    rs = micro.round_sizes(q, levels=[0.001, 0.01, 0.1, 0.5, 1.0]).where("instrument='a'").first()
    assert rs.round_fraction == approx(5 / 7) and rs.n_0_5 == 2


def test_encodings_and_entropy(spark):
    df = series(spark, [1.0, -1.0, 0.0, 2.0, -3.0], name="x", shift=0.0)
    assert entropy.messages(entropy.binary_code(df, "x"), window=10).where("instrument='a'").first().msg == "1010"
    q = entropy.quantile_code(series(spark, range(1, 9), name="x"), "x", letters=4)
    assert entropy.messages(q, window=10).where("instrument='a'").first().msg == "00112233"
    m = spark.createDataFrame([("a", 0, "0011"), ("a", 1, "1011")], "instrument string, window long, msg string")
    assert entropy.plug_in(m.where("window=0"), word=1).first().h_plugin == approx(0.9182958341)
    assert entropy.plug_in(m.where("window=1"), word=2).first().h_plugin == approx(0.5)
    assert entropy.lz_words("101010") == ["1", "0", "10"] and entropy.lz_words("0000") == ["0", "00"]
    assert entropy.match_length("0011001100", 4, 4) == 5


def test_chow_matches_regression(spark):
    y = [math.log(100 + 3 * math.sin(i) + i * 0.5) for i in range(30)]
    t = breaks.chow_at(series(spark, y, name="y"), tau=0.4).where("instrument='a'").first()
    k = round(0.4 * 30)
    x = [y[i - 1] if i >= k else 0.0 for i in range(1, 30)]
    d = [y[i] - y[i - 1] for i in range(1, 30)]
    sxx, sxy = sum(a * a for a in x), sum(a * b for a, b in zip(x, d))
    b = sxy / sxx
    s2 = sum((dd - b * xx) ** 2 for dd, xx in zip(d, x)) / (len(d) - 1)
    assert t.k == k and t.dfc == approx(b / math.sqrt(s2 / sxx))


def test_weight_pieces():
    import numpy as np

    w = fracdiff.weights(0.3, 50)
    assert np.allclose(np.concatenate(list(fracdiff.weight_chunks(0.3, 50, chunk=7))), w)
    assert np.allclose(fracdiff.weight_segment(0.3, 13, 29), w[13:29])
    cum = np.cumsum(np.abs(w)[::-1])
    assert fracdiff.skipped_rows(0.3, 50, 0.2) == int((cum / cum[-1] > 0.2).sum())


def test_catalog_loads_without_a_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 150"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=60)

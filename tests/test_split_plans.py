"""Block plans (three-row blocks) must equal the plain plans and brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import col, series, trades
from tapeloom.operators import bars as B
from tapeloom.operators import breaks, entropy, labels, portfolio, ticks
from tapeloom.operators.flow_history import FlowHistory
from tapeloom.plans.series import ewm_sums, framed, position, quantiles, running

approx = pytest.approx
RNG = random.Random(5)
X = [RNG.uniform(-3, 5) for _ in range(23)]


def test_position_running_framed(spark, split):
    df = series(spark, X, name="x", shift=0.0).drop("pos")
    df = position(df, ["ts", "seq"])
    assert col(df, "pos", "ts") == list(range(23))
    out = running(df, {"s": ("sum", F.col("x")), "m": ("max", F.col("x")), "n": ("count", F.col("x")), "l": ("last", F.when(F.col("x") > 0, F.col("x")))})
    assert col(out, "s") == [approx(v) for v in np.cumsum(X)]
    assert col(out, "m") == list(np.maximum.accumulate(X))
    assert col(out, "n") == list(range(1, 24))
    assert col(out, "l") == [approx(v) for v in pd.Series(X).where(pd.Series(X) > 0).ffill()]
    ex = running(df, {"s": ("sum", F.col("x"))}, exclusive=True)
    assert col(ex, "s")[0] is None and col(ex, "s")[1:] == [approx(v) for v in np.cumsum(X)[:-1]]
    fr = framed(df, lambda w: {"r": F.sum("x").over(w.rowsBetween(-4, 0)), "n": F.lead("x", 2).over(w)}, before=4, after=2)
    assert col(fr, "r") == [approx(sum(X[max(0, i - 4) : i + 1])) for i in range(23)]
    assert col(fr, "n") == X[2:] + [None, None]


def test_quantiles(spark, split):
    r = quantiles(series(spark, X, name="x", shift=0.0), "x", [0.25, 0.5, 0.9]).where("instrument='a'").first()
    assert [r.q0, r.q1, r.q2] == [approx(v) for v in np.quantile(X, [0.25, 0.5, 0.9])]


def test_ewm_crosses_blocks(spark):
    x = [1.0 + (i % 7) for i in range(700)]
    beta = 0.5  # blocks of 199 rows
    got = col(ewm_sums(series(spark, x, name="x", shift=0.0), {"y": F.col("x")}, beta), "y")
    acc, want = 0.0, []
    for v in x:
        acc = acc * beta + v
        want.append(acc)
    assert got == [approx(v, rel=1e-12) for v in want]


def _tape(spark):
    price = [round(10 + RNG.uniform(-1, 1), 2) for _ in range(40)]
    qty = [RNG.randint(1, 9) for _ in range(40)]
    side = [RNG.choice([1, 1, -1]) for _ in range(40)]
    return trades(spark, price, qty, side)


@pytest.mark.parametrize(
    "make",
    [
        lambda t: B.volume_bars(t, threshold=12),
        lambda t: B.tick_run_bars(t, init_ticks=3),
        lambda t: B.tick_imbalance_bars(t, init_ticks=3),
    ],
    ids=["volume", "run", "imbalance"],
)
def test_folds_split_equals_plain(spark, make):
    t = _tape(spark)
    plain = make(t).orderBy("instrument", "bar_id").drop("ts").collect()
    spark.conf.set("tapeloom.series.block_rows", "7")
    try:
        blocks = make(t).orderBy("instrument", "bar_id").drop("ts").collect()
    finally:
        spark.conf.unset("tapeloom.series.block_rows")
    assert len(plain) > 4 and plain == blocks


def test_imbalance_bars_against_definition(spark):
    t = _tape(spark)
    side = col(t, "side")

    def ewma(v, w):
        a, y = 2 / (w + 1), v[0]
        for q in v[1:]:
            y = a * q + (1 - a) * y
        return y

    theta, n, et, eb, lengths, hist, ends = 0, 0, 3, 0, [], [], []
    for i, b in enumerate(side):
        hist.append(b)
        theta, n = theta + b, n + 1
        if not lengths and len(hist) >= 3:
            eb = max(ewma(hist, 3), 1e-6)
        if eb != 0 and abs(theta) >= et * abs(eb):
            ends.append(i)
            lengths.append(n)
            theta = n = 0
            et = ewma(lengths, 3)
            eb = max(ewma(hist, max(1, int(3 * et))), 1e-6)
    assert col(B.tick_imbalance_bars(t, init_ticks=3), "end_pos", "bar_id") == ends


def test_sup_statistics_tiles(spark):
    y = np.cumsum([0.01 * v for v in X * 2]) + 4.6
    df = series(spark, y, name="y", shift=0.0)
    got = {r.pos: r for r in breaks.level_shift_sup(df, min_sample=3, size=5).where("instrument='a'").collect()}
    for t in range(3, len(y)):
        sig = math.sqrt(sum(np.diff(y[: t + 1]) ** 2) / (t - 1))
        vals = [(y[t] - y[n]) / (sig * math.sqrt(t - n)) for n in range(t)]
        assert got[t].s == approx(max(vals)) and got[t].n_star == int(np.argmax(vals))
    for lags, const in ((1, "nc"), (1, "ct"), (0, "c")):
        sadf = {r.pos: r.sadf for r in breaks.sup_adf(df, min_length=12, lags=lags, constant=const, size=6).where("instrument='a'").collect()}
        d = np.diff(y)
        rows = len(d) - lags
        x = np.column_stack([y[lags:-1], *[d[lags - i : len(d) - i] for i in range(1, lags + 1)]])
        if const != "nc":
            x = np.column_stack([x, np.ones(rows)])
        if const == "ct":
            x = np.column_stack([x, np.arange(rows)])
        dy = d[lags:]
        for end in (15, 20, len(y) - 1):
            best = -np.inf
            top = end - lags
            for s in range(0, top + lags - 12 + 1):
                xx, yy = x[s:top], dy[s:top]
                inv = np.linalg.pinv(xx.T @ xx)
                b = inv @ xx.T @ yy
                e = yy - xx @ b
                best = max(best, b[0] / math.sqrt(e @ e / (len(yy) - xx.shape[1]) * inv[0, 0]))
            assert sadf[end] == approx(best, rel=1e-5)


def test_entropy_rate_against_definition():
    def slow(msg, i, n):
        best = ""
        for length in range(n):
            w = msg[i : i + length + 1]
            if any(msg[j : j + length + 1] == w for j in range(i - n, i)):
                best = w
        return len(best) + 1

    for _ in range(20):
        m = "".join(RNG.choice("012") for _ in range(24))
        assert all(entropy.match_length(m, i, i) == slow(m, i, i) for i in range(1, 13))
        assert all(entropy.match_length(m, i, 6) == slow(m, i, 6) for i in range(6, 19))


def test_trajectory_and_tree(spark):
    mu = [[0.01, 0.02], [0.03, -0.01]]
    params = spark.createDataFrame([("u", h, f"a{i}", mu[h][i], 0.001) for h in range(2) for i in range(2)], "universe string, h int, asset string, mean double, c double")
    v = [[[0.04, 0.01], [0.01, 0.09]], [[0.05, 0.0], [0.0, 0.02]]]
    cov = spark.createDataFrame([("u", h, f"a{i}", f"a{j}", v[h][i][j], 0.0) for h in range(2) for i in range(2) for j in range(2)], "universe string, h int, a string, b string, cov double, corr double")
    got = portfolio.best_trajectory(params, cov, k=2, chunk=7).first()
    grid, best = portfolio.weight_grid(2, 2), None
    for p in grid:
        for q in grid:
            cost = 0.001 * (np.sqrt(abs(p)).sum() + np.sqrt(abs(q - p)).sum())
            sr = (p @ mu[0] + q @ mu[1] - cost) / math.sqrt(p @ np.array(v[0]) @ p + q @ np.array(v[1]) @ q)
            if best is None or sr > best[0]:
                best = (sr, p.tolist(), q.tolist())
    assert got.sr == approx(best[0]) and got.w == [best[1], best[2]]
    assert portfolio.count_trajectories(2, 2, 2) == len(grid) ** 2
    c = np.diag([0.04, 0.09, 0.01])
    long = spark.createDataFrame([("u", f"a{i}", f"a{j}", float(c[i, j]), float(i == j)) for i in range(3) for j in range(3)], "universe string, a string, b string, cov double, corr double")
    w = [r.w for r in portfolio.hierarchical_risk_parity(long, by=["universe"]).orderBy("asset").collect()]
    assert sum(w) == approx(1) and all(x > 0 for x in w)


def test_no_pairwise_joins_in_plans(spark):
    import tapeloom.catalog as catalog

    q = catalog.load()[0]
    for name in ("tk5_tick_rule", "bar2_tick_bars", "mic11_spectrum", "sta2_cscv", "cv1_purged_kfold"):
        plan = q[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
    plan = q["src4_parquet_pruned"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<value:double>" in plan


def test_labels_split_equals_plain(spark, split):
    b = series(spark, [100 + 5 * math.sin(i) for i in range(20)])
    ev = b.select("instrument", F.col("ts").alias("t0")).where("pos % 4 = 2")
    vol = labels.daily_volatility(b, span=5)
    out = labels.triple_barrier_events(b, ev, vol, pt_sl=(1, 1), min_ret=0.0, num_days=4).orderBy("instrument", "t0").collect()
    spark.conf.unset("tapeloom.series.block_rows")
    vol = labels.daily_volatility(b, span=5)
    plain = labels.triple_barrier_events(b, ev, vol, pt_sl=(1, 1), min_ret=0.0, num_days=4).orderBy("instrument", "t0").collect()
    assert [(r.instrument, r.t0, r.t1) for r in out] == [(r.instrument, r.t0, r.t1) for r in plain] and len(out) > 4


def test_tick_rule_split(spark, split):
    t = series(spark, [100, 101, 101, 99, 99, 100, 100, 100], name="price")
    assert col(ticks.tick_rule(t), "tick") == [1, 1, 1, -1, -1, 1, 1, 1]


def test_first_touch_levels(spark):
    b = series(spark, [100 + 5 * math.sin(i * 0.7) + 0.1 * i for i in range(90)])
    ev = b.where("pos % 7 = 2").select(
        "instrument", F.col("ts").alias("t0"), F.when(F.col("pos") % 2 == 0, F.col("ts") + F.expr("INTERVAL 40 DAYS")).alias("t1"),
        F.lit(0.02).alias("trgt"), F.when(F.col("pos") % 3 == 0, -1).otherwise(1).alias("side"),
    )
    out = [labels.first_touch(b, ev, pt=1.0, sl=1.5, levels=x).orderBy("instrument", "t0").collect() for x in ((1 << 16, 256), (32, 8, 2), (2,))]
    assert out[0] == out[1] == out[2] and any(r.pt_ts for r in out[0]) and any(r.sl_ts for r in out[0])
    assert labels.first_touch(b, ev, pt=0, sl=0).where("pt_ts is not null or sl_ts is not null").isEmpty()


def test_flow_history_is_the_recursion():
    rng = np.random.default_rng(0)
    x = rng.normal(size=60_000) + 0.1
    whole, parts = FlowHistory(), FlowHistory()
    whole.append(x)
    for i in range(0, len(x), 37):
        parts = FlowHistory.of(parts.state())
        parts.append(x[i : i + 37])
    assert whole.state() == parts.state()
    for window in (1, 10, 5_000, 200_000):
        a = 2 / (window + 1)
        w = a * (1 - a) ** np.arange(len(x) - 1, -1, -1.0)
        w[0] /= a
        assert abs(whole.average(window) - float(w @ x)) < 1e-12


@pytest.mark.parametrize("block", ["1000000", "60"])
def test_long_imbalance_span_does_not_depend_on_blocks(spark, block):
    """Bars whose span is far longer than a block, with a DOUBLE measure beside them."""
    rng = np.random.default_rng(2)
    t = spark.createDataFrame(pd.DataFrame({"instrument": "a", "pos": range(700), "seq": range(700), "ts": pd.date_range("2020", periods=700, freq="h"), "price": 100 + rng.normal(size=700).cumsum(), "qty": rng.uniform(0.5, 2, 700), "side": rng.choice([-1, 1], 700)}))
    t = t.withColumn("dollar", F.col("price") * F.col("qty"))
    spark.conf.set("tapeloom.series.block_rows", block)
    try:
        bars = B.tick_imbalance_bars(t, init_ticks=5, prev_bars=40, floor="abs").orderBy("bar_id").collect()
        dollars = B.dollar_bars(t, threshold=1000.5).orderBy("bar_id").collect()
    finally:
        spark.conf.unset("tapeloom.series.block_rows")
    flow = t.orderBy("pos").toPandas()
    ends, acc = [], 0.0
    for i, v in enumerate(flow["dollar"].tolist()):
        acc += v
        if acc >= 1000.5:
            ends.append(i)
            acc = 0.0
    assert [r.end_pos for r in dollars] == ends
    side, ends, theta, ticks, span, bars_done, length, goal = flow["side"].tolist(), [], 0.0, 0, 5.0, 0, 0.0, 0.0

    def mean(n, window):
        a, m = 2 / (window + 1), side[0]
        for v in side[1:n]:
            m = a * v + (1 - a) * m
        return max(abs(m), 1e-6)

    for i, v in enumerate(side):
        theta, ticks = theta + v, ticks + 1
        if not bars_done:
            goal = span * mean(i + 1, 5) if i + 1 >= 5 else math.inf
        if abs(theta) >= goal * (1 + 1e-12):
            length = ticks if not bars_done else 2 / 41 * ticks + (1 - 2 / 41) * length
            goal = length * mean(i + 1, max(1, int(40 * length)))
            ends.append(i)
            theta, ticks, bars_done = 0.0, 0, 1
    assert [r.end_pos for r in bars] == ends


@pytest.mark.parametrize("blocks", [10, 100])
def test_wavefront_visits_rows_once(spark, tmp_path, blocks):
    """Folds that never forget: one visit for the states and one for the rows, however many blocks."""
    from pyspark.sql import types as T

    from tapeloom.plans.series import fold

    n = 300
    df = series(spark, [float(i % 11) for i in range(n)])
    log = str(tmp_path / "visits")

    def total(rows, state):
        with open(log, "a") as f:
            f.write(f"{len(rows)}\n")
        sums = state[0] + rows["close"].cumsum()
        return rows.assign(total=sums), [float(sums.iloc[-1])]

    schema = T.StructType([*df.schema.fields, T.StructField("total", T.DoubleType())])
    spark.conf.set("tapeloom.series.block_rows", str(n // blocks))
    try:
        out = fold(df, total, [0.0], schema, forgets=False).collect()
    finally:
        spark.conf.unset("tapeloom.series.block_rows")
    want = {"a": 0.0, "z": 0.0}
    for r in sorted(out, key=lambda r: (r["instrument"], r["pos"])):
        want[r["instrument"]] += r["close"]
        assert r["total"] == want[r["instrument"]]
    assert len(out) == 2 * n and sum(map(int, open(log))) == 2 * 2 * n


def test_linear_scan_is_the_recurrence(spark, split):
    from pyspark.sql import functions as F

    from tapeloom.plans.series import linear_scan

    df = series(spark, [0.1 * (i % 5) - 0.2 for i in range(20)], shift=0.05)
    turn = (F.col("pos") % 4 == 1).cast("double")
    got = linear_scan(df, [[F.lit(1.0), F.col("close")], [turn, 1 - turn]], ["k", "s"], [1.0, 0.5]).collect()
    state = {}
    for r in sorted(got, key=lambda r: (r["instrument"], r["pos"])):
        k, s = state.get(r["instrument"], (1.0, 0.5))
        assert (r["k"], r["s"]) == pytest.approx((k, s))
        state[r["instrument"]] = (k + s * r["close"], k if r["pos"] % 4 == 1 else s)
    assert len(got) == 40


@pytest.mark.parametrize("tile", [128, 7])
def test_covariance_tiles(spark, monkeypatch, tile):
    """Many assets, missing values and large means: pairwise-complete moments, merged over tasks."""
    monkeypatch.setattr(portfolio, "TILE", tile)
    rng = np.random.default_rng(11)
    n, names = 240, [f"s{i:03d}" for i in range(500 if tile == 128 else 20)]
    x = 1e6 + rng.normal(size=(n, len(names))) + rng.normal(size=(n, 1))
    x[rng.random(x.shape) < 0.05] = np.nan
    frame = pd.DataFrame(x, columns=names).assign(u=np.where(np.arange(n) % 3 == 0, "p", "q"))
    wide = spark.createDataFrame(frame).repartition(6)
    wide = wide.select("u", *(F.nanvl(c, F.lit(None)).alias(c) for c in names))
    got = portfolio.covariance(wide, names, by=["u"]).toPandas()
    assert len(got) == 2 * len(names) ** 2
    for u, part in got.groupby("u"):
        want = frame[frame["u"] == u][names]
        assert np.allclose(part.pivot(index="a", columns="b", values="cov")[names].loc[names], want.cov(), rtol=1e-6, atol=1e-9)
        own = part[part["a"] == part["b"]]
        assert (own["corr"] == 1.0).all() and part["corr"].abs().max() <= 1.2
    dist = portfolio.correlation_distance(spark.createDataFrame(got[got["a"].isin(names[:15]) & got["b"].isin(names[:15])]))
    two = portfolio.distance_of_distances(dist, by=["u"]).toPandas()
    d = dist.toPandas()
    for u, part in two.groupby("u"):
        m = d[d["u"] == u].pivot(index="a", columns="b", values="dist")
        want = np.sqrt(((m.to_numpy()[:, None, :] - m.to_numpy()[None, :, :]) ** 2).sum(2))
        assert np.allclose(part.pivot(index="a", columns="b", values="dist2").loc[m.index, m.index], want)

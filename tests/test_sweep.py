"""Sweep of configurations in one job: equal to runs of one configuration; tiles of the level shift statistic."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import T0
from tapeloom.operators import bets as B
from tapeloom.operators import breaks as K
from tapeloom.operators import cv as V
from tapeloom.operators.cell_fits import out_of_sample_cells
from tapeloom.operators.stats import evaluate_overfitting
from tapeloom.plans import evidence as E
from tapeloom.plans import sweep as S
from tapeloom.plans.series import position, reuse
from tapeloom.sources.artefacts import training_table

CFG = E.LabelConfig(target_bars=90, cusum_h=2.0, vol_span=20, pt_sl=(0.5, 0.4), min_ret=0.001, num_days=2, measure="cents")
FEATS = ["roll_c", "vpin_10bar", "fracdiff"]


@pytest.fixture(scope="module")
def tape(spark):
    rng = np.random.default_rng(5)
    parts = []
    for name in ("a", "b"):
        n = 900
        price = np.round(100 + np.cumsum(rng.normal(0, 0.6, n)), 2)
        qty = rng.integers(1, 50, n)
        side = rng.choice([-1, 1], n)
        parts.append(
            pd.DataFrame(
                {
                    "instrument": name, "pos": np.arange(n), "seq": np.arange(n), "ts": pd.Timestamp(T0) + pd.to_timedelta(np.arange(n) * 2, unit="h"),
                    "price": price, "qty": qty, "side": side, "dollar": price * qty, "cents": np.round(price * 100).astype("int64") * qty, "is_buyer_maker": side < 0,
                }
            )
        )
    return reuse(spark.createDataFrame(pd.concat(parts)))


def single(tape, cfg):
    x = E.bars_and_labels(tape, cfg)
    n = x.bars.groupBy("instrument").agg(F.count(F.lit(1)).alias("n_bars"))
    tw = x.tw.groupBy("instrument").agg(F.count(F.lit(1)).alias("n_events"), F.avg("tw").alias("tw_mean"), F.sum("tw").alias("t_eff"))
    return x, n.join(tw, "instrument").toPandas().set_index("instrument").sort_index()


def test_every_setting_acts_as_in_a_run_of_its_own(spark, tape):
    grid = {"base": CFG, "other": E.LabelConfig(60, 3.0, 12, (0.0, 0.3), 0.004, 1.5, "dollar"), "none": replace(CFG, cusum_h=1e9), "wrong": replace(CFG, vol_span=0)}
    got = S.label_sweep(tape, grid).toPandas().set_index(["config", "instrument"]).sort_index()
    assert len(got) == 8 and got.loc["none", "error"].eq("stage events produced no rows").all()
    assert got.loc["wrong", "error"].eq("vol_span must be positive").all()
    for name in ("base", "other"):
        want = single(tape, grid[name])[1]
        assert got.loc[name, "status"].eq("ok").all() and want["n_events"].min() > 5
        for c in want.columns:
            assert np.allclose(got.loc[name, c].astype(float), want[c]), (name, c)


def test_evidence_equals_a_run_of_its_own(spark, tape):
    regs, steps = (0.01, 1.0), (0.1, 0.25)
    got = S.evidence_sweep(tape, {"x": replace(CFG, cusum_h=3.0), "base": CFG}, features=FEATS, regs=regs, steps=steps, blocks=4).toPandas()
    got = got[got["config"] == "base"].set_index("instrument").sort_index()
    x, _ = single(tape, CFG)
    rows = training_table(E.enriched_events(x), x.w, FEATS).withColumn("bin", (F.col("bin") > 0).cast("int"))
    rows = reuse(position(rows, ["t0"]))
    oos = reuse(out_of_sample_cells(reuse(V.purged_kfold(rows, n_splits=3, pct_embargo=0.01)), {f"{g:g}": (FEATS, g) for g in regs}, splits=range(3), name="reg"))
    bars, parts = x.bars.select("instrument", "pos", "ts", "close"), []
    for g in regs:
        sides = oos.where(F.col("reg") == f"{g:g}").select("instrument", "t0", "t1", "prob", F.when(F.col("pred") == 1, 1).otherwise(-1).alias("pred"))
        for s in steps:
            pnl = B.strategy_pnl(B.positions_on_bars(bars, B.bet_signal(sides, n_classes=2, step=s)))
            parts.append(pnl.select(F.col("instrument").alias("study"), F.lit(f"reg={g:g},step={s:g}").alias("trial"), "pos", "pnl"))
    used = x.tw.join(rows.select("instrument", "t0"), ["instrument", "t0"]).select(F.col("instrument").alias("study"), "tw")
    want = evaluate_overfitting(reuse(S._union(parts)), used, blocks=4).toPandas().set_index("study").sort_index()
    assert got["status"].eq("ok").all() and list(got["best_trial"]) == list(want["best_trial"])
    for c in ("sr_hat", "pbo", "dsr"):
        assert np.allclose(got[c].astype(float), want[c], atol=1e-6), c


def test_level_shift_leaves_out_tiles_that_cannot_matter(spark):
    rng = np.random.default_rng(3)
    n, size = 400, 16
    walks = {"up": np.cumsum(rng.normal(0.2, 1, n)), "down": np.cumsum(rng.normal(-0.2, 1, n)), "flat": np.repeat([1.0, 1.0, 2.0, 1.0], n // 4)}
    df = reuse(spark.createDataFrame(pd.concat([pd.DataFrame({"instrument": k, "pos": np.arange(n), "y": v}) for k, v in walks.items()])))
    got = K.level_shift_sup(df, size=size).toPandas()
    for k, y in walks.items():
        part = got[got["instrument"] == k].sort_values("pos")
        moved = np.concatenate([[0.0], np.cumsum(np.diff(y) ** 2)]) > 0  # no spread, no statistic
        assert list(part["pos"]) == [t for t in range(3, n) if moved[t]]
        for t, v, m in zip(part["pos"], part["s"], part["n_star"]):
            d = (y[t] - y[:t]) / np.sqrt(t - np.arange(t))
            sig = np.sqrt((np.diff(y[: t + 1]) ** 2).sum() / (t - 1))
            assert m == d.argmax() and np.isclose(v, d.max() / sig)
    blocks = K._blocks(df, ["y"], size)
    known = {k: [max([(y[t] - y[s]) / np.sqrt(t - s) for s in range(max(t // size - 1, 0) * size, t)], default=-np.inf) for t in range(n)] for k, y in walks.items()}
    near = spark.createDataFrame([(k, b, [float(v) for v in walks[k][b * size : (b + 1) * size]], [float(v) for v in known[k][b * size : (b + 1) * size]]) for k in walks for b in range(n // size)], "instrument string, blk long, y array<double>, _known array<double>")
    kept = K._far_tiles(near, blocks, "y", size).groupBy("instrument").count().toPandas().set_index("instrument")["count"]
    assert kept.get("down", 0) < 0.5 * (n // size - 1) * (n // size - 2) / 2


def test_sweep_without_a_valid_point(spark, tape):
    got = S.evidence_sweep(tape, {"w": replace(CFG, measure="absent")}).toPandas()
    assert sorted(got["instrument"]) == ["a", "b"] and got["status"].eq("failed").all() and got["error"].eq("no column absent").all()

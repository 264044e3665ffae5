"""Logistic fits of many cells: closed forms, optimality and MLlib on the same objective."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import cell_fits as C
from tapeloom.operators import importance as I


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(4)
    n = 600
    x = rng.normal(size=(n, 3)) * [1, 50, 0.01] + [0, 1e4, 0]
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - (x[:, 1] - 1e4) / 60)))).astype(int)
    f = pd.DataFrame(x, columns=["a", "b", "c"]).assign(g=(x[:, 0] > 0.3).astype(float), bin=y, w=rng.uniform(0.5, 2, n), instrument="i", pos=range(n))
    f.loc[::37, "c"] = np.nan
    return f


@pytest.fixture(scope="module")
def members(spark, frame):
    parts = [frame.assign(split=s, role=np.where(frame["pos"] % 4 == s, "test", "train")) for s in range(4)]
    df = spark.createDataFrame(pd.concat(parts)).repartition(5)
    return df.withColumn("c", F.nanvl("c", F.lit(None))).cache()


def test_saturated_fit_is_the_weighted_share(members, frame):
    """One 0/1 feature without ridge: the probability is the weighted share of its group in the training rows."""
    got = C.out_of_sample_cells(members, {"g": (["g"], 0.0)}, splits=range(4)).toPandas()
    assert len(got) == len(frame)
    for split, part in got.groupby("split"):
        train = frame[frame["pos"] % 4 != split]
        share = train.groupby("g").apply(lambda t: np.average(t["bin"], weights=t["w"]), include_groups=False)
        assert np.allclose(part["prob1"], part["g"].map(share), atol=1e-8)
        assert (part["pred"] == (part["prob1"] > 0.5)).all()


def test_cells_are_optimal_and_equal_mllib(members, frame):
    candidates = {"one": (["a"], 0.01), "all": (["a", "b", "c"], 0.01), "soft": (["a", "b"], 1.0)}
    cells = C.fit_cells(members, candidates, splits=range(3))
    assert len(cells) == 9 and all(c.done for c in cells)
    names = ["a", "b", "c"]
    for c in cells:
        t = frame[frame["pos"] % 4 != c.split].dropna(subset=[names[i] for i in c.columns])
        z, p, w = c.design(t[names].to_numpy()), c.probability(t[names].to_numpy()), t["w"].to_numpy()
        grad = z.T @ (w * (p - t["bin"])) / w.sum() + np.append(c.reg * c.beta[:-1], 0)
        assert np.abs(grad).max() < 1e-7
    mine = C.out_of_sample_cells(members, candidates, splits=[1], name="candidate").toPandas()
    for name, (fs, reg) in candidates.items():
        model = I.fit(members.where("split = 1 and role = 'train'"), fs, C.Logistic(reg))
        other = I.predict(model, members.where("split = 1 and role = 'test'")).toPandas().sort_values("pos")
        part = mine[mine["candidate"] == name].sort_values("pos")
        assert part["pos"].tolist() == other["pos"].tolist()
        assert np.allclose(part["prob1"], other["prob1"], atol=0.02)  # MLlib scales by weighted deviations


def test_jobs_do_not_grow_with_candidates(spark, members):
    """One job of moments and one per Newton step, however many cells there are."""
    tracker = spark.sparkContext.statusTracker()

    def jobs(candidates):
        spark.sparkContext.setJobGroup(name := f"fits-{len(candidates)}", name)
        C.fit_cells(members, candidates, splits=range(4))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(name))

    few = jobs({"a": (["a"], 0.01)})
    many = jobs({f"{f}{r}": ([f], r) for f in ("a", "b") for r in (0.01, 0.02, 0.05, 0.1)})
    assert many <= 2 * few + 4


def test_scores_by_feature_and_candidate(members):
    sfi = {r["feature"]: r["mean"] for r in I.sfi(members, ["a", "b", "c"], I.logistic(), splits=range(4)).collect()}
    assert sfi["c"] < min(sfi["a"], sfi["b"])
    found = I.search(members, ["a", "b"], {"x": I.logistic(reg=0.01), "y": I.logistic(reg=100.0)}, splits=range(4)).collect()
    assert [r["candidate"] for r in found] == ["x", "y"]

"""Returns of a position as rows or as one array."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tapeloom.operators import cv as V


def test_rows_and_arrays_agree(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2, 30, 3)) + 0.1
    rows = [(n, p, [float(v) for v in x[i, p]]) for i, n in enumerate("az") for p in range(30)]
    wide = spark.createDataFrame(rows, "instrument string, pos long, rets array<double>")
    tall = wide.select("instrument", "pos", F.posexplode("rets").alias("path", "ret")).withColumn("path", F.col("path") + 1)
    for df in (wide, tall):
        got = {r["instrument"]: r for r in V.path_variance(df, n_path=3).collect()}
        for i, n in enumerate("az"):
            sharpe = x[i].mean(0) / x[i].std(0, ddof=1)
            c = np.corrcoef(x[i].T)
            rho = (c[0, 1] + c[0, 2] + c[1, 2]) / 3
            assert math.isclose(got[n]["sigma2"], sharpe.var(ddof=1), rel_tol=1e-9)
            assert math.isclose(got[n]["mean_sharpe"], sharpe.mean(), rel_tol=1e-9)
            assert math.isclose(got[n]["rho_bar"], rho, rel_tol=1e-9)
            assert math.isclose(got[n]["var_of_mean"], sharpe.var(ddof=1) / 3 * (1 + 2 * rho), rel_tol=1e-9)

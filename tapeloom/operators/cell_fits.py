"""Logistic regressions of many cells at once: every (split, candidate) of a cross-validation in one scan per Newton step.

A candidate is a set of features with a ridge strength. A task turns its training rows into gradient and Hessian of each cell; these are
added up by Spark, and the driver solves one small system per cell. The number of jobs depends on the Newton steps only, not on
splits, features or candidates. Features are standardised inside the cell's training rows, the intercept is free, and rows with a
null among a candidate's features take no part in it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEPS, TOLERANCE = 30, 1e-9


@dataclass(frozen=True)
class Logistic:
    """Ridge logistic regression; called, it gives MLlib's estimator with the same objective."""

    reg: float = 0.01

    def __call__(self) -> LogisticRegression:
        return LogisticRegression(featuresCol="features", labelCol="label", weightCol="w", regParam=self.reg, maxIter=25)


@dataclass
class Cell:
    """One fit: columns of its features, ridge, centre and scale of the features, and coefficients (intercept last)."""

    split: int
    candidate: str
    columns: list[int]
    reg: float
    centre: np.ndarray
    scale: np.ndarray
    beta: np.ndarray = field(default_factory=lambda: np.empty(0))
    loss: float = np.inf
    step: np.ndarray | None = None
    done: bool = False

    def design(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, self.columns] - self.centre) / self.scale
        return np.column_stack((z, np.ones(len(z))))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.beta, -700, 700)))


def _cells(train: DataFrame, candidates: dict[str, tuple[Sequence[str], float]], features: list[str]) -> list[Cell]:
    """Cells with the moments of their features, from one pass of aggregates."""
    sets = sorted({tuple(f) for f, _ in candidates.values()})
    stats = []
    for i, fs in enumerate(sets):
        whole = F.lit(True)
        for f in fs:
            whole = whole & F.col(f).isNotNull()
        stats += [F.avg(F.when(whole, F.col(f))).alias(f"m{i}_{j}") for j, f in enumerate(fs)]
        stats += [F.stddev_samp(F.when(whole, F.col(f))).alias(f"s{i}_{j}") for j, f in enumerate(fs)]
    out = []
    for row in train.groupBy("split").agg(*stats).orderBy("split").collect():  # one row per split
        for name, (fs, reg) in candidates.items():
            i = sets.index(tuple(fs))
            centre = np.array([row[f"m{i}_{j}"] or 0.0 for j in range(len(fs))])
            scale = np.array([row[f"s{i}_{j}"] or 1.0 for j in range(len(fs))])
            out.append(Cell(row["split"], name, [features.index(f) for f in fs], reg, centre, scale, np.zeros(len(fs) + 1)))
    return out


def _sums(train: DataFrame, cells: list[Cell], features: list[str]) -> dict[int, tuple[float, float, np.ndarray, np.ndarray]]:
    """Weight, loss, gradient and Hessian of each open cell at its coefficients."""
    schema = "cell int, weight double, loss double, grad array<double>, hess array<double>"

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, list] = {}
        for frame in frames:
            for split, rows in frame.groupby("split"):
                x, y, w = rows[features].to_numpy(float), rows["bin"].to_numpy(float), rows["w"].to_numpy(float)
                for i, c in enumerate(cells):
                    if c.done or c.split != split:
                        continue
                    whole = ~np.isnan(x[:, c.columns]).any(axis=1)
                    z, yy, ww = c.design(x[whole]), y[whole], w[whole]
                    eta = z @ c.beta
                    p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                    new = [ww.sum(), float((ww * (np.logaddexp(0, eta) - yy * eta)).sum()), z.T @ (ww * (p - yy)), (z * (ww * p * (1 - p))[:, None]).T @ z]
                    total[i] = [a + b for a, b in zip(total[i], new, strict=True)] if i in total else new
        yield pd.DataFrame([(i, w, v, g.tolist(), h.ravel().tolist()) for i, (w, v, g, h) in total.items()], columns=["cell", "weight", "loss", "grad", "hess"])

    parts = train.select("split", "bin", "w", *features).mapInPandas(gather, schema)
    long = parts.select("cell", "weight", "loss", F.posexplode(F.concat("grad", "hess")).alias("at", "v"))
    added = long.groupBy("cell", "at").agg(F.sum("v").alias("v"), F.sum("weight").alias("weight"), F.sum("loss").alias("loss"))
    out = {}
    for i, part in added.toPandas().groupby("cell"):  # cells x (features + features squared) numbers
        v, k = part.sort_values("at")["v"].to_numpy(), len(cells[i].beta)
        out[i] = (part["weight"].iat[0], part["loss"].iat[0], v[:k], v[k:].reshape(k, k))
    return out


def fit_cells(members: DataFrame, candidates: dict[str, tuple[Sequence[str], float]], *, splits: Sequence[int]) -> list[Cell]:
    """Newton steps for all cells together; a step that raises a cell's loss is halved."""
    features = sorted({f for fs, _ in candidates.values() for f in fs})
    kept = [F.col(f).cast("double").alias(f) for f in features]
    train = members.where((F.col("role") == "train") & F.col("split").isin(list(splits))).select("split", F.col("bin").cast("double").alias("bin"), F.col("w").cast("double").alias("w"), *kept)
    cells = _cells(train, candidates, features)
    for _ in range(STEPS):
        if all(c.done for c in cells):
            break
        sums = _sums(train, cells, features)
        for i, c in enumerate(cells):
            if c.done or i not in sums:
                c.done = True
                continue
            weight, loss, grad, hess = sums[i]
            ridge = np.append(np.full(len(c.beta) - 1, c.reg), 0.0)
            loss = loss / weight + float((ridge * c.beta**2).sum()) / 2
            if loss > c.loss + 1e-12 and np.abs(c.step).max() > TOLERANCE:
                c.step = c.step / 2
                c.beta = c.beta - c.step
                continue
            move = -np.linalg.lstsq(hess / weight + np.diag(ridge) + 1e-12 * np.eye(len(c.beta)), grad / weight + ridge * c.beta, rcond=None)[0]
            c.loss, c.step = loss, move
            c.beta = c.beta + move
            c.done = bool(np.abs(move).max() < TOLERANCE)
    return cells


def predict_cells(rows: DataFrame, cells: list[Cell], features: list[str], *, name: str | None = None) -> DataFrame:
    """Adds prob1, prob and pred of every cell of a row's split; ``name`` is the column that takes the candidate."""
    extra = [T.StructField("prob1", T.DoubleType()), T.StructField("prob", T.DoubleType()), T.StructField("pred", T.IntegerType())]
    extra += [T.StructField(name, T.StringType())] if name else []
    rows = rows.drop(*(f.name for f in extra))
    schema, columns = T.StructType([*rows.schema.fields, *extra]), [*rows.columns, *(f.name for f in extra)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for split, part in frame.groupby("split"):
                x = part[features].astype(float).to_numpy()
                for c in cells:
                    if c.split == split:
                        whole = ~np.isnan(x[:, c.columns]).any(axis=1)
                        p = c.probability(x[whole])
                        out = part[whole].assign(prob1=p, prob=np.maximum(p, 1 - p), pred=(p > 0.5).astype("int32"))
                        yield (out.assign(**{name: c.candidate}) if name else out)[columns]

    return rows.mapInPandas(run, schema)


def out_of_sample_cells(members: DataFrame, candidates: dict[str, tuple[Sequence[str], float]], *, splits: Sequence[int], name: str | None = None) -> DataFrame:
    """Every test row predicted by each candidate's model of its split."""
    features = sorted({f for fs, _ in candidates.values() for f in fs})
    test = members.where((F.col("role") == "test") & F.col("split").isin(list(splits)))
    return predict_cells(test.withColumn("label", F.col("bin").cast("double")), fit_cells(members, candidates, splits=splits), features, name=name)

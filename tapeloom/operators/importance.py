"""Cross-validated models, feature importance and tuning over purged membership.

Forests (one distributed MLlib job per split) and logistic regressions (all splits, features and parameter points in one scan per
Newton step, ``cell_fits``) take the place of kernel machines, with the same contract (weights in fit and score, scaling inside
the fold).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.cell_fits import Logistic, out_of_sample_cells
from tapeloom.operators.cv import path_assignment, weighted_scores
from tapeloom.operators.portfolio import covariance
from tapeloom.plans.series import KEYS, position, reuse

Factory = Callable[[], object]


def forest(*, trees: int = 20, depth: int = 5, seed: int = 7) -> Factory:
    return lambda: RandomForestClassifier(
        featuresCol="features", labelCol="label", weightCol="w", numTrees=trees, maxDepth=depth,
        featureSubsetStrategy="1", impurity="entropy", seed=seed,
    )


def logistic(*, reg: float = 0.01) -> Factory:
    return Logistic(reg)


def fit(train: DataFrame, features: Sequence[str], factory: Factory):
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="skip"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
        factory(),
    ]
    return Pipeline(stages=stages).fit(train.withColumn("label", F.col("bin").cast("double")))


def predict(model, rows: DataFrame) -> DataFrame:
    """Adds class-1 probability, largest probability and predicted class."""
    out = model.transform(rows.withColumn("label", F.col("bin").cast("double")))
    p = vector_to_array("probability")
    return out.withColumns(
        {"prob1": p[1], "prob": F.array_max(p), "pred": F.col("prediction").cast("int")}
    ).drop("_raw", "features", "rawPrediction", "probability", "prediction")


def _split(members: DataFrame, s: int, role: str) -> DataFrame:
    return members.where((F.col("split") == s) & (F.col("role") == role))


def out_of_sample(members: DataFrame, features: Sequence[str], factory: Factory, *, splits: Sequence[int]) -> DataFrame:
    """Every test row predicted by a model that never saw its fold."""
    if isinstance(factory, Logistic):
        return out_of_sample_cells(members, {"": (list(features), factory.reg)}, splits=splits)
    parts = None
    for s in splits:
        model = fit(_split(members, s, "train"), features, factory)
        part = predict(model, _split(members, s, "test"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def cv_score(members: DataFrame, features: Sequence[str], factory: Factory, *, splits: Sequence[int]) -> DataFrame:
    """Weighted scores per split."""
    return weighted_scores(out_of_sample(members, features, factory, splits=splits), ["split"], prob="prob1")


def cpcv_paths(members: DataFrame, features: Sequence[str], factory: Factory, *, n_groups: int, k: int) -> DataFrame:
    """Combinatorial predictions routed to their backtest path."""
    n = math.comb(n_groups, k)
    oos = out_of_sample(members, features, factory, splits=range(n))
    return oos.join(path_assignment(members.sparkSession, n_groups=n_groups, k=k), ["split", "grp"])


# --------------------------------------------------------------------------- importance
def mdi(table: DataFrame, features: Sequence[str], factory: Factory) -> DataFrame:
    """Mean decrease of impurity: per-tree importances, zeros as missing, normalised."""
    model = fit(table, features, factory).stages[-1]
    rows = [
        (f, float(v)) for tree in model.trees for f, v in zip(features, tree.featureImportances.toArray()) if v != 0
    ]
    per_tree = table.sparkSession.createDataFrame(rows, "feature string, v double")
    n = len(model.trees)
    agg = per_tree.groupBy("feature").agg(F.avg("v").alias("m"), (F.stddev_samp("v") / math.sqrt(n)).alias("s"))
    total = agg.agg(F.sum("m").alias("t")).first()["t"]
    return agg.select("feature", (F.col("m") / total).alias("mean"), (F.col("s") / total).alias("std"))


def mda(
    members: DataFrame, features: Sequence[str], factory: Factory, *, splits: Sequence[int], scoring: str = "neg_log_loss", seed: int = 7
) -> DataFrame:
    """Score lost when one feature is shuffled inside the test fold.

    All features are shuffled in one pass: rows are numbered, each (feature, row) value gets a second
    number by a seeded hash, and the two numberings are joined.
    """
    parts = None
    for s in splits:
        model = fit(_split(members, s, "train"), features, factory)
        test = position(
            _split(members, s, "test").select("split", *KEYS, "pos", "bin", "w", *features).dropna(), [*KEYS, "pos"], keys=["split"], name="_i"
        )
        cells = test.select(
            "split", "_i",
            F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("_c"),
        ).select("split", "_i", "_c.*")
        shuffled = position(
            cells.withColumn("_h", F.xxhash64("feature", "_i", F.lit(seed))), ["_h", "_i"], keys=["split", "feature"], name="_j"
        ).select("split", "feature", F.col("_j").alias("_i"), F.col("value").alias("_v"))
        moved = test.join(shuffled, ["split", "_i"]).withColumns(
            {f: F.when(F.col("feature") == f, F.col("_v")).otherwise(F.col(f)) for f in features}
        )
        both = predict(model, test.withColumn("feature", F.lit("")).unionByName(moved.drop("_v")))
        part = weighted_scores(both, ["split", "feature"], prob="prob1")
        parts = part if parts is None else parts.unionByName(part)
    scores = reuse(parts)
    base = scores.where(F.col("feature") == "").select("split", F.col(scoring).alias("_s0"))
    lost = scores.where(F.col("feature") != "").join(base, "split")
    room = -F.col(scoring) if scoring == "neg_log_loss" else 1 - F.col(scoring)
    imp = (F.col("_s0") - F.col(scoring)) / F.nullif(room, F.lit(0.0))
    return lost.groupBy("feature").agg(
        F.avg(imp).alias("mean"), (F.stddev_samp(imp) / F.sqrt(F.count(F.lit(1)))).alias("std"), F.avg("_s0").alias("oos_score")
    )


def sfi(members: DataFrame, features: Sequence[str], factory: Factory, *, splits: Sequence[int], scoring: str = "neg_log_loss") -> DataFrame:
    """Cross-validated score of each feature on its own."""
    spread = F.avg(scoring).alias("mean"), (F.stddev_samp(scoring) / F.sqrt(F.count(F.lit(1)))).alias("std")
    if isinstance(factory, Logistic):
        oos = out_of_sample_cells(members, {f: ([f], factory.reg) for f in features}, splits=splits, name="feature")
        return weighted_scores(oos, ["feature", "split"], prob="prob1").groupBy("feature").agg(*spread)
    parts = None
    for f in features:
        part = cv_score(members, [f], factory, splits=splits).agg(F.lit(f).alias("feature"), *spread)
        parts = part if parts is None else parts.unionByName(part)
    return parts


def importance(method: str, table: DataFrame, members: DataFrame, features: Sequence[str], factory: Factory, *, splits: Sequence[int]) -> DataFrame:
    """Importance by ``MDI``, ``MDA`` or ``SFI`` with out-of-bag (null: not offered by MLlib) and
    out-of-sample scores."""
    if method == "MDI":
        imp = mdi(table, features, factory)
        oos = cv_score(members, features, factory, splits=splits).agg(F.avg("neg_log_loss").alias("oos_score"))
        imp = imp.withColumn("_k", F.lit(1)).join(oos.withColumn("_k", F.lit(1)), "_k").drop("_k")
    elif method == "MDA":
        imp = mda(members, features, factory, splits=splits)
    elif method == "SFI":
        imp = sfi(members, features, factory, splits=splits).withColumn("oos_score", F.lit(None).cast("double"))
    else:
        raise ValueError(f"unknown importance method {method}")
    return imp.select(F.lit(method).alias("method"), "feature", "mean", "std", F.lit(None).cast("double").alias("oob_score"), "oos_score")


def orthogonal_features(table: DataFrame, features: Sequence[str], *, variance: float = 0.95) -> DataFrame:
    """Standardised features projected on the components that explain ``variance``.

    Only the feature correlation matrix (features squared) reaches the driver.
    """
    features = sorted(features)
    stats = table.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_samp(f).alias(f"s_{f}") for f in features]).first()
    cells = covariance(table.withColumn("_g", F.lit(0)), features, by=["_g"]).collect()
    rho = np.array([[0.0] * len(features) for _ in features])
    at = {f: i for i, f in enumerate(features)}
    for c in cells:
        rho[at[c["a"]], at[c["b"]]] = c["corr"]
    val, vec = np.linalg.eigh(rho)
    val, vec = val[::-1], vec[:, ::-1]
    keep = int(np.searchsorted(np.cumsum(val) / val.sum(), variance)) + 1
    z = {f: (F.col(f) - stats[f"m_{f}"]) / stats[f"s_{f}"] for f in features}
    out = {}
    for c in range(min(keep, len(features))):
        v = vec[:, c] * (1 if vec[np.argmax(np.abs(vec[:, c])), c] > 0 else -1)
        total = F.lit(0.0)
        for f, x in zip(features, v):
            total = total + z[f] * F.lit(float(x))
        out[f"PC_{c + 1}"] = total
    return table.withColumns(out)


def weighted_tau(ranked: DataFrame, *, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Kendall correlation with hyperbolic weights, averaged over the two importance orders.

    ``ranked`` holds one row per feature; each group's features form one small array.
    """
    item = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    groups = ranked.groupBy(*by).agg(F.collect_list(item).alias("_f"))

    def one(first: str, second: str):
        ordered = F.reverse(F.array_sort(F.transform("_f", lambda f: F.struct(f[first].alias("a"), f[second].alias("b")))))
        numbered = F.transform(ordered, lambda f, i: F.struct(f["a"].alias("a"), f["b"].alias("b"), (1.0 / (i + 1)).alias("w"), i.alias("i")))

        def total(value):
            return F.aggregate(
                numbered, F.lit(0.0),
                lambda s, p: s + F.aggregate(numbered, F.lit(0.0), lambda t, q: t + F.when(q["i"] > p["i"], (p["w"] + q["w"]) * value(p, q)).otherwise(0.0)),
            )

        sx = lambda p, q: F.signum(p["a"] - q["a"])
        sy = lambda p, q: F.signum(p["b"] - q["b"])
        return total(lambda p, q: sx(p, q) * sy(p, q)) / F.nullif(
            F.sqrt(total(lambda p, q: sx(p, q) * sx(p, q)) * total(lambda p, q: sy(p, q) * sy(p, q))), F.lit(0.0)
        )

    return groups.select(*by, ((one("x", "y") + one("y", "x")) / 2).alias("tau"))


def by_prefix(imp: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Total and mean importance per feature-name group (first letter)."""
    return imp.groupBy(*by, F.substring("feature", 1, 1).alias("family")).agg(F.sum("mean").alias("total"), F.avg("mean").alias("average"))


# --------------------------------------------------------------------------- tuning
def log_uniform(lo: float, hi: float, n: int, *, seed: int = 7) -> list[float]:
    """Draws whose logarithm is uniform on [log lo, log hi]."""
    u = np.random.default_rng(seed).uniform(size=n)
    return [float(lo * (hi / lo) ** v) for v in u]


def search(members: DataFrame, features: Sequence[str], candidates: dict[str, Factory], *, splits: Sequence[int], binary: bool = True) -> DataFrame:
    """Mean score per candidate over purged splits, best first; F1 for 0/1 labels else log loss."""
    members = reuse(members)
    score = "f1" if binary else "neg_log_loss"
    told = F.avg(F.coalesce(score, F.lit(0.0))).alias("score"), F.stddev_samp(score).alias("spread")
    linear = {name: (list(features), f.reg) for name, f in candidates.items() if isinstance(f, Logistic)}
    parts = None
    if linear:
        oos = out_of_sample_cells(members, linear, splits=splits, name="candidate")
        parts = weighted_scores(oos, ["candidate", "split"], prob="prob1").groupBy("candidate").agg(*told)
    for name, factory in candidates.items():
        if name not in linear:
            part = cv_score(members, features, factory, splits=splits).agg(F.lit(name).alias("candidate"), *told)
            parts = part if parts is None else parts.unionByName(part)
    return parts.orderBy(F.col("score").desc(), "candidate")


def refit_best(table: DataFrame, features: Sequence[str], candidates: dict[str, Factory], results: DataFrame, *, bags: int = 0, seed: int = 7) -> list:
    """Winner refitted on all rows; with ``bags`` also on that many weighted resamples of them."""
    best = candidates[results.first()["candidate"]]
    models = [fit(table, features, best)]
    models += [fit(table.sample(withReplacement=True, fraction=1.0, seed=seed + i), features, best) for i in range(bags)]
    return models

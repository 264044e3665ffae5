"""Purged, embargoed and combinatorial cross-validation membership over observations.

``obs`` is (instrument, pos, t0, t1[, ...]) with dense positions in t0 order.  Fold facts are one small
row per (instrument, fold); each observation carries its instrument's fold array and decides its own
role, so nothing is collected and no observation pairs are formed.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.operators.labels import us
from tapeloom.plans.series import KEYS, asof, div


def _facts(obs: DataFrame, fold: Column) -> DataFrame:
    """Per fold: position range, first start, and position of the first start not before its last end."""
    tagged = obs.withColumn("fold", fold)
    facts = tagged.groupBy(*KEYS, "fold").agg(
        F.min("pos").alias("lo"), (F.max("pos") + 1).alias("hi"), F.min("t0").alias("first_t0"), F.max("t1").alias("last_t1")
    )
    starts = obs.groupBy(*KEYS, "t0").agg(F.min("pos").alias("pos"))
    after = asof(facts, starts, {"next_pos": "pos"}, left_on=us("last_t1"), right_on=us("t0"), forward=True)
    open_ended = facts.where(F.col("last_t1").isNull()).withColumn("next_pos", F.lit(None).cast("long"))
    n = obs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_obs"))
    return after.unionByName(open_ended).join(n, list(KEYS))


def _fold_arrays(facts: DataFrame) -> DataFrame:
    item = F.struct("fold", "lo", "hi", "first_t0", "next_pos", "n_obs")
    return facts.groupBy(*KEYS).agg(F.array_sort(F.collect_list(item)).alias("_folds"))


def _safe(f, pct_embargo: float) -> Column:
    """Training row clear of fold ``f``: its label ended before, or it starts after the embargo."""
    gap = F.floor(f["n_obs"] * F.lit(float(pct_embargo))).cast("long")
    return F.coalesce(F.col("t1") <= f["first_t0"], F.lit(False)) | F.coalesce(F.col("pos") >= f["next_pos"] + gap, F.lit(False))


def even_fold(n_obs: Column, pos: Column, k: int) -> Column:
    """Fold of a position when the first ``n mod k`` of ``k`` folds are one longer."""
    base = F.floor(n_obs / k).cast("long")
    extra = n_obs % k
    cut = extra * (base + 1)
    return F.when(pos < cut, F.floor(pos / (base + 1))).otherwise(extra + F.floor(div(pos - cut, base))).cast("int")


def purged_kfold(obs: DataFrame, *, n_splits: int, pct_embargo: float = 0.0) -> DataFrame:
    """Long membership (instrument, split, pos, role)."""
    n = obs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"))
    sized = obs.join(n, list(KEYS))
    folded = sized.withColumn("_fold", even_fold(F.col("_n"), F.col("pos"), n_splits))
    folds = _fold_arrays(_facts(folded.drop("_n"), F.col("_fold")))
    inside = lambda f: (F.col("pos") >= f["lo"]) & (F.col("pos") < f["hi"])
    role = lambda f: F.when(inside(f), "test").when(_safe(f, pct_embargo), "train")
    roles = F.transform("_folds", lambda f: F.struct(f["fold"].alias("split"), role(f).alias("role")))
    return (
        obs.join(folds, list(KEYS))
        .withColumn("_r", F.explode(roles))
        .select(*[c for c in obs.columns], F.col("_r.split").alias("split"), F.col("_r.role").alias("role"))
        .where(F.col("role").isNotNull())
    )


def fold_report(members: DataFrame, *, weight: str = "w") -> DataFrame:
    train = F.col("role") == "train"
    return members.groupBy(*KEYS, "split").agg(
        F.sum(train.cast("long")).alias("n_train"),
        F.sum((~train).cast("long")).alias("n_test"),
        F.sum(F.when(train, F.col(weight)).otherwise(0.0)).alias("train_weight"),
    )


# --------------------------------------------------------------------------- combinatorial
def group_of(n_obs: Column, pos: Column, n_groups: int) -> Column:
    """Group of a position when the last of ``n_groups`` groups takes the remainder."""
    base = F.floor(n_obs / n_groups).cast("long")
    return F.least(F.coalesce(F.floor(div(pos, base)), F.lit(n_groups - 1)), F.lit(n_groups - 1)).cast("int")


def with_groups(obs: DataFrame, *, n_groups: int) -> DataFrame:
    if n_groups < 2:
        raise ValueError("need at least two groups")
    n = obs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"))
    return obs.join(n, list(KEYS)).withColumn("grp", group_of(F.col("_n"), F.col("pos"), n_groups)).drop("_n")


def enumerate_splits(n_groups: int, k: int) -> list[tuple[int, ...]]:
    if not 1 <= k <= n_groups - 1:
        raise ValueError("k must lie in 1 .. n_groups - 1")
    return list(combinations(range(n_groups), k))


def n_paths(n_groups: int, k: int) -> int:
    return k * math.comb(n_groups, k) // n_groups


def path_assignment(spark: SparkSession, *, n_groups: int, k: int) -> DataFrame:
    """(split, grp, path): the m-th split that tests a group belongs to path m (1-based)."""
    rows = [(i, g) for i, groups in enumerate(enumerate_splits(n_groups, k)) for g in groups]
    table = spark.createDataFrame(rows, "split int, grp int")
    return table.withColumn("path", F.row_number().over(Window.partitionBy("grp").orderBy("split")))


def cpcv_membership(obs: DataFrame, *, n_groups: int, k: int, pct_embargo: float = 0.0) -> DataFrame:
    """Long membership (instrument, split, pos, grp, role); train rows are clear of every test group."""
    grouped = with_groups(obs, n_groups=n_groups)
    folds = _fold_arrays(_facts(grouped, F.col("grp")))
    splits = F.array(
        *[
            F.struct(F.lit(i).alias("split"), F.array(*[F.lit(g) for g in groups]).alias("test"))
            for i, groups in enumerate(enumerate_splits(n_groups, k))
        ]
    )
    safe = F.transform("_folds", lambda f: F.struct(f["fold"].alias("g"), _safe(f, pct_embargo).alias("ok")))
    clear = F.transform(F.filter("_safe", lambda s: s["ok"]), lambda s: s["g"])
    return (
        grouped.join(folds, list(KEYS))
        .withColumn("_safe", safe)
        .withColumn("_clear", clear)
        .drop("_folds", "_safe")
        .withColumn("_s", F.explode(splits))
        .withColumn("split", F.col("_s.split"))
        .withColumn(
            "role",
            F.when(F.array_contains(F.col("_s.test"), F.col("grp")), "test").when(
                F.size(F.array_except(F.col("_s.test"), F.col("_clear"))) == 0, "train"
            ),
        )
        .where(F.col("role").isNotNull())
        .drop("_s", "_clear")
    )


def path_variance(path_returns: DataFrame, *, n_path: int) -> DataFrame:
    """Variance of the mean Sharpe over paths from their average correlation.

    ``path_returns`` is (instrument, pos, path, ret), or (instrument, pos, rets) with the returns of paths 1 .. ``n_path`` of a
    position as one array, which needs no grouping by position. Paths are few, so all facts come from one aggregation.
    """
    paths = range(1, n_path + 1)
    if "rets" in path_returns.columns:
        wide = path_returns.select(*KEYS, *[F.col("rets")[i - 1].alias(f"_p{i}") for i in paths])
    else:
        wide = path_returns.groupBy(*KEYS, "pos").agg(*[F.max(F.when(F.col("path") == i, F.col("ret"))).alias(f"_p{i}") for i in paths])
    pairs = [(i, j) for i in paths for j in range(i + 1, n_path + 1)]
    facts = wide.groupBy(*KEYS).agg(
        F.array(*[F.avg(f"_p{i}") / F.nullif(F.stddev_samp(f"_p{i}"), F.lit(0.0)) for i in paths]).alias("_s"),
        (sum((F.corr(f"_p{i}", f"_p{j}") for i, j in pairs), F.lit(0.0)) / F.lit(float(max(len(pairs), 1)))).alias("rho_bar"),
    )
    sharpe = facts.select(*KEYS, F.explode("_s").alias("sharpe"))
    spread = sharpe.groupBy(*KEYS).agg(F.var_samp("sharpe").alias("sigma2"), F.avg("sharpe").alias("mean_sharpe"))
    var = F.col("sigma2") / n_path * (1 + (n_path - 1) * F.col("rho_bar"))
    return spread.join(facts.select(*KEYS, "rho_bar"), list(KEYS)).withColumn("var_of_mean", var)


# --------------------------------------------------------------------------- weighted metrics
def weighted_scores(
    df: DataFrame, by: list[str], *, label: str = "label", pred: str = "pred", prob: str = "prob", weight: str = "w", eps: float = 1e-15
) -> DataFrame:
    """Weighted accuracy, negative log loss and F1 of 0/1 labels (``prob`` of class 1)."""
    y, p, w = F.col(label), F.col(pred), F.col(weight)
    q = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1 - eps))
    ll = F.when(y == 1, F.log(q)).otherwise(F.log(1 - q))

    def mass(cond: Column) -> Column:
        return F.sum(F.when(cond, w).otherwise(0.0))

    tp2 = 2 * mass((y == 1) & (p == 1))
    return df.groupBy(*by).agg(
        div(mass(y == p), F.sum(w)).alias("accuracy"),
        div(F.sum(w * ll), F.sum(w)).alias("neg_log_loss"),
        div(tp2, tp2 + mass(y != p)).alias("f1"),
    )


def search_score(scores: DataFrame, *, binary: bool) -> DataFrame:
    """Tuning score: F1 for 0/1 labels, negative log loss otherwise."""
    return scores.withColumn("score", F.col("f1") if binary else F.col("neg_log_loss"))

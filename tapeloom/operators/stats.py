"""Backtest statistics and overfitting evidence over long trial tables ``(study, trial, pos, pnl)``."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.gaussian import with_norm_cdf, with_norm_ppf
from tapeloom.plans.series import KEYS, affine_scan, div, lagged, position, running

EULER = 0.5772156649015329
YEAR_DAYS = 365.2425
DAY_US = 86_400_000_000.0
Metric = Callable[[Column, Column, Column], Column]


def sharpe_metric(n: Column, s: Column, ss: Column) -> Column:
    """Mean over sample deviation from counts, sums and sums of squares; null when there is no spread."""
    var = div(ss - div(s * s, n), (n - 1).cast("double"))
    return F.when(var > 1e-18, div(s, n) / F.sqrt(var))


def sharpe_by(df: DataFrame, by: Sequence[str], *, x: str = "pnl") -> DataFrame:
    sd = F.stddev_samp(x)
    return df.groupBy(*by).agg(F.when(sd > 0, F.avg(x) / sd).alias("sharpe"))


# --------------------------------------------------------------------------- combinatorial symmetric cross-validation
def block_statistics(trials: DataFrame, *, blocks: int) -> DataFrame:
    """One row per (study, trial) with counts, sums and sums of squares of its ``blocks`` row blocks."""
    size = trials.groupBy("study").agg((F.max("pos") + 1).alias("_t"))
    base = F.floor(F.col("_t") / blocks).cast("long")
    extra = F.col("_t") % blocks
    cut = extra * (base + 1)
    blk = F.when(F.col("pos") < cut, F.floor(F.col("pos") / (base + 1))).otherwise(
        extra + F.floor(div(F.col("pos") - cut, base))
    )
    cells = (
        trials.join(size, "study")
        .groupBy("study", "trial", blk.cast("int").alias("blk"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("s"), F.sum(F.col("pnl") * F.col("pnl")).alias("ss"))
    )
    return cells.groupBy("study", "trial").agg(F.array_sort(F.collect_list(F.struct("blk", "n", "s", "ss"))).alias("b"))


def cscv(trials: DataFrame, *, blocks: int = 8, metric: Metric = sharpe_metric) -> DataFrame:
    """Per half-split of the blocks: best in-sample trial and its out-of-sample relative rank.

    The tape is read once into block statistics; the C(S, S/2) splits only touch those.  ``combo`` is
    the bit mask of the in-sample blocks.
    """
    if blocks % 2 or blocks < 2:
        raise ValueError("blocks must be even")
    stats = block_statistics(trials, blocks=blocks)
    masks = [m for m in range(1 << blocks) if m.bit_count() == blocks // 2]
    spread = stats.withColumn("combo", F.explode(F.lit(masks)))

    def total(field: str, inside: bool) -> Column:
        want = F.lit(1 if inside else 0)
        member = F.filter("b", lambda x: F.getbit(F.col("combo"), x["blk"]) == want)
        return F.aggregate(member, F.lit(0.0), lambda acc, x: acc + x[field].cast("double"))

    scored = spread.select(
        "study", "trial", "combo",
        metric(total("n", True), total("s", True), total("ss", True)).alias("r_is"),
        metric(total("n", False), total("s", False), total("ss", False)).alias("r_oos"),
    )
    cell = Window.partitionBy("study", "combo")
    ranked = scored.withColumns(
        {
            "_n": F.count(F.lit(1)).over(cell),
            "_rank": F.rank().over(Window.partitionBy("study", "combo", F.col("r_oos").isNull()).orderBy("r_oos"))
            + (F.count(F.lit(1)).over(Window.partitionBy("study", "combo", "r_oos")) - 1) / 2.0,
            "_best": F.row_number().over(cell.orderBy(F.col("r_is").desc_nulls_last(), "trial")),
        }
    ).where((F.col("_best") == 1) & F.col("r_is").isNotNull())
    rank = F.when(F.col("r_oos").isNotNull(), F.col("_rank"))
    w = rank / (F.col("_n") + 1.0)
    return ranked.select(
        "study", "combo", F.col("trial").alias("n_star"), "r_is", "r_oos", rank.alias("rank_oos"), w.alias("w_bar"),
        F.log(w / (1 - w)).alias("logit"),
    )


def pbo(splits: DataFrame) -> DataFrame:
    """Probability of backtest overfitting: share of splits with a negative logit."""
    return splits.groupBy("study").agg(
        F.avg((F.coalesce("logit", F.lit(0.0)) < 0).cast("double")).alias("pbo"), F.count(F.lit(1)).alias("n_combos")
    )


# --------------------------------------------------------------------------- probabilistic and deflated Sharpe
def with_psr(df: DataFrame, *, sr: str, benchmark: str, n: str, skew: str, kurt: str, out: str) -> DataFrame:
    s = F.col(sr)
    spread = F.sqrt(1 - F.col(skew) * s + (F.col(kurt) - 1) / 4 * s * s)
    z = div((s - F.col(benchmark)) * F.sqrt(F.col(n) - 1), spread)
    return with_norm_cdf(df.withColumn("_z", z), "_z", out).drop("_z")


def with_expected_max_sharpe(df: DataFrame, *, var: str, n_trials: str, out: str) -> DataFrame:
    df = df.withColumns({"_p1": 1 - 1.0 / F.col(n_trials), "_p2": 1 - 1.0 / (F.col(n_trials) * math.e)})
    df = with_norm_ppf(with_norm_ppf(df, "_p1", "_z1"), "_p2", "_z2")
    value = F.sqrt(var) * ((1 - EULER) * F.col("_z1") + EULER * F.col("_z2"))
    return df.withColumn(out, value).drop("_p1", "_p2", "_z1", "_z2")


def with_dsr(df: DataFrame, *, sr: str, var: str, n_trials: str, n: str, skew: str, kurt: str, out: str = "dsr") -> DataFrame:
    df = with_expected_max_sharpe(df, var=var, n_trials=n_trials, out="sr_star")
    return with_psr(df, sr=sr, benchmark="sr_star", n=n, skew=skew, kurt=kurt, out=out)


def corrected_moments(x: Column) -> tuple[Column, Column]:
    """Bias-corrected skewness and (non-excess) kurtosis aggregates; (0, 3) for two rows or fewer."""
    n = F.count(x).cast("double")
    skew = F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    excess = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(x) + 6)
    return F.when(n > 2, skew).otherwise(0.0), F.when(n > 2, excess + 3).otherwise(3.0)


def strategy_moments(returns: DataFrame, by: Sequence[str], *, x: str = "ret") -> DataFrame:
    """Count, Sharpe, skewness and kurtosis of the non-zero bets."""
    bets = returns.where(F.col(x) != 0)
    skew, kurt = corrected_moments(F.col(x))
    sd = F.stddev_samp(x)
    return bets.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_bets"), F.when(sd > 0, F.avg(x) / sd).alias("sharpe"), skew.alias("skew"), kurt.alias("kurt")
    )


def evaluate_overfitting(trials: DataFrame, uniqueness: DataFrame, *, blocks: int = 12) -> DataFrame:
    """One evidence row per study: best trial, PBO, effective sample size and deflated Sharpe.

    ``uniqueness`` is (study, tw); a missing or null value is an error.
    """
    per_trial = sharpe_by(trials, ["study", "trial"])
    best = per_trial.groupBy("study").agg(
        F.min_by("trial", F.when(F.col("sharpe").isNotNull(), F.struct(-F.col("sharpe"), "trial"))).alias("best_trial"),
        F.max("sharpe").alias("sr_hat"),
        F.count(F.lit(1)).alias("n_trials"),
        F.var_samp("sharpe").alias("var_sr_trials"),
    )
    mean_tw = uniqueness.groupBy("study").agg(
        F.when(F.count(F.when(F.col("tw").isNull(), 1)) > 0, F.raise_error(F.lit("uniqueness has nulls")))
        .otherwise(F.avg("tw"))
        .alias("tw_mean")
    )
    chosen = trials.join(best.select("study", F.col("best_trial").alias("trial")), ["study", "trial"], "left_semi")
    skew, kurt = corrected_moments(F.col("pnl"))
    moments = chosen.where(F.col("pnl") != 0).groupBy("study").agg(
        F.count(F.lit(1)).alias("t_raw"), skew.alias("skew"), kurt.alias("kurtosis")
    )
    out = best.join(moments, "study").join(mean_tw, "study").join(pbo(cscv(trials, blocks=blocks)), "study")
    out = out.withColumn("t_eff", F.col("t_raw") * F.col("tw_mean"))
    return with_dsr(out, sr="sr_hat", var="var_sr_trials", n_trials="n_trials", n="t_eff", skew="skew", kurt="kurtosis")


def path_survival(paths: DataFrame, *, level: float = 0.95) -> DataFrame:
    """Per path (sharpe, n, skew, kurt): probabilistic Sharpe against 0, deflated Sharpe, survival."""
    spread = paths.groupBy("study").agg(F.var_samp("sharpe").alias("_v"), F.count(F.lit(1)).alias("_k"))
    out = paths.join(spread, "study").withColumn("_zero", F.lit(0.0))
    out = with_psr(out, sr="sharpe", benchmark="_zero", n="n_bets", skew="skew", kurt="kurt", out="psr_vs_zero")
    out = with_dsr(out, sr="sharpe", var="_v", n_trials="_k", n="n_bets", skew="skew", kurt="kurt")
    return out.withColumn("survives_dsr", F.col("dsr") > level).drop("_v", "_k", "_zero", "sr_star")


# --------------------------------------------------------------------------- bets and holding
def bet_timing(positions: DataFrame) -> DataFrame:
    """Rows on which a bet ends: flattening, sign flip, or the last row."""
    out = lagged(positions, {"_prev": F.col("position")})
    last = positions.groupBy(*KEYS).agg(F.max("pos").alias("_last"))
    flat = (F.col("position") == 0) & (F.col("_prev").isNull() | (F.col("_prev") != 0))
    flip = F.coalesce(F.col("position") * F.col("_prev") < 0, F.lit(False))
    return out.join(last, list(KEYS)).where(flat | flip | (F.col("pos") == F.col("_last"))).drop("_prev", "_last")


def holding_period(positions: DataFrame) -> DataFrame:
    """Average holding days, weighting each reduction by its size; entries average by size."""
    start = positions.groupBy(*KEYS).agg(F.min("ts").alias("_s"))
    days = positions.join(start, list(KEYS)).select(
        *KEYS, "pos", "position", ((F.unix_micros("ts") - F.unix_micros("_s")) / F.lit(DAY_US)).alias("t")
    )
    p, q, t = F.col("position").cast("double"), F.col("_q"), F.col("t")
    flip, grow = p * q < 0, (p * q >= 0) & (F.abs(p) > F.abs(q))
    # The mean entry time is affine in itself: growth mixes in the new part, a flip starts anew, a reduction keeps it.
    keep = F.when(flip, 0.0).when(grow, div(q, p)).otherwise(1.0)
    add = F.when(flip, t).when(grow, t * div(p - q, p)).otherwise(0.0)
    moved = lagged(days, {"_q": F.col("position").cast("double")})
    first = F.col("_q").isNull()
    held = affine_scan(moved, F.when(first, 1.0).otherwise(keep), F.when(first, 0.0).otherwise(add), "_entry")
    closed = F.when(flip, F.abs(q)).when(F.abs(p) < F.abs(q), F.abs(p - q)).otherwise(0.0)
    return held.groupBy(*KEYS).agg(div(F.sum(closed * (t - F.col("_entry"))), F.sum(closed)).alias("holding_days"))


# --------------------------------------------------------------------------- concentration and drawdown
def _hhi(n: Column, s: Column, ss: Column) -> Column:
    return F.when(n > 2, (div(ss, s * s) - 1 / F.nullif(n, F.lit(0))) / F.nullif(1 - 1 / F.nullif(n, F.lit(0)), F.lit(0.0)))


def hhi_concentration(returns: DataFrame, *, by: Sequence[str] = KEYS, ts: str = "ts", x: str = "ret") -> DataFrame:
    """Concentration of gains, losses and bets per month (empty months count as zero bets)."""
    r = F.col(x)

    def part(cond: Column) -> Column:
        v = F.when(cond, r)
        return _hhi(F.count(v), F.sum(v), F.sum(v * v))

    month = F.year(ts) * 12 + F.month(ts)
    monthly = returns.groupBy(*by, month.alias("_m")).agg(F.count(x).cast("double").alias("_c"))
    months = monthly.groupBy(*by).agg(
        _hhi(F.max("_m") - F.min("_m") + 1, F.sum("_c"), F.sum(F.col("_c") * F.col("_c"))).alias("hhi_time")
    )
    signs = returns.groupBy(*by).agg(part(r >= 0).alias("hhi_positive"), part(r < 0).alias("hhi_negative"))
    return signs.join(months, list(by))


def drawdowns(pnl: DataFrame, *, dollars: bool = False, x: str = "equity") -> DataFrame:
    """Every high-water mark followed by a fall: drawdown and years until the next such mark."""
    run = running(pnl, {"hwm": ("max", F.col(x))})
    marks = run.groupBy(*KEYS, "hwm").agg(F.min(x).alias("low"), F.min("ts").alias("start")).where(F.col("hwm") > F.col("low"))
    ordered = lagged(position(marks, ["start"]), {"_next": F.col("start")}, n=-1)
    dd = F.col("hwm") - F.col("low") if dollars else 1 - F.col("low") / F.col("hwm")
    years = (F.unix_micros("_next") - F.unix_micros("start")) / F.lit(DAY_US * YEAR_DAYS)
    return ordered.select(*KEYS, "start", "hwm", "low", dd.alias("drawdown"), years.alias("tuw_years"))


# --------------------------------------------------------------------------- classification scores
def classification_scores(
    df: DataFrame, by: Sequence[str], *, label: str = "label", pred: str = "pred", prob: str = "prob", eps: float = 1e-15
) -> DataFrame:
    """Confusion counts, rates (null on 0/0) and mean log likelihood of 0/1 labels (``prob`` of class 1)."""
    y, p = F.col(label), F.col(pred)

    def count(cond: Column) -> Column:
        return F.sum(cond.cast("long"))

    q = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1 - eps))
    out = df.groupBy(*by).agg(
        count((y == 1) & (p == 1)).alias("tp"),
        count((y == 0) & (p == 0)).alias("tn"),
        count((y == 0) & (p == 1)).alias("fp"),
        count((y == 1) & (p == 0)).alias("fn"),
        F.avg(F.when(y == 1, F.log(q)).otherwise(F.log(1 - q))).alias("neg_log_loss"),
    )
    c = F.col
    return out.withColumns(
        {
            "accuracy": (c("tp") + c("tn")) / (c("tp") + c("tn") + c("fp") + c("fn")),
            "precision": div(c("tp"), c("tp") + c("fp")),
            "recall": div(c("tp"), c("tp") + c("fn")),
            "f1": F.when(c("tp") > 0, 2 * c("tp") / (2 * c("tp") + c("fp") + c("fn"))),
        }
    )

"""Fractional differentiation of ``(instrument, pos, x)`` series and its stationarity search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.gaussian import with_norm_cdf
from tapeloom.plans.series import KEYS, div, framed, lagged, map_blocks, packed, position, running, running_product


# Published response surface of the constant-only unit-root test (one series).
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
TAU_SMALL = (2.1659, 1.4412, 0.038269)
TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
CRIT_5PCT = (-2.86154, -2.8903, -4.234, -40.040)


# --------------------------------------------------------------------------- weights
def weights(d: float, size: int) -> np.ndarray:
    """Binomial-series weights by lag: w0 = 1, wk = -w(k-1) (d - k + 1) / k."""
    k = np.arange(1, size)
    return np.concatenate([[1.0], np.cumprod(-(d - k + 1) / k)])


def weight_chunks(d: float, size: int, chunk: int = 1 << 20) -> Iterator[np.ndarray]:
    """The same weights in consecutive pieces, so long series never need them all at once."""
    last = 1.0
    for lo in range(0, size, chunk):
        k = np.arange(max(lo, 1), min(lo + chunk, size))
        w = last * np.cumprod(-(d - k + 1) / k)
        if lo == 0:
            w = np.concatenate([[1.0], w])
        last = float(w[-1])
        yield w


def weight_segment(d: float, lo: int, hi: int) -> np.ndarray:
    """Weights of lags ``lo .. hi - 1``."""
    out, at = [], 0
    for w in weight_chunks(d, hi):
        if at + len(w) > lo:
            out.append(w[max(lo - at, 0) :])
        at += len(w)
    return np.concatenate(out)


def skipped_rows(d: float, n: int, thres: float) -> int:
    """Leading rows whose missing weight mass (share of lags not yet reached) exceeds ``thres``."""
    total = sum(float(np.abs(w).sum()) for w in weight_chunks(d, n))
    count, before = 0, 0.0
    for w in weight_chunks(d, n):
        mass = np.abs(w)
        upto = before + np.cumsum(mass)
        count += int(((total - upto + mass) / total > thres).sum())
        before = float(upto[-1])
    return count


def weights_until(d: float, thres: float, limit: int = 1_000_000) -> np.ndarray:
    """Weights before the first whose magnitude falls below ``thres``."""
    size = 64
    while True:
        w = weights(d, size)
        small = np.flatnonzero(np.abs(w) < thres)
        if len(small):
            return w[: small[0]]
        if size >= limit:
            raise ValueError(f"weights of d={d} stay above {thres} for {limit} lags")
        size *= 4


def weight_table(series: DataFrame, *, d: float) -> DataFrame:
    """``(instrument, k, w)`` for as many lags as each series has rows."""
    factor = -(F.lit(float(d)) - F.col("pos") + 1) / F.greatest(F.col("pos"), F.lit(1))
    factor = F.when(F.col("pos") == 0, F.lit(1.0)).otherwise(factor)
    run = running_product(series.select(*KEYS, "pos"), factor, "w")
    return run.select(*KEYS, F.col("pos").alias("k"), "w")


def calibrate_threshold(table: DataFrame, *, mass: float) -> DataFrame:
    """Cut-off keeping ``mass`` of the total weight, counted from the most recent lag."""
    run = running(table, {"_cum": ("sum", F.abs("w"))}, pos="k")
    run = lagged(run, {"_next": F.abs("w")}, n=-1, pos="k")
    total = table.groupBy(*KEYS).agg(F.sum(F.abs("w")).alias("_tot"))
    hit = run.join(total, list(KEYS)).where(F.col("_cum") / F.col("_tot") >= mass)
    return hit.groupBy(*KEYS).agg(F.min(F.struct("k", F.abs("w").alias("w"), "_next")).alias("_f")).select(
        *KEYS,
        (F.col("_f.k") + 1).alias("n_weights"),
        ((F.col("_f.w") + F.coalesce("_f._next", F.lit(0.0))) / 2).alias("thres"),
    )


# --------------------------------------------------------------------------- fixed width
def _filled(df: DataFrame, x: str) -> DataFrame:
    """Forward-filled values renumbered from the first non-null row (``_k``)."""
    out = running(df, {"_x": ("last", F.col(x))})
    first = df.where(F.col(x).isNotNull()).groupBy(*KEYS).agg(F.min("pos").alias("_p"))
    return out.join(first, list(KEYS)).where(F.col("pos") >= F.col("_p")).withColumn("_k", F.col("pos") - F.col("_p")).drop("_p")


def ffd_grid(df: DataFrame, *, x: str, ds: Sequence[float], thres: float) -> DataFrame:
    """Fixed-width differentiation for several ``d`` in one pass: ``(instrument, pos, d, x, value)``.

    Rows whose own value was null are dropped, as are rows without a full window.
    """
    table = {float(d): weights_until(d, thres) for d in ds}
    width = max(len(w) for w in table.values()) - 1
    base = _filled(df.select(*KEYS, "pos", x), x)
    schema = T.StructType([*base.schema.fields] + [T.StructField(f"_v{i}", T.DoubleType()) for i in range(len(table))])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf["_x"].to_numpy(dtype=float)
        return pdf.assign(**{f"_v{i}": np.convolve(v, w)[: len(v)] for i, w in enumerate(table.values())})

    lags = map_blocks(base, run, schema, pos="_k", before=width)
    items = [
        F.when(F.col("_k") >= len(w) - 1, F.struct(F.lit(d).alias("d"), F.col(f"_v{i}").alias("value")))
        for i, (d, w) in enumerate(table.items())
    ]
    return (
        lags.where(F.col(x).isNotNull())
        .select(*KEYS, "pos", x, F.explode(F.array_compact(F.array(*items))).alias("_e"))
        .select(*KEYS, "pos", "_e.d", x, "_e.value")
    )


def frac_diff_ffd(df: DataFrame, *, x: str, d: float, thres: float = 1e-5) -> DataFrame:
    return ffd_grid(df, x=x, ds=[d], thres=thres).drop("d")


# --------------------------------------------------------------------------- expanding
def frac_diff(df: DataFrame, *, x: str, d: float, thres: float = 0.01, size: int = 4096) -> DataFrame:
    """Expanding-window differentiation: every past value contributes.

    Quadratic by definition, so blocks of past values are sent to each later block and reduced there
    to one partial sum per output row; no pair of rows is ever emitted.
    """
    base = _filled(df.select(*KEYS, "pos", x), x)
    n = df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"))

    @F.pandas_udf("long")
    def skipped(counts: pd.Series) -> pd.Series:
        return counts.map({m: skipped_rows(d, int(m), thres) for m in counts.unique()})

    @F.pandas_udf("array<double>")
    def contribution(values: pd.Series, ahead: pd.Series) -> pd.Series:
        segments = {int(a): weight_segment(d, max(int(a) * size - size + 1, 0), (int(a) + 1) * size) for a in ahead.unique()}
        out = []
        for v, a in zip(values, ahead):
            v, seg = np.asarray(v, dtype=float), segments[int(a)]
            if a == 0:
                out.append(np.convolve(v, seg[: len(v)])[: len(v)])
            else:
                padded = np.zeros(size)
                padded[: len(v)] = v
                out.append(np.convolve(padded, seg)[size - 1 : 2 * size - 1])
        return pd.Series(out)

    limits = n.withColumn("_skip", skipped("_n"))
    blocks = packed(base, ["_x"], size=size, pos="_k").select(
        *KEYS, "blk", F.transform("rows", lambda r: r["_x"]).alias("v")
    )
    last = blocks.groupBy(*KEYS).agg(F.max("blk").alias("_last"))
    parts = (
        blocks.join(last, list(KEYS))
        .withColumn("out", F.explode(F.sequence("blk", "_last")))
        .select(*KEYS, "out", F.posexplode(contribution("v", F.col("out") - F.col("blk"))).alias("_i", "_c"))
        .groupBy(*KEYS, (F.col("out") * size + F.col("_i")).alias("_k"))
        .agg(F.sum("_c").alias("value"))
    )
    return (
        base.join(parts, [*KEYS, "_k"])
        .join(limits, list(KEYS))
        .where((F.col("_k") >= F.col("_skip")) & F.col(x).isNotNull())
        .select(*KEYS, "pos", x, "value")
    )


# --------------------------------------------------------------------------- stationarity search
def _poly(coefs: Sequence[float], t: str) -> Column:
    total = F.lit(float(coefs[-1]))
    for c in reversed(coefs[:-1]):
        total = total * F.col(t) + F.lit(float(c))
    return total


def adf_table(diffed: DataFrame, *, x: str) -> DataFrame:
    """Per ``(instrument, d)``: one-lag unit-root regression with constant, by grouped moments."""
    keys = [*KEYS, "d"]
    # rows may have gaps where the input was null, so renumber before taking lags
    dense = position(diffed, ["pos"], keys=keys, name="_j")
    lags = lagged(dense, {"_y1": F.col("value")}, keys=keys, pos="_j")
    lags = lagged(lags, {"_y2": F.col("_y1")}, keys=keys, pos="_j")
    lags = lags.withColumns({"dy": F.col("value") - F.col("_y1"), "dl": F.col("_y1") - F.col("_y2")})
    reg = F.col("dl").isNotNull()

    def cov(a: str, b: str) -> Column:
        return F.covar_pop(F.when(reg, F.col(a)), F.when(reg, F.col(b)))

    m = lags.groupBy(*keys).agg(
        F.sum(reg.cast("long")).alias("n_obs"),
        F.corr(x, "value").alias("corr"),
        cov("_y1", "_y1").alias("s11"),
        cov("dl", "dl").alias("s22"),
        cov("_y1", "dl").alias("s12"),
        cov("dy", "_y1").alias("s1y"),
        cov("dy", "dl").alias("s2y"),
        cov("dy", "dy").alias("syy"),
    )
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    m = m.withColumn("_det", det).withColumns(
        {
            "_b1": div(F.col("s22") * F.col("s1y") - F.col("s12") * F.col("s2y"), F.col("_det")),
            "_b2": div(F.col("s11") * F.col("s2y") - F.col("s12") * F.col("s1y"), F.col("_det")),
        }
    )
    rss = (F.col("syy") - F.col("_b1") * F.col("s1y") - F.col("_b2") * F.col("s2y")) * F.col("n_obs")
    s2 = div(rss, F.greatest(F.col("n_obs") - 3, F.lit(0)).cast("double"))
    se = F.sqrt(div(s2 * div(F.col("s22"), F.col("_det")), F.col("n_obs")))
    m = m.withColumn("adf_stat", div(F.col("_b1"), se)).withColumn(
        "_z", F.when(F.col("adf_stat") <= TAU_STAR, _poly(TAU_SMALL, "adf_stat")).otherwise(_poly(TAU_LARGE, "adf_stat"))
    )
    m = with_norm_cdf(m, "_z", "_p")
    p = F.when(F.col("adf_stat") > TAU_MAX, 1.0).when(F.col("adf_stat") < TAU_MIN, 0.0).otherwise(F.col("_p"))
    inv = div(F.lit(1.0), F.col("n_obs"))
    crit = CRIT_5PCT[0] + inv * (CRIT_5PCT[1] + inv * (CRIT_5PCT[2] + inv * CRIT_5PCT[3]))
    return m.withColumns({"p_value": p, "critical_value_95": crit}).select(
        *keys, "adf_stat", "p_value", "n_obs", "critical_value_95", "corr"
    )


D_GRID = tuple(round(0.1 * i, 1) for i in range(11))


def find_min_ffd(prices: DataFrame, *, price: str = "close", ds: Sequence[float] = D_GRID, thres: float = 0.01) -> DataFrame:
    """Unit-root table of the log price over the grid of ``d``."""
    logs = prices.select(*KEYS, "pos", F.log(price).alias("lp"))
    return adf_table(ffd_grid(logs, x="lp", ds=ds, thres=thres), x="lp")


def minimum_d(table: DataFrame, *, level: float = 0.05) -> DataFrame:
    """Smallest ``d`` per instrument whose unit root is rejected, null if none is."""
    return table.groupBy(*KEYS).agg(F.min(F.when(F.col("p_value") < level, F.col("d"))).alias("min_d"))


def fracdiff_feature(prices: DataFrame, *, price: str = "close", ds: Sequence[float] = D_GRID, thres: float = 0.01) -> DataFrame:
    """Log price differentiated at each instrument's own minimum stationary ``d``."""
    logs = prices.select(*KEYS, "pos", F.log(price).alias("lp"))
    grid = ffd_grid(logs, x="lp", ds=ds, thres=thres)
    best = minimum_d(adf_table(grid, x="lp")).withColumnRenamed("min_d", "d")
    return grid.join(best, [*KEYS, "d"]).select(*KEYS, "pos", "d", F.col("value").alias("fracdiff"))

"""Microstructure features of bars and of trades inside bars, and irregular-time spectra."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.operators.ticks import tick_rule
from tapeloom.plans.series import KEYS, div, framed, lagged, position, running

DEN = 3 - 2 * math.sqrt(2.0)
K2 = math.sqrt(8.0 / math.pi)
BAR = (*KEYS, "bar_id")


def _positive_root(c: Column) -> Column:
    return F.sqrt(F.greatest(c, F.lit(0.0)))


def _full(w, n: int, value: Column, seen: str) -> Column:
    """``value`` only where the frame holds ``n`` non-null rows."""
    return F.when(F.count(seen).over(w) == n, value)


def _changes(bars: DataFrame, price: str) -> DataFrame:
    out = lagged(bars, {"_c1": F.col(price), "_c2": F.col(price)})
    out = lagged(out, {"_c2": F.col("_c1")})
    return out.withColumns({"_d": F.col(price) - F.col("_c1"), "_dl": F.col("_c1") - F.col("_c2")}).drop("_c1", "_c2")


# --------------------------------------------------------------------------- spread and volatility estimators
def roll_measure(bars: DataFrame, *, price: str = "close") -> DataFrame:
    """Effective half spread and noise of each whole series."""
    m = _changes(bars, price).groupBy(*KEYS).agg(
        F.covar_samp("_d", "_dl").alias("cov_dp"), F.var_samp("_d").alias("var_dp")
    )
    return m.withColumns(
        {"c": _positive_root(-F.col("cov_dp")), "sigma_u": _positive_root(F.col("var_dp") + 2 * F.col("cov_dp"))}
    )


def roll_rolling(bars: DataFrame, *, window: int = 20, price: str = "close") -> DataFrame:
    """The same over the last ``window`` changes (``window + 1`` closes)."""

    def build(w):
        pairs, moves = w.rowsBetween(-(window - 2), 0), w.rowsBetween(-(window - 1), 0)
        return {
            "_cov": F.covar_samp("_d", "_dl").over(pairs),
            "_var": _full(moves, window, F.var_samp("_d").over(moves), "_d"),
        }

    out = framed(_changes(bars, price), build, before=window - 1)
    full = F.col("_var").isNotNull()
    return out.withColumns(
        {
            "roll_c": F.when(full, _positive_root(-F.col("_cov"))),
            "roll_sigma_u": F.when(full, _positive_root(F.col("_var") + 2 * F.col("_cov"))),
        }
    ).drop("_cov", "_var", "_d", "_dl")


def _hl2() -> Column:
    return F.pow(F.log(F.col("high") / F.col("low")), 2)


def parkinson(bars: DataFrame) -> DataFrame:
    return bars.groupBy(*KEYS).agg(F.sqrt(F.avg(_hl2()) / (4 * math.log(2))).alias("parkinson_vol"))


def parkinson_rolling(bars: DataFrame, *, window: int = 20, name: str = "parkinson_vol_20bar") -> DataFrame:
    def build(w):
        f = w.rowsBetween(-(window - 1), 0)
        return {name: _full(f, window, F.sqrt(F.avg("_hl").over(f) / (4 * math.log(2))), "_hl")}

    return framed(bars.withColumn("_hl", _hl2()), build, before=window - 1).drop("_hl")


def high_low_estimators(bars: DataFrame, *, sl: int = 1) -> DataFrame:
    """Beta, gamma, alpha, spread and volatility from bar highs and lows."""

    def two(w):
        f = w.rowsBetween(-1, 0)
        return {
            "_b2": _full(f, 2, F.sum("_hl").over(f), "_hl"),
            "gamma": _full(f, 2, F.pow(F.log(F.max("high").over(f) / F.min("low").over(f)), 2), "_hl"),
        }

    out = framed(bars.withColumn("_hl", _hl2()), two, before=1)

    def mean(w):
        f = w.rowsBetween(-(sl - 1), 0)
        return {"beta": _full(f, sl, F.avg("_b2").over(f), "_b2")}

    out = framed(out, mean, before=sl - 1)
    alpha = (math.sqrt(2) - 1) * F.sqrt("beta") / DEN - F.sqrt(F.col("gamma") / DEN)
    out = out.withColumn("alpha", F.when(alpha < 0, 0.0).otherwise(alpha))
    sigma = (2**-0.5 - 1) * F.sqrt("beta") / (K2 * DEN) + F.sqrt(F.col("gamma") / (K2 * K2 * DEN))
    return out.withColumns(
        {
            "corwin_schultz_spread": 2 * (F.exp("alpha") - 1) / (1 + F.exp("alpha")),
            "becker_parkinson_sigma": F.when(sigma < 0, 0.0).otherwise(sigma),
        }
    ).drop("_hl", "_b2")


# --------------------------------------------------------------------------- price impact and flow
def kyle_lambda(trades: DataFrame, *, min_trades: int = 3) -> DataFrame:
    """Slope of price change on signed volume inside each bar."""
    inner = lagged(trades, {"_p": F.col("price"), "_b": F.col("bar_id")})
    same = F.col("_b") == F.col("bar_id")
    return inner.groupBy(*BAR).agg(_impact(F.when(same, F.col("price") - F.col("_p")), min_trades).alias("kyle_lambda"))


def _impact(step: Column, min_trades: int) -> Column:
    return F.when(F.count(F.lit(1)) >= min_trades, F.regr_slope(step, (F.col("qty") * F.col("side")).cast("double")))


def amihud(bars: DataFrame) -> DataFrame:
    """Through-origin slope of |log return| on dollar volume per series."""
    out = lagged(bars, {"_c": F.col("close")}).withColumn("_m", F.abs(F.log("close") - F.log("_c")))
    moved = F.col("_m").isNotNull()
    v = F.when(moved, F.col("dollar"))
    return out.groupBy(*KEYS).agg(div(F.sum(v * F.col("_m")), F.sum(v * v)).alias("amihud_lambda"))


def amihud_rolling(bars: DataFrame, *, window: int = 20, name: str = "amihud_lambda_20bar") -> DataFrame:
    """Over the ``window - 1`` moves inside each run of ``window`` bars."""
    out = lagged(bars, {"_c": F.col("close")}).withColumn("_m", F.abs(F.log("close") - F.log("_c")))

    def build(w):
        f = w.rowsBetween(-(window - 2), 0)
        num, den = F.sum(F.col("dollar") * F.col("_m")).over(f), F.sum(F.col("dollar") * F.col("dollar")).over(f)
        return {name: _full(f, window - 1, div(num, den), "_m")}

    return framed(out, build, before=window - 2).drop("_c", "_m")


def vpin(bars: DataFrame, *, window: int, name: str = "vpin_10bar") -> DataFrame:
    """Rolling share of one-sided volume; null until the window is full."""

    def build(w):
        f = w.rowsBetween(-(window - 1), 0)
        gap = F.sum(F.abs(F.col("buy_volume") - F.col("sell_volume"))).over(f)
        total = F.sum(F.col("buy_volume") + F.col("sell_volume")).over(f)
        return {name: _full(f, window, div(gap.cast("double"), total.cast("double")), "buy_volume")}

    return framed(bars, build, before=window - 1)


def round_sizes(trades: DataFrame, *, levels: Sequence[float], tol: float = 1e-6, by: Sequence[str] = KEYS) -> DataFrame:
    """Share of trades at a round size, and the count per level."""

    any_level, near = _round(levels, tol)
    return trades.groupBy(*by).agg(
        F.avg(any_level.cast("double")).alias("round_fraction"),
        *[F.sum(c.cast("long")).alias(f"n_{lv:g}".replace(".", "_")) for lv, c in zip(levels, near, strict=True)],
    )


def _round(levels: Sequence[float], tol: float = 1e-6) -> tuple[Column, list[Column]]:
    """Whether a trade is at any of the levels, and at each."""
    near = [F.abs(F.col("qty") - F.lit(float(lv))) <= lv * tol + tol * abs(lv) for lv in levels]
    return reduce(lambda x, y: x | y, near), near


def serial_correlation(trades: DataFrame, *, value: str = "side", by_bar: bool = False) -> DataFrame:
    """Correlation of flow with its own previous value, per series or inside each bar (> 3 trades)."""
    prev = lagged(trades, {"_v": F.col(value), **({"_b": F.col("bar_id")} if by_bar else {})})
    lag = F.when(F.col("_b") == F.col("bar_id"), F.col("_v")) if by_bar else F.col("_v")
    paired = prev.withColumn("_lag", lag.cast("double"))
    return paired.groupBy(*(BAR if by_bar else KEYS)).agg(_serial("_lag", value, by_bar).alias("serial_corr_signed_flow"))


def _serial(lag: str, value: str, by_bar: bool) -> Column:
    now = F.when(F.col(lag).isNotNull(), F.col(value).cast("double"))
    rho = div(F.covar_pop(now, F.col(lag)), F.stddev_pop(now) * F.stddev_pop(lag))
    return F.when(F.count(F.lit(1)) > 3, rho) if by_bar else rho


def bar_tick_accuracy(trades: DataFrame) -> DataFrame:
    """Tick-rule accuracy inside each bar; the rule restarts with every bar."""
    inner = position(trades, ["pos"], keys=BAR, name="_i")
    signed = tick_rule(inner, keys=BAR, pos="_i")
    return signed.groupBy(*BAR).agg(F.avg((F.col("tick") == F.col("side")).cast("double")).alias("tick_rule_accuracy"))


def trade_features(trades: DataFrame, *, levels: Sequence[float], min_trades: int = 5) -> DataFrame:
    """:func:`kyle_lambda`, :func:`round_sizes`, :func:`serial_correlation` and :func:`bar_tick_accuracy` of each bar from one pass of neighbours."""
    same = F.col("_b") == F.col("bar_id")
    prev = lagged(trades.select(*BAR, "pos", "price", "qty", "side"), {"_p": F.col("price"), "_v": F.col("side"), "_b": F.col("bar_id")})
    inner = prev.select(*BAR, "pos", "qty", "side", F.when(same, F.col("price") - F.col("_p")).alias("_step"), F.when(same, F.col("_v")).cast("double").alias("_lag"))
    move = F.signum("_step").cast("int")
    signed = running(inner, {"_sgn": ("last", F.when(move != 0, move))}, keys=BAR)
    return signed.groupBy(*BAR).agg(
        _impact(F.col("_step"), min_trades).alias("kyle_lambda"),
        F.avg(_round(levels)[0].cast("double")).alias("round_number_fraction"),
        _serial("_lag", "side", True).alias("serial_corr_signed_flow"),
        F.avg((F.coalesce("_sgn", F.lit(1)) == F.col("side")).cast("double")).alias("tick_rule_accuracy"),
    )


# --------------------------------------------------------------------------- feature table
FEATURES = (
    "roll_c", "roll_sigma_u", "parkinson_vol_20bar", "corwin_schultz_spread", "becker_parkinson_sigma", "kyle_lambda",
    "amihud_lambda_20bar", "vpin_10bar", "round_number_fraction", "serial_corr_signed_flow", "tick_rule_accuracy",
)


def feature_table(
    bars: DataFrame, trades: DataFrame, *, window: int = 20, vpin_window: int = 10, levels: Sequence[float] = (1, 5, 10, 50, 100)
) -> DataFrame:
    """The eleven bar features keyed by ``(instrument, bar_id)``; trades carry their ``bar_id``."""
    wide = amihud_rolling(
        vpin(high_low_estimators(parkinson_rolling(roll_rolling(bars, window=window), window=window)), window=vpin_window),
        window=window,
    )
    out = wide.join(trade_features(trades, levels=levels), list(BAR), "left")
    return out.select(*BAR, "pos", "ts", "close", *FEATURES)


# --------------------------------------------------------------------------- spectrum
def nudft(df: DataFrame, *, t: str, v: str, freqs: Sequence[float]) -> DataFrame:
    """Discrete Fourier sums at irregular times: each task sums its rows for all frequencies, then the partial sums meet."""
    freqs = [float(f) for f in freqs]
    key = T.StructType([df.schema[k] for k in KEYS])
    out = T.StructType([*key.fields, T.StructField("freq", T.DoubleType()), T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])

    def partial(batches):
        turn = -2.0 * math.pi * np.array(freqs)
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for k, part in pdf.dropna().groupby(list(KEYS), sort=False):
                for i in range(0, len(part), 4096):
                    rows = part.iloc[i : i + 4096]
                    angle = np.outer(rows[t].to_numpy(float), turn)
                    x = rows[v].to_numpy(float)
                    sums[k] = sums.get(k, 0) + np.stack((x @ np.cos(angle), x @ np.sin(angle)))
        for k, (re, im) in sums.items():
            yield pd.DataFrame({**dict(zip(KEYS, ([x] * len(freqs) for x in k))), "freq": freqs, "re": re, "im": im})

    long = df.select(*KEYS, t, v).mapInPandas(partial, out).groupBy(*KEYS, "freq").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    return long.withColumns({"magnitude": F.sqrt(power), "power": power})


def spectrum_summary(spectrum: DataFrame) -> DataFrame:
    """Peak frequency and flatness (std / mean of power)."""
    return spectrum.groupBy(*KEYS).agg(
        F.max_by("freq", "power").alias("peak_freq"),
        F.max("power").alias("peak_power"),
        div(F.stddev_pop("power"), F.avg("power")).alias("flatness"),
    )

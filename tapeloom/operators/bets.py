"""Bet sizing: probabilities -> signals -> positions -> limit prices and P&L."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.gaussian import with_norm_cdf
from tapeloom.operators.labels import us
from tapeloom.plans.series import KEYS, asof, div, lagged, position, running


def probability_signal(df: DataFrame, *, n_classes: int, prob: str = "prob", pred: str = "pred") -> DataFrame:
    """Signed size in (-1, 1) from the t-value of the winning class; times ``side`` when present."""
    p = F.col(prob)
    z = div(p - 1.0 / n_classes, F.sqrt(p * (1 - p)))
    out = with_norm_cdf(df.withColumn("_z", z), "_z", "_cdf")
    size = F.col(pred) * (2 * F.col("_cdf") - 1)
    if "side" in df.columns:
        size = size * F.col("side")
    return out.withColumn("signal", size).drop("_z", "_cdf")


def average_active(signals: DataFrame) -> DataFrame:
    """Mean of the signals open at every time one opens or closes (0 where none is open).

    A signal is open for t0 <= t < t1 (null t1: still open), so the average is a running sum of
    opening and closing amounts over the distinct times.
    """
    edges = F.array_compact(
        F.array(
            F.struct(F.col("t0").alias("t"), F.col("signal").alias("s"), F.lit(1).alias("n")),
            F.when(
                F.col("t1").isNotNull(), F.struct(F.col("t1").alias("t"), (-F.col("signal")).alias("s"), F.lit(-1).alias("n"))
            ),
        )
    )
    points = (
        signals.select(*KEYS, F.explode(edges).alias("e"))
        .groupBy(*KEYS, F.col("e.t").alias("t"))
        .agg(F.sum("e.s").alias("_s"), F.sum("e.n").alias("_n"))
    )
    run = running(position(points, ["t"]), {"_ss": ("sum", F.col("_s")), "active": ("sum", F.col("_n"))})
    return run.select(
        *KEYS, "t", "active", F.when(F.col("active") > 0, F.col("_ss") / F.col("active")).otherwise(0.0).alias("signal")
    )


def stepped(signal: Column, step: float | Column) -> Column:
    """Half-even to multiples of ``step``, clipped to [-1, 1]."""
    s = F.lit(step)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.rint(signal / s) * s)) + F.lit(0.0)


def discretise(df: DataFrame, *, step: float, signal: str = "signal") -> DataFrame:
    """Round half-even to multiples of ``step`` and clip to [-1, 1]."""
    return df.withColumn(signal, stepped(F.col(signal), step))


def bet_signal(df: DataFrame, *, n_classes: int, step: float) -> DataFrame:
    """Probability table with (t0, t1, prob, pred[, side]) -> discretised average signal per time."""
    return discretise(average_active(probability_signal(df, n_classes=n_classes)), step=step)


# --------------------------------------------------------------------------- dynamic positions
def scale_for(x: Column, m: Column) -> Column:
    """Width w for which divergence ``x`` gives bet size ``m``."""
    return x * x * (F.pow(m, F.lit(-2.0)) - 1)


def bet_size(w: Column, x: Column) -> Column:
    return div(x, F.sqrt(w + x * x))


def target_position(df: DataFrame, *, w: str = "w", forecast: str = "forecast", price: str = "price", max_pos: str = "max_pos") -> DataFrame:
    """Whole position for the forecast divergence, truncated toward zero."""
    size = bet_size(F.col(w), F.col(forecast) - F.col(price))
    return df.withColumn("target_pos", (size * F.col(max_pos)).cast("long"))


def limit_price(
    df: DataFrame, *, w: str = "w", forecast: str = "forecast", max_pos: str = "max_pos", pos: str = "pos", target: str = "target_pos"
) -> DataFrame:
    """Break-even limit price for moving from ``pos`` to ``target``; null when they are equal."""
    t, p = F.col(target), F.col(pos)
    first = F.abs(p + F.when(t >= p, 1).otherwise(-1))
    last = F.abs(t + 1) - 1
    steps = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    def inverse(j: Column) -> Column:
        m = j / F.col(max_pos).cast("double")
        return F.col(forecast) - m * F.sqrt(div(F.col(w), 1 - m * m))

    total = F.aggregate(steps, F.lit(0.0), lambda acc, j: acc + inverse(j))
    return df.withColumn("limit_price", div(total, (t - p).cast("double")) + F.lit(0.0))


# --------------------------------------------------------------------------- positions and P&L on bars
def positions_on_bars(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """Latest signal known at each bar, 0 before the first."""
    found = asof(bars, signals, {"position": "signal"}, left_on=us("ts"), right_on=us("t"))
    return found.withColumn("position", F.coalesce("position", F.lit(0.0)))


def strategy_pnl(bars: DataFrame) -> DataFrame:
    """Previous bar's position times this bar's return."""
    out = lagged(bars, {"_pos": F.col("position"), "_c": F.col("close")})
    pnl = F.coalesce(F.col("_pos"), F.lit(0.0)) * F.coalesce(F.col("close") / F.col("_c") - 1, F.lit(0.0))
    return out.withColumn("pnl", pnl + F.lit(0.0)).drop("_pos", "_c")


def event_returns(events: DataFrame, signals: DataFrame) -> DataFrame:
    """Signal at each event's start (0 when none) times the event return."""
    sig = signals.select(*KEYS, F.col("t").alias("t0"), "signal")
    out = events.join(sig, [*KEYS, "t0"], "left").withColumn("signal", F.coalesce("signal", F.lit(0.0)))
    return out.withColumn("strategy_ret", F.col("signal") * F.col("ret"))


def latest_signal(signals: DataFrame) -> DataFrame:
    return signals.groupBy(*KEYS).agg(F.max_by("signal", "t").alias("signal"))


def capital_suggestion(df: DataFrame, *, capital: float, max_fraction: float, signal: str = "signal") -> DataFrame:
    if not 0 < max_fraction <= 1:
        raise ValueError("max_fraction must be in (0, 1]")
    if capital <= 0:
        raise ValueError("capital must be positive")
    s = F.col(signal)
    return df.withColumns(
        {
            "suggested": s * F.lit(capital) * F.lit(max_fraction),
            "direction": F.when(s.isNull(), "no signal").when(s > 0, "long").when(s < 0, "short").otherwise("flat"),
        }
    )

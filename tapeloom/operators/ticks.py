"""Tape cleaning and per-trade features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.plans.series import KEYS, div, ewm_sums, lagged, position, quantiles, running


def dedupe_trades(df: DataFrame, *, order: Sequence[str] = ("ts", "seq"), keys=("instrument", "trade_id")) -> DataFrame:
    """Keep the first row per trade id.

    An aggregation (not a window), so a heavily replayed id is combined map-side.
    """
    rest = [c for c in df.columns if c not in keys]
    first = [c for c in order if c in rest] + [c for c in rest if c not in order]
    return (
        df.groupBy(*keys)
        .agg(F.min(F.struct(*first)).alias("_r"))
        .select(*[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in df.columns])
    )


def disambiguate_timestamps(df: DataFrame, *, tie: Sequence[str] = ("trade_id",)) -> DataFrame:
    """Shift the k-th trade of an equal-time group by k microseconds, in trade-id order."""
    ranked = position(df, list(tie), keys=("instrument", "ts"), name="_k")
    shifted = F.timestamp_micros(F.unix_micros("ts") + F.col("_k"))
    return ranked.withColumn("ts", shifted).drop("_k").select(*df.columns)


def aggressor_side(is_buyer_maker: Column) -> Column:
    return F.when(is_buyer_maker, F.lit(-1)).otherwise(F.lit(1))


def price_delta(df: DataFrame, *, price: str = "price", name: str = "delta") -> DataFrame:
    """First difference, 0 on the first row."""
    out = lagged(df, {"_prev": F.col(price)})
    return out.withColumn(name, F.coalesce(F.col(price) - F.col("_prev"), F.lit(0.0))).drop("_prev")


def tick_rule(
    df: DataFrame, *, price: str = "price", b0: int = 1, name: str = "tick", keys: Sequence[str] = KEYS, pos: str = "pos"
) -> DataFrame:
    """Sign of the price change; an unchanged price repeats the previous sign; ``b0`` to start."""
    out = lagged(df, {"_prev": F.col(price)}, keys=keys, pos=pos)
    change = F.signum(F.col(price) - F.col("_prev")).cast("int")
    out = running(out, {"_sgn": ("last", F.when(change != 0, change))}, keys=keys, pos=pos)
    return out.withColumn(name, F.coalesce("_sgn", F.lit(b0))).drop("_prev", "_sgn")


def tick_rule_accuracy(df: DataFrame, *, inferred: str = "tick", true: str = "side", by: Sequence[str] = KEYS) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(inferred) == F.col(true)).cast("double")).alias("accuracy"))


def side_probabilities(df: DataFrame, *, side: str = "side") -> DataFrame:
    """Share of buys and sells among labelled trades."""
    buy = F.avg((F.col(side) == 1).cast("double"))
    return df.where(F.col(side).isin(1, -1)).groupBy(*KEYS).agg(buy.alias("p_buy"), (1 - buy).alias("p_sell"))


def ewma(df: DataFrame, *, x: str, window: int, name: str = "ewma", pos: str = "pos") -> DataFrame:
    """Recursive average seeded with the first value, alpha = 2 / (window + 1)."""
    alpha = 2.0 / (window + 1.0)
    if alpha >= 1.0:
        return df.withColumn(name, F.col(x).cast("double"))
    seeded = F.when(F.col(pos) == 0, F.col(x) / alpha).otherwise(F.col(x))
    return ewm_sums(df, {"_y": seeded}, 1 - alpha, pos=pos).withColumn(name, F.col("_y") * alpha).drop("_y")


def returns(df: DataFrame, *, price: str = "price") -> DataFrame:
    """Log price, log return and simple return (null on the first row)."""
    return (
        lagged(df, {"_prev": F.col(price)})
        .withColumn("log_price", F.log(price))
        .withColumn("log_return", F.log(price) - F.log("_prev"))
        .withColumn("pct_change", F.col(price) / F.col("_prev") - 1)
        .drop("_prev")
    )


def elapsed_days(df: DataFrame, *, ts: str = "ts", name: str = "days") -> DataFrame:
    """Days since the first row of the series, as a double."""
    start = df.groupBy(*KEYS).agg(F.min(ts).alias("_start"))
    days = (F.unix_micros(ts) - F.unix_micros("_start")) / F.lit(86_400_000_000.0)
    return df.join(start, list(KEYS)).withColumn(name, days).drop("_start")


def tape_profile(df: DataFrame) -> DataFrame:
    """Baseline statistics of a tape: arrival rate, price noise, trade size, sell share, span."""
    gaps = lagged(df, {"_pp": F.col("price"), "_pt": F.unix_micros("ts")})
    seconds = (F.unix_micros("ts") - F.col("_pt")) / F.lit(1e6)
    median = quantiles(gaps.withColumn("_s", seconds), "_s", [0.5])
    stats = gaps.groupBy(*KEYS).agg(
        F.stddev_samp(F.col("price") - F.col("_pp")).alias("delta_std"),
        F.avg("qty").alias("mean_size"),
        F.avg((F.col("side") == -1).cast("double")).alias("sell_share"),
        F.count(F.lit(1)).alias("n_trades"),
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / F.lit(3.6e9)).alias("span_hours"),
    )
    return stats.join(median, list(KEYS), "left").withColumn("trades_per_second", div(F.lit(1.0), F.col("q0"))).drop("q0")


def signed_flow(df: DataFrame) -> DataFrame:
    """Signed volume and its running total."""
    signed = df.withColumn("signed_volume", F.col("qty") * F.col("side"))
    return running(signed, {"order_flow": ("sum", F.col("signed_volume"))})


def preprocess_trades(df: DataFrame) -> DataFrame:
    """Raw trades -> ordered tape with side, dollar value, position and price change."""
    tape = price_delta(position(disambiguate_timestamps(df), ["ts", "trade_id"]))
    return tape.withColumns({"side": aggressor_side(F.col("is_buyer_maker")), "dollar": F.col("price") * F.col("qty")})

"""Futures rolls and multi-product baskets over contract panels
``(instrument, contract, date, open, high, low, close, volume, open_int)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.plans.series import KEYS, div, framed, lagged, linear_scan, position, running, running_product


def front_month_by_volume(panel: DataFrame) -> DataFrame:
    """Per date the contract with the largest volume; each column is its first non-null value."""
    order = F.struct((-F.col("volume")).alias("v"), "contract")
    pick = [
        F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("contract", "open", "close")
    ]
    return position(panel.groupBy(*KEYS, "date").agg(*pick), ["date"])


def front_month_by_open_interest(
    panel: DataFrame, *, start: str | None = None, end: str | None = None, limit: int = 3
) -> DataFrame:
    """Per business day the contract with the largest open interest.

    Each contract is first laid on its own business-day calendar and gaps of up to ``limit`` days
    are filled forward; days without a close are dropped.
    """
    fields = ["open", "high", "low", "close", "volume", "open_int"]
    rows = panel
    if start:
        rows = rows.where(F.col("date") >= F.to_date(F.lit(start)))
    if end:
        rows = rows.where(F.col("date") <= F.to_date(F.lit(end)))
    series = [*KEYS, "contract"]
    span = rows.groupBy(*series).agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    workdays = F.filter(F.sequence("_a", "_b"), lambda d: F.weekday(d) < 5)
    calendar = span.select(*series, F.posexplode(workdays).alias("_i", "date"))
    laid = calendar.join(rows.select(*series, "date", *fields), [*series, "date"], "left")
    filled = framed(
        laid,
        lambda w: {f"_f_{c}": F.last(c, ignorenulls=True).over(w.rowsBetween(-limit, 0)) for c in fields},
        keys=series, pos="_i", before=limit,
    ).select(*series, "date", *[F.col(f"_f_{c}").alias(c) for c in fields])
    best = F.struct(F.coalesce("open_int", F.lit(-1)).alias("oi"), "contract")
    front = filled.where(F.col("close").isNotNull()).groupBy(*KEYS, "date").agg(
        F.max_by(F.struct("contract", *fields), best).alias("_r")
    )
    return position(front.select(*KEYS, "date", "_r.*"), ["date"])


def roll_gaps(front: DataFrame, *, match_end: bool = True) -> DataFrame:
    """Cumulative price gap at each contract's first appearance (open minus the old close)."""
    first = front.groupBy(*KEYS, "contract").agg(F.min("pos").alias("_p"))
    out = lagged(front.join(first, [*KEYS, "contract"]), {"_pc": F.col("close")})
    jump = F.when((F.col("pos") == F.col("_p")) & (F.col("pos") > 0), F.col("open") - F.col("_pc")).otherwise(F.lit(0.0))
    out = running(out.withColumn("_gap", jump), {"gap": ("sum", F.col("_gap"))})
    if match_end:
        total = out.groupBy(*KEYS).agg(F.sum("_gap").alias("_tot"))
        out = out.join(total, list(KEYS)).withColumn("gap", F.col("gap") - F.col("_tot")).drop("_tot")
    return out.drop("_p", "_pc", "_gap")


def rolled_prices(front: DataFrame, *, match_end: bool = True) -> DataFrame:
    out = roll_gaps(front, match_end=match_end)
    return out.withColumns({"rolled_open": F.col("open") - F.col("gap"), "rolled_close": F.col("close") - F.col("gap")})


def non_negative_index(front: DataFrame, *, match_end: bool = True) -> DataFrame:
    """Compounded index of rolled changes over raw closes; null on the first row."""
    out = lagged(rolled_prices(front, match_end=match_end), {"_pr": F.col("rolled_close"), "_pc": F.col("close")})
    out = out.withColumn("ret", div(F.col("rolled_close") - F.col("_pr"), F.col("_pc"))).drop("_pr", "_pc")
    out = running_product(out, 1 + F.col("ret"), "_prod")
    return out.withColumn("r_price", F.when(F.col("ret").isNotNull(), F.col("_prod"))).drop("_prod")


def continuous_prices(panel: DataFrame, *, by: str = "volume", match_end: bool = True, **calendar) -> DataFrame:
    front = front_month_by_volume(panel) if by == "volume" else front_month_by_open_interest(panel, **calendar)
    return non_negative_index(front, match_end=match_end)


def aligned_returns(returns: DataFrame, products: Sequence[str]) -> DataFrame:
    """Wide return panel on the dates every product has."""
    wide = returns.where(F.col("ret").isNotNull()).groupBy("date").pivot("instrument", list(products)).agg(F.first("ret"))
    return wide.dropna()


# --------------------------------------------------------------------------- basket index
def etf_trick(legs: DataFrame) -> DataFrame:
    """One-dollar basket index with costs and tradable volume.

    ``legs`` is (basket, pos, asset, open, close, w, phi, div, cost, volume, rebalance), every asset in every bar. After a bar
    that rebalances, value k is spread by the bar's weights at the next open. Holdings are thus a scale times a shape: the shape (units
    per unit of value) is known from the legs, the scale is the value at the last rebalance. Value and scale before a bar become
    those after it by a 2 x 2 matrix, so the index is a matrix scan over all bars; costs are sums over shapes times scales.
    """
    asset, bar = ["basket", "asset"], ["basket", "pos"]
    gross = legs.groupBy(*bar).agg(F.sum(F.abs("w")).alias("_gross"))
    before = {f"_{c}": F.col(c) for c in ("w", "phi", "close", "rebalance", "_gross")}
    legs = lagged(legs.join(gross, bar), before, keys=asset)
    fresh = F.coalesce(F.col("_rebalance").cast("boolean"), F.lit(False))
    legs = legs.withColumn("_new", F.when(fresh, div(F.col("_w"), F.col("open") * F.col("_phi") * F.col("__gross"))))
    legs = running(legs, {"_was": ("last", F.col("_new"))}, keys=asset, exclusive=True)
    was, now = F.coalesce("_was", F.lit(0.0)), F.coalesce("_new", "_was", F.lit(0.0))
    move = F.when(fresh, F.col("close") - F.col("open")).otherwise(F.coalesce(F.col("close") - F.col("_close"), F.lit(0.0)))
    charge = F.col("phi") * F.col("cost")
    bars = legs.groupBy(*bar).agg(
        F.max(fresh).alias("_fresh"),
        F.sum(was * F.col("phi") * (move + F.col("div"))).alias("_gain"),
        F.sum(F.abs(was) * F.col("close") * charge).alias("_held"),
        F.sum(F.abs(now) * F.col("open") * charge).alias("_bought"),
        F.min(F.when(was != 0, F.col("volume") / F.abs(was))).alias("_room"),
    )
    one, set_ = F.lit(1.0), F.col("_fresh").cast("double")
    bars = linear_scan(bars, [[one, F.col("_gain")], [set_, one - set_]], ["_k", "_s"], [1.0, 0.0], keys=["basket"])
    scale = F.abs("_s")
    return bars.select(
        *bar,
        (F.col("_k") + F.col("_s") * F.col("_gain")).alias("k"),
        F.when(F.col("_fresh"), scale * F.col("_held") + F.abs("_k") * F.col("_bought")).otherwise(F.lit(0.0)).alias("rebalance_cost"),
        (scale * F.col("_held")).alias("bid_ask_cost"),
        F.coalesce(F.col("_room") / F.nullif(scale, F.lit(0.0)), F.lit(0.0)).alias("volume"),
    )

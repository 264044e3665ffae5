"""Event-driven bars: ordered aggregation of a tape ``(instrument, pos, ts, price, qty, side, dollar)``.

The trade that reaches the threshold belongs to the bar, accumulators restart from zero, and a
trailing incomplete bar is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.operators.flow_history import FlowHistory
from tapeloom.plans.series import KEYS, block_offsets, fold, lagged, reuse

FLOOR = 1e-6


def bar_aggregates(tagged: DataFrame, *extra: Column) -> DataFrame:
    """OHLC, VWAP, counts and two-sided flow per ``(instrument, bar_id)``."""
    return (
        tagged.groupBy(*KEYS, "bar_id")
        .agg(
            *extra,
            F.max_by("ts", "pos").alias("ts"),
            F.max("pos").alias("end_pos"),
            F.min_by("price", "pos").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "pos").alias("close"),
            (F.sum("dollar") / F.sum("qty")).alias("vwap"),
            F.count(F.lit(1)).alias("n_trades"),
            F.sum("dollar").alias("dollar"),
            F.sum(F.when(F.col("side") == 1, F.col("qty")).otherwise(0)).alias("buy_volume"),
            F.sum(F.when(F.col("side") == -1, F.col("qty")).otherwise(0)).alias("sell_volume"),
        )
        .withColumn("pos", F.col("bar_id"))
    )


def _complete(tagged: DataFrame) -> DataFrame:
    """Aggregate only bars whose closing trade was seen."""
    return bar_aggregates(tagged, F.max("is_end").alias("_closed")).where("_closed").drop("_closed")


# --------------------------------------------------------------------------- time bars
def time_bars(tape: DataFrame, *, freq: str = "D", style: str = "last") -> DataFrame:
    """Calendar bars, freq in H, D, W, M; empty periods are absent.

    ``style='last'``: last price and total volume; weeks are labelled by their closing Sunday and
    months by their last day.  ``style='ohlcv'``: OHLC and VWAP, Monday weeks, stamped with the first trade.
    """
    day = F.date_trunc("day", F.col("ts"))
    if style == "ohlcv":
        unit = {"H": "hour", "D": "day", "W": "week", "M": "month"}[freq]
        return (
            tape.groupBy(*KEYS, F.date_trunc(unit, F.col("ts")).alias("period"))
            .agg(
                F.min("ts").alias("ts"),
                F.min_by("price", "pos").alias("open"),
                F.max("price").alias("high"),
                F.min("price").alias("low"),
                F.max_by("price", "pos").alias("close"),
                F.sum("qty").alias("volume"),
                (F.sum("dollar") / F.sum("qty")).alias("vwap"),
            )
            .drop("period")
        )
    label = {
        "H": F.date_trunc("hour", F.col("ts")),
        "D": day,
        "W": F.date_trunc("week", F.col("ts")) + F.expr("INTERVAL 6 DAYS"),
        "M": F.last_day(F.col("ts")).cast("timestamp"),
    }[freq]
    return tape.groupBy(*KEYS, label.alias("ts")).agg(
        F.max_by("price", "pos").alias("price"), F.sum("qty").alias("volume")
    )


# --------------------------------------------------------------------------- fixed-count and threshold bars
def tick_bars(tape: DataFrame, *, n: int) -> DataFrame:
    """Every ``n`` trades: pure position arithmetic, one aggregation."""
    tagged = tape.withColumn("bar_id", F.floor(F.col("pos") / n).cast("long"))
    return bar_aggregates(tagged).where(F.col("n_trades") == n)


def _threshold_ends(x: np.ndarray, limit: float, carry: float) -> tuple[np.ndarray, float]:
    """Closing rows of a reset-at-threshold accumulation; exact jumps when ``x`` is integer."""
    ends = np.zeros(len(x), dtype=bool)
    if np.issubdtype(x.dtype, np.integer):
        cum = np.cumsum(x)
        base, last = -int(carry), -1
        need = math.ceil(limit)
        while True:
            i = max(int(np.searchsorted(cum, base + need, side="left")), last + 1)
            if i >= len(x):
                break
            ends[i] = True
            base, last = int(cum[i]), i
        return ends, float((cum[-1] if len(x) else 0) - base)
    at, acc = 0, np.array([carry])
    while at < len(x):
        i, acc = _first_hit(x[:, None], at, acc, lambda c: c[:, 0] >= limit)
        if i is None:
            break
        ends[i] = True
        at, acc = i + 1, np.zeros(1)
    return ends, float(acc[0])


def _first_hit(x: np.ndarray, at: int, carry: np.ndarray, test, free: int = 0) -> tuple[int | None, np.ndarray]:
    """First row from ``at`` on whose running column sums pass ``test``, and the sums there (at the end: None and all sums).

    The first ``free`` rows may not be it. Stretches double, so the cost is that of the rows passed over.
    """
    width, begin = 64, at
    while at < len(x):
        sums = np.cumsum(np.vstack((carry, x[at : at + width])), axis=0)[1:]
        ok = test(sums)
        ok[: max(0, begin + free - at)] = False
        hit = int(ok.argmax())
        if ok[hit]:
            return at + hit, sums[hit]
        at, carry, width = at + len(sums), sums[-1], 2 * width
    return None, carry


def _numbered(tape: DataFrame, fn, init, uses: Sequence[str], *, forgets: bool = True) -> DataFrame:
    """Run an end-marking fold over the columns that it ``uses`` and turn its marks into global bar ids, which then join the tape."""
    tape = reuse(tape)
    marks = [T.StructField("is_end", T.BooleanType()), T.StructField("_local", T.LongType())]
    schema = T.StructType([*[tape.schema[c] for c in (*KEYS, "pos")], *marks])
    cols = schema.fieldNames()

    def run(pdf: pd.DataFrame, state):
        ends, state = fn(pdf, state)
        done = ends.cumsum()
        return pdf.assign(is_end=ends, _local=done - ends)[cols], state

    marked = reuse(fold(tape.select(*dict.fromkeys((*KEYS, "pos", *uses))), run, init, schema, forgets=forgets))
    marked = block_offsets(marked, F.col("is_end").cast("long"), "_off")
    out = marked.select(*KEYS, "pos", "is_end", (F.col("_local") + F.col("_off")).alias("bar_id"))
    return tape.join(out, [*KEYS, "pos"]).select(*tape.columns, "is_end", "bar_id")


def threshold_marker(measure: str, threshold: float | str):
    def mark(pdf: pd.DataFrame, state):
        limit = float(pdf[threshold].iloc[0]) if isinstance(threshold, str) else float(threshold)
        ends, carry = _threshold_ends(pdf[measure].to_numpy(), limit, state[0])
        return ends, [carry]

    return mark


def tag_threshold_bars(tape: DataFrame, *, measure: str, threshold: float | str) -> DataFrame:
    """Label each trade with ``bar_id``; ``threshold`` is a constant or a per-instrument column.

    ``measure`` is the accumulated column; integer measures make bar edges exactly reproducible.
    """

    uses = [measure, threshold] if isinstance(threshold, str) else [measure]
    return _numbered(tape, threshold_marker(measure, threshold), [0.0], uses)


def threshold_bars(tape: DataFrame, *, measure: str, threshold: float | str) -> DataFrame:
    return _complete(tag_threshold_bars(tape, measure=measure, threshold=threshold))


def volume_bars(tape: DataFrame, *, threshold: float | str) -> DataFrame:
    return threshold_bars(tape, measure="qty", threshold=threshold)


def dollar_bars(tape: DataFrame, *, threshold: float | str, measure: str = "dollar") -> DataFrame:
    return threshold_bars(tape, measure=measure, threshold=threshold)


def trades_with_bar_id(tape: DataFrame, *, measure: str, threshold: float | str, compat: bool = True) -> DataFrame:
    """Trades of complete bars with their ``bar_id``.

    ``compat`` drops the highest id even when its last trade closed the bar exactly.  The tagged tape
    is stored once, so the fold is not repeated by the branches that read it.
    """
    tagged = reuse(tag_threshold_bars(tape, measure=measure, threshold=threshold))
    if compat:
        last = tagged.groupBy(*KEYS).agg(F.max("bar_id").alias("_m"))
    else:
        last = tagged.groupBy(*KEYS).agg(F.sum(F.col("is_end").cast("long")).alias("_m"))
    return tagged.join(last, list(KEYS)).where(F.col("bar_id") < F.col("_m")).drop("_m")


def adaptive_threshold(tape: DataFrame, *, target_bars: int, measure: str = "dollar") -> DataFrame:
    """Per-instrument threshold giving about ``target_bars`` bars; raises on a non-positive one."""
    limit = F.sum(measure) / F.lit(target_bars)
    return tape.groupBy(*KEYS).agg(
        F.when(limit > 0, limit)
        .otherwise(F.raise_error(F.concat(F.lit("non-positive threshold for "), F.first("instrument"))))
        .alias("threshold")
    )


# --------------------------------------------------------------------------- information-driven bars
def _smooth(prev: float | None, x: float, window: float) -> float:
    a = 2.0 / (window + 1.0)
    return x if prev is None else a * x + (1.0 - a) * prev


def imbalance_marker(flow: str, init: int, prev: int, floor: str):
    """Bars whose signed flow outgrows (expected length) x (expected flow per tick); the state holds a sketch of all past flow."""
    a = 2.0 / (init + 1.0)
    lags = np.subtract.outer(np.arange(256), np.arange(256))
    kernel = np.where(lags >= 0, a * (1.0 - a) ** np.maximum(lags, 0), 0.0)

    def first_bar(x: np.ndarray, theta: float, past: FlowHistory, span: float) -> tuple[int | None, float]:
        """Before any bar is complete the expectation is a new one at every tick."""
        seen, now = past.seen, past.average(init) if past.seen else None
        for at in range(0, len(x), 256):
            part = x[at : at + 256]
            n = np.arange(len(part))
            now = float(part[0]) if now is None else now
            mean = kernel[: len(part), : len(part)] @ part + (1.0 - a) ** (n + 1) * now
            flow_sum = theta + np.cumsum(part)
            goal = span * np.maximum(np.abs(mean) if floor == "abs" else mean, FLOOR)
            ok = (np.abs(flow_sum) >= goal) & (seen + at + n + 1 >= init)
            if ok.any():
                return at + int(ok.argmax()), 0.0
            theta, now = float(flow_sum[-1]), float(mean[-1])
        return None, theta

    def mark(pdf: pd.DataFrame, state):
        theta, ticks, span, goal, bars, length = state[:6]
        past, x = FlowHistory.of(state[6:]), pdf[flow].to_numpy(dtype=float)
        ends, at = np.zeros(len(x), dtype=bool), 0
        while at < len(x):
            if bars:
                i, sums = _first_hit(x[:, None], at, np.array([theta]), lambda c, g=goal: np.abs(c[:, 0]) >= g)
                theta = float(sums[0])
            else:
                i, theta = first_bar(x[at:], theta, past, span)
            if i is None:
                past.append(x[at:])
                ticks += len(x) - at
                break
            past.append(x[at : i + 1])
            ends[i] = True
            length = _smooth(length if bars else None, ticks + i + 1 - at, prev)
            goal = length * abs(_floored(past.average(max(1, int(prev * length))), floor))
            theta, ticks, span, bars, at = 0.0, 0.0, length, 1.0, i + 1
        return ends, [theta, ticks, span, goal, bars, length, *past.state()]

    return mark


def _floored(v: float, floor: str) -> float:
    return max(abs(v) if floor == "abs" else v, FLOOR)


def _imbalance_bars(tape: DataFrame, flow: Column, init: int, prev: int, floor: str) -> DataFrame:
    flowed = tape.withColumn("_flow", flow.cast("double"))
    state = [0.0, 0.0, float(init), 0.0, 0.0, 0.0]
    return _complete(_numbered(flowed, imbalance_marker("_flow", init, prev, floor), state, ["_flow"], forgets=False).drop("_flow"))


def tick_imbalance_bars(tape: DataFrame, *, init_ticks: int = 10, prev_bars: int = 3, floor: str = "signed") -> DataFrame:
    """Close when the signed tick count outgrows its expectation.

    ``floor='signed'`` floors a negative expected imbalance at 1e-6, so sell-dominated stretches
    close nearly every tick; ``'abs'`` uses its magnitude instead.
    """
    return _imbalance_bars(tape, F.col("side"), init_ticks, prev_bars, floor)


def volume_imbalance_bars(
    tape: DataFrame, *, init_ticks: int = 10, prev_bars: int = 3, floor: str = "signed", measure: str = "qty"
) -> DataFrame:
    """As tick imbalance with signed volume (``measure='dollar'``: dollar imbalance)."""
    return _imbalance_bars(tape, F.col("side") * F.col(measure), init_ticks, prev_bars, floor)


def run_marker(init: int, prev: int, measure: str | None):
    def expected(t: float, p: float, vb: float, vs: float) -> float:
        if measure is None:
            return max(t * max(p, 1 - p), FLOOR)
        return max(t * max(p * vb, (1 - p) * vs), FLOOR)

    def mark(pdf: pd.DataFrame, state):
        sums, (ticks, goal, bars, *means) = np.array(state[:2]), state[2:]
        side = pdf["side"].to_numpy()
        size = np.ones(len(side)) if measure is None else pdf[measure].to_numpy(dtype=float)
        x = np.column_stack((np.where(side == 1, size, 0.0), np.where(side == -1, size, 0.0)))
        ends, at = np.zeros(len(side), dtype=bool), 0
        if not bars:
            goal = expected(init, 0.5, 0.01, 0.01)
        while at < len(x):
            free = 0 if bars else max(0, int(init - ticks) - 1)  # the first bar has ``init`` ticks at least
            i, sums = _first_hit(x, at, sums, lambda c, g=goal: c.max(axis=1) >= g, free)
            if i is None:
                ticks += len(x) - at
                break
            ends[i] = True
            ticks += i + 1 - at
            per_tick = sums / ticks
            whole = per_tick.sum()
            share = per_tick[0] if measure is None else per_tick[0] / whole if whole > 0 else 0.5
            means = [_smooth(m if bars else None, float(v), prev) for m, v in zip(means, (ticks, share, *per_tick))]
            goal, bars, ticks, sums, at = expected(*means), 1.0, 0.0, np.zeros(2), i + 1
        return ends, [*sums.tolist(), ticks, goal, bars, *means]

    return mark


def tick_run_bars(tape: DataFrame, *, init_ticks: int = 10, prev_bars: int = 3) -> DataFrame:
    """Close when the count of the dominant side outgrows its expectation."""
    return _complete(_numbered(tape, run_marker(init_ticks, prev_bars, None), [0.0] * 9, ["side"]))


def volume_run_bars(tape: DataFrame, *, init_ticks: int = 10, prev_bars: int = 3, measure: str = "qty") -> DataFrame:
    """Close when the volume of the dominant side outgrows its expectation."""
    return _complete(_numbered(tape, run_marker(init_ticks, prev_bars, measure), [0.0] * 9, ["side", measure]))


# --------------------------------------------------------------------------- event sampling
def cusum_marker(value: str, h: float | str):
    def mark(pdf: pd.DataFrame, state):
        up, down, prev, seen = state
        limit = float(pdf[h].iloc[0]) if isinstance(h, str) else float(h)
        hit = np.zeros(len(pdf), dtype=bool)
        for i, v in enumerate(pdf[value].astype(float).tolist()):
            if seen:
                d = v - prev
                up, down = max(0.0, up + d), min(0.0, down + d)
                if up >= limit:
                    up, hit[i] = 0.0, True
                elif abs(down) >= limit:
                    down, hit[i] = 0.0, True
            prev, seen = v, 1.0
        return hit, [up, down, prev, seen]

    return mark


def cusum_filter(df: DataFrame, *, h: float | str, value: str = "close", keys=KEYS) -> DataFrame:
    """Rows at which a symmetric CUSUM of value changes reaches ``h`` (constant or column).

    Only the side that fires restarts; the first change is skipped.
    """
    mark = cusum_marker(value, h)

    def run(pdf: pd.DataFrame, state):
        hit, state = mark(pdf, state)
        return pdf[hit], state

    return fold(df, run, [0.0] * 4, df.schema, keys=keys).drop("_blk")


def sampling_threshold_audit(bars: DataFrame, grid: list[float]) -> DataFrame:
    """Per instrument and threshold: bar count, close and change statistics, event count and rate."""
    change = lagged(bars, {"_prev": F.col("close")}).withColumn("_d", F.col("close") - F.col("_prev"))
    stats = change.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_bars"),
        F.avg("close").alias("mean_close"),
        F.stddev_samp("close").alias("std_close"),
        F.avg(F.abs("_d")).alias("mean_abs_diff"),
        F.stddev_samp("_d").alias("std_diff"),
    )
    spread = bars.select(*KEYS, "pos", "close").withColumn("h", F.explode(F.array(*[F.lit(float(v)) for v in grid])))
    events = cusum_filter(spread, h="h", keys=(*KEYS, "h")).groupBy(*KEYS, "h").agg(F.count(F.lit(1)).alias("n_events"))
    return (
        stats.withColumn("h", F.explode(F.array(*[F.lit(float(v)) for v in grid])))
        .join(events, [*KEYS, "h"], "left")
        .withColumn("n_events", F.coalesce("n_events", F.lit(0)))
        .withColumn("event_rate", F.col("n_events") / F.col("n_bars"))
    )


def equivalent_threshold(audit: DataFrame, *, reference: str) -> DataFrame:
    """Threshold with the same meaning on each tape: ``h`` scaled by the ratio of change deviations."""
    ref = audit.where(F.col("instrument") == reference).select("h", F.col("std_diff").alias("_ref"))
    return audit.join(ref, "h").withColumn("h_equivalent", F.col("h") * F.col("std_diff") / F.col("_ref")).drop("_ref")


def threshold_candidates(bars: DataFrame, vol: DataFrame, *, fixed: float, k: float) -> DataFrame:
    """Candidate thresholds: fixed, mean close times mean volatility, k times mean volatility."""
    close = bars.groupBy(*KEYS).agg(F.avg("close").alias("_c"))
    return vol.groupBy(*KEYS).agg(F.avg("vol").alias("_v")).join(close, list(KEYS)).select(
        *KEYS,
        F.lit(float(fixed)).alias("h_fixed"),
        (F.col("_c") * F.col("_v")).alias("h_price"),
        (F.lit(float(k)) * F.col("_v")).alias("h_return"),
    )

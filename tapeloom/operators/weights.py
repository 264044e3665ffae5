"""Sample weights for overlapping labels: concurrency, uniqueness, attribution, decay, bootstrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.operators.labels import locate, range_aggregate
from tapeloom.plans.series import KEYS, div, lagged, position, running


def _sweep(bars: DataFrame, spans: DataFrame, weight: str | None = None) -> DataFrame:
    """Number of open spans on every bar: +1 at p0, -1 after p1, running total."""
    w = F.col(weight) if weight else F.lit(1)
    edges = (
        spans.select(*KEYS, F.explode(F.array(F.struct(F.col("p0").alias("pos"), w.alias("d")), F.struct((F.col("p1") + 1).alias("pos"), (-w).alias("d")))).alias("e"))
        .select(*KEYS, "e.pos", "e.d")
        .groupBy(*KEYS, "pos")
        .agg(F.sum("d").alias("_d"))
    )
    joined = bars.join(edges, [*KEYS, "pos"], "left")
    return running(joined, {"c": ("sum", F.coalesce("_d", F.lit(0)))}).drop("_d")


def concurrency(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Labels whose [t0, t1] covers each bar (open labels last to the final bar)."""
    return _sweep(bars.select(*KEYS, "pos", "ts", "close"), locate(bars, events))


def average_uniqueness(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Mean of 1/concurrency over each label's bars, as ``tw``."""
    spans = locate(bars, events)
    conc = _sweep(bars.select(*KEYS, "pos"), spans).withColumn("_u", div(F.lit(1.0), F.col("c")))
    sums = range_aggregate(conc, spans, {"_s": "_u"}, id_cols=["t0"])
    return sums.select(*KEYS, "t0", (F.col("_s") / F.col("n_bars")).alias("tw"))


def return_attribution(bars: DataFrame, events: DataFrame, *, scaled: bool = True) -> DataFrame:
    """|sum of log return / concurrency| over each label, scaled to average one per instrument."""
    spans = locate(bars, events)
    moves = lagged(bars.select(*KEYS, "pos", "close"), {"_prev": F.col("close")}).withColumn(
        "_lr", F.log("close") - F.log("_prev")
    )
    conc = _sweep(moves, spans).withColumn("_a", div(F.col("_lr"), F.col("c")))
    raw = range_aggregate(conc, spans, {"_s": "_a"}, id_cols=["t0"]).select(*KEYS, "t0", F.abs("_s").alias("w"))
    if not scaled:
        return raw
    total = raw.groupBy(*KEYS).agg(div(F.count(F.lit(1)), F.sum("w")).alias("_k"))
    return raw.join(total, list(KEYS)).withColumn("w", F.col("w") * F.col("_k")).drop("_k")


def time_decay(weights: DataFrame, *, last: float, tw: str = "tw") -> DataFrame:
    """Linear decay over cumulative uniqueness: newest 1, oldest ``last`` (negative: cut to zero)."""
    cum = running(position(weights, ["t0"]), {"_cum": ("sum", F.col(tw))})
    total = weights.groupBy(*KEYS).agg(F.sum(tw).alias("_tot"))
    slope = (1 - last) / F.col("_tot") if last >= 0 else 1 / ((last + 1) * F.col("_tot"))
    decayed = 1 - slope * F.col("_tot") + slope * F.col("_cum")
    return (
        cum.join(total, list(KEYS)).withColumn("decay", F.greatest(decayed, F.lit(0.0))).drop("_cum", "_tot", "pos")
    )


def indicator(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Sparse event x bar membership."""
    return locate(bars, events).select(*KEYS, "t0", F.explode(F.sequence("p0", "p1")).alias("pos"))


def indicator_uniqueness(bars: DataFrame, events: DataFrame, *, copies: str = "copies") -> DataFrame:
    """Mean uniqueness of each event when event ``i`` is present ``copies`` times."""
    spans = locate(bars, events)
    conc = _sweep(bars.select(*KEYS, "pos"), spans, copies).withColumn("_u", div(F.lit(1.0), F.col("c")))
    sums = range_aggregate(conc, spans.where(F.col(copies) > 0), {"_s": "_u"}, id_cols=["t0"])
    return sums.select(*KEYS, "t0", (F.col("_s") / F.col("n_bars")).alias("avg_u"))


def draw_probabilities(bars: DataFrame, events: DataFrame, *, copies: str = "copies") -> DataFrame:
    """Next-draw probability of every event given those already drawn (``copies`` times each)."""
    spans = locate(bars, events)
    conc = _sweep(bars.select(*KEYS, "pos"), spans, copies).withColumn("_u", 1 / (F.col("c") + 1))
    avg = range_aggregate(conc, spans, {"_s": "_u"}, id_cols=["t0"]).select(
        *KEYS, "t0", (F.col("_s") / F.col("n_bars")).alias("avg_u")
    )
    total = avg.groupBy(*KEYS).agg(F.sum("avg_u").alias("_t"))
    return avg.join(total, list(KEYS)).select(*KEYS, "t0", "avg_u", (F.col("avg_u") / F.col("_t")).alias("prob"))


# --------------------------------------------------------------------------- bootstrap
def _segments(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bars between neighbouring span edges are alike: lengths of these runs, and each span's first run and run after its last."""
    edges = np.unique(np.concatenate([lo, hi + 1]))
    return np.diff(edges), np.searchsorted(edges, lo), np.searchsorted(edges, hi + 1)


def _mean_over_spans(per_bar: np.ndarray, run: np.ndarray, first: np.ndarray, end: np.ndarray, n_bars: np.ndarray) -> np.ndarray:
    """Mean over each span (columns) of a value per run, one row per trial."""
    cum = np.zeros((len(per_bar), len(run) + 1))
    np.cumsum(per_bar * run, axis=1, out=cum[:, 1:])
    return (cum[:, end] - cum[:, first]) / n_bars


def _sequential_draws(lo: np.ndarray, hi: np.ndarray, n: int, rngs: list[np.random.Generator]) -> np.ndarray:
    """``n`` draws per trial (row), each event by its mean 1/(c+1) given the trial's draws before; trials advance side by side."""
    run, first, end = _segments(lo, hi)
    n_bars, at = np.maximum(hi - lo + 1, 1), np.arange(len(run))  # an event between two bars is never drawn
    inside = (at >= first[:, None]) & (at < end[:, None])
    count = np.zeros((len(rngs), len(run)))
    uniform = np.array([g.random(n) for g in rngs])
    picks = np.empty((len(rngs), n), np.int64)
    for i in range(n):
        cum = np.cumsum(_mean_over_spans(1.0 / (count + 1.0), run, first, end, n_bars), axis=1)
        picks[:, i] = (cum / cum[:, -1:] <= uniform[:, i : i + 1]).sum(axis=1)
        count += inside[picks[:, i]]
    return picks


def _draws_by_blocks(lo: np.ndarray, hi: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """``n`` draws over all events (sorted by ``lo``), each by its mean 1/(c+1) given all draws before. The block is chosen by its
    total and the event inside it; a draw changes only events that overlap it, and the totals of their blocks."""
    size = max(1, int(len(lo) ** 0.5))
    count = np.zeros(int(hi.max()) + 1, np.int64)
    reach = np.maximum.accumulate(hi)
    u = (hi >= lo).astype(float)  # an event between two bars has no bar and is never drawn
    if not u.any():
        return np.empty(0, np.int64)
    edges = np.arange(0, len(lo), size)
    total = np.add.reduceat(u, edges)
    picks = np.empty(n, np.int64)
    for i in range(n):
        cum = np.cumsum(total)
        x = rng.random() * cum[-1]
        b = min(int(np.searchsorted(cum, x, side="right")), len(cum) - 1)
        inside = np.cumsum(u[b * size : (b + 1) * size])
        k = b * size + min(int(np.searchsorted(inside, x - (cum[b - 1] if b else 0.0), side="right")), len(inside) - 1)
        picks[i] = k
        count[lo[k] : hi[k] + 1] += 1
        first, last = int(np.searchsorted(reach, lo[k])), int(np.searchsorted(lo, hi[k], side="right"))
        base = lo[first]
        sums = np.concatenate([[0.0], np.cumsum(1.0 / (count[base : reach[last - 1] + 1] + 1.0))])
        u[first:last] = (sums[hi[first:last] + 1 - base] - sums[lo[first:last] - base]) / np.maximum(hi[first:last] - lo[first:last] + 1, 1)
        for c in range(first // size, (last - 1) // size + 1):
            total[c] = u[c * size : (c + 1) * size].sum()
    return picks


def _mean_uniqueness(lo: np.ndarray, hi: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """Mean uniqueness of the drawn spans, one value per trial (row of ``picks``)."""
    run, first, end = _segments(lo, hi)
    step = np.zeros((len(picks), len(run) + 1))
    row = np.arange(len(picks))[:, None]
    np.add.at(step, (row, first[picks]), 1)
    np.add.at(step, (row, end[picks]), -1)
    c = np.cumsum(step, axis=1)[:, :-1]
    u = _mean_over_spans(np.where(c > 0, 1.0 / np.maximum(c, 1), 0.0), run, first, end, np.maximum(hi - lo + 1, 1))
    return np.take_along_axis(u, picks, axis=1).mean(axis=1)


def _windows(bars: DataFrame, events: DataFrame, max_events: int | None) -> DataFrame:
    """Spans in windows of at most ``max_events`` consecutive events, or window 0 with all of them."""
    spans = position(locate(bars, events).select(*KEYS, "t0", "p0", "p1"), ["t0", "p1"])
    return spans.withColumn("window", F.floor(F.col("pos") / max_events).cast("long") if max_events else F.lit(0).cast("long")).drop("pos")


def _rng(instrument: str, window: int, trial: int, seed: int) -> np.random.Generator:
    return np.random.default_rng(list(f"{instrument}|{window}|{trial}|{seed}".encode()))


def sequential_bootstrap(
    bars: DataFrame, events: DataFrame, *, max_events: int | None = None, trials: int = 1, length: int | None = None, seed: int = 7
) -> DataFrame:
    """Draws in order over all events of an instrument, each given all draws before it, so one task per instrument and trial. With
    ``max_events``, windows of so many consecutive events are drawn on their own instead."""
    schema = T.StructType.fromDDL("instrument string, window long, trial int, draw int, t0 timestamp")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t0", "p1"], ignore_index=True)
        base = pdf["p0"].min()
        lo, hi = (pdf["p0"] - base).to_numpy(), (pdf["p1"] - base).to_numpy()
        picks = _draws_by_blocks(lo, hi, length or len(pdf), _rng(*(pdf[c].iloc[0] for c in ("instrument", "window", "trial")), seed))
        return pd.DataFrame(
            {
                "instrument": pdf["instrument"].iloc[0],
                "window": pdf["window"].iloc[0],
                "trial": pdf["trial"].iloc[0],
                "draw": np.arange(len(picks)),
                "t0": pdf["t0"].to_numpy()[picks],
            }
        )

    groups = _windows(bars, events, max_events).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    return groups.groupBy("instrument", "window", "trial").applyInPandas(run, schema)


def bootstrap_comparison(
    bars: DataFrame, events: DataFrame, *, max_events: int = 200, trials: int = 20, seed: int = 7
) -> DataFrame:
    """Mean uniqueness of standard against sequential draws, per instrument and window; one step draws all trials of a window."""
    schema = T.StructType.fromDDL("instrument string, window long, n_trials long, mean_std double, mean_seq double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t0", "p1"], ignore_index=True)
        base, name, window = pdf["p0"].min(), pdf["instrument"].iloc[0], pdf["window"].iloc[0]
        lo, hi = (pdf["p0"] - base).to_numpy(), (pdf["p1"] - base).to_numpy()
        rngs = [_rng(name, window, t, seed) for t in range(trials)]
        plain = np.array([g.integers(0, len(lo), len(lo)) for g in rngs])
        drawn = _sequential_draws(lo, hi, len(lo), rngs)
        means = [[_mean_uniqueness(lo, hi, p).mean()] for p in (plain, drawn)]
        return pd.DataFrame({"instrument": [name], "window": [window], "n_trials": [trials], "mean_std": means[0], "mean_seq": means[1]})

    return _windows(bars, events, max_events).groupBy("instrument", "window").applyInPandas(run, schema)

"""End-to-end jobs: tape -> bars -> labels -> weights -> features -> evidence, keyed by instrument."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators import bars as B
from tapeloom.operators import labels as L
from tapeloom.operators import micro as M
from tapeloom.operators import weights as W
from tapeloom.operators.fracdiff import fracdiff_feature
from tapeloom.plans.series import KEYS, reuse


@dataclass(frozen=True)
class LabelConfig:
    target_bars: int = 500
    cusum_h: float = 313.0
    vol_span: int = 100
    pt_sl: tuple[float, float] = (1.0, 1.0)
    min_ret: float = 0.005
    num_days: float = 3
    measure: str = "dollar"


@dataclass
class Labelled:
    trades: DataFrame
    bars: DataFrame
    events: DataFrame
    w: DataFrame
    tw: DataFrame


def _need_rows(df: DataFrame, stage: str, check: bool) -> DataFrame:
    df = reuse(df)
    if check and df.isEmpty():
        raise ValueError(f"stage {stage} produced no rows")
    return df


def bars_and_labels(tape: DataFrame, cfg: LabelConfig, *, check: bool = False) -> Labelled:
    """Adaptive dollar bars, CUSUM events, triple-barrier labels and both weights.

    Bars and events feed several branches and are kept; ``check`` names the first empty stage.
    """
    limits = B.adaptive_threshold(tape, target_bars=cfg.target_bars, measure=cfg.measure)
    trades = B.trades_with_bar_id(
        tape.join(limits, list(KEYS)), measure=cfg.measure, threshold="threshold", compat=False
    ).drop("threshold")
    bars = _need_rows(B.bar_aggregates(trades), "bars", check)
    sampled = B.cusum_filter(bars.select(*KEYS, "pos", "ts", "close"), h=cfg.cusum_h)
    sampled = _need_rows(sampled.select(*KEYS, F.col("ts").alias("t0")), "events", check)
    vol = _need_rows(L.daily_volatility(bars, span=cfg.vol_span), "volatility", check)
    found = L.triple_barrier_events(bars, sampled, vol, pt_sl=cfg.pt_sl, min_ret=cfg.min_ret, num_days=cfg.num_days)
    events = _need_rows(L.label_returns(bars, found), "labels", check)
    return Labelled(trades, bars, events, W.return_attribution(bars, events), W.average_uniqueness(bars, events))


def enriched_events(data: Labelled, *, thres: float = 0.01, features: Sequence[str] = M.FEATURES) -> DataFrame:
    """Events joined to bar features and the stationary fractional difference; incomplete rows dropped."""
    table = M.feature_table(data.bars, data.trades).join(
        fracdiff_feature(data.bars, thres=thres).select(*KEYS, "pos", "fracdiff"), [*KEYS, "pos"], "left"
    )
    named = table.select(*KEYS, F.col("ts").alias("t0"), F.col("pos").alias("bar_pos"), "fracdiff", *features)
    return data.events.join(named, [*KEYS, "t0"], "left").dropna(subset=["fracdiff", *features])


def enrichment_counts(data: Labelled, enriched: DataFrame) -> DataFrame:
    before = data.events.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_before"))
    after = enriched.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_after"))
    return before.join(after, list(KEYS), "left").withColumn("n_after", F.coalesce("n_after", F.lit(0)))


def events_without_features(events: DataFrame, features: DataFrame) -> DataFrame:
    """Events whose time is missing from the feature index."""
    return events.join(features.select(*KEYS, F.col("ts").alias("t0")), [*KEYS, "t0"], "left_anti")


def aligned(events: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Events with their uniqueness / weight; a missing value fails the job."""
    out = events.join(values.select(*KEYS, "t0", column), [*KEYS, "t0"], "left")
    return out.withColumn(
        column,
        F.when(F.col(column).isNull(), F.raise_error(F.concat(F.lit(f"no {column} for event of "), F.col("instrument")))).otherwise(F.col(column)),
    )


# --------------------------------------------------------------------------- lifecycle and oversight
def lifecycle_stage(
    df: DataFrame, *, min_t: float = 30, min_trials: int = 10, paper: float = 0.5, graduate: float = 0.95
) -> DataFrame:
    small = (F.col("t_eff") < min_t) | (F.col("n_trials") < min_trials)
    return df.withColumns(
        {
            "small_sample": small,
            "stage": F.when(small | (F.col("dsr") < paper), "EMBARGO").when(F.col("dsr") < graduate, "PAPER_TRADING").otherwise("GRADUATION_CANDIDATE"),
        }
    )


def circuit_breaker(df: DataFrame, *, max_pbo: float = 0.5, max_fail: float = 0.5) -> DataFrame:
    reasons = F.array_compact(
        F.array(F.when(F.col("pbo") > max_pbo, "pbo"), F.when(F.col("p_fail") > max_fail, "p_fail"))
    )
    return df.withColumn("reasons", reasons).withColumn("triggered", F.size("reasons") > 0)


def confidence_band(df: DataFrame, *, min_t: float = 30, min_trials: int = 10) -> DataFrame:
    small = (F.col("t_eff") < min_t) | (F.col("n_trials") < min_trials)
    d = F.col("dsr")
    return df.withColumn(
        "confidence",
        F.when(d.isNull(), "undetermined").when(small, "unreliable").when(d >= 0.95, "high").when(d >= 0.5, "moderate").otherwise("low"),
    )


# --------------------------------------------------------------------------- sweeps and checks
def sweep(spark: SparkSession, configs: dict[str, LabelConfig], run: Callable[[LabelConfig], DataFrame]) -> DataFrame:
    """One row of facts per configuration over a shared frozen tape; a failing point becomes a row too."""
    fields = "config string, status string, error string, n_bars long, n_events long, tw_mean double, t_eff double"
    rows = []
    for name, cfg in configs.items():
        try:
            r = run(cfg).first()
            rows.append((name, "ok", None, r["n_bars"], r["n_events"], r["tw_mean"], r["t_eff"]))
        except Exception as e:  # noqa: BLE001 - the point is recorded and the sweep goes on
            rows.append((name, "failed", f"{type(e).__name__}: {str(e)[:200]}", None, None, None, None))
    return spark.createDataFrame(rows, fields)


def sweep_point(tape: DataFrame, cfg: LabelConfig) -> DataFrame:
    data = bars_and_labels(tape, cfg, check=True)
    n = data.bars.agg(F.count(F.lit(1)).alias("n_bars"), F.lit(1).alias("_k"))
    tw = data.tw.agg(F.count(F.lit(1)).alias("n_events"), F.avg("tw").alias("tw_mean"), F.sum("tw").alias("t_eff"), F.lit(1).alias("_k"))
    return n.join(tw, "_k").drop("_k")


def degenerate_features(table: DataFrame, features: Sequence[str], *, tol: float = 1e-10) -> DataFrame:
    """Deviation of every feature and whether it is (nearly) constant."""
    stats = table.agg(*[F.stddev_samp(f).alias(f) for f in features])
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("std")) for f in features])
    long = stats.select(F.explode(items).alias("_f")).select("_f.*")
    return long.withColumn("degenerate", F.coalesce(F.col("std") < tol, F.lit(True)))


def class_balance(table: DataFrame, *, label: str = "bin", pred: str | None = None) -> DataFrame:
    """Label (and prediction) counts per instrument, min/max ratio, fewer-than-two-classes flag."""
    cols = [label] + ([pred] if pred else [])
    items = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("int").alias("cls")) for c in cols])
    counts = table.select(*KEYS, F.explode(items).alias("_i")).groupBy(*KEYS, "_i.kind", "_i.cls").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*KEYS, "kind").agg(
        F.count(F.lit(1)).alias("n_classes"), (F.min("n") / F.max("n")).alias("balance"), (F.count(F.lit(1)) < 2).alias("single_class")
    )

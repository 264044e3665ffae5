"""Parameter sweep over one tape: the configuration is part of the series key, so all points share each step.

A series is named by its configuration and instrument and every operator runs once for all of them. Bars depend on the measure
and the target count only: points that agree in these share their bars, bar features and (per span) volatilities. Models of all
points are fitted together, one scan per Newton step; the steps of the bet size are columns of one pass over the bars.
Nothing is decided on the driver but the plan, which grows with the distinct measures and volatility spans, not with the points.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators import bars as B
from tapeloom.operators import bets
from tapeloom.operators import cv as V
from tapeloom.operators import labels as L
from tapeloom.operators import micro as M
from tapeloom.operators import weights as W
from tapeloom.operators.cell_fits import out_of_sample_cells
from tapeloom.operators.fracdiff import fracdiff_feature
from tapeloom.operators.stats import evaluate_overfitting
from tapeloom.plans.evidence import LabelConfig
from tapeloom.plans.series import KEYS, asof, lagged, position, reuse
from tapeloom.sources.artefacts import training_table

SEP = "\x1f"
FEATURES = ("fracdiff", *M.FEATURES)
STAGES = (("n_bars", "bars"), ("n_sampled", "events"), ("n_events", "labels"), ("n_training", "features"), ("pbo", "trials"))


def _series(head: Column | str, instrument: Column | str = "instrument") -> Column:
    return F.concat_ws(SEP, head, instrument).alias("instrument")


def _head(c: str = "instrument") -> Column:
    return F.substring_index(c, SEP, 1)


def _rest(c: str = "instrument") -> Column:
    return F.substring(F.col(c), F.locate(SEP, c) + 1, F.lit(1 << 30))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def invalid(cfg: LabelConfig, measures: Sequence[str]) -> str | None:
    """Why a configuration cannot run, before any data is read."""
    if cfg.measure not in measures:
        return f"no column {cfg.measure}"
    for name in ("target_bars", "cusum_h", "vol_span", "num_days"):
        if not getattr(cfg, name) > 0:
            return f"{name} must be positive"
    return "barriers must not be negative" if min(cfg.pt_sl) < 0 else None


class Sweep:
    """Tables of all configurations, keyed by ``instrument`` = configuration name, separator, instrument."""

    def __init__(self, tape: DataFrame, configs: dict[str, LabelConfig]):
        if any(SEP in c for c in configs):
            raise ValueError("a configuration's name holds the separator")
        self.tape, self.configs = tape, configs
        self.errors = {c: e for c, cfg in configs.items() if (e := invalid(cfg, tape.columns))}
        good = {c: cfg for c, cfg in configs.items() if c not in self.errors}
        self.variants = list(dict.fromkeys((cfg.measure, cfg.target_bars) for cfg in good.values()))
        rows = [
            (c, str(self.variants.index((cfg.measure, cfg.target_bars))), float(cfg.cusum_h), int(cfg.vol_span), *map(float, cfg.pt_sl), float(cfg.min_ret), float(cfg.num_days))
            for c, cfg in good.items()
        ]
        fields = "config string, variant string, h double, span int, pt double, sl double, min_ret double, days double"
        #: One row per configuration given by the caller, so its size is known.
        self.points = tape.sparkSession.createDataFrame(rows, fields)
        self.spans = sorted({cfg.vol_span for cfg in good.values()})

    def _spread(self, variants: DataFrame, *settings: str, where: Column | None = None) -> DataFrame:
        """Rows of a variant's series, once for each of its configurations."""
        points = self.points if where is None else self.points.where(where)
        keyed = variants.withColumns({"variant": _head(), "_i": _rest()}).drop("instrument")
        out = keyed.join(F.broadcast(points.select("config", "variant", *settings)), "variant")
        return out.withColumn("instrument", _series("config", "_i")).drop("variant", "_i", "config")

    def label(self) -> None:
        """Bars, events, labels and both weights of all points."""
        tagged = []
        for measure in dict.fromkeys(m for m, _ in self.variants):
            targets = [F.struct(F.lit(str(i)).alias("v"), F.lit(t).alias("target")) for i, (m, t) in enumerate(self.variants) if m == measure]
            total = self.tape.groupBy(*KEYS).agg(F.sum(measure).alias("_sum")).where(F.col("_sum") > 0)
            limits = total.withColumn("_v", F.explode(F.array(*targets))).select(*KEYS, "_v.v", (F.col("_sum") / F.col("_v.target")).alias("threshold"))
            spread = self.tape.join(limits, list(KEYS)).withColumn("instrument", _series("v")).drop("v")
            tagged.append(B.trades_with_bar_id(spread, measure=measure, threshold="threshold", compat=False).drop("threshold"))
        self.trades = _union(tagged)
        self.variant_bars = reuse(B.bar_aggregates(self.trades))
        self.bars = reuse(self._spread(self.variant_bars, "h", "pt", "sl", "min_ret", "days"))
        settings = ("pt", "sl", "min_ret", "days")
        sampled = B.cusum_filter(self.bars.select(*KEYS, "pos", "ts", "close", "h", *settings), h="h")
        self.sampled = reuse(sampled.select(*KEYS, F.col("ts").alias("t0"), *settings))
        vols = [self._spread(L.daily_volatility(self.variant_bars, span=s), where=F.col("span") == s) for s in self.spans]
        plain = self.bars.drop("h", *settings)
        found = L.triple_barrier_events(plain, self.sampled, reuse(_union(vols)), pt_sl=("pt", "sl"), min_ret="min_ret", num_days="days")
        self.events = reuse(L.label_returns(plain, found))
        self.tw = reuse(W.average_uniqueness(plain, self.events))
        self.w = W.return_attribution(plain, self.events)

    def train(self, *, thres: float, features: Sequence[str], n_splits: int, pct_embargo: float) -> DataFrame:
        """Cross-validation membership of the enriched events; ``split`` counts on over the configurations."""
        table = M.feature_table(self.variant_bars, self.trades).join(
            fracdiff_feature(self.variant_bars, thres=thres).select(*KEYS, "pos", "fracdiff"), [*KEYS, "pos"], "left"
        )
        named = table.select(*KEYS, F.col("ts").alias("t0"), "fracdiff", *M.FEATURES).dropna()
        enriched = self.events.join(self._spread(named), [*KEYS, "t0"])
        rows = training_table(enriched, self.w, features).withColumn("bin", (F.col("bin") > 0).cast("int"))
        self.training = reuse(position(rows, ["t0"]))
        number = F.create_map(*[F.lit(x) for c in enumerate(self.configs) for x in reversed(c)])
        members = V.purged_kfold(self.training, n_splits=n_splits, pct_embargo=pct_embargo)
        return reuse(members.withColumn("split", (F.col("split") + number[_head()] * n_splits).cast("int")))

    def trials(self, members: DataFrame, *, features: Sequence[str], regs: Sequence[float], steps: Sequence[float], n_splits: int) -> DataFrame:
        """P&L on bars of every (ridge, step) of each series: ``(study, trial, pos, pnl)``."""
        candidates = {f"reg={g:g}": (list(features), g) for g in regs}
        splits = range(len(self.configs) * n_splits)
        oos = out_of_sample_cells(members, candidates, splits=splits, name="reg")
        sides = oos.select(_series("reg"), "t0", "t1", "prob", F.when(F.col("pred") == 1, 1).otherwise(-1).alias("pred"))
        signals = reuse(bets.average_active(bets.probability_signal(sides, n_classes=2)))
        predicted = signals.select(*KEYS).distinct().select(F.col("instrument").alias("_k"), _rest().alias("instrument"))
        bars = self.bars.select(*KEYS, "pos", "ts", "close").join(predicted, list(KEYS)).drop("instrument").withColumnRenamed("_k", "instrument")
        held = asof(bars, signals, {"position": "signal"}, left_on=L.us("ts"), right_on=L.us("t"))
        moved = lagged(held, {"_pos": F.col("position"), "_c": F.col("close")})
        gain = F.coalesce(F.col("close") / F.col("_c") - 1, F.lit(0.0))
        item = [F.struct(F.lit(f",step={s:g}").alias("step"), (bets.stepped(F.coalesce("_pos", F.lit(0.0)), s) * gain + F.lit(0.0)).alias("pnl")) for s in steps]
        long = moved.select(_head().alias("_reg"), _rest().alias("study"), "pos", F.explode(F.array(*item)).alias("_t"))
        return reuse(long.select("study", F.concat("_reg", "_t.step").alias("trial"), "pos", "_t.pnl"))

    def label_facts(self) -> DataFrame:
        """Per series: bars, sampled and labelled events, mean and sum of the uniqueness."""
        count = lambda df, name: df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias(name))
        tw = self.tw.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_events"), F.avg("tw").alias("tw_mean"), F.sum("tw").alias("t_eff"))
        return count(self.bars, "n_bars").join(count(self.sampled, "n_sampled"), list(KEYS), "left").join(tw, list(KEYS), "left")

    def with_status(self, facts: DataFrame, stages: Sequence[tuple[str, str]]) -> DataFrame:
        """One row per configuration and instrument of the tape; the first stage without rows is the error of a failed one."""
        names = [F.struct(F.lit(c).alias("config"), F.lit(self.errors.get(c)).cast("string").alias("error")) for c in self.configs]
        grid = self.tape.select(*KEYS).distinct().select(F.explode(F.array(*names)).alias("_c"), *KEYS).select("_c.config", "_c.error", *KEYS)
        split = facts.select(_head().alias("config"), _rest().alias("_i"), *[c for c in facts.columns if c not in KEYS]).withColumnRenamed("_i", "instrument")
        out = grid.join(split, ["config", *KEYS], "left")
        empty = F.coalesce("error", *[F.when(F.col(c).isNull(), F.lit(f"stage {stage} produced no rows")) for c, stage in stages])
        out = out.withColumn("error", empty)
        return out.select("config", *KEYS, F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"), "error", *[c for c in facts.columns if c not in KEYS])


def label_sweep(tape: DataFrame, configs: dict[str, LabelConfig]) -> DataFrame:
    """Facts of bars, events and uniqueness per configuration and instrument."""
    s = Sweep(tape, configs)
    if len(s.errors) == len(configs):
        return s.with_status(tape.select(*KEYS).limit(0), ())
    s.label()
    return s.with_status(s.label_facts(), STAGES[:3])


def evidence_sweep(
    tape: DataFrame, configs: dict[str, LabelConfig], *, features: Sequence[str] = FEATURES, thres: float = 0.01, n_splits: int = 3, pct_embargo: float = 0.01,
    regs: Sequence[float] = (0.001, 0.01, 0.1, 1.0), steps: Sequence[float] = (0.05, 0.1, 0.15, 0.2, 0.25), blocks: int = 8,
) -> DataFrame:
    """Label facts with trial evidence: best trial, its Sharpe ratio, probability of overfitting and deflated Sharpe ratio."""
    s = Sweep(tape, configs)
    if len(s.errors) == len(configs):
        return s.with_status(tape.select(*KEYS).limit(0), ())
    s.label()
    members = s.train(thres=thres, features=features, n_splits=n_splits, pct_embargo=pct_embargo)
    trials = s.trials(members, features=features, regs=regs, steps=steps, n_splits=n_splits)
    used = s.tw.join(s.training.select(*KEYS, "t0"), [*KEYS, "t0"])
    found = evaluate_overfitting(trials, used.select(F.col("instrument").alias("study"), "tw"), blocks=blocks)
    found = found.select(F.col("study").alias("instrument"), "n_trials", "best_trial", "sr_hat", F.col("t_eff").alias("t_eff_bets"), "pbo", "dsr")
    rows = s.training.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_training"))
    facts = s.label_facts().join(rows, list(KEYS), "left").join(found, list(KEYS), "left")
    return s.with_status(facts, STAGES)

"""Cross-validation, importance, tuning, assembly and oversight."""

from __future__ import annotations

from dataclasses import replace
from itertools import combinations

from pyspark.sql import functions as F

from tapeloom.catalog import strategy_queries as Q
from tapeloom.catalog.base_sql import view, with_views
from tapeloom.catalog.feature_queries import feature_views, fracdiff_views
from tapeloom.catalog.label_queries import T0, T0_SQL, T1, T1_SQL, label_views
from tapeloom.catalog.registry import query
from tapeloom.catalog.tape_queries import US, US_SQL, cusum_views, threshold_views
from tapeloom.operators import bets as B
from tapeloom.operators import cv as V
from tapeloom.operators import importance as I
from tapeloom.operators import micro as M
from tapeloom.operators import risk as K_R
from tapeloom.operators import ticks as K
from tapeloom.operators.cell_fits import out_of_sample_cells
from tapeloom.operators.fracdiff import ffd_grid
from tapeloom.operators.stats import sharpe_by
from tapeloom.plans import evidence as E
from tapeloom.plans.series import position, reuse
from tapeloom.plans.sweep import evidence_sweep, label_sweep
from tapeloom.sources import artefacts as A
from tapeloom.sources import canonical as C
from tapeloom.sources.storage import scratch

CFG = E.LabelConfig(target_bars=60, cusum_h=40.0, vol_span=20, pt_sl=(0.3, 0.1), min_ret=0.01, num_days=2, measure="cents")


def r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


# --------------------------------------------------------------------------- membership
view("obs", "SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY t0, event_id) - 1 AS pos, count(*) OVER (PARTITION BY instrument) AS n FROM intervals", "intervals")


def facts_views(p: str, fold: str) -> None:
    view(
        f"{p}_facts",
        f"""
SELECT f.*, (SELECT min(o.pos) FROM obs o WHERE o.instrument = f.instrument AND o.t0 >= f.last_t1) AS nextpos FROM (
  SELECT instrument, {fold} AS fold, min(pos) AS lo, max(pos) + 1 AS hi, min(t0) AS first_t0, max(t1) AS last_t1, any_value(n) AS n FROM obs GROUP BY 1, 2) f
""",
        "obs",
    )


K5 = 5
facts_views("kf", f"CASE WHEN pos < (n % {K5}) * (n // {K5} + 1) THEN pos // (n // {K5} + 1) ELSE n % {K5} + (pos - (n % {K5}) * (n // {K5} + 1)) // (n // {K5}) END")
_SAFE = "(coalesce(o.t1 <= f.first_t0, false) OR coalesce(o.pos >= f.nextpos + CAST(floor(f.n * 0.01::DOUBLE) AS BIGINT), false))"
view(
    "kfm",
    f"""
SELECT * FROM (SELECT o.instrument, o.pos, o.value, f.fold AS split, CASE WHEN o.pos >= f.lo AND o.pos < f.hi THEN 'test' WHEN {_SAFE} THEN 'train' END AS role
FROM obs o JOIN kf_facts f ON f.instrument = o.instrument) WHERE role IS NOT NULL
""",
    "kf_facts",
)


def obs(spark, d):
    return reuse(position(C.intervals(spark, d), ["t0", "event_id"]))


@query("cv1_purged_kfold", with_views("SELECT instrument, CAST(split AS INTEGER) AS split, pos, role FROM kfm", "kfm"))
def cv1(spark, d):
    return V.purged_kfold(obs(spark, d), n_splits=K5, pct_embargo=0.01).select("instrument", "split", "pos", "role")


@query(
    "cv2_fold_report",
    with_views(
        "SELECT instrument, CAST(split AS INTEGER) AS split, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test, round(sum(CASE WHEN role = 'train' THEN value ELSE 0 END), 2) AS train_weight FROM kfm GROUP BY 1, 2",
        "kfm",
    ),
)
def cv2(spark, d):
    return V.fold_report(V.purged_kfold(obs(spark, d), n_splits=K5, pct_embargo=0.01), weight="value").select(
        "instrument", "split", "n_train", "n_test", r("train_weight", 2)
    )


NG, KT = 6, 2
_GRP = f"least(pos // (n // {NG}), {NG - 1})"
facts_views("cg", _GRP)


@query(
    "cv3_group_partition",
    with_views(f"SELECT instrument, CAST({_GRP} AS INTEGER) AS grp, count(*) AS n, min(pos) AS lo FROM obs GROUP BY 1, 2", "obs"),
)
def cv3(spark, d):
    return V.with_groups(obs(spark, d), n_groups=NG).groupBy("instrument", "grp").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("lo"))


_SPLITS = list(combinations(range(NG), KT))
view("splits", " UNION ALL ".join(f"SELECT {i} AS split, {g} AS grp" for i, s in enumerate(_SPLITS) for g in s))
view("paths", "SELECT *, row_number() OVER (PARTITION BY grp ORDER BY split) AS path FROM splits", "splits")


@query(
    "cv5_path_assignment",
    with_views(
        f"SELECT o.instrument, CAST(p.split AS INTEGER) AS split, CAST(p.grp AS INTEGER) AS grp, CAST(p.path AS INTEGER) AS path, count(*) AS n FROM obs o JOIN paths p ON p.grp = {_GRP.replace('pos', 'o.pos').replace('(n ', '(o.n ')} GROUP BY 1, 2, 3, 4",
        "obs", "paths",
    ),
)
def cv5(spark, d):
    sizes = V.with_groups(obs(spark, d), n_groups=NG).groupBy("instrument", "grp").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(V.path_assignment(spark, n_groups=NG, k=KT), "grp").select("instrument", "split", "grp", "path", "n")


@query(
    "cv4_splits_and_paths",
    with_views(
        f"SELECT instrument, count(DISTINCT split) AS n_splits, CAST(max(path) AS INTEGER) AS n_paths, CAST(min(first_test) AS INTEGER) AS first_group, CAST(max(first_test) AS INTEGER) AS last_first_group FROM (SELECT DISTINCT instrument FROM obs), (SELECT split, path, min(grp) OVER (PARTITION BY split) AS first_test FROM paths) GROUP BY 1",
        "obs", "paths",
    ),
)
def cv4(spark, d):
    table = V.path_assignment(spark, n_groups=NG, k=KT)
    first = table.groupBy("split").agg(F.min("grp").alias("_f"))
    grouped = V.with_groups(obs(spark, d), n_groups=NG).select("instrument", "grp").distinct()
    return grouped.join(table.join(first, "split"), "grp").groupBy("instrument").agg(
        F.countDistinct("split").alias("n_splits"), F.max("path").alias("n_paths"), F.min("_f").alias("first_group"), F.max("_f").alias("last_first_group")
    )


view(
    "cpm",
    f"""
SELECT o.instrument, o.pos, o.split, CASE WHEN bool_or(o.own = f.fold) THEN 'test' WHEN bool_and({_SAFE}) THEN 'train' END AS role
FROM (SELECT obs.*, s.split, s.grp, {_GRP} AS own FROM obs CROSS JOIN splits s) o JOIN cg_facts f ON f.instrument = o.instrument AND f.fold = o.grp
GROUP BY 1, 2, 3
""",
    "obs", "splits", "cg_facts",
)


@query(
    "cv6_cpcv_membership",
    with_views(
        "SELECT instrument, CAST(split AS INTEGER) AS split, role, count(*) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos, CAST(sum(pos * pos) AS BIGINT) AS sum_sq FROM cpm WHERE role IS NOT NULL GROUP BY 1, 2, 3",
        "cpm",
    ),
)
def cv6(spark, d):
    m = V.cpcv_membership(obs(spark, d), n_groups=NG, k=KT, pct_embargo=0.01)
    return m.groupBy("instrument", "split", "role").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pos").alias("sum_pos"), F.sum(F.col("pos") * F.col("pos")).alias("sum_sq")
    )


# --------------------------------------------------------------------------- labelled bars
threshold_views("pbars", "cents", "(SELECT CAST(sum(t2.cents) AS DOUBLE) / 60 FROM ticks t2 WHERE t2.instrument = ticks.instrument)")
cusum_views("pev", "pbars", "close", "40::DOUBLE")
label_views("p", "pbars", "pev", beta="(1 - 2.0/21.0)::DOUBLE", pt=0.3, sl=0.1, min_ret=0.01, days=2)
feature_views("pf", "pbars_tag", "pbars")
fracdiff_views("pfd_", "pbars")
view(
    "penr",
    "SELECT w.instrument, w.t0, w.t1, w.tw, w.w, CAST(sign(w.ret) AS INTEGER) AS bin, f.pos AS bar_pos, g.value AS fracdiff, "
    + ", ".join(f"f.{c}" for c in M.FEATURES)
    + " FROM p_weights w JOIN pf_features f ON f.instrument = w.instrument AND f.ts = w.t0 JOIN (SELECT g0.* FROM pfd_grid g0 JOIN (SELECT instrument, min(CASE WHEN p_value < 0.05 THEN d END) AS d FROM pfd_adf GROUP BY 1) m USING (instrument, d)) g"
    + " ON g.instrument = f.instrument AND g.pos = f.pos WHERE g.value IS NOT NULL AND "
    + " AND ".join(f"f.{c} IS NOT NULL" for c in M.FEATURES),
    "p_weights", "pf_features", "pfd_adf", "pfd_grid",
)


def labelled(spark, d) -> E.Labelled:
    return E.bars_and_labels(C.ticks(spark, d), CFG)


@query(
    "pip1_preprocess",
    with_views(
        f"SELECT instrument, trade_id, pos, {US_SQL}, side, round(dollar, 2) AS dollar, round(coalesce(price - lag(price) OVER (PARTITION BY instrument ORDER BY pos), 0) + 3e-10, 6) AS delta FROM ("
        "SELECT *, CASE WHEN is_buyer_maker THEN -1 ELSE 1 END AS side, price * qty AS dollar, row_number() OVER (PARTITION BY instrument ORDER BY ts, trade_id) - 1 AS pos FROM raw_clean)",
        "raw_clean",
    ),
)
def pip1(spark, d):
    raw = K.dedupe_trades(C.raw_tape(spark, d), order=("ts", "part", "qty", "quote_qty"))
    raw = raw.select("instrument", "trade_id", "ts", "price", "qty", "is_buyer_maker")  # every ordered step writes what it is given
    return K.preprocess_trades(raw).select("instrument", "trade_id", "pos", US(), "side", r("dollar", 2), F.round(F.col("delta") + 3e-10, 6).alias("delta"))


@query(
    "pip2_bars_labels_weights",
    with_views(
        f"SELECT instrument, {T0_SQL}, {T1_SQL}, round(trgt, 6) AS trgt, round(ret, 6) AS ret, CAST(sign(ret) AS INTEGER) AS bin, round(w, 6) AS w, round(tw, 6) AS tw FROM p_weights",
        "p_weights",
    ),
)
def pip2(spark, d):
    x = labelled(spark, d)
    return x.events.join(x.w, ["instrument", "t0"]).join(x.tw, ["instrument", "t0"]).select(
        "instrument", T0(), T1(), r("trgt"), r("ret"), "bin", r("w"), r("tw")
    )


def enriched(spark, d):
    x = labelled(spark, d)
    return x, reuse(E.enriched_events(x))


_COLS = ["fracdiff", *M.FEATURES]
_SCALE = {"amihud_lambda_20bar": 1e6}


@query(
    "pip3_enriched_events",
    with_views(
        f"SELECT instrument, {T0_SQL}, bin, "
        + ", ".join(f"round({c}{' * 1e6' if c in _SCALE else ''} + 3e-10, 5) AS {c}" for c in _COLS)
        + " FROM penr",
        "penr",
    ),
)
def pip3(spark, d):
    _, e = enriched(spark, d)
    return e.select("instrument", T0(), "bin", *[F.round(F.col(c) * F.lit(_SCALE.get(c, 1.0)) + 3e-10, 5).alias(c) for c in _COLS])


@query(
    "pip3_enrichment_counts",
    with_views(
        "SELECT instrument, a.n AS n_before, coalesce(b.n, 0) AS n_after FROM (SELECT instrument, count(*) AS n FROM p_weights GROUP BY 1) a LEFT JOIN (SELECT instrument, count(*) AS n FROM penr GROUP BY 1) b USING (instrument)",
        "penr",
    ),
)
def pip3c(spark, d):
    x, e = enriched(spark, d)
    return E.enrichment_counts(x, e)


@query(
    "pip4_events_without_features",
    with_views(
        f"SELECT instrument, {T0_SQL} FROM p_weights w WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM pfd_grid WHERE d = 0.5) g JOIN pbars b USING (instrument, pos) WHERE g.instrument = w.instrument AND b.ts = w.t0)",
        "p_weights", "pfd_grid",
    ),
)
def pip4(spark, d):
    x = labelled(spark, d)
    logs = x.bars.select("instrument", "pos", F.log("close").alias("lp"))
    feats = ffd_grid(logs, x="lp", ds=[0.5], thres=0.01).join(x.bars.select("instrument", "pos", "ts"), ["instrument", "pos"])
    return E.events_without_features(x.events, feats).select("instrument", T0())


@query("pip5_aligned_uniqueness", with_views(f"SELECT instrument, {T0_SQL}, round(tw, 6) AS tw FROM p_weights", "p_weights"))
def pip5(spark, d):
    x = labelled(spark, d)
    return E.aligned(x.events, x.tw, "tw").select("instrument", T0(), r("tw"))


@query(
    "src6_training_table",
    with_views(
        f"SELECT instrument, {T0_SQL}, {T1_SQL}, bin, round(w, 6) AS w, round(roll_c + 3e-10, 5) AS roll_c, round(fracdiff + 3e-10, 5) AS fracdiff FROM penr",
        "penr",
    ),
)
def src6(spark, d):
    x, e = enriched(spark, d)
    path = scratch(spark, "training")
    A.stage_training_table(e, x.w, _COLS, path)
    return spark.read.parquet(path).select(
        "instrument", T0(), T1(), "bin", r("w"), *[F.round(F.col(c) + 3e-10, 5).alias(c) for c in ("roll_c", "fracdiff")]
    )


@query(
    "src7_run_log",
    with_views("SELECT instrument, CAST(count(*) AS BIGINT) AS n_trades, CAST(NULL AS VARCHAR) AS note FROM ticks GROUP BY 1", "ticks"),
)
def src7(spark, d):
    path = scratch(spark, "log")
    runs = C.ticks(spark, d).groupBy("instrument").agg(F.count(F.lit(1)).alias("n_trades"))
    half = F.col("instrument") < "u08"
    A.append_run_log(runs.where(half), path, fields=["instrument", "n_trades", "note"])
    A.append_run_log(runs.where(~half), path, fields=["instrument", "n_trades", "note"])
    return spark.read.parquet(path)


# --------------------------------------------------------------------------- models
FEATS = ["roll_c", "parkinson_vol_20bar", "corwin_schultz_spread", "amihud_lambda_20bar", "vpin_10bar", "fracdiff"]


def training(spark, d):
    x, e = enriched(spark, d)
    t = A.training_table(e, x.w, FEATS).join(x.events.select("instrument", "t0", "ret"), ["instrument", "t0"])
    return reuse(position(t.withColumn("bin", (F.col("bin") > 0).cast("int")), ["t0"]))


def members(spark, d, n_splits: int = 3):
    return reuse(V.purged_kfold(training(spark, d), n_splits=n_splits, pct_embargo=0.01))


MODEL = I.forest(trees=8, depth=3)


@query("cv7_cross_validated_score")
def cv7(spark, d):
    return I.cv_score(members(spark, d), FEATS, MODEL, splits=range(3))


@query("cv8_out_of_sample_probabilities")
def cv8(spark, d):
    return I.out_of_sample(members(spark, d), FEATS, I.logistic(), splits=range(3)).select("instrument", T0(), "split", "prob", "prob1", "pred", "bin")


def path_predictions(spark, d):
    m = reuse(V.cpcv_membership(training(spark, d), n_groups=4, k=2, pct_embargo=0.01))
    return I.cpcv_paths(m, FEATS, I.logistic(), n_groups=4, k=2)


@query("cv9_cpcv_paths")
def cv9(spark, d):
    return path_predictions(spark, d).select("instrument", T0(), "path", "split", "grp", "prob", "pred")


view(
    "cpath",
    """
SELECT o.instrument, o.pos, p.path, ((o.event_id * (p.path + 7)) % 101 - 50) / 1000.0::DOUBLE AS ret
FROM obs o JOIN (SELECT DISTINCT path FROM paths) p ON true
""",
    "obs", "paths",
)


@query(
    "cv10_path_variance",
    with_views(
        "SELECT instrument, round(v, 8) AS sigma2, round(m, 6) AS mean_sharpe, round(rho, 6) AS rho_bar, round(v / 5 * (1 + 4 * rho), 8) AS var_of_mean FROM ("
        "SELECT instrument, var_samp(sh) AS v, avg(sh) AS m FROM (SELECT instrument, path, avg(ret) / stddev_samp(ret) AS sh FROM cpath GROUP BY 1, 2) GROUP BY 1) JOIN ("
        "SELECT instrument, avg(rho) AS rho FROM (SELECT a.instrument, a.path, b.path, corr(a.ret, b.ret) AS rho FROM cpath a JOIN cpath b ON a.instrument = b.instrument AND a.pos = b.pos AND a.path < b.path GROUP BY ALL) GROUP BY 1) USING (instrument)",
        "cpath",
    ),
)
def cv10(spark, d):
    n = V.n_paths(NG, KT)
    rets = F.array(*[((F.col("event_id") * (path + 7)) % 101 - 50) / F.lit(1000.0) for path in range(1, n + 1)])
    return V.path_variance(obs(spark, d).select("instrument", "pos", rets.alias("rets")), n_path=n).select(
        "instrument", r("sigma2", 8), r("mean_sharpe"), r("rho_bar"), r("var_of_mean", 8)
    )


@query(
    "cv11_weighted_metrics",
    with_views(
        """
SELECT source, round(sum(w * (label = pred)::INT) / sum(w), 6) AS accuracy, round(sum(w * CASE WHEN label = 1 THEN ln(prob) ELSE ln(1 - prob) END) / sum(w), 6) AS neg_log_loss,
       round(2 * sum(w * (label = 1 AND pred = 1)::INT) / (2 * sum(w * (label = 1 AND pred = 1)::INT) + sum(w * (label <> pred)::INT)), 6) AS f1
FROM (SELECT *, 1 + prob AS w FROM scored) GROUP BY 1
""",
        "scored",
    ),
)
def cv11(spark, d):
    return V.weighted_scores(Q.scored(spark, d).withColumn("w", 1 + F.col("prob")), ["source"]).select(
        "source", r("accuracy"), r("neg_log_loss"), r("f1")
    )


@query("imp1_mdi")
def imp1(spark, d):
    return I.mdi(training(spark, d), FEATS, MODEL)


@query("imp2_mda")
def imp2(spark, d):
    return I.mda(members(spark, d), FEATS, MODEL, splits=range(3))


@query("imp3_sfi")
def imp3(spark, d):
    return I.sfi(members(spark, d), FEATS, I.logistic(), splits=range(3))


@query("imp4_orthogonal_features")
def imp4(spark, d):
    t = I.orthogonal_features(training(spark, d), FEATS)
    return t.select("instrument", T0(), *[c for c in t.columns if c.startswith("PC_")])


view(
    "ranked",
    "SELECT study, trial, sharpe AS x, rank() OVER (PARTITION BY study ORDER BY n DESC, trial) AS rk FROM tsr JOIN (SELECT l_linestatus AS study, 't' || lpad(CAST(l_suppkey % 20 AS VARCHAR), 2, '0') AS trial, count(*) AS n FROM lineitem GROUP BY 1, 2) USING (study, trial)",
    "tsr",
)


def _tau(order: str) -> str:
    return f"""
SELECT a.study, sum((a.w + b.w) * sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum((a.w + b.w) * abs(sign(a.x - b.x))) * sum((a.w + b.w) * abs(sign(a.y - b.y)))) AS tau
FROM (SELECT *, 1.0::DOUBLE / row_number() OVER (PARTITION BY study ORDER BY {order}) AS w FROM yrank) a
JOIN (SELECT *, 1.0::DOUBLE / row_number() OVER (PARTITION BY study ORDER BY {order}) AS w FROM yrank) b ON a.study = b.study AND a.trial < b.trial GROUP BY 1
"""


view("yrank", "SELECT study, trial, x, 1.0::DOUBLE / rk AS y FROM ranked", "ranked")


@query(
    "imp5_weighted_tau",
    with_views(f"SELECT study, round((p.tau + q.tau) / 2, 6) AS tau FROM ({_tau('x DESC, y DESC')}) p JOIN ({_tau('y DESC, x DESC')}) q USING (study)", "yrank"),
)
def imp5(spark, d):
    li = C.table(spark, d, "lineitem")
    trial = F.concat(F.lit("t"), F.lpad((F.col("l_suppkey") % 20).cast("string"), 2, "0"))
    n = li.groupBy(F.col("l_linestatus").alias("study"), trial.alias("trial")).agg(F.count(F.lit(1)).alias("n"))
    ranked = position(n.withColumn("_o", -F.col("n")), ["_o", "trial"], keys=["study"], name="rk")
    x = sharpe_by(C.trials(spark, d), ["study", "trial"]).join(ranked, ["study", "trial"])
    return I.weighted_tau(x.withColumn("y", 1.0 / (F.col("rk") + 1)), x="sharpe", y="y", by=["study"]).select("study", r("tau"))


@query(
    "imp6_importance_by_family",
    with_views("SELECT study, substr(trial, 1, 1) AS family, round(sum(sharpe), 6) AS total, round(avg(sharpe), 6) AS average FROM tsr GROUP BY 1, 2", "tsr"),
)
def imp6(spark, d):
    imp = sharpe_by(C.trials(spark, d), ["study", "trial"]).select("study", F.col("trial").alias("feature"), F.col("sharpe").alias("mean"))
    return I.by_prefix(imp, by=["study"]).select("study", "family", r("total"), r("average"))


@query("imp5_component_tau")
def imp5_components(spark, d):
    """Importances of principal components against the order of their variances."""
    t = reuse(I.orthogonal_features(training(spark, d), FEATS))
    parts = [c for c in t.columns if c.startswith("PC_")]
    ranked = I.mdi(t, parts, MODEL).withColumn("y", 1.0 / F.substring("feature", 4, 9).cast("int"))
    return I.weighted_tau(ranked.withColumn("k", F.lit("MDI")), x="mean", y="y", by=["k"]).select(F.col("k").alias("method"), "tau")


@query("imp6_family_importance")
def imp6_families(spark, d):
    """Importances by all three methods, added up by family of features."""
    return I.by_prefix(imp7(spark, d), by=["method"])


@query("cv10_cpcv_path_variance")
def cv10_paths(spark, d):
    """Variance of the mean Sharpe ratio of the combinatorial paths: each path bets on its own out-of-sample predictions."""
    side = F.when(F.col("pred") == 1, 1.0).otherwise(-1.0)
    bets = reuse(path_predictions(spark, d)).select("instrument", "pos", "path", (side * F.col("ret")).alias("ret"))
    return V.path_variance(bets, n_path=V.n_paths(4, 2))


@query("imp7_importance_driver")
def imp7(spark, d):
    t = training(spark, d)
    m = reuse(V.purged_kfold(t, n_splits=3, pct_embargo=0.01))
    parts = [I.importance(method, t, m, FEATS, MODEL, splits=range(3)) for method in ("MDI", "MDA", "SFI")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("tun1_search")
def tun1(spark, d):
    grid = {f"reg={v:.6f}": I.logistic(reg=v) for v in I.log_uniform(1e-4, 1.0, 2)} | {"forest": MODEL}
    return I.search(members(spark, d), FEATS, grid, splits=range(3))


@query("sta4_trial_grid")
def sta4(spark, d):
    """Model strength x discretisation step -> trial P&L on bars with market share."""
    x, _ = enriched(spark, d)
    m = members(spark, d)
    bars = x.bars.select("instrument", "pos", "ts", "close")
    parts = None
    regs = (0.001, 0.01, 0.1, 1.0)
    every = reuse(out_of_sample_cells(m, {str(v): (FEATS, v) for v in regs}, splits=range(3), name="reg"))
    for reg in regs:
        oos = every.where(F.col("reg") == str(reg)).select("instrument", "t0", "t1", "prob", F.when(F.col("pred") == 1, 1).otherwise(-1).alias("pred"))
        for step in (0.05, 0.1, 0.15, 0.2, 0.25):
            pnl = B.strategy_pnl(B.positions_on_bars(bars, B.bet_signal(oos, n_classes=2, step=step)))
            part = pnl.select("instrument", F.lit(f"reg={reg},step={step}").alias("trial"), "pos", "position", "pnl")
            parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("instrument", "trial").agg(
        F.count(F.lit(1)).alias("n_bars"), F.avg((F.col("position") != 0).cast("double")).alias("in_market"),
        (F.avg("pnl") / F.nullif(F.stddev_samp("pnl"), F.lit(0.0))).alias("sharpe"),
    )


# --------------------------------------------------------------------------- oversight
def oversight(spark, d):
    """Evidence of each study with its best trial's probability of failure at the most demanding target."""
    risk = K_R.probability_of_failure(Q.payoffs(spark, d)).groupBy("study", "trial").agg(F.max_by("p_fail", "target").alias("p_fail"))
    return Q.evidence(spark, d).join(risk.withColumnRenamed("trial", "best_trial"), ["study", "best_trial"], "left")


view(
    "bestfail",
    f"SELECT study, trial AS best_trial, {Q.norm_cdf_sql('z')} AS p_fail FROM (SELECT *, (need - p) / sqrt(p * (1 - p)) AS z FROM need QUALIFY row_number() OVER (PARTITION BY study, trial ORDER BY target DESC) = 1)",
    "need",
)


_STAGE = "CASE WHEN t_eff < 30 OR n_trials < 10 OR dsr < 0.5 THEN 'EMBARGO' WHEN dsr < 0.95 THEN 'PAPER_TRADING' ELSE 'GRADUATION_CANDIDATE' END"


@query("pip6_lifecycle_stage", with_views(f"SELECT study, {_STAGE} AS stage, t_eff < 30 OR n_trials < 10 AS small_sample FROM evid", "evid"))
def pip6(spark, d):
    return E.lifecycle_stage(oversight(spark, d)).select("study", "stage", "small_sample")


@query(
    "pip7_circuit_breaker",
    with_views(
        "SELECT study, concat_ws(',', CASE WHEN pbo > 0.5 THEN 'pbo' END, CASE WHEN p_fail > 0.5 THEN 'p_fail' END) AS reasons, pbo > 0.5 OR coalesce(p_fail > 0.5, false) AS triggered, round(p_fail, 6) AS p_fail FROM evid LEFT JOIN bestfail USING (study, best_trial)",
        "evid", "bestfail",
    ),
)
def pip7(spark, d):
    return E.circuit_breaker(oversight(spark, d)).select("study", F.array_join("reasons", ",").alias("reasons"), "triggered", r("p_fail"))


@query(
    "pip8_confidence_band",
    with_views(
        "SELECT study, CASE WHEN dsr IS NULL THEN 'undetermined' WHEN t_eff < 30 OR n_trials < 10 THEN 'unreliable' WHEN dsr >= 0.95 THEN 'high' WHEN dsr >= 0.5 THEN 'moderate' ELSE 'low' END AS confidence, round(dsr, 6) AS dsr, round(pbo, 6) AS pbo FROM evid",
        "evid",
    ),
)
def pip8(spark, d):
    return E.confidence_band(oversight(spark, d)).select("study", "confidence", r("dsr"), r("pbo"))


SWEEP_H = (40.0, 120.0, 1e9)
for _h in SWEEP_H:
    _p = f"sw{_h:.0f}"
    cusum_views(f"{_p}_ev", "pbars", "close", f"{_h:.0f}::DOUBLE")
    label_views(_p, "pbars", f"{_p}_ev", beta="(1 - 2.0/21.0)::DOUBLE", pt=0.3, sl=0.1, min_ret=0.01, days=2)


def frozen_tape(spark, d):
    path = scratch(spark, "frozen")
    A.freeze({"tape": C.ticks(spark, d)}, path)
    return A.load_frozen(spark, path, ["tape"])["tape"]


def sweep_grid():
    return {f"h={h:g}": replace(CFG, cusum_h=h) for h in SWEEP_H} | {"no bars": replace(CFG, target_bars=0)}


@query(
    "pip10_label_sweep",
    with_views(
        " UNION ALL ".join(
            f"""
SELECT 'h={h:g}' AS config, n.instrument, CASE WHEN e.n_events IS NULL THEN 'failed' ELSE 'ok' END AS status,
       CASE WHEN s.n_sampled IS NULL THEN 'stage events produced no rows' WHEN e.n_events IS NULL THEN 'stage labels produced no rows' END AS error,
       n.n_bars, s.n_sampled, e.n_events, e.tw_mean, e.t_eff
FROM (SELECT instrument, count(*) AS n_bars FROM pbars GROUP BY 1) n
LEFT JOIN (SELECT instrument, count(*) AS n_sampled FROM sw{h:.0f}_ev GROUP BY 1) s USING (instrument)
LEFT JOIN (SELECT instrument, count(*) AS n_events, round(avg(tw), 6) AS tw_mean, round(sum(tw), 6) AS t_eff FROM sw{h:.0f}_weights GROUP BY 1) e USING (instrument)
"""
            for h in SWEEP_H
        )
        + " UNION ALL SELECT DISTINCT 'no bars', instrument, 'failed', 'target_bars must be positive', NULL, NULL, NULL, NULL, NULL FROM ticks",
        "ticks", "pbars", *[f"sw{h:.0f}_{v}" for h in SWEEP_H for v in ("ev", "weights")],
    ),
)
def pip10_labels(spark, d):
    """Bars, events and uniqueness of every configuration from one job."""
    return label_sweep(frozen_tape(spark, d), sweep_grid()).select(
        "config", "instrument", "status", "error", "n_bars", "n_sampled", "n_events", r("tw_mean"), r("t_eff")
    )


@query("pip10_parameter_sweep")
def pip10(spark, d):
    """The same with models, trials, probability of overfitting and deflated Sharpe ratio per configuration."""
    return evidence_sweep(frozen_tape(spark, d), sweep_grid(), features=FEATS)


@query(
    "pip11_degenerate_features",
    with_views(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, round(stddev_samp({c}{' * 1e6' if c in _SCALE else ''}), 5) AS std, coalesce(stddev_samp({c}) < 1e-10, true) AS degenerate FROM penr"
            for c in _COLS
        ),
        "penr",
    ),
)
def pip11(spark, d):
    _, e = enriched(spark, d)
    scale = F.when(F.col("feature") == "amihud_lambda_20bar", 1e6).otherwise(1.0)
    return E.degenerate_features(e, _COLS).select("feature", F.round(F.col("std") * scale, 5).alias("std"), "degenerate")


@query(
    "pip11_class_balance",
    with_views(
        "SELECT instrument, 'bin' AS kind, count(*) AS n_classes, round(min(n) / max(n)::DOUBLE, 6) AS balance, count(*) < 2 AS single_class FROM (SELECT instrument, sign(ret) AS cls, count(*) AS n FROM p_weights GROUP BY 1, 2) GROUP BY 1",
        "p_weights",
    ),
)
def pip11b(spark, d):
    return E.class_balance(labelled(spark, d).events).select("instrument", "kind", "n_classes", r("balance"), "single_class")

"""Bet sizing, backtest statistics, strategy risk and trading-rule replay."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tapeloom.catalog.base_sql import view, with_views
from tapeloom.catalog.label_queries import MIN_RET, PT_SL, T0, T0_SQL, bars, tb_events
from tapeloom.catalog.registry import query
from tapeloom.functions.gaussian import norm_cdf_sql, norm_ppf_polish_sql, norm_ppf_start_sql
from tapeloom.operators import bets as B
from tapeloom.operators import labels as L
from tapeloom.operators import risk as R
from tapeloom.operators import stats as S
from tapeloom.plans.series import position, reuse
from tapeloom.sources import canonical as C


def r(c: str, n: int = 6):
    return F.round(c, n).alias(c)



def T():
    return F.unix_micros("t").alias("t_us")



# --------------------------------------------------------------------------- signals
view(
    "preds",
    "SELECT instrument, t0, t1, ret, 0.5::DOUBLE + (epoch_us(t0) % 450) / 1000.0::DOUBLE AS prob, CASE WHEN epoch_us(t0) % 2 = 0 THEN 1 ELSE -1 END AS pred FROM (SELECT v.instrument, v.t0, v.t1, b.ret FROM tev v LEFT JOIN bins b USING (instrument, t0))",
    "tev", "bins",
)
view(
    "sig0",
    f"SELECT *, pred * (2 * {norm_cdf_sql('z')} - 1) AS signal FROM (SELECT *, (prob - 0.5::DOUBLE) / sqrt(prob * (1 - prob)) AS z FROM preds)",
    "preds",
)
view(
    "sig1",
    """
SELECT p.instrument, p.t, count(s.t0) AS active, coalesce(avg(s.signal), 0) AS signal
FROM (SELECT instrument, t0 AS t FROM sig0 UNION SELECT instrument, t1 FROM sig0 WHERE t1 IS NOT NULL) p
LEFT JOIN sig0 s ON s.instrument = p.instrument AND s.t0 <= p.t AND (p.t < s.t1 OR s.t1 IS NULL) GROUP BY 1, 2
""",
    "sig0",
)
view("sig", "SELECT instrument, t, greatest(-1, least(1, round_even(signal / 0.1::DOUBLE, 0) * 0.1::DOUBLE)) + 0::DOUBLE AS signal FROM sig1", "sig1")


def predictions(spark, d):
    b = bars(spark, d)
    ev = tb_events(b)
    ret = L.label_returns(b, ev).select("instrument", "t0", "ret")
    u = F.unix_micros("t0")
    return reuse(
        ev.join(ret, ["instrument", "t0"], "left").select(
            "instrument", "t0", "t1", "ret",
            (F.lit(0.5) + (u % 450) / F.lit(1000.0)).alias("prob"),
            F.when(u % 2 == 0, 1).otherwise(-1).alias("pred"),
        )
    )


def signals(spark, d):
    return reuse(B.bet_signal(predictions(spark, d), n_classes=2, step=0.1))


@query("bet1_probability_signal", with_views(f"SELECT instrument, {T0_SQL}, round(signal, 6) AS signal FROM sig0", "sig0"))
def bet1(spark, d):
    return B.probability_signal(predictions(spark, d), n_classes=2).select("instrument", T0(), r("signal"))


@query(
    "bet2_average_active",
    with_views("SELECT instrument, epoch_us(t) AS t_us, CAST(active AS BIGINT) AS active, round(signal, 6) AS signal FROM sig1", "sig1"),
)
def bet2(spark, d):
    s = B.probability_signal(predictions(spark, d), n_classes=2)
    return B.average_active(s).select("instrument", T(), "active", r("signal"))


@query("bet3_discretised", with_views("SELECT instrument, epoch_us(t) AS t_us, round(signal, 6) AS signal FROM sig", "sig"))
def bet3(spark, d):
    return signals(spark, d).select("instrument", T(), r("signal"))


def forecasts(spark, d):
    return C.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        (F.col("l_extendedprice") / F.lit(1000.0)).alias("price"),
        ((F.col("l_extendedprice") / F.lit(1000.0)) * (F.lit(0.95) + F.col("l_tax"))).alias("forecast"),
        F.lit(100).cast("long").alias("max_pos"), (F.col("l_quantity").cast("long") - 25).alias("pos"),
        B.scale_for(F.lit(10.0), F.lit(0.95)).alias("w"),
    )


view(
    "fcast",
    """
SELECT *, CAST(trunc((forecast - price) / sqrt(w + (forecast - price) * (forecast - price)) * max_pos) AS BIGINT) AS target_pos FROM (
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / 1000.0::DOUBLE AS price, l_extendedprice / 1000.0::DOUBLE * (0.95::DOUBLE + l_tax) AS forecast,
       100::BIGINT AS max_pos, CAST(l_quantity AS BIGINT) - 25 AS pos, 100 * (pow(0.95::DOUBLE, -2) - 1) AS w FROM lineitem)
""",
)


@query(
    "bet4_target_position",
    with_views("SELECT l_orderkey, l_linenumber, l_partkey, round(w, 6) AS w, target_pos FROM fcast", "fcast"),
)
def bet4(spark, d):
    return B.target_position(forecasts(spark, d)).select("l_orderkey", "l_linenumber", "l_partkey", r("w"), "target_pos")


@query(
    "bet5_limit_price",
    with_views(
        """
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN target_pos <> pos THEN coalesce(list_sum(list_transform(
         generate_series(abs(pos + CASE WHEN target_pos >= pos THEN 1 ELSE -1 END), abs(target_pos + 1) - 1),
         lambda j: forecast - j / 100.0::DOUBLE * sqrt(w / nullif(1 - (j / 100.0::DOUBLE) * (j / 100.0::DOUBLE), 0)))), 0) / (target_pos - pos) + 0::DOUBLE END, 6) + 0::DOUBLE AS limit_price FROM fcast
""",
        "fcast",
    ),
)
def bet5(spark, d):
    return B.limit_price(B.target_position(forecasts(spark, d))).select("l_orderkey", "l_linenumber", "l_partkey", (F.round("limit_price", 6) + F.lit(0.0)).alias("limit_price"))


view(
    "bpos",
    "SELECT b.instrument, b.pos, b.ts, b.close, coalesce(s.signal, 0) AS position FROM tbars b ASOF LEFT JOIN sig s ON b.instrument = s.instrument AND b.ts >= s.t",
    "tbars", "sig",
)
view(
    "bpnl",
    "SELECT *, coalesce(lag(position) OVER w, 0) * coalesce(close / lag(close) OVER w - 1, 0) + 0::DOUBLE AS pnl FROM bpos WINDOW w AS (PARTITION BY instrument ORDER BY pos)",
    "bpos",
)


def on_bars(spark, d):
    return reuse(B.positions_on_bars(bars(spark, d).select("instrument", "pos", "ts", "close"), signals(spark, d)))


@query("bet6_positions", with_views("SELECT instrument, pos, round(position, 6) AS position FROM bpos", "bpos"))
def bet6(spark, d):
    return on_bars(spark, d).select("instrument", "pos", r("position"))


@query("bet7_strategy_pnl", with_views("SELECT instrument, pos, round(pnl, 6) + 0::DOUBLE AS pnl FROM bpnl", "bpnl"))
def bet7(spark, d):
    return B.strategy_pnl(on_bars(spark, d)).select("instrument", "pos", (F.round("pnl", 6) + F.lit(0.0)).alias("pnl"))


@query(
    "bet8_event_returns",
    with_views(
        "SELECT instrument, round(avg(x) / stddev_samp(x), 6) AS sharpe, round(sum(x), 6) AS total FROM (SELECT p.instrument, coalesce(s.signal, 0) * p.ret AS x FROM preds p"
        " LEFT JOIN sig s ON s.instrument = p.instrument AND s.t = p.t0) GROUP BY 1",
        "preds", "sig",
    ),
)
def bet8(spark, d):
    ev = B.event_returns(predictions(spark, d), signals(spark, d))
    total = ev.groupBy("instrument").agg(F.sum("strategy_ret").alias("total"))
    return S.sharpe_by(ev, ["instrument"], x="strategy_ret").join(total, "instrument").select("instrument", r("sharpe"), r("total"))


@query("bet9_latest_signal", with_views("SELECT instrument, round(arg_max(signal, t), 6) AS signal FROM sig GROUP BY 1", "sig"))
def bet9(spark, d):
    return B.latest_signal(signals(spark, d)).select("instrument", r("signal"))


@query(
    "bet10_capital_suggestion",
    with_views(
        "SELECT instrument, round(s * 10000 * 0.25::DOUBLE, 4) AS suggested, CASE WHEN s IS NULL THEN 'no signal' WHEN s > 0 THEN 'long' WHEN s < 0 THEN 'short' ELSE 'flat' END AS direction"
        " FROM (SELECT instrument, arg_max(signal, t) AS s FROM sig GROUP BY 1)",
        "sig",
    ),
)
def bet10(spark, d):
    out = B.capital_suggestion(B.latest_signal(signals(spark, d)), capital=10_000.0, max_fraction=0.25)
    return out.select("instrument", r("suggested", 4), "direction")


# --------------------------------------------------------------------------- overfitting statistics
S_BLOCKS = 8
view(
    "tsr",
    "SELECT study, trial, avg(pnl) / stddev_samp(pnl) AS sharpe FROM trials GROUP BY 1, 2",
    "trials",
)
view(
    "tblk",
    f"""
SELECT study, trial, pnl, CASE WHEN pos < (n % {S_BLOCKS}) * (n // {S_BLOCKS} + 1) THEN pos // (n // {S_BLOCKS} + 1)
       ELSE n % {S_BLOCKS} + (pos - (n % {S_BLOCKS}) * (n // {S_BLOCKS} + 1)) // (n // {S_BLOCKS}) END AS blk
FROM (SELECT *, max(pos) OVER (PARTITION BY study) + 1 AS n FROM trials)
""",
    "trials",
)
view("combos", f"SELECT i AS combo FROM range({1 << S_BLOCKS}) t(i) WHERE bit_count(i) = {S_BLOCKS // 2}")
view(
    "cscore",
    """
SELECT study, trial, combo, avg(pnl) FILTER (ins) / stddev_samp(pnl) FILTER (ins) AS r_is, avg(pnl) FILTER (NOT ins) / stddev_samp(pnl) FILTER (NOT ins) AS r_oos
FROM (SELECT b.*, c.combo, (c.combo >> CAST(b.blk AS INTEGER)) & 1 = 1 AS ins FROM tblk b CROSS JOIN combos c) GROUP BY 1, 2, 3
""",
    "tblk", "combos",
)
view(
    "csplit",
    """
SELECT study, combo, trial AS n_star, r_is, r_oos, rk AS rank_oos, rk / (n + 1) AS w_bar, ln(rk / (n + 1) / (1 - rk / (n + 1))) AS logit FROM (
  SELECT *, rank() OVER (PARTITION BY study, combo ORDER BY r_oos) + (count(*) OVER (PARTITION BY study, combo, r_oos) - 1) / 2.0::DOUBLE AS rk,
         count(*) OVER (PARTITION BY study, combo) AS n, row_number() OVER (PARTITION BY study, combo ORDER BY r_is DESC, trial) AS best FROM cscore) WHERE best = 1
""",
    "cscore",
)


@query("sta1_trial_sharpe", with_views("SELECT study, trial, round(sharpe, 6) AS sharpe FROM tsr", "tsr"))
def sta1(spark, d):
    return S.sharpe_by(C.trials(spark, d), ["study", "trial"]).select("study", "trial", r("sharpe"))


@query(
    "sta2_cscv",
    with_views(
        "SELECT study, CAST(combo AS INTEGER) AS combo, n_star, round(r_is, 6) AS r_is, round(r_oos, 6) AS r_oos, rank_oos, round(w_bar, 6) AS w_bar, round(logit, 6) AS logit FROM csplit",
        "csplit",
    ),
)
def sta2(spark, d):
    return S.cscv(C.trials(spark, d), blocks=S_BLOCKS).select(
        "study", "combo", "n_star", r("r_is"), r("r_oos"), "rank_oos", r("w_bar"), r("logit")
    )


@query(
    "sta3_pbo",
    with_views("SELECT study, round(avg(CASE WHEN logit < 0 THEN 1.0 ELSE 0 END), 6) AS pbo, count(*) AS n_combos FROM csplit GROUP BY 1", "csplit"),
)
def sta3(spark, d):
    return S.pbo(S.cscv(C.trials(spark, d), blocks=S_BLOCKS)).select("study", r("pbo"), "n_combos")


view("combos12", "SELECT i AS combo FROM range(4096) t(i) WHERE bit_count(i) = 6")
view(
    "tsums12",
    """
SELECT study, trial, blk, count(*)::DOUBLE AS n, sum(pnl) AS s, sum(pnl * pnl) AS ss FROM (
  SELECT study, trial, pnl, CASE WHEN pos < (n % 12) * (n // 12 + 1) THEN pos // (n // 12 + 1) ELSE n % 12 + (pos - (n % 12) * (n // 12 + 1)) // (n // 12) END AS blk
  FROM (SELECT *, max(pos) OVER (PARTITION BY study) + 1 AS n FROM trials)) GROUP BY 1, 2, 3
""",
    "trials",
)
_SR = "(sum(s) FILTER ({0}) / sum(n) FILTER ({0})) / sqrt((sum(ss) FILTER ({0}) - sum(s) FILTER ({0}) * sum(s) FILTER ({0}) / sum(n) FILTER ({0})) / (sum(n) FILTER ({0}) - 1))"
view(
    "csplit12",
    f"""
SELECT study, combo, rk / (n + 1) AS w FROM (
  SELECT *, rank() OVER (PARTITION BY study, combo ORDER BY r_oos) + (count(*) OVER (PARTITION BY study, combo, r_oos) - 1) / 2.0::DOUBLE AS rk,
         count(*) OVER (PARTITION BY study, combo) AS n, row_number() OVER (PARTITION BY study, combo ORDER BY r_is DESC, trial) AS best FROM (
    SELECT study, trial, combo, {_SR.format('ins')} AS r_is, {_SR.format('NOT ins')} AS r_oos
    FROM (SELECT b.*, c.combo, (c.combo >> CAST(b.blk AS INTEGER)) & 1 = 1 AS ins FROM tsums12 b CROSS JOIN combos12 c) GROUP BY 1, 2, 3)) WHERE best = 1
""",
    "tsums12", "combos12",
)


@query(
    "sta3_pbo_s12",
    with_views("SELECT study, round(avg(CASE WHEN w < 0.5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS pbo, count(*) AS n_combos FROM csplit12 GROUP BY 1", "csplit12"),
)
def sta3_12(spark, d):
    return S.pbo(S.cscv(C.trials(spark, d), blocks=12)).select("study", r("pbo"), "n_combos")


def psr_sql(source: str, sr: str, bench: str, n: str, skew: str, kurt: str, out: str) -> str:
    inner = (
        f"SELECT *, ({sr} - {bench}) * sqrt({n} - 1) / sqrt(1 - {skew} * {sr} + ({kurt} - 1) / 4 * {sr} * {sr}) AS zz FROM ({source})"
    )
    return f"SELECT * EXCLUDE (zz), {norm_cdf_sql('zz')} AS {out} FROM ({inner})"


def star_sql(source: str, var: str, k: str) -> str:
    s = f"SELECT *, 1 - 1.0::DOUBLE / {k} AS pp1, 1 - 1.0::DOUBLE / ({k} * {math.e!r}::DOUBLE) AS pp2 FROM ({source})"
    s = f"SELECT *, {norm_ppf_start_sql('pp1')} AS q1, {norm_ppf_start_sql('pp2')} AS q2 FROM ({s})"
    s = f"SELECT *, {norm_ppf_polish_sql('q1', 'pp1')} AS z1, {norm_ppf_polish_sql('q2', 'pp2')} AS z2 FROM ({s})"
    return (
        f"SELECT * EXCLUDE (pp1, pp2, q1, q2, z1, z2), sqrt({var}) * ((1 - {S.EULER!r}::DOUBLE) * z1 + {S.EULER!r}::DOUBLE * z2) AS sr_star FROM ({s})"
    )


_SKEW = "skewness(pnl)"
_KURT = "kurtosis(pnl) + 3"
view("uniq_study", "SELECT l_linestatus AS study, avg(0.5::DOUBLE + l_tax) AS tw_mean FROM lineitem GROUP BY 1")
view(
    "evid",
    psr_sql(
        star_sql(
            f"""
SELECT b.*, m.t_raw, m.skew, m.kurtosis, u.tw_mean, p.pbo, m.t_raw * u.tw_mean AS t_eff
FROM (SELECT study, arg_max(trial, sharpe) AS best_trial, max(sharpe) AS sr_hat, count(*) AS n_trials, var_samp(sharpe) AS var_sr_trials FROM tsr GROUP BY 1) b
JOIN (SELECT t.study, count(*) AS t_raw, {_SKEW} AS skew, {_KURT} AS kurtosis FROM trials t
      JOIN (SELECT study, arg_max(trial, sharpe) AS trial FROM tsr GROUP BY 1) c USING (study, trial) WHERE pnl <> 0 GROUP BY 1) m USING (study)
JOIN uniq_study u USING (study) JOIN (SELECT study, avg(CASE WHEN logit < 0 THEN 1.0::DOUBLE ELSE 0 END) AS pbo FROM csplit GROUP BY 1) p USING (study)
""",
            "var_sr_trials", "n_trials",
        ),
        "sr_hat", "sr_star", "t_eff", "skew", "kurtosis", "dsr",
    ),
    "tsr", "trials", "csplit", "uniq_study",
)


def evidence(spark, d):
    tw = C.table(spark, d, "lineitem").select(F.col("l_linestatus").alias("study"), (F.lit(0.5) + F.col("l_tax")).alias("tw"))
    return S.evaluate_overfitting(reuse(C.trials(spark, d)), tw, blocks=S_BLOCKS)


_EV = ["sr_hat", "var_sr_trials", "skew", "kurtosis", "tw_mean", "t_eff", "pbo", "dsr"]


@query(
    "sta5_overfitting_evidence",
    with_views("SELECT study, best_trial, n_trials, t_raw, " + ", ".join(f"round({c}, 6) AS {c}" for c in _EV) + " FROM evid", "evid"),
)
def sta5(spark, d):
    return evidence(spark, d).select("study", "best_trial", "n_trials", "t_raw", *[r(c) for c in _EV])


view(
    "tmom",
    f"SELECT study, trial, count(*) AS n_bets, avg(pnl) / stddev_samp(pnl) AS sharpe, {_SKEW} AS skew, {_KURT} AS kurt FROM trials WHERE pnl <> 0 GROUP BY 1, 2",
    "trials",
)
view("psr0", psr_sql("SELECT *, 0::DOUBLE AS zero FROM tmom", "sharpe", "zero", "n_bets", "skew", "kurt", "psr"), "tmom")


def moments(spark, d):
    return S.strategy_moments(C.trials(spark, d), ["study", "trial"], x="pnl")


@query("sta6_probabilistic_sharpe", with_views("SELECT study, trial, round(psr, 6) AS psr FROM psr0", "psr0"))
def sta6(spark, d):
    m = moments(spark, d).withColumn("zero", F.lit(0.0))
    return S.with_psr(m, sr="sharpe", benchmark="zero", n="n_bets", skew="skew", kurt="kurt", out="psr").select("study", "trial", r("psr"))


view("tspread", "SELECT study, var_samp(sharpe) AS v, count(*) AS k FROM tmom GROUP BY 1", "tmom")


@query(
    "sta7_deflated_sharpe",
    with_views("SELECT study, round(v, 8) AS v, k, round(sr_star, 6) AS sr_star FROM (" + star_sql("SELECT * FROM tspread", "v", "k") + ")", "tspread"),
)
def sta7(spark, d):
    m = moments(spark, d).groupBy("study").agg(F.var_samp("sharpe").alias("v"), F.count(F.lit(1)).alias("k"))
    return S.with_expected_max_sharpe(m, var="v", n_trials="k", out="sr_star").select("study", r("v", 8), "k", r("sr_star"))


@query(
    "sta8_bet_timing",
    with_views(
        "SELECT instrument, pos FROM (SELECT *, lag(position) OVER w AS p, max(pos) OVER (PARTITION BY instrument) AS l FROM bpos WINDOW w AS (PARTITION BY instrument ORDER BY pos))"
        " WHERE (position = 0 AND (p IS NULL OR p <> 0)) OR position * p < 0 OR pos = l",
        "bpos",
    ),
)
def sta8(spark, d):
    return S.bet_timing(on_bars(spark, d)).select("instrument", "pos")


view("hstart", "SELECT instrument, pos, position AS p, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY instrument)) / 86400000000.0::DOUBLE AS t FROM bpos", "bpos")
view(
    "hfold",
    """
SELECT instrument, pos, p, 0::DOUBLE AS entry, 0::DOUBLE AS dt, 0::DOUBLE AS w FROM hstart WHERE pos = 0
UNION ALL
SELECT h.instrument, h.pos, h.p,
  CASE WHEN (h.p - f.p) * f.p >= 0 THEN CASE WHEN h.p <> 0 THEN (f.entry * f.p + h.t * (h.p - f.p)) / h.p ELSE f.entry END
       WHEN h.p * f.p < 0 THEN h.t ELSE f.entry END,
  CASE WHEN (h.p - f.p) * f.p >= 0 THEN 0 ELSE h.t - f.entry END,
  CASE WHEN (h.p - f.p) * f.p >= 0 THEN 0 WHEN h.p * f.p < 0 THEN abs(f.p) ELSE abs(h.p - f.p) END
FROM hfold f JOIN hstart h ON h.instrument = f.instrument AND h.pos = f.pos + 1
""",
    "hstart",
)


@query(
    "sta9_holding_period",
    with_views("SELECT instrument, round(sum(dt * w) / sum(w), 6) AS holding_days FROM hfold GROUP BY 1", "hfold"),
)
def sta9(spark, d):
    return S.holding_period(on_bars(spark, d)).select("instrument", r("holding_days"))


def _hhi_sql(n: str, s: str, ss: str) -> str:
    return f"CASE WHEN {n} > 2 THEN ({ss} / ({s} * {s}) - 1.0::DOUBLE / {n}) / (1 - 1.0::DOUBLE / {n}) END"


@query(
    "sta10_hhi",
    with_views(
        f"""
SELECT a.study, a.trial, round({_hhi_sql('np', 'sp', 'qp')}, 6) AS hhi_positive, round({_hhi_sql('nn', 'sn', 'qn')}, 6) AS hhi_negative, round({_hhi_sql('m', 'c', 'cc')}, 6) AS hhi_time
FROM (SELECT study, trial, count(*) FILTER (pnl >= 0) AS np, sum(pnl) FILTER (pnl >= 0) AS sp, sum(pnl * pnl) FILTER (pnl >= 0) AS qp,
             count(*) FILTER (pnl < 0) AS nn, sum(pnl) FILTER (pnl < 0) AS sn, sum(pnl * pnl) FILTER (pnl < 0) AS qn FROM trials GROUP BY 1, 2) a
JOIN (SELECT study, trial, max(k) - min(k) + 1 AS m, CAST(sum(n) AS DOUBLE) AS c, CAST(sum(n * n) AS DOUBLE) AS cc FROM (
        SELECT study, trial, year(month) * 12 + month(month) AS k, count(*) AS n FROM trials WHERE pnl > 0.001 GROUP BY 1, 2, 3) GROUP BY 1, 2) b USING (study, trial)
""".replace("WHERE pnl > 0.001 ", ""),
        "trials",
    ),
)
def sta10(spark, d):
    return S.hhi_concentration(C.trials(spark, d), by=["study", "trial"], ts="month", x="pnl").select(
        "study", "trial", r("hhi_positive"), r("hhi_negative"), r("hhi_time")
    )


view("deq", "SELECT instrument, pos, ts, close AS equity FROM tbars", "tbars")
view(
    "dd",
    """
SELECT instrument, start, hwm, low, 1 - low / hwm AS drawdown, (epoch_us(lead(start) OVER (PARTITION BY instrument ORDER BY start)) - epoch_us(start)) / (86400000000.0::DOUBLE * 365.2425::DOUBLE) AS tuw
FROM (SELECT instrument, hwm, min(equity) AS low, min(ts) AS start FROM (SELECT *, max(equity) OVER (PARTITION BY instrument ORDER BY pos) AS hwm FROM deq) GROUP BY 1, 2) WHERE hwm > low
""",
    "deq",
)


@query(
    "sta11_drawdowns",
    with_views("SELECT instrument, epoch_us(start) AS start_us, hwm, low, round(drawdown, 6) AS drawdown, round(tuw, 9) AS tuw_years FROM dd", "dd"),
)
def sta11(spark, d):
    eq = bars(spark, d).select("instrument", "pos", "ts", F.col("close").alias("equity"))
    return S.drawdowns(eq).select(
        "instrument", F.unix_micros("start").alias("start_us"), "hwm", "low", r("drawdown"), r("tuw_years", 9)
    )


view(
    "scored",
    "SELECT d.source, l.quality AS label, CAST(n_chars AS DOUBLE) / (n_chars + 1500) AS prob, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS pred FROM labels l JOIN documents d USING (doc_id)",
)


def scored(spark, d):
    docs = C.table(spark, d, "documents").select("doc_id", "source", "n_chars")
    n = F.col("n_chars").cast("double")
    return C.table(spark, d, "labels").join(docs, "doc_id").select(
        "source", F.col("quality").alias("label"), (n / (n + 1500)).alias("prob"), (n > 1500).cast("int").alias("pred")
    )


@query(
    "sta12_classification_scores",
    with_views(
        """
SELECT source, tp, tn, fp, fn, round(nll, 6) AS neg_log_loss, round(CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn), 6) AS accuracy,
       round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS precision, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS recall,
       CASE WHEN tp > 0 THEN round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) END AS f1
FROM (SELECT source, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 0) AS tn,
             count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 1 AND pred = 0) AS fn,
             avg(CASE WHEN label = 1 THEN ln(prob) ELSE ln(1 - prob) END) AS nll FROM scored GROUP BY 1)
""",
        "scored",
    ),
)
def sta12(spark, d):
    cols = ["neg_log_loss", "accuracy", "precision", "recall", "f1"]
    return S.classification_scores(scored(spark, d), ["source"]).select("source", "tp", "tn", "fp", "fn", *[r(c) for c in cols])


view(
    "surv",
    psr_sql(
        star_sql("SELECT p.*, s.v, s.k FROM psr0 p JOIN tspread s USING (study)", "v", "k"),
        "sharpe", "sr_star", "n_bets", "skew", "kurt", "dsr",
    ),
    "psr0", "tspread",
)


@query(
    "sta13_path_survival",
    with_views("SELECT study, trial, round(psr, 6) AS psr_vs_zero, round(dsr, 6) AS dsr, dsr > 0.95 AS survives_dsr FROM surv", "surv"),
)
def sta13(spark, d):
    return S.path_survival(moments(spark, d)).select("study", "trial", r("psr_vs_zero"), r("dsr"), "survives_dsr")


@query(
    "sta14_strategy_moments",
    with_views("SELECT study, trial, n_bets, round(sharpe, 6) AS sharpe, round(skew, 6) AS skew, round(kurt, 6) AS kurt FROM tmom", "tmom"),
)
def sta14(spark, d):
    return moments(spark, d).select("study", "trial", "n_bets", r("sharpe"), r("skew"), r("kurt"))


# --------------------------------------------------------------------------- strategy risk
view(
    "pay",
    "SELECT study, trial, count(*) AS n, avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0 END) AS p, avg(pnl) FILTER (pnl > 0) AS gain, avg(pnl) FILTER (pnl <= 0) AS loss FROM trials GROUP BY 1, 2",
    "trials",
)
TARGETS = [0.5, 1.0, 2.0]


def payoffs(spark, d):
    out = R.payoff_table(C.trials(spark, d), ["study", "trial"], x="pnl").withColumn("freq", F.lit(12.0))
    return out.withColumn("target", F.explode(F.array(*[F.lit(t) for t in TARGETS])))


view("payt", "SELECT p.*, 12::DOUBLE AS freq, t.target FROM pay p CROSS JOIN (SELECT unnest([0.5::DOUBLE, 1, 2]) AS target) t", "pay")


@query(
    "rsk1_symmetric",
    with_views(
        "SELECT study, trial, target, round((2 * p - 1) / (2 * sqrt(p * (1 - p))) * sqrt(freq), 6) AS sharpe, round(0.5 * (1 + sqrt(1 - freq / (target * target + freq))), 6) AS p_needed FROM payt",
        "payt",
    ),
)
def rsk1(spark, d):
    c = F.col
    return payoffs(spark, d).select(
        "study", "trial", "target", F.round(R.sharpe_symmetric(c("p"), c("freq")), 6).alias("sharpe"),
        F.round(R.implied_precision_symmetric(c("freq"), c("target")), 6).alias("p_needed"),
    )


_A = "((freq + target * target) * (gain - loss) * (gain - loss))"
_BB = "((2 * freq * loss - target * target * (gain - loss)) * (gain - loss))"
_CC = "(freq * loss * loss)"
view("need", f"SELECT *, CASE WHEN {_BB} * {_BB} - 4 * {_A} * {_CC} >= 0 THEN (-{_BB} + sqrt({_BB} * {_BB} - 4 * {_A} * {_CC})) / (2 * {_A}) END AS need FROM payt", "payt")
_EDGE = "((gain - loss) * p + loss)"
view(
    "fneed",
    f"SELECT *, {_EDGE} / ((gain - loss) * sqrt(p * (1 - p))) * sqrt(f0) AS back FROM (SELECT *, pow(target * (gain - loss), 2) * p * (1 - p) / pow({_EDGE}, 2) AS f0 FROM need)",
    "need",
)


@query(
    "rsk2_asymmetric",
    with_views(
        f"SELECT study, trial, target, round({_EDGE} / ((gain - loss) * sqrt(p * (1 - p))) * sqrt(freq), 6) AS sharpe, round(need, 6) AS p_needed,"
        " CASE WHEN abs(back - target) <= 1e-8::DOUBLE + 1e-5::DOUBLE * target THEN round(f0, 4) END AS freq_needed FROM fneed",
        "fneed",
    ),
)
def rsk2(spark, d):
    c = F.col
    sl, pt = c("loss"), c("gain")
    return payoffs(spark, d).select(
        "study", "trial", "target", F.round(R.sharpe_asymmetric(sl, pt, c("freq"), c("p")), 6).alias("sharpe"),
        F.round(R.implied_precision(sl, pt, c("freq"), c("target")), 6).alias("p_needed"),
        F.round(R.implied_frequency(sl, pt, c("p"), c("target")), 4).alias("freq_needed"),
    )


@query(
    "rsk3_probability_of_failure",
    with_views(
        f"SELECT study, trial, target, round({norm_cdf_sql('z')}, 6) AS p_fail FROM (SELECT *, (need - p) / sqrt(p * (1 - p)) AS z FROM need)", "need"
    ),
)
def rsk3(spark, d):
    return R.probability_of_failure(payoffs(spark, d)).select("study", "trial", "target", r("p_fail"))


view(
    "rbase",
    f"""
SELECT b.*, n / yrs AS freq FROM (
SELECT instrument, count(*) AS n, avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END) AS p, avg(ret) FILTER (ret > 0) AS gain, avg(ret) FILTER (ret <= 0) AS loss,
       (epoch_us(max(t1)) - epoch_us(min(t0))) / {R.YEAR_US!r}::DOUBLE AS yrs, avg(ret) / stddev_samp(ret) AS target FROM bins GROUP BY 1) b
""",
    "bins",
)
view("rneed", f"SELECT *, (-{_BB} + sqrt({_BB} * {_BB} - 4 * {_A} * {_CC})) / (2 * {_A}) AS need FROM rbase", "rbase")


@query(
    "rsk4_strategy_risk",
    with_views(
        f"SELECT instrument, n, round(yrs, 8) AS elapsed_years, round(freq, 4) AS freq, round(p, 6) AS p, round({norm_cdf_sql('z')}, 6) AS p_fail FROM (SELECT *, (need - p) / sqrt(p * (1 - p)) AS z FROM rneed)",
        "rneed",
    ),
)
def rsk4(spark, d):
    b = bars(spark, d)
    ev = L.label_returns(b, tb_events(b))
    sharpe = S.sharpe_by(ev, ["instrument"], x="ret")
    return R.strategy_risk(ev, sharpe).select("instrument", "n", r("elapsed_years", 8), r("freq", 4), r("p"), r("p_fail"))


@query(
    "rsk5_barrier_context",
    with_views(
        f"SELECT instrument, round(t, 6) AS latest_trgt, round(t * {PT_SL[0]}::DOUBLE, 6) AS implied_pt, round(t * {PT_SL[1]}::DOUBLE, 6) AS implied_sl FROM (SELECT instrument, arg_max(trgt, t0) AS t FROM tev GROUP BY 1)",
        "tev",
    ),
)
def rsk5(spark, d):
    return R.barrier_context(tb_events(bars(spark, d)), pt_sl=PT_SL).select("instrument", r("latest_trgt"), r("implied_pt"), r("implied_sl"))


# --------------------------------------------------------------------------- rules on historical paths
view(
    "epath",
    "SELECT s.instrument, s.t0, b.pos - s.p0 AS j, b.close - c.close AS dev FROM spans s JOIN tbars c ON c.instrument = s.instrument AND c.pos = s.p0"
    " JOIN tbars b ON b.instrument = s.instrument AND b.pos BETWEEN s.p0 AND s.p1 WHERE s.t1 IS NOT NULL",
    "spans", "tbars",
)
view("oupair", "SELECT a.instrument, a.t0, a.j, a.dev AS x, b.dev AS y FROM epath a JOIN epath b ON a.instrument = b.instrument AND a.t0 = b.t0 AND b.j = a.j + 1", "epath")
view(
    "oup",
    """
SELECT *, CASE WHEN phi > 0 AND phi < 1 THEN -ln(2) / ln(phi) END AS half_life, phi > -1 AND phi < 1 AS stationary FROM (
SELECT m.instrument, any_value(n) AS n_pairs, any_value(f) AS phi, stddev_pop(p.y - f * p.x) AS sigma
FROM (SELECT instrument, count(*) AS n, covar_pop(y, x) / var_pop(x) AS f FROM oupair GROUP BY 1) m JOIN oupair p USING (instrument) GROUP BY 1)
""",
    "oupair",
)


def closed_events(spark, d):
    b = bars(spark, d)
    return b, tb_events(b)


@query("otr1_deviation_pairs", with_views(f"SELECT instrument, {T0_SQL}, j, round(x, 6) AS x, round(y, 6) AS y FROM oupair", "oupair"))
def otr1(spark, d):
    b, ev = closed_events(spark, d)
    return R.deviation_pairs(b, ev).select("instrument", T0(), "j", r("x"), r("y"))


@query(
    "otr2_ou_parameters",
    with_views("SELECT instrument, n_pairs, round(phi, 6) AS phi, round(sigma, 5) AS sigma, round(half_life, 5) AS half_life, stationary FROM oup", "oup"),
)
def otr2(spark, d):
    b, ev = closed_events(spark, d)
    return R.ou_parameters(R.pair_moments(b, ev)).select("instrument", "n_pairs", r("phi"), r("sigma", 5), r("half_life", 5), "stationary")


LEVELS = [0.5, 1.0, 2.0, 3.0]
view(
    "mesh",
    """
SELECT instrument, pt, sl, count(*) AS n_paths, avg(x) AS mean, stddev_pop(x) AS std, CASE WHEN stddev_pop(x) > 0 THEN avg(x) / stddev_pop(x) END AS sharpe
FROM (SELECT e.instrument, e.t0, u.m AS pt, v.m AS sl,
             coalesce(arg_min(e.dev, e.j) FILTER (e.dev > o.sigma * u.m OR e.dev < -o.sigma * v.m OR e.j > 4), arg_max(e.dev, e.j)) AS x
      FROM epath e JOIN oup o USING (instrument) CROSS JOIN (SELECT unnest([0.5::DOUBLE, 1, 2, 3]) AS m) u CROSS JOIN (SELECT unnest([0.5::DOUBLE, 1, 2, 3]) AS m) v
      WHERE e.j > 0 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3
""",
    "epath", "oup",
)


def mesh(spark, d):
    b, ev = closed_events(spark, d)
    spans = R.closed_spans(b, ev)
    params = R.ou_parameters(R.pair_moments(b, spans))
    return R.rule_mesh(R.event_paths(b, spans, max_hp=4), params, pts=LEVELS, sls=LEVELS, max_hp=4)


_MESH = "round(mean, 5) AS mean, round(std, 5) AS std, round(sharpe, 6) AS sharpe"


@query("otr3_rule_mesh", with_views(f"SELECT instrument, pt, sl, n_paths, {_MESH} FROM mesh", "mesh"))
def otr3(spark, d):
    return mesh(spark, d).select("instrument", "pt", "sl", "n_paths", r("mean", 5), r("std", 5), r("sharpe"))


view("bnode", "SELECT * FROM mesh WHERE sharpe IS NOT NULL QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY sharpe DESC, pt, sl) = 1", "mesh")


@query("otr4_best_node", with_views("SELECT instrument, round(sharpe, 6) AS sharpe FROM bnode", "bnode"))
def otr4(spark, d):
    return R.best_node(mesh(spark, d)).select("instrument", r("sharpe"))


@query(
    "pip9_ou_finding",
    with_views(
        "SELECT o.instrument, o.n_pairs, round(o.phi, 6) AS phi, o.stationary, CASE WHEN o.stationary THEN round(b.sharpe, 6) END AS sharpe FROM oup o LEFT JOIN bnode b USING (instrument)",
        "oup", "bnode",
    ),
)
def pip9(spark, d):
    b, ev = closed_events(spark, d)
    return R.ou_finding(b, ev, levels=LEVELS, max_hp=4).select("instrument", "n_pairs", r("phi"), "stationary", r("sharpe"))

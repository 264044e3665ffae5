"""Fractional differentiation, microstructure features and spectra."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tapeloom.catalog.base_sql import view, with_views
from tapeloom.catalog.registry import query
from tapeloom.functions.gaussian import norm_cdf_sql
from tapeloom.operators import bars as B
from tapeloom.operators import fracdiff as D
from tapeloom.operators import micro as M
from tapeloom.operators import ticks as K
from tapeloom.plans.series import reuse
from tapeloom.sources import canonical as C


def r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


def bars(spark, d):
    return reuse(C.tick_bar_table(spark, d))


def logs(spark, d):
    return bars(spark, d).select("instrument", "pos", F.log("close").alias("lp"))


# --------------------------------------------------------------------------- fractional differentiation
view(
    "wtab",
    """
SELECT instrument, pos AS k, 1::DOUBLE AS w FROM tbars WHERE pos = 0
UNION ALL
SELECT b.instrument, b.pos, -t.w * (0.4::DOUBLE - b.pos + 1) / b.pos FROM wtab t JOIN tbars b ON b.instrument = t.instrument AND b.pos = t.k + 1
""",
    "tbars",
)


@query("ffd1_weights", with_views("SELECT instrument, k, round(w, 9) AS w FROM wtab", "wtab"))
def ffd1(spark, d):
    return D.weight_table(bars(spark, d), d=0.4).select("instrument", "k", r("w", 9))


@query(
    "ffd2_threshold_weights",
    with_views(
        "SELECT instrument, k, round(w, 9) AS w FROM wtab t WHERE k < (SELECT min(k) FROM wtab u WHERE u.instrument = t.instrument AND abs(u.w) < 0.01)",
        "wtab",
    ),
)
def ffd2(spark, d):
    table = D.weight_table(bars(spark, d), d=0.4)
    stop = table.where(F.abs("w") < 0.01).groupBy("instrument").agg(F.min("k").alias("stop"))
    return table.join(stop, "instrument").where(F.col("k") < F.col("stop")).select("instrument", "k", r("w", 9))


view(
    "ffull",
    """
SELECT a.instrument, a.pos, sum(t.w * ln(b.close)) AS value, any_value(n.n) AS n
FROM tbars a JOIN tbars b ON a.instrument = b.instrument AND b.pos <= a.pos
JOIN wtab t ON t.instrument = a.instrument AND t.k = a.pos - b.pos
JOIN (SELECT instrument, count(*) AS n FROM tbars GROUP BY 1) n ON n.instrument = a.instrument
GROUP BY 1, 2
""",
    "wtab",
)
view(
    "fskip",
    "SELECT instrument, count(*) AS skip FROM (SELECT instrument, sum(abs(w)) OVER (PARTITION BY instrument ORDER BY k DESC) / sum(abs(w)) OVER (PARTITION BY instrument) AS share FROM wtab) WHERE share > 0.3 GROUP BY 1",
    "wtab",
)


@query(
    "ffd3_expanding",
    with_views("SELECT instrument, pos, round(value, 6) AS value FROM ffull JOIN fskip USING (instrument) WHERE pos >= skip", "ffull", "fskip"),
)
def ffd3(spark, d):
    return D.frac_diff(logs(spark, d), x="lp", d=0.4, thres=0.3).select("instrument", "pos", r("value"))


@query(
    "ffd4_fixed_width",
    with_views(
        "SELECT a.instrument, a.pos, round(sum(t.w * ln(b.close)), 6) AS value FROM tbars a JOIN tbars b ON a.instrument = b.instrument AND b.pos <= a.pos"
        " JOIN wtab t ON t.instrument = a.instrument AND t.k = a.pos - b.pos WHERE t.k < (SELECT min(k) FROM wtab WHERE abs(w) < 0.01)"
        " AND a.pos >= (SELECT min(k) FROM wtab WHERE abs(w) < 0.01) - 1 GROUP BY 1, 2",
        "wtab",
    ),
)
def ffd4(spark, d):
    return D.frac_diff_ffd(logs(spark, d), x="lp", d=0.4, thres=0.01).select("instrument", "pos", r("value"))


@query(
    "ffd5_calibrated_threshold",
    with_views(
        """
SELECT instrument, k + 1 AS n_weights, round((a + coalesce(nx, 0)) / 2, 9) AS thres FROM (
  SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY k) AS rn FROM (
    SELECT instrument, k, abs(w) AS a, lead(abs(w)) OVER (PARTITION BY instrument ORDER BY k) AS nx,
           sum(abs(w)) OVER (PARTITION BY instrument ORDER BY k) / sum(abs(w)) OVER (PARTITION BY instrument) AS share FROM wtab) WHERE share >= 0.9)
WHERE rn = 1
""",
        "wtab",
    ),
)
def ffd5(spark, d):
    return D.calibrate_threshold(D.weight_table(bars(spark, d), d=0.4), mass=0.9).select("instrument", "n_weights", r("thres", 9))


_GRID = [(d, D.weights_until(d, 0.01)) for d in D.D_GRID]


def fracdiff_views(p: str, bars: str) -> None:
    view(
        f"{p}grid",
        " UNION ALL ".join(
            f"SELECT instrument, pos, {d}::DOUBLE AS d, ln(close) AS lp, "
            + " + ".join(f"({float(w)!r}::DOUBLE) * ln(lag(close, {i}, close) OVER w)" for i, w in enumerate(ws))
            + f" AS value FROM {bars} WINDOW w AS (PARTITION BY instrument ORDER BY pos) QUALIFY pos >= {len(ws) - 1}"
            for d, ws in _GRID
        ),
        bars,
    )
    view(
        f"{p}adf",
        f"""
    SELECT *, CASE WHEN st > {D.TAU_MAX} THEN 1 WHEN st < {D.TAU_MIN} THEN 0 ELSE {norm_cdf_sql('z')} END AS p_value FROM (
    SELECT *, CASE WHEN st <= {D.TAU_STAR} THEN {D.TAU_SMALL[0]}::DOUBLE + {D.TAU_SMALL[1]}::DOUBLE * st + {D.TAU_SMALL[2]}::DOUBLE * st * st
              ELSE {D.TAU_LARGE[0]}::DOUBLE + {D.TAU_LARGE[1]}::DOUBLE * st + {D.TAU_LARGE[2]}::DOUBLE * st * st + {D.TAU_LARGE[3]}::DOUBLE * st * st * st END AS z
    FROM (SELECT *, b1 / sqrt((syy - b1 * s1y - b2 * s2y) / (n - 3) * s22 / dt) AS st FROM (
      SELECT *, (s22 * s1y - s12 * s2y) / dt AS b1, (s11 * s2y - s12 * s1y) / dt AS b2 FROM (
        SELECT *, s11 * s22 - s12 * s12 AS dt FROM (
          SELECT instrument, d, count(*) AS n, any_value(rho) AS rho, covar_pop(y1, y1) AS s11, covar_pop(dl, dl) AS s22, covar_pop(y1, dl) AS s12,
                 covar_pop(dy, y1) AS s1y, covar_pop(dy, dl) AS s2y, covar_pop(dy, dy) AS syy
          FROM (SELECT *, value - y1 AS dy, y1 - y2 AS dl FROM (
            SELECT instrument, d, pos, value, lag(value) OVER w AS y1, lag(value, 2) OVER w AS y2, corr(lp, value) OVER (PARTITION BY instrument, d) AS rho
            FROM {p}grid WINDOW w AS (PARTITION BY instrument, d ORDER BY pos))) WHERE dl IS NOT NULL GROUP BY 1, 2)))))
    """,
        f"{p}grid",
    )


fracdiff_views("", "tbars")


@query(
    "ffd6_adf_table",
    with_views(
        "SELECT instrument, d, round(st, 5) AS adf_stat, round(p_value, 7) AS p_value, n AS n_obs, round(rho, 6) AS corr,"
        f" round({D.CRIT_5PCT[0]}::DOUBLE + ({D.CRIT_5PCT[1]}::DOUBLE) / n + ({D.CRIT_5PCT[2]}::DOUBLE) / n / n + ({D.CRIT_5PCT[3]}::DOUBLE) / n / n / n, 6) AS critical_value_95 FROM adf",
        "adf",
    ),
)
def ffd6(spark, d):
    return D.find_min_ffd(bars(spark, d)).select(
        "instrument", "d", r("adf_stat", 5), r("p_value", 7), "n_obs", r("corr"), r("critical_value_95")
    )


@query(
    "ffd7_minimum_d",
    with_views("SELECT instrument, min(CASE WHEN p_value < 0.05 THEN d END) AS min_d FROM adf GROUP BY 1", "adf"),
)
def ffd7(spark, d):
    return D.minimum_d(D.find_min_ffd(bars(spark, d)))


@query(
    "ffd7_fracdiff_feature",
    with_views(
        "SELECT g.instrument, g.pos, g.d, round(g.value, 6) AS fracdiff FROM grid g JOIN (SELECT instrument, min(CASE WHEN p_value < 0.05 THEN d END) AS d FROM adf GROUP BY 1) m USING (instrument, d)",
        "adf",
    ),
)
def ffd7b(spark, d):
    return D.fracdiff_feature(bars(spark, d)).select("instrument", "pos", "d", r("fracdiff"))


# --------------------------------------------------------------------------- microstructure
def tagged(spark, d):
    return B.trades_with_bar_id(C.ticks(spark, d), measure="cents", threshold=1_500_000, compat=False)


view(
    "dch",
    "SELECT *, close - c1 AS dp, c1 - c2 AS dl FROM (SELECT *, lag(close) OVER w AS c1, lag(close, 2) OVER w AS c2 FROM tbars WINDOW w AS (PARTITION BY instrument ORDER BY pos))",
    "tbars",
)


@query(
    "mic1_roll",
    with_views(
        "SELECT instrument, round(cv, 6) AS cov_dp, round(vr, 6) AS var_dp, round(sqrt(greatest(0, -cv)), 6) AS c, round(sqrt(greatest(0, vr + 2 * cv)), 6) AS sigma_u"
        " FROM (SELECT instrument, covar_samp(dp, dl) AS cv, var_samp(dp) AS vr FROM dch GROUP BY 1)",
        "dch",
    ),
)
def mic1(spark, d):
    return M.roll_measure(bars(spark, d)).select("instrument", r("cov_dp"), r("var_dp"), r("c"), r("sigma_u"))


def roll_view(name: str, source: str) -> None:
    view(
        name,
        f"""
SELECT instrument, pos, CASE WHEN pos >= 20 THEN sqrt(greatest(0, -cv)) END AS roll_c, CASE WHEN pos >= 20 THEN sqrt(greatest(0, vr + 2 * cv)) END AS roll_sigma_u
FROM (SELECT instrument, pos, covar_samp(dp, dl) OVER (PARTITION BY instrument ORDER BY pos ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) AS cv,
             var_samp(dp) OVER (PARTITION BY instrument ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS vr
      FROM (SELECT *, close - c1 AS dp, c1 - c2 AS dl FROM (SELECT *, lag(close) OVER w AS c1, lag(close, 2) OVER w AS c2 FROM {source} WINDOW w AS (PARTITION BY instrument ORDER BY pos))))
""",
        source,
    )


roll_view("rroll", "tbars")


@query("mic1_roll_rolling", with_views("SELECT instrument, pos, round(roll_c, 5) AS roll_c, round(roll_sigma_u, 5) AS roll_sigma_u FROM rroll", "rroll"))
def mic1r(spark, d):
    return M.roll_rolling(bars(spark, d)).select("instrument", "pos", r("roll_c", 5), r("roll_sigma_u", 5))


_PARK = "sqrt(avg(pow(ln(high / low), 2)) {} / (4 * ln(2)))"


@query("mic2_parkinson", with_views(f"SELECT instrument, round({_PARK.format('')}, 6) AS parkinson_vol FROM tbars GROUP BY 1", "tbars"))
def mic2(spark, d):
    return M.parkinson(bars(spark, d)).select("instrument", r("parkinson_vol"))


_W20 = "OVER (PARTITION BY instrument ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query(
    "mic2_parkinson_rolling",
    with_views(f"SELECT instrument, pos, CASE WHEN pos >= 19 THEN round({_PARK.format(_W20)}, 6) END AS parkinson_vol_20bar FROM tbars", "tbars"),
)
def mic2r(spark, d):
    return M.parkinson_rolling(bars(spark, d)).select("instrument", "pos", r("parkinson_vol_20bar"))


def hl_view(name: str, source: str, sl: int) -> None:
    view(
        name,
        f"""
SELECT *, 2 * (exp(alpha) - 1) / (1 + exp(alpha)) AS spread,
       greatest(0, (pow(2, -0.5) - 1) * sqrt(beta) / ({M.K2 * M.DEN!r}::DOUBLE) + sqrt(gamma / ({M.K2 * M.K2 * M.DEN!r}::DOUBLE))) AS sigma
FROM (SELECT *, CASE WHEN beta IS NULL OR gamma IS NULL THEN NULL ELSE greatest(0, (sqrt(2) - 1) * sqrt(beta) / {M.DEN!r}::DOUBLE - sqrt(gamma / {M.DEN!r}::DOUBLE)) END AS alpha
FROM (SELECT instrument, pos, g AS gamma, CASE WHEN pos >= {sl} THEN avg(b) OVER (PARTITION BY instrument ORDER BY pos ROWS BETWEEN {sl - 1} PRECEDING AND CURRENT ROW) END AS beta
FROM (SELECT instrument, pos, CASE WHEN pos >= 1 THEN sum(pow(ln(high / low), 2)) OVER w END AS b,
             CASE WHEN pos >= 1 THEN pow(ln(max(high) OVER w / min(low) OVER w), 2) END AS g
      FROM {source} WINDOW w AS (PARTITION BY instrument ORDER BY pos ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))))
""",
        source,
    )


hl_view("hl3", "tbars", 3)


@query(
    "mic3_corwin_schultz",
    with_views("SELECT instrument, pos, round(beta, 6) AS beta, round(gamma, 6) AS gamma, round(alpha, 6) AS alpha, round(spread, 6) AS corwin_schultz_spread FROM hl3", "hl3"),
)
def mic3(spark, d):
    return M.high_low_estimators(bars(spark, d), sl=3).select(
        "instrument", "pos", r("beta"), r("gamma"), r("alpha"), r("corwin_schultz_spread")
    )


@query(
    "mic4_becker_parkinson",
    with_views("SELECT instrument, pos, CASE WHEN beta IS NOT NULL THEN round(sigma, 6) END AS becker_parkinson_sigma FROM hl3", "hl3"),
)
def mic4(spark, d):
    return M.high_low_estimators(bars(spark, d), sl=3).select("instrument", "pos", r("becker_parkinson_sigma"))


@query("mic5_kyle_lambda", with_views("SELECT instrument, bar_id, round(kyle_lambda, 6) AS kyle_lambda FROM d_kyle", "d_kyle"))
def mic5(spark, d):
    return M.kyle_lambda(tagged(spark, d), min_trades=5).select("instrument", "bar_id", r("kyle_lambda"))


@query(
    "mic6_amihud",
    with_views(
        "SELECT instrument, round(sum(dollar * abs(ln(close) - ln(c1))) / sum(CASE WHEN c1 IS NOT NULL THEN dollar * dollar END) * 1e6, 6) AS amihud_per_million FROM dch GROUP BY 1",
        "dch",
    ),
)
def mic6(spark, d):
    return M.amihud(bars(spark, d)).select("instrument", F.round(F.col("amihud_lambda") * 1e6, 6).alias("amihud_per_million"))


def amihud_view(name: str, source: str) -> None:
    view(
        name,
        f"""
SELECT instrument, pos, CASE WHEN pos >= 19 THEN sum(dollar * m) OVER w / sum(dollar * dollar) OVER w END AS amihud
FROM (SELECT *, abs(ln(close) - ln(lag(close) OVER (PARTITION BY instrument ORDER BY pos))) AS m FROM {source})
WINDOW w AS (PARTITION BY instrument ORDER BY pos ROWS BETWEEN 18 PRECEDING AND CURRENT ROW)
""",
        source,
    )


amihud_view("ramihud", "tbars")


@query("mic6_amihud_rolling", with_views("SELECT instrument, pos, round(amihud * 1e6, 6) AS amihud_per_million FROM ramihud", "ramihud"))
def mic6r(spark, d):
    return M.amihud_rolling(bars(spark, d)).select(
        "instrument", "pos", F.round(F.col("amihud_lambda_20bar") * 1e6, 6).alias("amihud_per_million")
    )


_W10 = "OVER (PARTITION BY instrument ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
_VPIN = f"CASE WHEN pos >= 9 THEN CAST(sum(abs(buy_volume - sell_volume)) {_W10} AS DOUBLE) / CAST(sum(buy_volume + sell_volume) {_W10} AS DOUBLE) END"


@query("mic7_vpin", with_views(f"SELECT instrument, pos, round({_VPIN} + 3e-10, 6) AS vpin_10bar FROM tbars", "tbars"))
def mic7(spark, d):
    return M.vpin(bars(spark, d), window=10).select("instrument", "pos", F.round(F.col("vpin_10bar") + 3e-10, 6).alias("vpin_10bar"))


@query(
    "mic8_round_sizes",
    with_views(
        "SELECT instrument, round(avg(CASE WHEN qty IN (10, 25, 50, 100) THEN 1.0 ELSE 0 END), 6) AS round_fraction, "
        + ", ".join(f"CAST(sum(CASE WHEN qty = {q} THEN 1 ELSE 0 END) AS BIGINT) AS n_{q}" for q in (10, 25, 50, 100))
        + " FROM ticks GROUP BY 1",
        "ticks",
    ),
)
def mic8(spark, d):
    out = M.round_sizes(C.ticks(spark, d), levels=(10, 25, 50, 100))
    return out.select("instrument", r("round_fraction"), "n_10", "n_25", "n_50", "n_100")


@query(
    "mic9_serial_correlation",
    with_views(
        "SELECT instrument, round(corr(side, l), 6) AS serial_corr_signed_flow FROM (SELECT *, lag(side) OVER (PARTITION BY instrument ORDER BY pos) AS l FROM ticks) GROUP BY 1",
        "ticks",
    ),
)
def mic9(spark, d):
    return M.serial_correlation(C.ticks(spark, d)).select("instrument", r("serial_corr_signed_flow"))


def feature_views(p: str, tag: str, bars: str) -> None:
    """The eleven features of bars ``bars`` whose trades are labelled in ``tag``: view ``<p>_features``."""
    view(f"{p}_trades", f"SELECT t.* FROM {tag} t JOIN {bars} b USING (instrument, bar_id)", tag, bars)
    view(
        f"{p}_kyle",
        f"""
SELECT instrument, bar_id, CASE WHEN count(*) >= 5 THEN regr_slope(dp, sv) END AS kyle_lambda FROM (
  SELECT *, price - lag(price) OVER (PARTITION BY instrument, bar_id ORDER BY pos) AS dp, CAST(qty * side AS DOUBLE) AS sv FROM {p}_trades) GROUP BY 1, 2
""",
        f"{p}_trades",
    )
    roll_view(f"{p}_roll", bars)
    hl_view(f"{p}_hl", bars, 1)
    amihud_view(f"{p}_amihud", bars)
    view(
        f"{p}_inner",
        f"""
SELECT instrument, bar_id, avg(CASE WHEN qty IN (1, 5, 10, 50, 100) THEN 1.0 ELSE 0 END) AS rf,
       CASE WHEN count(*) > 3 AND stddev_pop(CASE WHEN l IS NOT NULL THEN side END) > 0 AND stddev_pop(l) > 0
            THEN covar_pop(side, l) / (stddev_pop(CASE WHEN l IS NOT NULL THEN side END) * stddev_pop(l)) END AS sc,
       avg(CASE WHEN tick = side THEN 1.0 ELSE 0 END) AS ta
FROM (SELECT *, lag(side) OVER w AS l, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY instrument, bar_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS tick
      FROM (SELECT *, nullif(sign(price - lag(price) OVER (PARTITION BY instrument, bar_id ORDER BY pos)), 0) AS s FROM {p}_trades)
      WINDOW w AS (PARTITION BY instrument, bar_id ORDER BY pos)) GROUP BY 1, 2
""",
        f"{p}_trades",
    )
    view(
        f"{p}_features",
        f"""
SELECT b.instrument, b.bar_id, b.pos, b.ts, b.close, roll_c, roll_sigma_u, CASE WHEN b.pos >= 19 THEN pk END AS parkinson_vol_20bar, spread AS corwin_schultz_spread,
       CASE WHEN h.beta IS NOT NULL THEN h.sigma END AS becker_parkinson_sigma, kyle_lambda, amihud AS amihud_lambda_20bar, vp AS vpin_10bar,
       rf AS round_number_fraction, sc AS serial_corr_signed_flow, ta AS tick_rule_accuracy
FROM (SELECT *, {_PARK.format(_W20)} AS pk, {_VPIN} AS vp FROM {bars}) b
JOIN {p}_roll USING (instrument, pos) JOIN {p}_hl h USING (instrument, pos) JOIN {p}_amihud USING (instrument, pos)
JOIN {p}_kyle USING (instrument, bar_id) JOIN {p}_inner USING (instrument, bar_id)
""",
        bars, f"{p}_roll", f"{p}_hl", f"{p}_amihud", f"{p}_kyle", f"{p}_inner",
    )


feature_views("d", "dbars_tag", "dbars")
FEATS = [c for c in M.FEATURES]


def feature_bars(spark, d):
    t = tagged(spark, d)
    return t, reuse(B.bar_aggregates(t))


@query(
    "mic10_feature_table",
    with_views(
        "SELECT instrument, bar_id, "
        + ", ".join(f"round({c}{' * 1e6' if c.startswith('amihud') else ''} + 3e-10, 5) AS {c}" for c in FEATS)
        + " FROM d_features",
        "d_features",
    ),
)
def mic10(spark, d):
    t, b = feature_bars(spark, d)
    scale = {"amihud_lambda_20bar": 1e6}
    return M.feature_table(b, t).select(
        "instrument", "bar_id", *[F.round(F.col(c) * F.lit(scale.get(c, 1.0)) + 3e-10, 5).alias(c) for c in FEATS]
    )


FREQS = [float(f) for f in np.round(np.linspace(0.1, 4.0, 400), 6)]
view(
    "nud",
    f"""
SELECT instrument, freq, sum(price * cos(-2 * {math.pi!r} * freq * days)) AS re, sum(price * sin(-2 * {math.pi!r} * freq * days)) AS im
FROM (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY instrument)) / 86400000000.0::DOUBLE AS days FROM ticks)
CROSS JOIN (SELECT unnest([{', '.join(f'{f}::DOUBLE' for f in FREQS)}]) AS freq) GROUP BY 1, 2
""",
    "ticks",
)


def spectrum(spark, d):
    return M.nudft(K.elapsed_days(C.ticks(spark, d)), t="days", v="price", freqs=FREQS)


@query(
    "mic11_spectrum",
    with_views("SELECT instrument, freq, round(re, 4) AS re, round(im, 4) AS im, round(sqrt(re * re + im * im), 4) AS magnitude, round(re * re + im * im, 1) AS power FROM nud", "nud"),
)
def mic11(spark, d):
    return spectrum(spark, d).select("instrument", "freq", r("re", 4), r("im", 4), r("magnitude", 4), r("power", 1))


@query(
    "mic11_spectrum_summary",
    with_views(
        "SELECT instrument, arg_max(freq, p) AS peak_freq, round(max(p), 1) AS peak_power, round(stddev_pop(p) / avg(p), 6) AS flatness FROM (SELECT *, re * re + im * im AS p FROM nud) GROUP BY 1",
        "nud",
    ),
)
def mic11s(spark, d):
    return M.spectrum_summary(spectrum(spark, d)).select("instrument", "peak_freq", r("peak_power", 1), r("flatness"))

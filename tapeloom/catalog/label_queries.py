"""Labels and sample weights on five-trade bars and CUSUM events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog.base_sql import view, with_views
from tapeloom.catalog.registry import query
from tapeloom.operators import bars as B
from tapeloom.operators import labels as L
from tapeloom.operators import ticks as K
from tapeloom.operators import weights as W
from tapeloom.plans.series import position, reuse
from tapeloom.sources import canonical as C

PT_SL = (0.3, 0.1)
MIN_RET = 0.01
DAYS = 2
SPAN = 20


def r(c: str, n: int = 6):
    return F.round(c, n).alias(c)



def T0():
    return F.unix_micros("t0").alias("t0_us")


def T1():
    return F.unix_micros("t1").alias("t1_us")


T0_SQL, T1_SQL = "epoch_us(t0) AS t0_us", "epoch_us(t1) AS t1_us"


def bars(spark, d):
    return reuse(C.tick_bar_table(spark, d))


def sampled(b):
    return reuse(B.cusum_filter(b, h=60.0).select("instrument", F.col("ts").alias("t0")))


def volatility(b):
    return reuse(L.daily_volatility(b, span=SPAN))


def tb_events(b):
    return reuse(
        L.triple_barrier_events(b, sampled(b), volatility(b), pt_sl=PT_SL, min_ret=MIN_RET, num_days=DAYS)
    )


view("ev", "SELECT instrument, pos, ts AS t0 FROM cusum60", "cusum60")
view(
    "dv",
    """
SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY pos) - 1 AS k FROM (
  SELECT b.instrument, b.pos, b.ts, b.close, b.close / p.close - 1 AS ret
  FROM tbars b ASOF JOIN tbars p ON b.instrument = p.instrument AND b.ts - INTERVAL 1 DAY > p.ts)
""",
    "tbars",
)
_B = "(1 - 2.0/21.0)::DOUBLE"
view(
    "vol",
    f"""
SELECT instrument, pos, ts, any_value(rr) AS ret,
       CASE WHEN count(*) > 1 THEN sqrt(greatest(0, sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2))
            * sum(w) * sum(w) / (sum(w) * sum(w) - sum(w * w))) END AS vol
FROM (SELECT a.instrument, a.pos, a.ts, a.ret AS rr, b.ret AS x, pow({_B}, a.k - b.k) AS w
      FROM dv a JOIN dv b ON a.instrument = b.instrument AND b.k <= a.k)
GROUP BY instrument, pos, ts
""",
    "dv",
)
view(
    "vb",
    "SELECT e.instrument, e.t0, b.ts AS t1 FROM ev e ASOF JOIN tbars b ON e.instrument = b.instrument AND e.t0 + INTERVAL 2 DAY <= b.ts",
    "ev", "tbars",
)
view(
    "tev0",
    f"SELECT e.instrument, e.t0, v.vol AS trgt, b.t1, 1 AS side FROM (ev e ASOF JOIN vol v ON e.instrument = v.instrument AND e.t0 <= v.ts)"
    f" LEFT JOIN vb b ON b.instrument = e.instrument AND b.t0 = e.t0 WHERE v.vol > {MIN_RET}",
    "ev", "vol", "vb",
)


def touch_view(name: str, base: str, pt: float, sl: float) -> None:
    touch_on(name, base, "tbars", pt, sl)


def touch_on(name: str, base: str, bars_view: str, pt: float, sl: float) -> None:
    view(
        name,
        f"""
SELECT e.instrument, e.t0, e.t1, e.trgt, e.side,
       min(CASE WHEN (b.close / c.close - 1) * e.side < -{sl}::DOUBLE * e.trgt THEN b.ts END) AS sl_ts,
       min(CASE WHEN (b.close / c.close - 1) * e.side > {pt}::DOUBLE * e.trgt THEN b.ts END) AS pt_ts
FROM {base} e JOIN {bars_view} c ON c.instrument = e.instrument AND c.ts = e.t0
JOIN {bars_view} b ON b.instrument = e.instrument AND b.ts >= e.t0 AND b.ts <= coalesce(e.t1, TIMESTAMP '2100-01-01')
GROUP BY ALL
""",
        base, bars_view,
    )


touch_view("touch", "tev0", *PT_SL)
view("tev", "SELECT instrument, t0, trgt, side, least(t1, sl_ts, pt_ts) AS t1 FROM touch", "touch")


def bins_view(name: str, base: str) -> None:
    view(
        name,
        f"""
SELECT e.*, x.close / c.close - 1 AS ret FROM {base} e
JOIN tbars c ON c.instrument = e.instrument AND c.ts = e.t0 JOIN tbars x ON x.instrument = e.instrument AND x.ts = e.t1
WHERE e.t1 IS NOT NULL
""",
        base, "tbars",
    )


bins_view("bins", "tev")
view(
    "msides",
    """
SELECT e.instrument, e.t0, CASE WHEN m.close > m.ma THEN 1 ELSE -1 END AS side FROM ev e
ASOF JOIN (SELECT instrument, ts, close, CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w END AS ma FROM tbars
           WINDOW w AS (PARTITION BY instrument ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) m
  ON e.instrument = m.instrument AND e.t0 >= m.ts
""",
    "ev", "tbars",
)
view("mev0", "SELECT t.instrument, t.t0, t.t1, t.trgt, s.side FROM tev0 t JOIN msides s USING (instrument, t0)", "tev0", "msides")
touch_view("mtouch", "mev0", *PT_SL)
view("mev", "SELECT instrument, t0, trgt, side, least(t1, sl_ts, pt_ts) AS t1 FROM mtouch", "mtouch")
bins_view("mbins", "mev")
view(
    "fixh",
    """
SELECT e.instrument, e.t0, n / close - 1 AS ret, CASE WHEN n / close - 1 > 0.5 THEN 1 WHEN n / close - 1 < -0.5 THEN -1 ELSE 0 END AS bin
FROM ev e JOIN (SELECT *, lead(close, 3) OVER (PARTITION BY instrument ORDER BY pos) AS n FROM tbars) b
  ON b.instrument = e.instrument AND b.ts = e.t0 WHERE n IS NOT NULL
""",
    "ev", "tbars",
)


@query("lab1_fixed_horizon", with_views(f"SELECT instrument, {T0_SQL}, round(ret, 6) AS ret, bin FROM fixh", "fixh"))
def lab1(spark, d):
    b = bars(spark, d)
    return L.fixed_horizon(b, sampled(b), horizon=3, tau=0.5).select("instrument", T0(), r("ret"), "bin")


@query("lab2_daily_volatility", with_views("SELECT instrument, pos, round(ret, 6) AS ret, round(vol, 6) AS vol FROM vol", "vol"))
def lab2(spark, d):
    return L.daily_volatility(bars(spark, d), span=SPAN).select("instrument", "pos", r("ret"), r("vol"))


@query("lab3_vertical_barrier", with_views(f"SELECT instrument, {T0_SQL}, {T1_SQL} FROM vb", "vb"))
def lab3(spark, d):
    b = bars(spark, d)
    return L.vertical_barrier(b, sampled(b), days=DAYS).select("instrument", T0(), T1())


@query(
    "lab4_first_touch",
    with_views(f"SELECT instrument, {T0_SQL}, epoch_us(sl_ts) AS sl_us, epoch_us(pt_ts) AS pt_us FROM touch", "touch"),
)
def lab4(spark, d):
    b = bars(spark, d)
    ev = sampled(b)
    vol = volatility(b)
    ev = L.asof(ev, vol, {"trgt": "vol"}, left_on=L.us("t0"), right_on=L.us("ts"), forward=True).where(F.col("trgt") > MIN_RET)
    ev = ev.join(L.vertical_barrier(b, ev, days=DAYS), ["instrument", "t0"], "left").withColumn("side", F.lit(1))
    return L.first_touch(b, ev, pt=PT_SL[0], sl=PT_SL[1]).select(
        "instrument", T0(), F.unix_micros("sl_ts").alias("sl_us"), F.unix_micros("pt_ts").alias("pt_us")
    )


@query("lab5_triple_barrier", with_views(f"SELECT instrument, {T0_SQL}, {T1_SQL}, round(trgt, 6) AS trgt FROM tev", "tev"))
def lab5(spark, d):
    return tb_events(bars(spark, d)).select("instrument", T0(), T1(), r("trgt"))


@query(
    "lab6_return_labels",
    with_views(f"SELECT instrument, {T0_SQL}, {T1_SQL}, round(ret, 6) AS ret, CAST(sign(ret) AS INTEGER) AS bin FROM bins", "bins"),
)
def lab6(spark, d):
    b = bars(spark, d)
    return L.label_returns(b, tb_events(b)).select("instrument", T0(), T1(), r("ret"), "bin")


def sided(b):
    ev = L.moving_average_side(b, sampled(b), window=20)
    return L.meta_events(b, ev, volatility(b), pt_sl=PT_SL, min_ret=MIN_RET, num_days=DAYS)


@query("lab7_meta_events", with_views(f"SELECT instrument, {T0_SQL}, {T1_SQL}, round(trgt, 6) AS trgt, side FROM mev", "mev"))
def lab7(spark, d):
    return sided(bars(spark, d)).select("instrument", T0(), T1(), r("trgt"), "side")


@query(
    "lab8_meta_labels",
    with_views(f"SELECT instrument, {T0_SQL}, round(ret * side, 6) AS ret, CASE WHEN ret * side > 0 THEN 1 ELSE 0 END AS bin FROM mbins", "mbins"),
)
def lab8(spark, d):
    b = bars(spark, d)
    return L.meta_labels(b, sided(b)).select("instrument", T0(), r("ret"), "bin")


@query(
    "lab9_drop_rare_labels",
    with_views(
        f"""
SELECT instrument, {T0_SQL}, bin FROM fixh f WHERE NOT (
  (SELECT count(DISTINCT bin) FROM fixh g WHERE g.instrument = f.instrument) >= 3
  AND (SELECT count(*) FROM fixh g WHERE g.instrument = f.instrument AND g.bin = f.bin) <= 0.22::DOUBLE * (SELECT count(*) FROM fixh g WHERE g.instrument = f.instrument)
  AND f.bin = (SELECT bin FROM fixh g WHERE g.instrument = f.instrument GROUP BY bin ORDER BY count(*), bin LIMIT 1))
""",
        "fixh",
    ),
)
def lab9(spark, d):
    b = bars(spark, d)
    labels = L.fixed_horizon(b, sampled(b), horizon=3, tau=0.5)
    return L.drop_rare_labels(labels, min_pct=0.22).select("instrument", T0(), "bin")


@query("lab10_moving_average_side", with_views(f"SELECT instrument, {T0_SQL}, side FROM msides", "msides"))
def lab10(spark, d):
    b = bars(spark, d)
    return L.moving_average_side(b, sampled(b), window=20).select("instrument", T0(), "side")


@query(
    "lab11_label_distribution",
    with_views(
        "SELECT bin, CAST(sum(CASE WHEN m = 'fixed' THEN 1 ELSE 0 END) AS BIGINT) AS fixed, CAST(sum(CASE WHEN m = 'barrier' THEN 1 ELSE 0 END) AS BIGINT) AS barrier"
        " FROM (SELECT 'fixed' AS m, bin FROM fixh UNION ALL SELECT 'barrier', CAST(sign(ret) AS INTEGER) FROM bins) GROUP BY 1",
        "fixh", "bins",
    ),
)
def lab11(spark, d):
    b = bars(spark, d)
    ev = sampled(b)
    return L.label_distribution(
        {"fixed": L.fixed_horizon(b, ev, horizon=3, tau=0.5), "barrier": L.label_returns(b, tb_events(b))}
    )


@query(
    "lab12_events_with_labels",
    with_views(f"SELECT instrument, {T0_SQL}, {T1_SQL}, round(trgt, 6) AS trgt, round(ret, 6) AS ret, CAST(sign(ret) AS INTEGER) AS bin FROM bins", "bins"),
)
def lab12(spark, d):
    b = bars(spark, d)
    ev = tb_events(b)
    return L.events_with_labels(ev, L.label_returns(b, ev)).select("instrument", T0(), T1(), r("trgt"), r("ret"), "bin")


@query(
    "lab13_path_touch",
    with_views(
        """
SELECT path, min(idx) AS touch FROM (SELECT path, idx, sum(ln(1 + r)) OVER (PARTITION BY path ORDER BY idx) AS p FROM (
  SELECT instrument || '-' || strftime(ts, '%Y%m%d') AS path, side * qty / 10000.0::DOUBLE AS r,
         row_number() OVER (PARTITION BY instrument, CAST(ts AS DATE) ORDER BY ts, seq) - 1 AS idx FROM ticks)) WHERE abs(p) >= 0.02 GROUP BY 1
""",
        "ticks",
    ),
)
def lab13(spark, d):
    t = C.ticks(spark, d).select(
        F.concat_ws("-", "instrument", F.date_format("ts", "yyyyMMdd")).alias("path"), "ts", "seq",
        (F.col("side") * F.col("qty") / F.lit(10000.0)).alias("r"),
    )
    paths = position(t, ["ts", "seq"], keys=["path"], name="idx").select("path", "idx", "r")
    return L.path_barrier_touch(paths, width=0.02)


# --------------------------------------------------------------------------- weights
view(
    "spans",
    """
SELECT e.*, b.pos AS p0, coalesce(x.pos, (SELECT max(pos) FROM tbars m WHERE m.instrument = e.instrument)) AS p1
FROM tev e JOIN tbars b ON b.instrument = e.instrument AND b.ts = e.t0
LEFT JOIN tbars x ON x.instrument = e.instrument AND x.ts = e.t1
""",
    "tev", "tbars",
)
view(
    "conc",
    """
SELECT b.instrument, b.pos, b.ts, b.close, count(s.t0) AS c, ln(b.close) - ln(lag(b.close) OVER (PARTITION BY b.instrument ORDER BY b.pos)) AS lr
FROM tbars b LEFT JOIN spans s ON s.instrument = b.instrument AND b.pos BETWEEN s.p0 AND s.p1 GROUP BY b.instrument, b.pos, b.ts, b.close
""",
    "tbars", "spans",
)
view(
    "uniq",
    """
SELECT s.instrument, s.t0, avg(1.0::DOUBLE / c.c) AS tw, abs(sum(coalesce(c.lr, 0) / c.c)) AS w
FROM spans s JOIN conc c ON c.instrument = s.instrument AND c.pos BETWEEN s.p0 AND s.p1 GROUP BY 1, 2
""",
    "spans", "conc",
)


@query("wgt1_concurrency", with_views("SELECT instrument, pos, c FROM conc", "conc"))
def wgt1(spark, d):
    b = bars(spark, d)
    return W.concurrency(b, tb_events(b)).select("instrument", "pos", "c")


@query("wgt2_average_uniqueness", with_views(f"SELECT instrument, {T0_SQL}, round(tw, 6) AS tw FROM uniq", "uniq"))
def wgt2(spark, d):
    b = bars(spark, d)
    return W.average_uniqueness(b, tb_events(b)).select("instrument", T0(), r("tw"))


@query(
    "wgt3_return_attribution",
    with_views(
        f"SELECT instrument, {T0_SQL}, round(w * count(*) OVER (PARTITION BY instrument) / sum(w) OVER (PARTITION BY instrument), 6) AS w FROM uniq",
        "uniq",
    ),
)
def wgt3(spark, d):
    b = bars(spark, d)
    return W.return_attribution(b, tb_events(b)).select("instrument", T0(), r("w"))


def _decay_sql(last: str, slope: str) -> str:
    return with_views(
        f"SELECT instrument, {T0_SQL}, round(greatest(0, 1 - {slope} * s + {slope} * c), 6) AS decay FROM ("
        "SELECT *, sum(tw) OVER (PARTITION BY instrument) AS s, sum(tw) OVER (PARTITION BY instrument ORDER BY t0) AS c FROM uniq)",
        "uniq",
    )


@query("wgt4_time_decay", _decay_sql("0.5", "(0.5 / s)"))
def wgt4(spark, d):
    b = bars(spark, d)
    return W.time_decay(W.average_uniqueness(b, tb_events(b)), last=0.5).select("instrument", T0(), r("decay"))


@query("wgt4_time_decay_cut", _decay_sql("-0.5", "(1 / (0.5 * s))"))
def wgt4c(spark, d):
    b = bars(spark, d)
    return W.time_decay(W.average_uniqueness(b, tb_events(b)), last=-0.5).select("instrument", T0(), r("decay"))


@query(
    "wgt5_indicator",
    with_views(f"SELECT instrument, {T0_SQL}, unnest(generate_series(p0, p1)) AS pos FROM spans", "spans"),
)
def wgt5(spark, d):
    b = bars(spark, d)
    return W.indicator(b, tb_events(b)).select("instrument", T0(), "pos")


view("copies", "SELECT *, epoch_us(t0) % 3 AS copies FROM spans", "spans")
view(
    "mconc",
    "SELECT b.instrument, b.pos, CAST(sum(coalesce(s.copies, 0)) AS BIGINT) AS c FROM tbars b LEFT JOIN copies s ON s.instrument = b.instrument AND b.pos BETWEEN s.p0 AND s.p1 GROUP BY 1, 2",
    "tbars", "copies",
)


def drawn(b):
    return tb_events(b).withColumn("copies", F.unix_micros("t0") % 3)


@query(
    "wgt6_indicator_uniqueness",
    with_views(
        f"SELECT instrument, {T0_SQL}, round(avg_u, 6) AS avg_u FROM (SELECT s.instrument, s.t0, avg(1.0::DOUBLE / c.c) AS avg_u FROM copies s JOIN mconc c"
        " ON c.instrument = s.instrument AND c.pos BETWEEN s.p0 AND s.p1 WHERE s.copies > 0 GROUP BY 1, 2)",
        "copies", "mconc",
    ),
)
def wgt6(spark, d):
    b = bars(spark, d)
    return W.indicator_uniqueness(b, drawn(b)).select("instrument", T0(), r("avg_u"))


@query(
    "wgt7_draw_probabilities",
    with_views(
        f"SELECT instrument, {T0_SQL}, round(u, 6) AS avg_u, round(u / sum(u) OVER (PARTITION BY instrument), 8) AS prob FROM ("
        "SELECT s.instrument, s.t0, avg(1.0::DOUBLE / (c.c + 1)) AS u FROM copies s JOIN mconc c"
        " ON c.instrument = s.instrument AND c.pos BETWEEN s.p0 AND s.p1 GROUP BY 1, 2)",
        "copies", "mconc",
    ),
)
def wgt7(spark, d):
    b = bars(spark, d)
    return W.draw_probabilities(b, drawn(b)).select("instrument", T0(), r("avg_u"), r("prob", 8))


@query("wgt8_sequential_bootstrap")
def wgt8(spark, d):
    b = bars(spark, d)
    return W.sequential_bootstrap(b, tb_events(b), trials=2).select("instrument", "window", "trial", "draw", T0())


@query("wgt9_bootstrap_comparison")
def wgt9(spark, d):
    b = bars(spark, d)
    return W.bootstrap_comparison(b, tb_events(b), max_events=50, trials=10)


def label_views(p: str, bars_view: str, events_view: str, *, beta: str, pt: float, sl: float, min_ret: float, days: int) -> None:
    """Volatility, barriers, labels, concurrency and weights on any bar view; closed labels only."""
    view(
        f"{p}_dv",
        f"""
SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY pos) - 1 AS k FROM (
  SELECT b.instrument, b.pos, b.ts, b.close, b.close / p.close - 1 AS ret
  FROM {bars_view} b ASOF JOIN {bars_view} p ON b.instrument = p.instrument AND b.ts - INTERVAL 1 DAY > p.ts)
""",
        bars_view,
    )
    view(
        f"{p}_vol",
        f"""
SELECT instrument, pos, ts, CASE WHEN count(*) > 1 THEN sqrt(greatest(0, sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2))
            * sum(w) * sum(w) / (sum(w) * sum(w) - sum(w * w))) END AS vol
FROM (SELECT a.instrument, a.pos, a.ts, b.ret AS x, pow({beta}, a.k - b.k) AS w FROM {p}_dv a JOIN {p}_dv b ON a.instrument = b.instrument AND b.k <= a.k)
GROUP BY instrument, pos, ts
""",
        f"{p}_dv",
    )
    view(
        f"{p}_t0",
        f"""
SELECT e.instrument, e.ts AS t0, v.vol AS trgt, 1 AS side, x.t1 FROM ({events_view} e ASOF JOIN {p}_vol v ON e.instrument = v.instrument AND e.ts <= v.ts)
LEFT JOIN (SELECT e2.instrument, e2.ts AS t0, b.ts AS t1 FROM {events_view} e2 ASOF JOIN {bars_view} b ON e2.instrument = b.instrument AND e2.ts + INTERVAL {days} DAY <= b.ts) x
  ON x.instrument = e.instrument AND x.t0 = e.ts WHERE v.vol > {min_ret}
""",
        f"{p}_vol", events_view,
    )
    touch_on(f"{p}_touch", f"{p}_t0", bars_view, pt, sl)
    view(
        f"{p}_bins",
        f"""
SELECT e.*, c.pos AS p0, x.pos AS p1, x.close / c.close - 1 AS ret FROM (SELECT instrument, t0, trgt, least(t1, sl_ts, pt_ts) AS t1 FROM {p}_touch) e
JOIN {bars_view} c ON c.instrument = e.instrument AND c.ts = e.t0 JOIN {bars_view} x ON x.instrument = e.instrument AND x.ts = e.t1 WHERE e.t1 IS NOT NULL
""",
        f"{p}_touch",
    )
    view(
        f"{p}_conc",
        f"""
SELECT b.instrument, b.pos, count(s.t0) AS c, ln(b.close) - ln(lag(b.close) OVER (PARTITION BY b.instrument ORDER BY b.pos)) AS lr
FROM {bars_view} b LEFT JOIN {p}_bins s ON s.instrument = b.instrument AND b.pos BETWEEN s.p0 AND s.p1 GROUP BY b.instrument, b.pos, b.close
""",
        f"{p}_bins",
    )
    view(
        f"{p}_weights",
        f"""
SELECT *, w0 * count(*) OVER (PARTITION BY instrument) / sum(w0) OVER (PARTITION BY instrument) AS w FROM (
SELECT s.instrument, s.t0, s.t1, s.trgt, s.ret, avg(1.0::DOUBLE / c.c) AS tw, abs(sum(coalesce(c.lr, 0) / c.c)) AS w0
FROM {p}_bins s JOIN {p}_conc c ON c.instrument = s.instrument AND c.pos BETWEEN s.p0 AND s.p1 GROUP BY ALL)
""",
        f"{p}_conc",
    )

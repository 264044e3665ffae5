"""Contract sources, rolls, baskets, portfolios, structural breaks and entropy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog.base_sql import view, with_views
from tapeloom.catalog.registry import query
from tapeloom.operators import breaks as X
from tapeloom.operators import entropy as E
from tapeloom.operators import portfolio as P
from tapeloom.operators import rolls as R
from tapeloom.operators import ticks as K
from tapeloom.plans.series import lagged, position, reuse
from tapeloom.sources import canonical as C
from tapeloom.sources.contracts import read_contract_panel, read_contracts
from tapeloom.sources.storage import scratch

PRODUCTS = ["p0", "p1", "p2", "p3"]
ASSETS = ["a1", "a2", "a3", "a4", "a5"]


def r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


def bars(spark, d):
    return reuse(C.tick_bar_table(spark, d))



def DAY():
    return F.date_format("date", "yyyy-MM-dd").alias("day")


DAY_SQL = "strftime(date, '%Y-%m-%d') AS day"

# --------------------------------------------------------------------------- contract files
_FILE_SQL = with_views(
    f"SELECT instrument, contract, {DAY_SQL}, open, high, low, close, volume, open_int FROM contracts", "contracts"
)


def _write_contracts(panel, path: str, *, headered: bool) -> None:
    """One folder per product; the text layout of the driver's own contract rows."""
    day = F.date_format("date", "MM/dd/yyyy" if headered else "yyMMdd")
    cols = [day.alias("Date"), "open", "high", "low", "close", "volume", "open_int"]
    line = F.concat_ws(",", *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols])
    panel.select("instrument", "contract", line.alias("value")).repartition("instrument", "contract").write.partitionBy(
        "instrument", "contract"
    ).text(path)


@query("src2_contract_rows", _FILE_SQL)
def src2(spark, d):
    path = scratch(spark, "contracts")
    panel = C.contracts(spark, d)
    for part, headered in ((panel.where(F.col("date") < "1999-01-01"), False), (panel.where(F.col("date") >= "1999-01-01"), True)):
        _write_contracts(part, f"{path}/{'new' if headered else 'old'}", headered=headered)
    contract = F.regexp_extract(F.col("_metadata.file_path"), "contract=([^/]+)/", 1)
    product = F.regexp_extract(F.col("_metadata.file_path"), "instrument=([^/]+)/", 1)
    return read_contracts(spark, path, instrument_from=product, contract_from=contract).select(
        "instrument", "contract", DAY(), "open", "high", "low", "close", "volume", "open_int"
    )


@query(
    "src3_contract_panel",
    with_views(
        "SELECT instrument, contract, count(*) AS n_days, strftime(min(date), '%Y-%m-%d') AS first_day, strftime(max(date), '%Y-%m-%d') AS last_day, CAST(sum(volume) AS BIGINT) AS volume FROM contracts GROUP BY 1, 2",
        "contracts",
    ),
)
def src3(spark, d):
    path = scratch(spark, "panel")
    _write_contracts(C.contracts(spark, d), path, headered=True)
    contract = F.regexp_extract(F.col("_metadata.file_path"), "contract=([^/]+)/", 1)
    product = F.regexp_extract(F.col("_metadata.file_path"), "instrument=([^/]+)/", 1)
    panel = read_contract_panel(spark, path, instrument_from=product, contract_from=contract)
    return panel.groupBy("instrument", "contract").agg(
        F.count(F.lit(1)).alias("n_days"), F.date_format(F.min("date"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("date"), "yyyy-MM-dd").alias("last_day"), F.sum("volume").alias("volume"),
    )


# --------------------------------------------------------------------------- rolls
view(
    "front",
    """
SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY date) - 1 AS pos FROM (
  SELECT instrument, date, contract, open, close FROM contracts QUALIFY row_number() OVER (PARTITION BY instrument, date ORDER BY volume DESC, contract) = 1)
""",
    "contracts",
)


def front(spark, d):
    return reuse(R.front_month_by_volume(C.contracts(spark, d)))


@query("rol1_front_by_volume", with_views(f"SELECT instrument, {DAY_SQL}, contract, open, close FROM front", "front"))
def rol1(spark, d):
    return front(spark, d).select("instrument", DAY(), "contract", "open", "close")


view(
    "laid",
    """
SELECT k.instrument, k.contract, k.date, c.open, c.high, c.low, c.close, c.volume, c.open_int FROM (
  SELECT instrument, contract, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM contracts
  WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY 1, 2) k
LEFT JOIN contracts c USING (instrument, contract, date) WHERE isodow(k.date) < 6
""",
    "contracts",
)
_L3 = "OVER (PARTITION BY instrument, contract ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
view(
    "oifront",
    "SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY date) - 1 AS pos FROM (SELECT * FROM (SELECT instrument, contract, date, "
    + ", ".join(f"last_value({c} IGNORE NULLS) {_L3} AS {c}" for c in ("open", "high", "low", "close", "volume", "open_int"))
    + " FROM laid) WHERE close IS NOT NULL QUALIFY row_number() OVER (PARTITION BY instrument, date ORDER BY open_int DESC, contract DESC) = 1)",
    "laid",
)


def oi_front(spark, d):
    return R.front_month_by_open_interest(C.contracts(spark, d), start="1996-01-01", end="2000-12-31")


@query("rol2_front_by_open_interest", with_views(f"SELECT instrument, {DAY_SQL}, contract, open, close, open_int FROM oifront", "oifront"))
def rol2(spark, d):
    return oi_front(spark, d).select("instrument", DAY(), "contract", "open", "close", "open_int")


def roll_sql(name: str, source: str) -> None:
    view(
        name,
        f"""
SELECT *, CASE WHEN ret IS NOT NULL THEN CASE WHEN min(abs(1 + ret)) OVER w = 0 THEN 0
       ELSE exp(sum(ln(abs(nullif(1 + ret, 0)))) OVER w) * pow(-1, sum(CASE WHEN 1 + ret < 0 THEN 1 ELSE 0 END) OVER w) END END AS r_price
FROM (SELECT *, (rc - lag(rc) OVER (PARTITION BY instrument ORDER BY pos)) / lag(close) OVER (PARTITION BY instrument ORDER BY pos) AS ret
FROM (SELECT *, open - gap AS ro, close - gap AS rc FROM (SELECT *, g - max_by_gap AS gap FROM (SELECT *, sum(jump) OVER (PARTITION BY instrument) AS max_by_gap FROM (
  SELECT *, sum(jump) OVER (PARTITION BY instrument ORDER BY pos) AS g FROM (
    SELECT *, CASE WHEN pos > 0 AND pos = min(pos) OVER (PARTITION BY instrument, contract) THEN open - lag(close) OVER (PARTITION BY instrument ORDER BY pos) ELSE 0 END AS jump FROM {source}))))))
WINDOW w AS (PARTITION BY instrument ORDER BY pos)
""",
        source,
    )


roll_sql("rolled", "front")
roll_sql("oirolled", "oifront")


@query("rol3_roll_gaps", with_views(f"SELECT instrument, {DAY_SQL}, round(gap, 4) + 0::DOUBLE AS gap FROM rolled", "rolled"))
def rol3(spark, d):
    return R.roll_gaps(front(spark, d)).select("instrument", DAY(), (F.round("gap", 4) + F.lit(0.0)).alias("gap"))


@query("rol4_rolled_prices", with_views(f"SELECT instrument, {DAY_SQL}, round(ro, 4) AS rolled_open, round(rc, 4) AS rolled_close FROM rolled", "rolled"))
def rol4(spark, d):
    return R.rolled_prices(front(spark, d)).select("instrument", DAY(), r("rolled_open", 4), r("rolled_close", 4))


def _index(df):
    live = F.when(F.col("r_price") != 0, F.log(F.abs(F.when(F.col("r_price") != 0, F.col("r_price")))))
    return df.select(
        "instrument", DAY(), F.signum("r_price").alias("sgn"), F.round(live, 5).alias("log_index"), r("ret")
    )


_RP = "CAST(sign(r_price) AS DOUBLE) AS sgn, round(ln(abs(nullif(r_price, 0))), 5) AS log_index, round(ret, 6) + 0::DOUBLE AS ret"


@query("rol5_non_negative_index", with_views(f"SELECT instrument, {DAY_SQL}, {_RP} FROM rolled", "rolled"))
def rol5(spark, d):
    return _index(R.non_negative_index(front(spark, d)))


@query("rol6_continuous_prices", with_views(f"SELECT instrument, {DAY_SQL}, {_RP} FROM oirolled", "oirolled"))
def rol6(spark, d):
    panel = C.contracts(spark, d)
    return _index(R.continuous_prices(panel, by="open_interest", start="1996-01-01", end="2000-12-31"))


@query(
    "rol7_aligned_returns",
    with_views(
        f"SELECT {DAY_SQL}, "
        + ", ".join(f"round(max(ret) FILTER (instrument = '{p}'), 6) + 0::DOUBLE AS {p}" for p in PRODUCTS)
        + " FROM rolled WHERE ret IS NOT NULL GROUP BY date HAVING count(*) = 4",
        "rolled",
    ),
)
def rol7(spark, d):
    return R.aligned_returns(R.non_negative_index(front(spark, d)), PRODUCTS).select(DAY(), *[r(p) for p in PRODUCTS])


view(
    "legs",
    """
SELECT 'b0' AS basket, dense_rank() OVER (ORDER BY date) - 1 AS pos, instrument AS asset, date, open, close, i + 1.0::DOUBLE AS w, 1 + i * 0.5::DOUBLE AS phi,
       0.01::DOUBLE AS div, 0.001::DOUBLE AS cost, close * 3 AS volume
FROM (SELECT *, CAST(substr(instrument, 2) AS INTEGER) AS i, count(*) OVER (PARTITION BY date) AS n FROM front) WHERE n = 4
""",
    "front",
)
view(
    "lbars",
    """
SELECT *, coalesce(strftime(date, '%Y%m') <> strftime(lag(date) OVER (ORDER BY pos), '%Y%m'), true) AS reb FROM (
SELECT pos, any_value(date) AS date, list(open ORDER BY asset) AS o, list(close ORDER BY asset) AS c, list(w ORDER BY asset) AS w, list(phi ORDER BY asset) AS phi,
       list(div ORDER BY asset) AS dv, list(cost ORDER BY asset) AS cost, list(volume ORDER BY asset) AS vol FROM legs GROUP BY pos)
""",
    "legs",
)
_I = "[1, 2, 3, 4]"


def _sum4(expr: str) -> str:
    return f"list_sum(list_transform({_I}, lambda i: {expr}))"


view(
    "etf",
    f"""
SELECT pos, 1::DOUBLE AS k, [0::DOUBLE, 0, 0, 0] AS h, [0::DOUBLE, 0, 0, 0] AS hp, reb, w, phi, c, 0::DOUBLE AS rcost, 0::DOUBLE AS acost, 0::DOUBLE AS vol FROM lbars WHERE pos = 0
UNION ALL
SELECT b.pos,
  e.k + {_sum4("e.h[i] * b.phi[i] * (b.c[i] - CASE WHEN e.reb THEN b.o[i] ELSE e.c[i] END + b.dv[i])")},
  CASE WHEN e.reb THEN list_transform({_I}, lambda i: e.w[i] * e.k / (b.o[i] * e.phi[i] * list_sum(list_transform(e.w, lambda x: abs(x))))) ELSE e.h END,
  e.h, b.reb, b.w, b.phi, b.c,
  CASE WHEN e.reb THEN {_sum4("(abs(e.h[i]) * b.c[i] + abs(e.w[i] * e.k / (b.o[i] * e.phi[i] * 10.0::DOUBLE)) * b.o[i]) * b.phi[i] * b.cost[i]")} ELSE 0 END,
  {_sum4("abs(e.h[i]) * b.c[i] * b.phi[i] * b.cost[i]")},
  coalesce(list_min(list_transform({_I}, lambda i: b.vol[i] / nullif(abs(e.h[i]), 0))), 0)
FROM etf e JOIN lbars b ON b.pos = e.pos + 1
""",
    "lbars",
)


def legs(spark, d):
    f = front(spark, d)
    full = f.groupBy("date").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 4).select(F.lit("b0").alias("basket"), "date")
    days = position(full, ["date"], keys=["basket"])
    days = lagged(days, {"_m": F.date_format("date", "yyyyMM")}, keys=["basket"])
    days = days.withColumn("rebalance", F.coalesce(F.col("_m") != F.date_format("date", "yyyyMM"), F.lit(True))).drop("_m")
    i = F.substring("instrument", 2, 9).cast("int")
    return f.drop("pos").join(days, "date").select(
        "basket", "pos", F.col("instrument").alias("asset"), "open", "close", (i + F.lit(1.0)).alias("w"), (1 + i * F.lit(0.5)).alias("phi"),
        F.lit(0.01).alias("div"), F.lit(0.001).alias("cost"), (F.col("close") * 3).alias("volume"), "rebalance",
    )


@query(
    "rol8_basket_index",
    with_views(
        "SELECT 'b0' AS basket, pos, CAST(sign(k) AS DOUBLE) AS sgn, round(ln(abs(k)), 6) + 0::DOUBLE AS log_k, round(ln(1 + rcost), 6) + 0::DOUBLE AS rebalance_cost, round(ln(1 + acost), 6) + 0::DOUBLE AS bid_ask_cost, round(ln(1 + vol), 6) + 0::DOUBLE AS volume FROM etf", "etf"
    ),
)
def rol8(spark, d):
    out = R.etf_trick(legs(spark, d))
    logs = [(F.round(F.log1p(c), 6) + F.lit(0.0)).alias(c) for c in ("rebalance_cost", "bid_ask_cost", "volume")]
    return out.select("basket", "pos", F.signum("k").alias("sgn"), (F.round(F.log(F.abs("k")), 6) + F.lit(0.0)).alias("log_k"), *logs)


# --------------------------------------------------------------------------- portfolios
view(
    "dret",
    "SELECT 'a' || substr(instrument, 1, 1) AS asset, ts AS date, close / lag(close) OVER (PARTITION BY instrument ORDER BY pos) - 1 AS ret FROM daily",
    "daily",
)
view(
    "wide",
    "SELECT *, CAST(row_number() OVER (ORDER BY date) - 1 AS BIGINT) AS pos, year(date) AS yr FROM (SELECT date, "
    + ", ".join(f"max(ret) FILTER (asset = '{a}') AS {a}" for a in ASSETS)
    + " FROM dret WHERE ret IS NOT NULL GROUP BY date HAVING count(*) = 5)",
    "dret",
)


def wide(spark, d):
    ret = K.returns(C.daily_market(spark, d), price="close").select(
        F.concat(F.lit("a"), F.substring("instrument", 1, 1)).alias("instrument"), F.col("ts").alias("date"), F.col("pct_change").alias("ret")
    )
    w = R.aligned_returns(ret, ASSETS).withColumn("universe", F.lit("all"))
    return reuse(position(w, ["date"], keys=["universe"]).withColumn("yr", F.year("date")))


view(
    "cov",
    " UNION ALL ".join(
        f"SELECT yr, '{a}' AS a, '{b}' AS b, covar_samp({a}, {b}) AS cov, covar_samp({a}, {b}) / sqrt(var_samp({a}) * var_samp({b})) AS corr FROM wide GROUP BY yr"
        for a in ASSETS for b in ASSETS
    ),
    "wide",
)


def cov(spark, d):
    return P.covariance(wide(spark, d), ASSETS, by=["yr"])


@query("prt1_covariance", with_views("SELECT CAST(yr AS INTEGER) AS yr, a, b, round(cov, 6) AS cov, round(corr, 6) AS corr FROM cov", "cov"))
def prt1(spark, d):
    return cov(spark, d).select("yr", "a", "b", r("cov"), r("corr"))


view("ivp", "SELECT yr, a AS asset, 1 / cov / sum(1 / cov) OVER (PARTITION BY yr) AS w FROM cov WHERE a = b", "cov")


@query("prt2_inverse_variance", with_views("SELECT CAST(yr AS INTEGER) AS yr, asset, round(w, 6) AS w FROM ivp", "ivp"))
def prt2(spark, d):
    return P.inverse_variance(cov(spark, d), by=["yr"]).select("yr", "asset", r("w"))


view("cdist", "SELECT yr, a, b, sqrt(greatest((1 - corr) / 2, 0)) AS dist FROM cov", "cov")


@query("prt3_correlation_distance", with_views("SELECT CAST(yr AS INTEGER) AS yr, a, b, round(CASE WHEN a = b THEN 0 ELSE dist END, 6) AS dist FROM cdist", "cdist"))
def prt3(spark, d):
    return P.correlation_distance(cov(spark, d)).select("yr", "a", "b", r("dist"))


@query(
    "prt4_distance_of_distances",
    with_views(
        "SELECT CAST(x.yr AS INTEGER) AS yr, x.a, y.a AS b, round(sqrt(sum(pow(x.dist - y.dist, 2))), 5) AS dist2 FROM cdist x JOIN cdist y ON x.yr = y.yr AND x.b = y.b GROUP BY 1, 2, 3",
        "cdist",
    ),
)
def prt4(spark, d):
    return P.distance_of_distances(P.correlation_distance(cov(spark, d)), by=["yr"]).select("yr", "a", "b", r("dist2", 5))


view("clus", "SELECT yr, asset, CASE WHEN asset < 'a3' THEN 'low' ELSE 'high' END AS cluster FROM ivp", "ivp")
view("ivpc", "SELECT c.yr, c.cluster, c.asset, 1 / v.cov / sum(1 / v.cov) OVER (PARTITION BY c.yr, c.cluster) AS w FROM clus c JOIN cov v ON v.yr = c.yr AND v.a = c.asset AND v.b = c.asset", "clus", "cov")


@query(
    "prt5_cluster_variance",
    with_views(
        "SELECT CAST(x.yr AS INTEGER) AS yr, x.cluster, round(sum(x.w * y.w * v.cov), 6) AS cluster_var FROM ivpc x JOIN ivpc y USING (yr, cluster) JOIN cov v ON v.yr = x.yr AND v.a = x.asset AND v.b = y.asset GROUP BY 1, 2",
        "ivpc", "cov",
    ),
)
def prt5(spark, d):
    m = cov(spark, d)
    clusters = m.where(F.col("a") == F.col("b")).select("yr", F.col("a").alias("asset"), F.when(F.col("a") < "a3", "low").otherwise("high").alias("cluster"))
    return P.cluster_variance(m, clusters, by=["yr"]).select("yr", "cluster", r("cluster_var"))


@query("prt6_hierarchical_risk_parity")
def prt6(spark, d):
    return P.hierarchical_risk_parity(cov(spark, d), by=["yr"])


@query("prt7_allocation_comparison")
def prt7(spark, d):
    return P.allocation_comparison(wide(spark, d), ASSETS, lookback=100, step=20)


@query("prt8_risk_concentration")
def prt8(spark, d):
    m = reuse(cov(spark, d))
    return P.risk_concentration(m, P.inverse_variance(m, by=["yr"]), by=["yr"])


@query("rol9_pca_weights")
def rol9(spark, d):
    return P.pca_weights(cov(spark, d), by=["yr"])


H, LB = 2, 60
view("htail", f"SELECT *, (pos - n + {H * LB}) // {LB} AS h FROM (SELECT *, count(*) OVER () AS n FROM wide) WHERE pos - n + {H * LB} >= 0", "wide")


@query(
    "prt9_horizon_parameters",
    with_views(
        " UNION ALL ".join(
            f"SELECT 'all' AS universe, CAST(h AS INTEGER) AS h, '{a}' AS asset, strftime(min(date), '%Y-%m-%d') AS first_day, strftime(max(date), '%Y-%m-%d') AS last_day, round(avg({a}), 6) AS mean, round(stddev_samp({a}) * 0.02::DOUBLE, 6) AS c FROM htail GROUP BY h"
            for a in ASSETS
        ),
        "htail",
    ),
)
def prt9(spark, d):
    out = P.horizon_parameters(wide(spark, d), ASSETS, horizon=H, lookback=LB)
    return out.select(
        "universe", "h", "asset", F.date_format("first_date", "yyyy-MM-dd").alias("first_day"),
        F.date_format("last_date", "yyyy-MM-dd").alias("last_day"), r("mean"), r("c"),
    )


@query(
    "prt10_weight_grid",
    with_views(
        """
SELECT CAST(yr AS INTEGER) AS universe, round(a * x / 3.0::DOUBLE, 6) + 0::DOUBLE AS w1, round(b * y / 3.0::DOUBLE, 6) + 0::DOUBLE AS w2, round((3 - a - b) * z / 3.0::DOUBLE, 6) + 0::DOUBLE AS w3
FROM (SELECT DISTINCT yr FROM wide), range(4) r1(a), range(4) r2(b), (SELECT unnest([-1, 1]) AS x), (SELECT unnest([-1, 1]) AS y), (SELECT unnest([-1, 1]) AS z) WHERE a + b <= 3
""",
        "wide",
    ),
)
def prt10(spark, d):
    g = P.weight_grid_table(wide(spark, d).select(F.col("yr").alias("universe")).distinct(), k=3, n=3)
    return g.select("universe", *[(F.round(F.col("w")[i], 6) + F.lit(0.0)).alias(f"w{i + 1}") for i in range(3)])


def horizons(spark, d, assets):
    w = wide(spark, d)
    return P.horizon_parameters(w, assets, horizon=H, lookback=LB), P.horizon_covariance(w, assets, horizon=H, lookback=LB)


@query("prt11_best_trajectory")
def prt11(spark, d):
    params, v = horizons(spark, d, ASSETS)
    return P.best_trajectory(params, v, k=3).select("universe", "traj", "sr", F.flatten("w").alias("w"))


view(
    "grid5",
    "SELECT a * s1 / 3.0::DOUBLE AS w1, b * s2 / 3.0::DOUBLE AS w2, c * s3 / 3.0::DOUBLE AS w3, e * s4 / 3.0::DOUBLE AS w4, (3 - a - b - c - e) * s5 / 3.0::DOUBLE AS w5 "
    "FROM range(4) r1(a), range(4) r2(b), range(4) r3(c), range(4) r4(e), "
    + ", ".join(f"(SELECT unnest([-1, 1]) AS s{i})" for i in range(1, 6))
    + " WHERE a + b + c + e <= 3",
)
_N = range(1, len(ASSETS) + 1)
view(
    "hmom",
    "SELECT h, "
    + ", ".join(f"avg(a{i}) AS m{i}, 0.02::DOUBLE * stddev_samp(a{i}) AS c{i}" for i in _N)
    + ", " + ", ".join(f"covar_samp(a{i}, a{j}) AS v{i}{j}" for i in _N for j in _N if i <= j)
    + " FROM htail GROUP BY h",
    "htail",
)


def _leg(w: str, prev: str | None, m: str) -> tuple[str, str]:
    gain = " + ".join(f"{w}.w{i} * {m}.m{i}" for i in _N)
    cost = " + ".join(f"{m}.c{i} * sqrt(abs({w}.w{i}{f' - {prev}.w{i}' if prev else ''}))" for i in _N)
    risk = " + ".join(f"{1 if i == j else 2} * {w}.w{i} * {w}.w{j} * {m}.v{i}{j}" for i in _N for j in _N if i <= j)
    return f"({gain} - ({cost}))", f"({risk})"


_G0, _R0 = _leg("p", None, "m0")
_G1, _R1 = _leg("q", "p", "m1")


@query(
    "prt11_best_sharpe",
    with_views(
        f"SELECT 'all' AS universe, round(max(({_G0} + {_G1}) / sqrt({_R0} + {_R1})), 6) AS sr, count(*) AS n_paths FROM grid5 p, grid5 q, (SELECT * FROM hmom WHERE h = 0) m0, (SELECT * FROM hmom WHERE h = 1) m1",
        "grid5", "hmom",
    ),
)
def prt11s(spark, d):
    params, v = horizons(spark, d, ASSETS)
    n = F.lit(P.count_trajectories(3, len(ASSETS), H)).cast("long").alias("n_paths")
    return P.best_trajectory(params, v, k=3).select("universe", r("sr"), n)


@query("prt12_static_weights")
def prt12(spark, d):
    params, v = horizons(spark, d, ASSETS)
    return P.static_weights(params, v)


# --------------------------------------------------------------------------- structural breaks
view("ylog", "SELECT instrument, pos, ln(close) AS y, lag(ln(close)) OVER (PARTITION BY instrument ORDER BY pos) AS l FROM tbars", "tbars")


def ylog(spark, d):
    return reuse(bars(spark, d).select("instrument", "pos", F.log("close").alias("y")))


_EX = "OVER (PARTITION BY instrument ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
view(
    "bde",
    f"""
SELECT instrument, t AS pos, (y - a - b * l) / sqrt(s2 * (1 + 1 / n + (l - mx) * (l - mx) / sxx)) AS omega FROM (
  SELECT *, my - b * mx AS a, (syy - b * sxy) / (n - 2) AS s2 FROM (
    SELECT *, sxy / sxx AS b FROM (
      SELECT instrument, t, y, l, CAST(count(*) {_EX} AS DOUBLE) AS n, avg(l) {_EX} AS mx, avg(y) {_EX} AS my,
             var_pop(l) {_EX} * count(*) {_EX} AS sxx, var_pop(y) {_EX} * count(*) {_EX} AS syy, covar_pop(y, l) {_EX} * count(*) {_EX} AS sxy
      FROM (SELECT *, pos - 1 AS t FROM ylog WHERE pos >= 1))) WHERE t >= 20)
""",
    "ylog",
)


def bde_rows(spark, d):
    y = lagged(ylog(spark, d), {"l": F.col("y")}).where(F.col("l").isNotNull())
    return y.withColumn("pos", F.col("pos") - 1).withColumn("one", F.lit(1.0))


@query(
    "sbk1_recursive_cusum",
    with_views(
        "SELECT instrument, pos, round(omega, 5) AS omega, round(sum(omega) OVER (PARTITION BY instrument ORDER BY pos) / stddev_pop(omega) OVER (PARTITION BY instrument), 5) AS s,"
        " round(1.96 * sqrt(pos - 20), 6) AS band_95 FROM bde",
        "bde",
    ),
)
def sbk1(spark, d):
    out = X.recursive_cusum(bde_rows(spark, d), y="y", x=["one", "l"], min_sample=20)
    return out.select("instrument", "pos", r("omega", 5), r("s", 5), r("band_95"))


view(
    "csw",
    """
SELECT instrument, t AS pos, v / sig AS s, n AS n_star, sqrt(4.6 + ln(t - n)) AS critical_95 FROM (
  SELECT a.instrument, a.pos AS t, b.pos AS n, (a.y - b.y) / sqrt(a.pos - b.pos) AS v, a.sig,
         row_number() OVER (PARTITION BY a.instrument, a.pos ORDER BY (a.y - b.y) / sqrt(a.pos - b.pos) DESC, b.pos) AS rk
  FROM (SELECT *, sqrt(sum((y - l) * (y - l)) OVER (PARTITION BY instrument ORDER BY pos) / nullif(pos - 1, 0)) AS sig FROM ylog) a
  JOIN ylog b ON a.instrument = b.instrument AND b.pos < a.pos WHERE a.pos >= 10) WHERE rk = 1 AND sig > 0
""",
    "ylog",
)


@query("sbk2_level_shift_sup", with_views("SELECT instrument, pos, round(s, 6) AS s, n_star, round(critical_95, 6) AS critical_95 FROM csw", "csw"))
def sbk2(spark, d):
    return X.level_shift_sup(ylog(spark, d), min_sample=10).select("instrument", "pos", r("s"), "n_star", r("critical_95"))


view(
    "chow",
    """
SELECT instrument, k, n, b / sqrt((yy - b * xy) / (n - 2) / xx) AS dfc FROM (
  SELECT *, xy / xx AS b FROM (
    SELECT instrument, pos AS k, count(*) OVER (PARTITION BY instrument) AS n, sum(l * (y - l)) OVER w AS xy, sum(l * l) OVER w AS xx, sum((y - l) * (y - l)) OVER (PARTITION BY instrument) AS yy
    FROM ylog WINDOW w AS (PARTITION BY instrument ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))) WHERE k >= 1 AND k < n - 1
""",
    "ylog",
)


@query("sbk3_chow_at", with_views("SELECT instrument, k, n, round(dfc, 6) AS dfc FROM chow WHERE k = CAST(round_even(0.4::DOUBLE * n, 0) AS BIGINT)", "chow"))
def sbk3(spark, d):
    return X.chow_at(ylog(spark, d), tau=0.4).select("instrument", "k", "n", r("dfc"))


@query(
    "sbk4_chow_sup",
    with_views(
        "SELECT instrument, round(dfc, 6) AS sdfc, round(k / n::DOUBLE, 6) AS tau_star FROM chow WHERE k >= ceil(0.15::DOUBLE * n) AND k <= floor(0.85::DOUBLE * n)"
        " QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY dfc DESC, k) = 1",
        "chow",
    ),
)
def sbk4(spark, d):
    return X.chow_sup(ylog(spark, d)).select("instrument", r("sdfc"), r("tau_star"))


@query(
    "sbk5_regression_design",
    with_views(
        "SELECT instrument, pos, round(dy, 6) AS dy, round(l, 6) AS level, round(d1, 6) AS d1, round(d2, 6) AS d2, 1.0::DOUBLE AS one, CAST(pos - 3 AS DOUBLE) AS trend FROM ("
        "SELECT *, y - l AS dy, lag(y - l) OVER w AS d1, lag(y - l, 2) OVER w AS d2 FROM ylog WINDOW w AS (PARTITION BY instrument ORDER BY pos)) WHERE d2 IS NOT NULL",
        "ylog",
    ),
)
def sbk5(spark, d):
    out = X.regression_design(ylog(spark, d), lags=2, constant="ct")
    return out.select("instrument", "pos", r("dy"), r("level"), r("d1"), r("d2"), "one", "trend")


@query(
    "sbk6_least_squares",
    with_views(
        """
SELECT instrument, unnest(['level', 'one']) AS term, round(unnest([b, my - b * mx]), 6) AS beta, round(unnest([s2 / (sxx * n), s2 * (1 / n + mx * mx / (sxx * n))]), 6) AS var
FROM (SELECT *, (syy - b * sxy) * n / (n - 2) AS s2 FROM (
  SELECT instrument, count(*) AS n, regr_slope(y - l, l) AS b, avg(y - l) AS my, avg(l) AS mx, var_pop(y - l) AS syy, covar_pop(y - l, l) AS sxy, var_pop(l) AS sxx
  FROM ylog WHERE l IS NOT NULL GROUP BY 1))
""",
        "ylog",
    ),
)
def sbk6(spark, d):
    design = X.regression_design(ylog(spark, d), lags=0, constant="c")
    out = X.least_squares(design, X.design_columns(0, "c"))
    return out.select("instrument", "term", r("beta"), r("var"))


MINSL = 20
view(
    "dfr",
    "SELECT instrument, pos - 2 AS j, y - l AS dy, l, d1 FROM (SELECT *, lag(y - l) OVER (PARTITION BY instrument ORDER BY pos) AS d1 FROM ylog) WHERE d1 IS NOT NULL",
    "ylog",
)
view(
    "dfc",
    "SELECT *, "
    + ", ".join(
        f"sum({e}) OVER w AS {n}, sum({e}) OVER w - ({e}) AS b_{n}"
        for n, e in {"m00": "l * l", "m01": "l * d1", "m11": "d1 * d1", "v0": "l * dy", "v1": "d1 * dy", "q": "dy * dy"}.items()
    )
    + " FROM dfr WINDOW w AS (PARTITION BY instrument ORDER BY j)",
    "dfr",
)
view(
    "sadf",
    f"""
SELECT instrument, j + 2 AS pos, max(b0 / sqrt((q - b0 * v0 - b1 * v1) / (rows - 2) * m11 / dt)) AS sadf FROM (
  SELECT *, (m11 * v0 - m01 * v1) / dt AS b0, (m00 * v1 - m01 * v0) / dt AS b1 FROM (
    SELECT *, m00 * m11 - m01 * m01 AS dt FROM (
      SELECT e.instrument, e.j, e.j - s.j + 1 AS rows, e.m00 - s.b_m00 AS m00, e.m01 - s.b_m01 AS m01, e.m11 - s.b_m11 AS m11, e.v0 - s.b_v0 AS v0, e.v1 - s.b_v1 AS v1, e.q - s.b_q AS q
      FROM dfc e JOIN dfc s ON e.instrument = s.instrument AND e.j - s.j + 1 >= {MINSL - 1} WHERE e.j >= {MINSL - 1})))
GROUP BY 1, 2
""",
    "dfc",
)


@query("sbk7_sup_adf", with_views("SELECT instrument, pos, round(sadf, 5) AS sadf FROM sadf", "sadf"))
def sbk7(spark, d):
    return X.sup_adf(ylog(spark, d), min_length=MINSL, lags=1, constant="nc").select("instrument", "pos", r("sadf", 5))


@query("sbk7_sup_adf_trend")
def sbk7t(spark, d):
    return X.sup_adf(ylog(spark, d), min_length=40, lags=1, constant="ct")


# --------------------------------------------------------------------------- entropy
WIN = 40
view("bret", "SELECT instrument, pos, close / lag(close) OVER (PARTITION BY instrument ORDER BY pos) - 1 AS x FROM tbars", "tbars")
view("bcode", "SELECT instrument, pos, CASE WHEN x > 0 THEN '1' ELSE '0' END AS code FROM bret WHERE x <> 0", "bret")
view(
    "qcode",
    "SELECT instrument, pos, CAST((x >= q[1])::INT + (x >= q[2])::INT + (x >= q[3])::INT AS VARCHAR) AS code FROM bret JOIN (SELECT instrument, quantile_cont(x, [0.25, 0.5, 0.75]) AS q FROM bret GROUP BY 1) USING (instrument) WHERE x IS NOT NULL",
    "bret",
)
view(
    "scode",
    f"""
SELECT instrument, pos, substr('{E.LETTERS}', 1 + CAST(least(floor((x - lo) / sg), greatest(ceil((hi - lo) / sg) - 1, 0)) AS INTEGER), 1) AS code
FROM bret JOIN (SELECT instrument, min(x) AS lo, max(x) AS hi, stddev_pop(x) / 4 AS sg FROM bret GROUP BY 1) USING (instrument) WHERE x IS NOT NULL
""",
    "bret",
)
for _c in ("b", "q", "s"):
    view(
        f"{_c}msg",
        f"SELECT instrument, i // {WIN} AS \"window\", string_agg(code, '' ORDER BY i) AS msg FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY pos) - 1 AS i FROM {_c}code) GROUP BY 1, 2",
        f"{_c}code",
    )


def rets(spark, d):
    return reuse(K.returns(bars(spark, d), price="close").select("instrument", "pos", F.col("pct_change").alias("x")))


@query("ent1_binary_messages", with_views('SELECT instrument, "window", msg FROM bmsg', "bmsg"))
def ent1(spark, d):
    return E.messages(E.binary_code(rets(spark, d), "x"), window=WIN)


@query("ent2_quantile_messages", with_views('SELECT instrument, "window", msg FROM qmsg', "qmsg"))
def ent2(spark, d):
    return E.messages(E.quantile_code(rets(spark, d), "x", letters=4), window=WIN)


@query("ent3_sigma_messages", with_views('SELECT instrument, "window", msg FROM smsg', "smsg"))
def ent3(spark, d):
    return E.messages(E.sigma_code(rets(spark, d), "x"), window=WIN)


view(
    "plug",
    """
SELECT instrument, "window", -sum(p * log2(p)) / 2 AS h FROM (
  SELECT instrument, "window", count(*) / sum(count(*)) OVER (PARTITION BY instrument, "window") AS p FROM (
    SELECT instrument, "window", substr(msg, CAST(unnest(generate_series(1, length(msg) - 2)) AS INTEGER), 2) AS w FROM qmsg WHERE length(msg) > 2) GROUP BY instrument, "window", w)
GROUP BY 1, 2
""",
    "qmsg",
)


@query("ent4_plug_in", with_views('SELECT instrument, "window", round(h, 6) + 0::DOUBLE AS h_plugin FROM plug', "plug"))
def ent4(spark, d):
    out = E.plug_in(E.messages(E.quantile_code(rets(spark, d), "x", letters=4), window=WIN), word=2)
    return out.select("instrument", "window", (F.round("h_plugin", 6) + F.lit(0.0)).alias("h_plugin"))


view(
    "lz",
    """
SELECT instrument, "window", msg, 0::BIGINT AS st, 0::BIGINT AS en, []::VARCHAR[] AS seen FROM bmsg
UNION ALL
SELECT instrument, "window", msg, CASE WHEN list_contains(seen, w) THEN st ELSE en + 1 END, en + 1, CASE WHEN list_contains(seen, w) THEN seen ELSE list_append(seen, w) END
FROM (SELECT *, substr(msg, st + 1, en + 1 - st) AS w FROM lz WHERE en < length(msg))
""",
    "bmsg",
)


def rate_view(name: str, window: int | None) -> None:
    n = "i" if window is None else "n"
    pts = "generate_series(1, length(msg) // 2)" if window is None else f"generate_series(least({window}, length(msg) // 2), length(msg) - least({window}, length(msg) // 2))"
    view(
        name,
        f"""
SELECT instrument, "window", any_value(msg) AS msg, avg(log2({n} + 1) / (best + 1)) AS h FROM (
  SELECT instrument, "window", msg, i, n, coalesce(max(CASE WHEN substr(msg, j + 1, l) = substr(msg, i + 1, l) THEN l END), 0) AS best FROM (
    SELECT *, unnest(generate_series(i - {n}, i - 1)) AS j FROM (
      SELECT *, unnest(generate_series(1, {n})) AS l FROM (
        SELECT *, unnest({pts}) AS i, least({window or 0}, length(msg) // 2) AS n FROM qmsg WHERE length(msg) > 1)))
  GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2
""",
        "qmsg",
    )


rate_view("rate", None)
rate_view("ratew", 10)
_RATE = 'SELECT q.instrument, q."window", q.msg, round(h, 6) AS h_konto, round(1 - h / log2(length(q.msg)), 6) AS redundancy FROM qmsg q LEFT JOIN {} r USING (instrument, "window")'


@query(
    "ent5_lempel_ziv",
    with_views("SELECT instrument, \"window\", CAST(len(seen) AS INTEGER) AS n_words, array_to_string(seen, '|') AS words FROM lz WHERE en = length(msg)", "lz"),
)
def ent5(spark, d):
    msgs = E.messages(E.binary_code(rets(spark, d), "x"), window=WIN)
    return E.with_lempel_ziv(msgs).select("instrument", "window", F.size("words").alias("n_words"), F.array_join("words", "|").alias("words"))


@query("ent6_entropy_rate", with_views(_RATE.format("rate"), "rate"))
def ent6(spark, d):
    return E.with_entropy_rate(E.messages(E.quantile_code(rets(spark, d), "x", letters=4), window=WIN)).withColumns({c: F.round(c, 6) for c in ("h_konto", "redundancy")})


@query("ent6_entropy_rate_window", with_views(_RATE.format("ratew"), "ratew"))
def ent6w(spark, d):
    return E.with_entropy_rate(E.messages(E.quantile_code(rets(spark, d), "x", letters=4), window=WIN), window=10).withColumns({c: F.round(c, 6) for c in ("h_konto", "redundancy")})


@query(
    "ent7_order_flow_imbalance",
    with_views("SELECT instrument, pos, round(coalesce(buy_volume / nullif(CAST(buy_volume + sell_volume AS DOUBLE), 0), 0.5) + 3e-10, 6) AS imbalance FROM tbars", "tbars"),
)
def ent7(spark, d):
    return E.order_flow_imbalance(bars(spark, d)).select("instrument", "pos", F.round(F.col("imbalance") + 3e-10, 6).alias("imbalance"))


@query("ent8_adverse_selection")
def ent8(spark, d):
    return E.adverse_selection(bars(spark, d), letters=5, window=30)


@query("ent9_encoding_report")
def ent9(spark, d):
    return E.encoding_report(rets(spark, d), "x", window=WIN)

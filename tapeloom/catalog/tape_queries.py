"""Sources, tape cleaning, tick features and bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog.base_sql import bar_select, view, with_views
from tapeloom.catalog.registry import query
from tapeloom.operators import bars as B
from tapeloom.operators import ticks as K
from tapeloom.plans.series import position
from tapeloom.sources import canonical as C
from tapeloom.sources import trades as S
from tapeloom.sources.storage import scratch


def US():
    return F.unix_micros("ts").alias("ts_us")


US_SQL = "epoch_us(ts) AS ts_us"


def r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


def rv(c: str, n: int = 6):
    """Rounding for quotients of whole cents, nudged off the exact decimal ties they often hit."""
    return F.round(F.col(c) + 3e-10, n).alias(c)


def rs(*cols: str, n: int = 6) -> str:
    return ", ".join(f"round({c}, {n}) AS {c}" for c in cols)


# --------------------------------------------------------------------------- sources
@query(
    "src1_trade_csv",
    with_views(
        f"SELECT 'tape' AS instrument, seq AS trade_id, price, CAST(qty AS DOUBLE) AS qty, dollar AS quote_qty, side = -1 AS is_buyer_maker,"
        f" true AS is_best_match, {US_SQL} FROM ticks",
        "ticks",
    ),
)
def src1(spark, d):
    path = scratch(spark, "csv") + "/tape"
    C.ticks(spark, d).select(
        "seq", "price", "qty", "dollar", F.unix_micros("ts"), F.col("side") == -1, F.lit(True)
    ).write.csv(path)
    return S.read_trade_csv(spark, path).select(
        "instrument", "trade_id", "price", "qty", "quote_qty", "is_buyer_maker", "is_best_match", US()
    )


@query("src4_parquet_pruned", "SELECT value AS price FROM events")
def src4(spark, d):
    C.table(spark, d, "events")
    return S.read_columns(spark, f"{d}/events.parquet", ["value"]).select(F.col("value").alias("price"))


_DEDUP = "SELECT * FROM raw_tape QUALIFY row_number() OVER (PARTITION BY instrument, trade_id ORDER BY ts, part, qty, quote_qty) = 1"
view("raw_dedup", _DEDUP, "raw_tape")
view(
    "raw_clean",
    "SELECT * REPLACE (ts + to_microseconds(row_number() OVER (PARTITION BY instrument, ts ORDER BY trade_id) - 1) AS ts) FROM raw_dedup",
    "raw_dedup",
)


@query(
    "src5_pull_normalised",
    with_views(
        f"SELECT instrument, trade_id, price, qty, {US_SQL} FROM raw_clean WHERE ts >= TIMESTAMP '1997-01-01'",
        "raw_clean",
    ),
)
def src5(spark, d):
    path = scratch(spark, "pull")
    raw = K.dedupe_trades(C.raw_tape(spark, d), order=("ts", "part", "qty", "quote_qty"))
    raw.select(
        F.col("trade_id").alias("id"), F.col("price").cast("string"), F.col("qty").cast("string"),
        F.col("quote_qty").cast("string").alias("quoteQty"), F.unix_millis("ts").alias("time"),
        F.col("is_buyer_maker").alias("isBuyerMaker"), F.col("is_best_match").alias("isBestMatch"),
        F.col("instrument").alias("symbol"),
    ).write.json(path, compression="gzip")
    pages = spark.read.schema(S.PULL_SCHEMA).json(path)
    return S.normalise_pull(pages, cutoff_ms=852076800000).select("instrument", "trade_id", "price", "qty", US())


@query("src8_frozen_tape", with_views(f"SELECT instrument, seq, price, qty, {US_SQL} FROM ticks", "ticks"))
def src8(spark, d):
    path = scratch(spark, "snapshot")
    S.write_tape(C.ticks(spark, d), path)
    return spark.read.parquet(path).select("instrument", "seq", "price", "qty", US())


# --------------------------------------------------------------------------- tape cleaning and tick features
@query(
    "tk1_dedupe_trades",
    with_views(f"SELECT instrument, trade_id, part, qty, {US_SQL} FROM raw_dedup", "raw_dedup"),
)
def tk1(spark, d):
    return K.dedupe_trades(C.raw_tape(spark, d), order=("ts", "part", "qty", "quote_qty")).select(
        "instrument", "trade_id", "part", "qty", US()
    )


@query("tk2_disambiguate", with_views(f"SELECT instrument, trade_id, {US_SQL} FROM raw_clean", "raw_clean"))
def tk2(spark, d):
    raw = K.dedupe_trades(C.raw_tape(spark, d), order=("ts", "part", "qty", "quote_qty"))
    return K.disambiguate_timestamps(raw).select("instrument", "trade_id", US())


@query(
    "tk3_aggressor_side",
    with_views(
        "SELECT instrument, CASE WHEN is_buyer_maker THEN -1 ELSE 1 END AS side, count(*) AS n FROM raw_tape GROUP BY 1, 2",
        "raw_tape",
    ),
)
def tk3(spark, d):
    side = K.aggressor_side(F.col("is_buyer_maker")).alias("side")
    return C.raw_tape(spark, d).groupBy("instrument", side).agg(F.count(F.lit(1)).alias("n"))


@query(
    "tk4_price_delta",
    with_views(
        "SELECT instrument, pos, round(coalesce(price - lag(price) OVER (PARTITION BY instrument ORDER BY pos), 0), 6) AS delta FROM ticks",
        "ticks",
    ),
)
def tk4(spark, d):
    return K.price_delta(C.ticks(spark, d)).select("instrument", "pos", r("delta"))


view(
    "tick_signs",
    """
SELECT *, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY pos
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS tick
FROM (SELECT *, CAST(nullif(sign(price - lag(price) OVER (PARTITION BY instrument ORDER BY pos)), 0) AS INTEGER) AS s FROM ticks)
""",
    "ticks",
)


@query("tk5_tick_rule", with_views("SELECT instrument, pos, tick FROM tick_signs", "tick_signs"))
def tk5(spark, d):
    return K.tick_rule(C.ticks(spark, d)).select("instrument", "pos", "tick")


@query(
    "tk6_tick_rule_accuracy",
    with_views(
        "SELECT instrument, round(avg(CASE WHEN tick = side THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM tick_signs GROUP BY 1",
        "tick_signs",
    ),
)
def tk6(spark, d):
    return K.tick_rule_accuracy(K.tick_rule(C.ticks(spark, d))).select("instrument", r("accuracy"))


@query(
    "tk7_side_probabilities",
    with_views(
        "SELECT instrument, round(avg(CASE WHEN side = 1 THEN 1.0 ELSE 0 END), 6) AS p_buy, round(1 - avg(CASE WHEN side = 1 THEN 1.0 ELSE 0 END), 6) AS p_sell FROM ticks GROUP BY 1",
        "ticks",
    ),
)
def tk7(spark, d):
    return K.side_probabilities(C.ticks(spark, d)).select("instrument", r("p_buy"), r("p_sell"))


view(
    "ewma20",
    """
SELECT instrument, pos, price AS y FROM ticks WHERE pos = 0
UNION ALL
SELECT t.instrument, t.pos, (2.0/21.0)::DOUBLE * t.price + (1 - 2.0/21.0)::DOUBLE * e.y
FROM ewma20 e JOIN ticks t ON t.instrument = e.instrument AND t.pos = e.pos + 1
""",
    "ticks",
)


@query("tk8_ewma", with_views("SELECT instrument, pos, round(y, 6) AS ewma FROM ewma20", "ewma20"))
def tk8(spark, d):
    return K.ewma(C.ticks(spark, d), x="price", window=20).select("instrument", "pos", r("ewma"))


@query(
    "tk9_returns",
    with_views(
        "SELECT instrument, pos, round(ln(price), 6) AS log_price, round(ln(price) - ln(p), 6) AS log_return, round(price / p - 1, 6) AS pct_change"
        " FROM (SELECT *, lag(price) OVER (PARTITION BY instrument ORDER BY pos) AS p FROM ticks)",
        "ticks",
    ),
)
def tk9(spark, d):
    return K.returns(C.ticks(spark, d)).select("instrument", "pos", r("log_price"), r("log_return"), r("pct_change"))


@query(
    "tk10_elapsed_days",
    with_views(
        "SELECT instrument, pos, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY instrument)) / 86400000000.0, 8) AS days, CAST(qty AS BIGINT) AS size FROM ticks",
        "ticks",
    ),
)
def tk10(spark, d):
    return K.elapsed_days(C.ticks(spark, d)).select("instrument", "pos", r("days", 8), F.col("qty").alias("size"))


@query(
    "tk11_tape_profile",
    with_views(
        """
SELECT instrument, round(1 / quantile_cont((epoch_us(ts) - pt) / 1e6, 0.5), 8) AS trades_per_second,
       round(stddev_samp(price - pp), 6) AS delta_std, round(avg(qty), 6) AS mean_size,
       round(avg(CASE WHEN side = -1 THEN 1.0 ELSE 0 END), 6) AS sell_share, count(*) AS n_trades,
       round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 6) AS span_hours
FROM (SELECT *, lag(price) OVER w AS pp, lag(epoch_us(ts)) OVER w AS pt FROM ticks
      WINDOW w AS (PARTITION BY instrument ORDER BY pos)) GROUP BY 1
""",
        "ticks",
    ),
)
def tk11(spark, d):
    return K.tape_profile(C.ticks(spark, d)).select(
        "instrument", r("trades_per_second", 8), r("delta_std"), r("mean_size"), r("sell_share"), "n_trades", r("span_hours")
    )


@query(
    "tk12_signed_flow",
    with_views(
        "SELECT instrument, pos, CAST(qty * side AS BIGINT) AS signed_volume, CAST(sum(qty * side) OVER (PARTITION BY instrument ORDER BY pos) AS BIGINT) AS order_flow FROM ticks",
        "ticks",
    ),
)
def tk12(spark, d):
    return K.signed_flow(C.ticks(spark, d)).select("instrument", "pos", "signed_volume", "order_flow")


# --------------------------------------------------------------------------- bars
@query(
    "bar1_time_bars_day",
    with_views(
        "SELECT instrument, epoch_us(date_trunc('day', ts)) AS ts_us, arg_max(price, pos) AS price, CAST(sum(qty) AS BIGINT) AS volume FROM ticks GROUP BY 1, 2",
        "ticks",
    ),
)
def bar1d(spark, d):
    return B.time_bars(C.ticks(spark, d), freq="D").select("instrument", US(), "price", "volume")


@query(
    "bar1_time_bars_week",
    with_views(
        "SELECT instrument, epoch_us(date_trunc('week', ts) + INTERVAL 6 DAY) AS ts_us, arg_max(price, pos) AS price, CAST(sum(qty) AS BIGINT) AS volume FROM ticks GROUP BY 1, 2",
        "ticks",
    ),
)
def bar1w(spark, d):
    return B.time_bars(C.ticks(spark, d), freq="W").select("instrument", US(), "price", "volume")


@query(
    "bar1_time_bars_ohlcv",
    with_views(
        "SELECT instrument, epoch_us(min(ts)) AS ts_us, arg_min(price, pos) AS open, max(price) AS high, min(price) AS low, arg_max(price, pos) AS close,"
        " CAST(sum(qty) AS BIGINT) AS volume, round(sum(dollar) / CAST(sum(qty) AS DOUBLE) + 3e-10, 6) AS vwap FROM ticks GROUP BY instrument, date_trunc('hour', ts)",
        "ticks",
    ),
)
def bar1o(spark, d):
    return B.time_bars(C.ticks(spark, d), freq="H", style="ohlcv").select(
        "instrument", US(), "open", "high", "low", "close", "volume", rv("vwap")
    )


def BAR_COLS():
    return ["instrument", "bar_id", US(), "open", "high", "low", "close", rv("vwap"), "n_trades", "end_pos"]


BAR_SQL = f"SELECT instrument, bar_id, {US_SQL}, open, high, low, close, round(vwap + 3e-10, 6) AS vwap, n_trades, end_pos FROM "


@query("bar2_tick_bars", with_views(BAR_SQL + "tbars", "tbars"))
def bar2(spark, d):
    return C.tick_bar_table(spark, d).select(*BAR_COLS())


def threshold_views(prefix: str, measure: str, limit: str) -> None:
    """Reset-at-threshold recursion: ``<prefix>_tag`` (all trades) and ``<prefix>`` (complete bars)."""
    view(
        f"{prefix}_fold",
        f"""
SELECT instrument, pos, CASE WHEN m >= lim THEN 0 ELSE m END AS acc, m >= lim AS is_end, 0::BIGINT AS bar_id,
       (CASE WHEN m >= lim THEN 1 ELSE 0 END)::BIGINT AS nxt, lim
FROM (SELECT instrument, pos, {measure} AS m, {limit} AS lim FROM ticks) WHERE pos = 0
UNION ALL
SELECT t.instrument, t.pos, CASE WHEN f.acc + t.m >= f.lim THEN 0 ELSE f.acc + t.m END, f.acc + t.m >= f.lim, f.nxt,
       f.nxt + (CASE WHEN f.acc + t.m >= f.lim THEN 1 ELSE 0 END)::BIGINT, f.lim
FROM {prefix}_fold f JOIN (SELECT instrument, pos, {measure} AS m FROM ticks) t
  ON t.instrument = f.instrument AND t.pos = f.pos + 1
""",
        "ticks",
    )
    view(f"{prefix}_tag", f"SELECT t.*, f.bar_id, f.is_end FROM ticks t JOIN {prefix}_fold f USING (instrument, pos)", f"{prefix}_fold")
    view(prefix, bar_select(f"{prefix}_tag", "HAVING bool_or(is_end)"), f"{prefix}_tag")


threshold_views("vbars", "qty", "200::BIGINT")
threshold_views("dbars", "cents", "1500000::BIGINT")
threshold_views("abars", "cents", "(SELECT CAST(sum(t2.cents) AS DOUBLE) / 40 FROM ticks t2 WHERE t2.instrument = ticks.instrument)")


@query("bar3_volume_bars", with_views(BAR_SQL + "vbars", "vbars"))
def bar3(spark, d):
    return B.volume_bars(C.ticks(spark, d), threshold=200).select(*BAR_COLS())


@query("bar4_dollar_bars", with_views(BAR_SQL + "dbars", "dbars"))
def bar4(spark, d):
    return B.dollar_bars(C.ticks(spark, d), threshold=1_500_000, measure="cents").select(*BAR_COLS())


@query(
    "bar5_trade_tags",
    with_views(
        "SELECT instrument, pos, bar_id FROM dbars_tag t WHERE bar_id < (SELECT max(bar_id) FROM dbars_tag u WHERE u.instrument = t.instrument)",
        "dbars_tag",
    ),
)
def bar5(spark, d):
    return B.trades_with_bar_id(C.ticks(spark, d), measure="cents", threshold=1_500_000).select("instrument", "pos", "bar_id")


@query(
    "bar6_bar_flow",
    with_views(
        "SELECT instrument, bar_id, n_trades, round(dollar, 4) AS dollar, buy_volume, sell_volume FROM dbars", "dbars"
    ),
)
def bar6(spark, d):
    return B.dollar_bars(C.ticks(spark, d), threshold=1_500_000, measure="cents").select(
        "instrument", "bar_id", "n_trades", r("dollar", 4), "buy_volume", "sell_volume"
    )


def _seeded(window: str) -> str:
    """Recursive average of the list ``h`` seeded with its first value, alpha = 2 / (window + 1)."""
    al = f"(2.0::DOUBLE / ({window} + 1))"
    return (
        f"list_sum(list_transform(h, lambda x, i: x * CASE WHEN i = 1 THEN pow(1 - {al}, len(h) - 1) ELSE {al} * pow(1 - {al}, len(h) - i) END))"
    )


def imbalance_views(prefix: str, flow: str, floor: str) -> None:
    view(
        f"{prefix}_fold",
        f"""
SELECT instrument, -1::BIGINT AS pos, 0::DOUBLE AS th, 0::DOUBLE AS k, 10::DOUBLE AS et, 0::DOUBLE AS eb, 0::BIGINT AS nxt, -1::BIGINT AS bar_id, false AS is_end,
       []::DOUBLE[] AS h FROM (SELECT DISTINCT instrument FROM ticks)
UNION ALL
SELECT instrument, pos, CASE WHEN e THEN 0 ELSE th END, CASE WHEN e THEN 0 ELSE k END, et2,
       CASE WHEN e THEN greatest({floor.format(_seeded("greatest(1, floor(3 * et2))"))}, 1e-6::DOUBLE) ELSE eb1 END, nxt + CASE WHEN e THEN 1 ELSE 0 END, nxt, e, h
FROM (SELECT *, CASE WHEN e THEN (CASE WHEN nxt = 0 THEN k ELSE 0.5::DOUBLE * k + 0.5::DOUBLE * et END) ELSE et END AS et2
      FROM (SELECT *, eb1 <> 0 AND abs(th) >= et * abs(eb1) AS e
            FROM (SELECT *, CASE WHEN nxt = 0 AND len(h) >= 10 THEN greatest({floor.format(_seeded("10"))}, 1e-6::DOUBLE) ELSE eb END AS eb1
                  FROM (SELECT t.instrument, t.pos, f.th + t.x AS th, f.k + 1 AS k, f.et, f.eb, f.nxt, list_append(f.h, t.x) AS h
                        FROM {prefix}_fold f JOIN (SELECT instrument, pos, CAST({flow} AS DOUBLE) AS x FROM ticks) t
                          ON t.instrument = f.instrument AND t.pos = f.pos + 1))))
""",
        "ticks",
    )
    view(f"{prefix}_tag", f"SELECT t.*, f.bar_id, f.is_end FROM ticks t JOIN {prefix}_fold f USING (instrument, pos)", f"{prefix}_fold")
    view(prefix, bar_select(f"{prefix}_tag", "HAVING bool_or(is_end)"), f"{prefix}_tag")


imbalance_views("tibars", "side", "{}")
imbalance_views("vibars", "side * qty", "{}")
imbalance_views("dibars", "side * dollar", "abs({})")


@query(
    "bar7_tick_imbalance_bars",
    with_views(f"SELECT instrument, bar_id, {US_SQL}, open, high, low, close, n_trades, end_pos FROM tibars", "tibars"),
)
def bar7(spark, d):
    return B.tick_imbalance_bars(C.ticks(spark, d)).select(*BAR_COLS()[:7], "n_trades", "end_pos")


@query("bar8_volume_imbalance_bars", with_views(BAR_SQL + "vibars", "vibars"))
def bar8(spark, d):
    return B.volume_imbalance_bars(C.ticks(spark, d)).select(*BAR_COLS())


@query("bar8_dollar_imbalance_bars", with_views(BAR_SQL + "dibars", "dibars"))
def bar8d(spark, d):
    return B.volume_imbalance_bars(C.ticks(spark, d), measure="dollar", floor="abs").select(*BAR_COLS())


def run_views(prefix: str, size: str, goal0: str, goal: str) -> None:
    a = "0.5::DOUBLE"
    view(
        f"{prefix}_fold",
        f"""
SELECT instrument, -1::BIGINT AS pos, 0::DOUBLE AS b, 0::DOUBLE AS s, 0::DOUBLE AS k, 0::DOUBLE AS g, 0::BIGINT AS nxt,
       -1::BIGINT AS bar_id, false AS is_end, 0::DOUBLE AS et, 0::DOUBLE AS p, 0::DOUBLE AS vb, 0::DOUBLE AS vs
FROM (SELECT DISTINCT instrument FROM ticks)
UNION ALL
SELECT instrument, pos, CASE WHEN e THEN 0 ELSE b END, CASE WHEN e THEN 0 ELSE s END, CASE WHEN e THEN 0 ELSE k END,
       CASE WHEN e THEN greatest({goal}, 1e-6::DOUBLE) ELSE g END, nxt + CASE WHEN e THEN 1 ELSE 0 END, nxt, e, et2, p2, vb2, vs2
FROM (SELECT *, CASE WHEN e THEN (CASE WHEN nxt = 0 THEN k ELSE {a} * k + (1 - {a}) * et END) ELSE et END AS et2,
             CASE WHEN e THEN (CASE WHEN nxt = 0 THEN sh ELSE {a} * sh + (1 - {a}) * p END) ELSE p END AS p2,
             CASE WHEN e THEN (CASE WHEN nxt = 0 THEN b / k ELSE {a} * (b / k) + (1 - {a}) * vb END) ELSE vb END AS vb2,
             CASE WHEN e THEN (CASE WHEN nxt = 0 THEN s / k ELSE {a} * (s / k) + (1 - {a}) * vs END) ELSE vs END AS vs2
      FROM (SELECT *, g <> 0 AND greatest(b, s) >= g AS e, (b / k) / (b / k + s / k) AS sh
            FROM (SELECT t.instrument, t.pos, f.b + CASE WHEN t.side = 1 THEN t.v ELSE 0 END AS b,
                         f.s + CASE WHEN t.side = -1 THEN t.v ELSE 0 END AS s, f.k + 1 AS k, f.nxt, f.et, f.p, f.vb, f.vs,
                         CASE WHEN f.nxt = 0 AND f.k + 1 >= 10 THEN {goal0} ELSE f.g END AS g
                  FROM {prefix}_fold f JOIN (SELECT instrument, pos, side, {size} AS v FROM ticks) t
                    ON t.instrument = f.instrument AND t.pos = f.pos + 1)))
""",
        "ticks",
    )
    view(f"{prefix}_tag", f"SELECT t.*, f.bar_id, f.is_end FROM ticks t JOIN {prefix}_fold f USING (instrument, pos)", f"{prefix}_fold")
    view(prefix, bar_select(f"{prefix}_tag", "HAVING bool_or(is_end)"), f"{prefix}_tag")


run_views("trbars", "1::DOUBLE", "10 * 0.5::DOUBLE", "et2 * greatest(p2, 1 - p2)")
run_views("vrbars", "qty::DOUBLE", "greatest(10 * 0.5::DOUBLE * 0.01::DOUBLE, 1e-6::DOUBLE)", "et2 * greatest(p2 * vb2, (1 - p2) * vs2)")


@query("bar9_tick_run_bars", with_views(BAR_SQL + "trbars", "trbars"))
def bar9(spark, d):
    return B.tick_run_bars(C.ticks(spark, d)).select(*BAR_COLS())


@query("bar10_volume_run_bars", with_views(BAR_SQL + "vrbars", "vrbars"))
def bar10(spark, d):
    return B.volume_run_bars(C.ticks(spark, d)).select(*BAR_COLS())


@query(
    "bar11_adaptive_threshold",
    with_views("SELECT instrument, round(sum(dollar) / 40, 6) AS threshold FROM ticks GROUP BY 1", "ticks"),
)
def bar11(spark, d):
    return B.adaptive_threshold(C.ticks(spark, d), target_bars=40).select("instrument", r("threshold"))


@query("bar11_adaptive_dollar_bars", with_views(BAR_SQL + "abars", "abars"))
def bar11b(spark, d):
    tape = C.ticks(spark, d)
    limits = B.adaptive_threshold(tape, target_bars=40, measure="cents")
    return B.dollar_bars(tape.join(limits, "instrument"), threshold="threshold", measure="cents").select(*BAR_COLS())


def cusum_views(prefix: str, source: str, value: str, h: str) -> None:
    view(
        f"{prefix}_fold",
        f"""
SELECT instrument, pos, {value} AS v, 0::DOUBLE AS up, 0::DOUBLE AS dn, false AS hit FROM {source} WHERE pos = 0
UNION ALL
SELECT instrument, pos, v, CASE WHEN u >= {h} THEN 0 ELSE u END,
       CASE WHEN u < {h} AND abs(w) >= {h} THEN 0 ELSE w END, u >= {h} OR abs(w) >= {h}
FROM (SELECT t.instrument, t.pos, t.v, greatest(0, f.up + (t.v - f.v)) AS u, least(0, f.dn + (t.v - f.v)) AS w
      FROM {prefix}_fold f JOIN (SELECT instrument, pos, {value} AS v FROM {source}) t
        ON t.instrument = f.instrument AND t.pos = f.pos + 1)
""",
        source,
    )
    view(prefix, f"SELECT b.* FROM {source} b JOIN {prefix}_fold f USING (instrument, pos) WHERE f.hit", f"{prefix}_fold")


cusum_views("cusum60", "tbars", "close", "60::DOUBLE")


@query("bar12_cusum_events", with_views(f"SELECT instrument, pos, {US_SQL}, close FROM cusum60", "cusum60"))
def bar12(spark, d):
    return B.cusum_filter(C.tick_bar_table(spark, d), h=60.0).select("instrument", "pos", US(), "close")


GRID = [30.0, 60.0, 120.0]
for _h in (30, 120):
    cusum_views(f"cusum{_h}", "tbars", "close", f"{_h}::DOUBLE")
view(
    "audit",
    "SELECT s.*, e.h, e.n AS n_events, e.n / s.n_bars::DOUBLE AS event_rate FROM ("
    + "SELECT instrument, count(*) AS n_bars, avg(close) AS mean_close, stddev_samp(close) AS std_close, avg(abs(dd)) AS mean_abs_diff, stddev_samp(dd) AS std_diff"
    + " FROM (SELECT *, close - lag(close) OVER (PARTITION BY instrument ORDER BY pos) AS dd FROM tbars) GROUP BY 1) s JOIN ("
    + " UNION ALL ".join(
        f"SELECT i.instrument, {h}::DOUBLE AS h, count(c.pos) AS n FROM (SELECT DISTINCT instrument FROM tbars) i LEFT JOIN cusum{h} c ON c.instrument = i.instrument GROUP BY 1, 2"
        for h in (30, 60, 120)
    )
    + ") e USING (instrument)",
    "tbars", "cusum30", "cusum60", "cusum120",
)


@query(
    "bar13_threshold_audit",
    with_views(
        "SELECT instrument, h, n_bars, round(mean_close, 6) AS mean_close, round(std_close, 6) AS std_close, round(mean_abs_diff, 6) AS mean_abs_diff,"
        " round(std_diff, 6) AS std_diff, n_events, round(event_rate, 6) AS event_rate,"
        " round(h * std_diff / (SELECT any_value(std_diff) FROM audit WHERE instrument = 'u00'), 6) AS h_equivalent FROM audit",
        "audit",
    ),
)
def bar13(spark, d):
    audit = B.sampling_threshold_audit(C.tick_bar_table(spark, d), GRID)
    return B.equivalent_threshold(audit, reference="u00").select(
        "instrument", "h", "n_bars", r("mean_close"), r("std_close"), r("mean_abs_diff"), r("std_diff"), "n_events",
        r("event_rate"), r("h_equivalent"),
    )

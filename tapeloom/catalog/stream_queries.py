"""Streaming forms run to completion over landed files; results equal the batch operators on all rows
older than the final watermark."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog.base_sql import view, with_views
from tapeloom.catalog.registry import query
from tapeloom.catalog.tape_queries import US, US_SQL, cusum_views
from tapeloom.sources import canonical as C
from tapeloom.sources.storage import scratch
from tapeloom.streaming import online as O

_WM = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM ticks)"


def r(c: str, n: int = 6):
    return F.round(F.col(c) + 3e-10, n).alias(c)


def landed(spark, d):
    """The trade tape as landed files, read back as a stream."""
    path = scratch(spark, "landed")
    tape = C.ticks(spark, d).select("instrument", "seq", "ts", "price", "qty", "cents", "side")
    tape.write.parquet(path)
    return O.trade_stream(spark, path, spark.read.parquet(path).schema)


def finished(spark, stream):
    sink = scratch(spark, "stream")
    O.run_available(stream, sink, scratch(spark, "ckpt"))
    return spark.read.schema(stream.schema).parquet(sink)


@query(
    "st1_deduplicated_trades",
    with_views(f"SELECT instrument, seq, {US_SQL}, price, qty FROM ticks", "ticks"),
)
def st1(spark, d):
    path = scratch(spark, "landed")
    tape = C.ticks(spark, d).select("instrument", "seq", "ts", "price", "qty")
    tape.write.parquet(path)
    tape.where(F.col("qty") > 50).write.mode("append").parquet(path)
    stream = O.trade_stream(spark, path, spark.read.parquet(path).schema)
    return finished(spark, stream).select("instrument", "seq", US(), "price", "qty")


@query(
    "st2_time_bars",
    with_views(
        f"""SELECT instrument, epoch_us(date_trunc('hour', ts)) AS start_us, arg_min(price, pos) AS open, max(price) AS high, min(price) AS low, arg_max(price, pos) AS close,
        CAST(sum(qty) AS BIGINT) AS volume, count(*) AS n_trades FROM ticks GROUP BY instrument, date_trunc('hour', ts) HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_WM}""",
        "ticks",
    ),
)
def st2(spark, d):
    out = finished(spark, O.time_bars(landed(spark, d), width="1 hour"))
    return out.select("instrument", F.unix_micros("start").alias("start_us"), "open", "high", "low", "close", "volume", "n_trades")


view(
    "sess",
    """
SELECT instrument, min(ts) AS start, max(ts) AS last, arg_min(price, pos) AS open, arg_max(price, pos) AS close, CAST(sum(qty) AS BIGINT) AS volume, count(*) AS n_trades
FROM (SELECT *, sum(brk) OVER (PARTITION BY instrument ORDER BY pos) AS sid FROM (
  SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY instrument ORDER BY pos) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk FROM ticks)) GROUP BY instrument, sid
""",
    "ticks",
)


@query(
    "st3_session_bars",
    with_views(f"SELECT instrument, epoch_us(start) AS start_us, open, close, volume, n_trades FROM sess WHERE last + INTERVAL 30 MINUTE <= {_WM}", "sess"),
)
def st3(spark, d):
    return finished(spark, O.session_bars(landed(spark, d), gap="30 minutes")).select("instrument", F.unix_micros("start").alias("start_us"), "open", "close", "volume", "n_trades")


def _bars(df):
    return df.select("instrument", "bar_id", US(), "open", "high", "low", "close", r("vwap"), "n_trades")


def _bars_sql(name: str):
    return with_views(
        f"SELECT instrument, bar_id, {US_SQL}, open, high, low, close, round(vwap + 3e-10, 6) AS vwap, n_trades FROM {name} WHERE epoch_ms(ts) < epoch_ms({_WM}) OR ts < date_trunc('millisecond', {_WM})", name, "ticks"
    )


@query("st4_dollar_bars", _bars_sql("dbars"))
def st4(spark, d):
    return _bars(finished(spark, O.threshold_bars(landed(spark, d), measure="cents", threshold=1_500_000)))


@query("st4_tick_bars", _bars_sql("tbars"))
def st4t(spark, d):
    return _bars(finished(spark, O.tick_bars(landed(spark, d), n=5)))


@query("st4_run_bars", _bars_sql("trbars"))
def st4r(spark, d):
    return _bars(finished(spark, O.run_bars(landed(spark, d))))


@query("st5_imbalance_bars", _bars_sql("tibars"))
def st5(spark, d):
    return _bars(finished(spark, O.imbalance_bars(landed(spark, d))))


cusum_views("tcusum", "ticks", "price", "60::DOUBLE")


@query(
    "st6_cusum_events",
    with_views(f"SELECT instrument, seq, {US_SQL}, price FROM tcusum WHERE ts < date_trunc('millisecond', {_WM})", "tcusum"),
)
def st6(spark, d):
    return finished(spark, O.cusum_events(landed(spark, d), h=60.0)).select("instrument", "seq", US(), "price")


view(
    "monitor",
    """
SELECT e.instrument, e.ts AS t0, arg_min(t.ts, t.pos) AS t1, arg_min(t.price / e.price - 1, t.pos) AS ret,
       arg_min(CASE WHEN t.price / e.price - 1 > 0.5 THEN 'pt' WHEN t.price / e.price - 1 < -0.5 THEN 'sl' ELSE 'time' END, t.pos) AS touched
FROM ticks e JOIN ticks t ON t.instrument = e.instrument AND t.pos > e.pos
WHERE e.qty > 90 AND (abs(t.price / e.price - 1) > 0.5 OR t.ts >= e.ts + INTERVAL 1 DAY) GROUP BY 1, 2
""",
    "ticks",
)


@query(
    "st7_barrier_monitor",
    with_views(
        f"SELECT instrument, epoch_us(t0) AS t0_us, epoch_us(t1) AS t1_us, round(ret + 3e-10, 6) AS ret, touched FROM monitor WHERE t1 < date_trunc('millisecond', {_WM})", "monitor"
    ),
)
def st7(spark, d):
    path = scratch(spark, "landed")
    t = C.ticks(spark, d).select("instrument", "seq", "ts", "price", "qty")
    opens = F.col("qty") > 90
    t.withColumns(
        {"trgt": F.when(opens, F.lit(0.5)), "expires": F.when(opens, F.col("ts") + F.expr("INTERVAL 1 DAY"))}
    ).write.parquet(path)
    stream = O.trade_stream(spark, path, spark.read.parquet(path).schema)
    out = finished(spark, O.barrier_monitor(stream, pt=1.0, sl=1.0))
    return out.select("instrument", F.unix_micros("t0").alias("t0_us"), F.unix_micros("t1").alias("t1_us"), r("ret"), "touched")


@query(
    "st8_incremental_rerun",
    with_views(
        f"""SELECT instrument, epoch_us(date_trunc('hour', ts)) AS start_us, arg_min(price, pos) AS open, arg_max(price, pos) AS close, CAST(sum(qty) AS BIGINT) AS volume, count(*) AS n_trades
        FROM ticks GROUP BY instrument, date_trunc('hour', ts) HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_WM}""",
        "ticks",
    ),
)
def st8(spark, d):
    """Half of the tape lands and the job runs, the other half lands and it runs again, and once more with nothing new."""
    path, sink, checkpoint = scratch(spark, "landed"), scratch(spark, "stream"), scratch(spark, "ckpt")
    tape = C.ticks(spark, d).select("instrument", "seq", "ts", "price", "qty")
    first, last = tape.agg(F.min("ts"), F.max("ts")).first()
    middle = first + (last - first) / 2
    for part in (F.col("ts") < F.lit(middle), F.col("ts") >= F.lit(middle), None):
        if part is not None:
            tape.where(part).write.mode("append").parquet(path)
        bars = O.time_bars(O.trade_stream(spark, path, tape.schema), width="1 hour")
        O.run_available(bars, sink, checkpoint)
    return spark.read.schema(bars.schema).parquet(sink).select("instrument", F.unix_micros("start").alias("start_us"), "open", "close", "volume", "n_trades")

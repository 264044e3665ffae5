"""Long series views over the test tables, with the types every operator expects.

Money decisions are taken on whole cents so results do not depend on summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators import bars as B
from tapeloom.plans.series import position


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as sixteen trade tapes ordered by ``(ts, seq)``."""
    price_cents = F.round((F.col("value") + 1) * 100).cast("long")
    qty = F.get_json_object("props", "$.k").cast("long") + 1
    tape = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.lpad((F.col("user_id") % 16).cast("string"), 2, "0")).alias("instrument"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        (price_cents / F.lit(100.0)).alias("price"),
        qty.alias("qty"),
        (price_cents * qty).alias("cents"),
        (price_cents * qty / F.lit(100.0)).alias("dollar"),
        F.when(F.col("event_type").isin("click", "purchase", "signup"), 1).otherwise(-1).alias("side"),
    )
    return position(tape, ["ts", "seq"])


def raw_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a raw tape per supplier, with repeated trade ids and many equal times."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("instrument"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trade_id"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("quote_qty"),
        (F.col("l_returnflag") == "R").alias("is_buyer_maker"),
        (F.col("l_linestatus") == "O").alias("is_best_match"),
        F.col("l_partkey").alias("part"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("ext_cents"),
    )


def tick_bar_table(spark: SparkSession, sf_dir: str, n: int = 5) -> DataFrame:
    return B.tick_bars(ticks(spark, sf_dir), n=n)


def daily_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLCV of order totals per order priority (prices in whole-cent doubles)."""
    o = table(spark, sf_dir, "orders")
    by = F.col("o_orderkey")
    daily = o.groupBy(
        F.regexp_replace("o_orderpriority", " ", "").alias("instrument"), F.col("o_orderdate").cast("timestamp").alias("ts")
    ).agg(
        F.min_by("o_totalprice", by).alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", by).alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )
    return position(daily, ["ts"])


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract panel: four products, each trading its current and next two yearly contracts every day."""
    li = table(spark, sf_dir, "lineitem")
    product = F.concat(F.lit("p"), (F.col("l_suppkey") % 4).cast("string"))
    contract = F.concat(product, F.lit("y"), (F.year("l_shipdate") + (F.col("l_suppkey") % 12 / 4).cast("int")).cast("string"))
    cents = F.round(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("long")
    first = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return (
        li.select("*", product.alias("instrument"), contract.alias("contract"), cents.alias("c"), first.alias("o"))
        .groupBy("instrument", "contract", F.to_date("l_shipdate").alias("date"))
        .agg(
            (F.min_by("c", "o") / F.lit(100.0)).alias("open"),
            (F.max("c") / F.lit(100.0)).alias("high"),
            (F.min("c") / F.lit(100.0)).alias("low"),
            (F.max_by("c", "o") / F.lit(100.0)).alias("close"),
            F.sum(F.col("l_quantity").cast("long")).alias("volume"),
            F.count(F.lit(1)).alias("open_int"),
        )
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label interval per order: t0 = order date, t1 = last ship date (null when absent or earlier)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_shipdate").alias("_t1")
    )
    joined = o.join(last, "o_orderkey", "left")
    return joined.select(
        F.regexp_replace("o_orderpriority", " ", "").alias("instrument"),
        F.col("o_orderkey").alias("event_id"),
        F.col("o_orderdate").cast("timestamp").alias("t0"),
        F.when(F.col("_t1") >= F.col("o_orderdate"), F.col("_t1")).cast("timestamp").alias("t1"),
        F.col("o_totalprice").alias("value"),
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty strategy trials per line status: monthly mean discount edge by supplier group."""
    li = table(spark, sf_dir, "lineitem")
    daily = li.groupBy(
        F.col("l_linestatus").alias("study"),
        F.concat(F.lit("t"), F.lpad((F.col("l_suppkey") % 20).cast("string"), 2, "0")).alias("trial"),
        F.date_trunc("month", F.col("l_shipdate")).alias("month"),
    ).agg(
        ((F.sum(F.round(F.col("l_discount") * 100).cast("long") - 5)) / F.count(F.lit(1)) / F.lit(100.0)).alias("pnl")
    )
    return position(daily, ["month"], keys=["study", "trial"])

"""Trade-tape sources (headerless CSV, landed JSON pages) and tape persistence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.operators.ticks import dedupe_trades, disambiguate_timestamps

TRADE_CSV_SCHEMA = T.StructType(
    [
        T.StructField("trade_id", T.LongType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("qty", T.DoubleType()),
        T.StructField("quote_qty", T.DoubleType()),
        T.StructField("time_us", T.LongType()),
        T.StructField("is_buyer_maker", T.BooleanType()),
        T.StructField("is_best_match", T.BooleanType()),
    ]
)

PULL_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("price", T.StringType()),
        T.StructField("qty", T.StringType()),
        T.StructField("quoteQty", T.StringType()),
        T.StructField("time", T.LongType()),
        T.StructField("isBuyerMaker", T.BooleanType()),
        T.StructField("isBestMatch", T.BooleanType()),
        T.StructField("symbol", T.StringType()),
    ]
)


def read_trade_csv(spark: SparkSession, path: str, *, instrument: Column | None = None) -> DataFrame:
    """Headerless seven-column tape with epoch-microsecond times.

    ``instrument`` defaults to the name of the file's folder, so one read covers many tapes.
    """
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return (
        spark.read.schema(TRADE_CSV_SCHEMA)
        .csv(path, recursiveFileLookup=True)
        .select((instrument if instrument is not None else folder).alias("instrument"), "*")
        .withColumn("ts", F.timestamp_micros("time_us"))
        .drop("time_us")
    )


def normalise_pull(pages: DataFrame, *, cutoff_ms: int | None = None) -> DataFrame:
    """Landed REST pages -> tape: rename, cast, ms -> us, dedupe, separate equal times, cut off."""
    tape = pages.select(
        F.col("symbol").alias("instrument"),
        F.col("id").alias("trade_id"),
        F.col("price").cast("double").alias("price"),
        F.col("qty").cast("double").alias("qty"),
        F.col("quoteQty").cast("double").alias("quote_qty"),
        F.timestamp_millis(F.col("time")).alias("ts"),
        F.col("isBuyerMaker").alias("is_buyer_maker"),
        F.col("isBestMatch").alias("is_best_match"),
    )
    tape = disambiguate_timestamps(dedupe_trades(tape, order=("ts",)))
    if cutoff_ms is not None:
        tape = tape.where(F.unix_micros("ts") >= F.lit(cutoff_ms) * 1000)
    return tape


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Column-pruned Parquet read."""
    return spark.read.parquet(path).select(*columns)


def write_tape(df: DataFrame, path: str, *, rows_per_file: int = 4_000_000) -> None:
    """Range-sorted Parquet tape: even files whatever the skew, and min/max statistics prune on time."""
    df.repartitionByRange("instrument", "ts").sortWithinPartitions("instrument", "ts").write.mode("errorifexists").option(
        "maxRecordsPerFile", rows_per_file
    ).parquet(path)

"""Futures contract files: one text file per contract, with or without a quoted header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBERS = ("open", "high", "low", "close", "volume", "open_int")


def read_contracts(
    spark: SparkSession,
    path: str,
    *,
    pivot_year: int = 30,
    rescale_headered: float | None = None,
    instrument_from: Column | None = None,
    contract_from: Column | None = None,
) -> DataFrame:
    """Contract rows from every ``.txt`` file (any case) under ``path``.

    A file is headered when its lines carry mm/dd/yyyy dates; headerless files use yymmdd with years
    up to ``pivot_year`` in the 2000s (68 gives the usual two-digit rule).  Dates stay text until parsed,
    so leading zeros survive.  ``rescale_headered`` multiplies the prices of headered files only.
    The contract is the file's name and the instrument its folder unless given from other metadata.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[tT][xX][tT]").text(path)
    parts = F.split("value", ",")
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    rows = lines.select(
        (stem if contract_from is None else contract_from).alias("contract"),
        (folder if instrument_from is None else instrument_from).alias("instrument"),
        F.trim(parts[0]).alias("d"),
        *[F.try_element_at(parts, F.lit(i + 2)).try_cast("double").alias(n) for i, n in enumerate(NUMBERS)],
    ).where(F.col("d").rlike(r"^\d"))
    dated = F.col("d").contains("/")
    six = F.lpad("d", 6, "0")
    yy = F.substring(six, 1, 2).try_cast("int")
    year = F.when(yy <= pivot_year, 2000 + yy).otherwise(1900 + yy)
    short = F.try_to_timestamp(F.when(~dated, F.concat(year.cast("string"), F.substring(six, 3, 4))), F.lit("yyyyMMdd"))
    long = F.try_to_timestamp(F.when(dated, F.col("d")), F.lit("MM/dd/yyyy"))
    scale = F.when(dated, F.lit(float(rescale_headered))).otherwise(F.lit(1.0)) if rescale_headered else F.lit(1.0)
    return rows.select(
        "instrument",
        "contract",
        F.coalesce(long, short).cast("date").alias("date"),
        *[(F.col(n) * scale).alias(n) for n in NUMBERS[:4]],
        F.col("volume").cast("long").alias("volume"),
        F.col("open_int").cast("long").alias("open_int"),
    )


def read_contract_panel(spark: SparkSession, path: str, **options) -> DataFrame:
    """All contracts of a folder as one panel; an empty folder is an error."""
    panel = read_contracts(spark, path, **options)
    if not panel.inputFiles():
        raise FileNotFoundError(f"no contract files under {path}")
    return panel

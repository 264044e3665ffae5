"""Training-table staging, guarded run log and frozen snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.plans.series import KEYS


def training_table(enriched: DataFrame, weights: DataFrame, features: Sequence[str]) -> DataFrame:
    """t1, bin, features and weight only; a row without weight fails the job."""
    joined = enriched.select(*KEYS, "t0", "t1", "bin", *features).join(weights.select(*KEYS, "t0", "w"), [*KEYS, "t0"], "left")
    w = F.when(F.col("w").isNull() | F.isnan("w"), F.raise_error(F.concat(F.lit("no weight for event of "), F.col("instrument")))).otherwise(F.col("w"))
    return joined.withColumn("w", w)


def stage_training_table(enriched: DataFrame, weights: DataFrame, features: Sequence[str], path: str) -> None:
    training_table(enriched, weights, features).write.mode("errorifexists").parquet(path)


def append_run_log(rows: DataFrame, path: str, *, fields: Sequence[str]) -> None:
    """Append runs to a Parquet log; missing fields become null, a differing log layout is an error."""
    spark = rows.sparkSession
    extra = [c for c in rows.columns if c not in fields]
    if extra:
        raise ValueError(f"unknown log fields {extra}")
    ordered = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in fields])
    try:
        have = spark.read.parquet(path).columns
    except AnalysisException:
        have = None
    if have is not None and have != list(fields):
        raise ValueError(f"log at {path} has fields {have}, expected {list(fields)}")
    ordered.write.mode("append").parquet(path)


def freeze(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet folder per table, so that sweeps share one input."""
    for name, df in tables.items():
        df.write.mode("errorifexists").partitionBy("instrument").parquet(f"{path}/{name}")


def load_frozen(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}

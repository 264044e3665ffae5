"""Session helpers: local/test sessions and durable lineage cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeloom.sources.storage import shared_base


def build_session(master: str = "local[8]", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the local bench; a cluster job brings its own."""
    spark = (
        SparkSession.builder.master(master)
        .appName("tapeloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder named by ``spark.checkpoint.dir``.

    A local session without that setting (tests) gets a private folder; a cluster session without it fails.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint(eager=True)

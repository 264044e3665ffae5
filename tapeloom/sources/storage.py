"""Scratch and artefact folders on shared storage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"
#: Folders made inside each open ``scratch_scope``, the innermost last.
_OPEN: list[list[str]] = []


def shared_base(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a session with master ``local`` (driver and executor are one process) gets a private folder that goes
    with the process; on a cluster this raises, as a machine-local folder would hide files from other machines.
    """
    base = spark.conf.get(SETTING, None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"{SETTING} must name a folder that driver and executors share")
    base = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    spark.conf.set(SETTING, f"file://{base}")
    return f"file://{base}"


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared folder."""
    path = f"{shared_base(spark)}/{label}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Folders that operators make inside the scope go when it ends, whether or not the job has failed.

    Results are lazy and read these folders, so write them out inside the scope. Without a scope folders stay.
    """
    _OPEN.append([])
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _OPEN.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(hadoop).delete(place, True)

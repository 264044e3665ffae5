from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tapeloom.session import build_session  # noqa: E402

T0 = dt.datetime(2020, 1, 1)


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 4)
    yield s
    s.stop()


@pytest.fixture
def split(spark):
    """Three-row blocks."""
    spark.conf.set("tapeloom.series.block_rows", "3")
    yield
    spark.conf.unset("tapeloom.series.block_rows")


def days(n: int, start: int = 0) -> list[dt.datetime]:
    return [T0 + dt.timedelta(days=start + i) for i in range(n)]


def series(spark, values, *, name="close", shift=1000.0, extra=None, step=1):
    """Two instruments: ``a`` is the fixture and ``z`` a shifted copy, interleaved in time."""
    rows = []
    for i, v in enumerate(values):
        more = {k: c[i] for k, c in (extra or {}).items()}
        for inst, s in (("a", 0.0), ("z", shift)):
            rows.append({"instrument": inst, "pos": i, "seq": i, "ts": T0 + dt.timedelta(days=i * step), name: float(v) + s, **more})
    schema_order = ["instrument", "pos", "seq", "ts", name, *(extra or {})]
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame(rows)[schema_order])


def trades(spark, price, qty=None, side=None):
    n = len(price)
    qty = qty or [1] * n
    side = side or [1] * n
    extra = {"qty": qty, "side": side}
    from pyspark.sql import functions as F

    return series(spark, price, name="price", shift=0.0, extra=extra).withColumn("dollar", F.col("price") * F.col("qty"))


def col(df, c, order="pos", inst="a"):
    return [r[c] for r in df.where(f"instrument = '{inst}'").orderBy(order).collect()]

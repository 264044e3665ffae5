"""Scratch folders of a job go with it."""

from __future__ import annotations

import os

import pytest
from conftest import trades

from tapeloom.operators import bars as B
from tapeloom.sources import storage


def test_a_job_leaves_no_scratch_folder(spark, tmp_path, split):
    base = storage.shared_base(spark)
    before = set(os.listdir(base.removeprefix("file://")))
    with storage.scratch_scope(spark):
        out = B.tick_imbalance_bars(trades(spark, [100.0 + i % 3 for i in range(20)], side=[1, -1, 1, 1] * 5), init_ticks=3)
        out.write.parquet(str(tmp_path / "bars"))
        assert set(os.listdir(base.removeprefix("file://"))) > before
    assert set(os.listdir(base.removeprefix("file://"))) == before
    assert spark.read.parquet(str(tmp_path / "bars")).count() > 0
    with pytest.raises(RuntimeError), storage.scratch_scope(spark):
        os.makedirs(storage.scratch(spark, "lost").removeprefix("file://"))
        raise RuntimeError
    assert set(os.listdir(base.removeprefix("file://"))) == before

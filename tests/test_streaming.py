"""Streams in many micro-batches: order, late files, flushes, state sizes and restarts."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import bars as B
from tapeloom.streaming import online as O

T0 = dt.datetime(2021, 3, 1)
SCHEMA = "instrument string, seq long, ts timestamp, price double, qty long, side int, trgt double, expires timestamp"


def tape(n: int = 400, seed: int = 3):
    rng = random.Random(seed)
    rows = []
    for inst in ("a", "b"):
        price = 100.0
        for i in range(n if inst == "a" else n // 3):
            price *= 1 + rng.uniform(-0.02, 0.02)
            ts = T0 + dt.timedelta(seconds=20 * i + rng.randint(0, 9))
            opens = rng.random() < 0.15
            rows.append((inst, i, ts, price, rng.randint(1, 20), rng.choice([-1, 1]), 0.03 if opens else None, ts + dt.timedelta(minutes=rng.randint(1, 40)) if opens else None))
    return rows


def landed(spark, folder, rows, size: int = 60):
    """Files of neighbouring times, their rows mixed, and neighbours overlapping by up to three minutes."""
    rng = random.Random(1)
    mixed = sorted(rows, key=lambda r: r[2] + dt.timedelta(seconds=rng.uniform(0, 180)))
    for k in range(0, len(mixed), size):
        part = mixed[k : k + size]
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return O.trade_stream(spark, str(folder), spark.read.parquet(str(folder)).schema, files_per_trigger=1)


def finished(spark, stream, folder):
    progress = O.run_available(stream, f"{folder}/out", f"{folder}/ckpt")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").toPandas(), progress.toPandas()


def old_enough(rows):
    mark = max(r[2] for r in rows) - dt.timedelta(minutes=10)
    mark = mark.replace(microsecond=mark.microsecond // 1000 * 1000)
    return [r for r in rows if r[2] < mark]


def test_bars_over_many_batches_equal_the_batch_operator(spark, tmp_path):
    rows = tape()
    got, progress = finished(spark, O.threshold_bars(landed(spark, tmp_path / "in", rows), measure="qty", threshold=90.0), tmp_path)
    batch = spark.createDataFrame(old_enough(rows), SCHEMA).withColumns({"pos": F.col("seq"), "dollar": F.col("price") * F.col("qty")})
    want = B.volume_bars(batch, threshold=90.0).toPandas()
    got, want = (x.sort_values(["instrument", "bar_id"]).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want) > 30 and (got[["instrument", "bar_id"]] == want[["instrument", "bar_id"]]).all().all()
    for c in ("open", "high", "low", "close", "n_trades"):
        assert got[c].tolist() == pytest.approx(want[c].tolist())
    mine = progress[progress["operator"].str.contains("transformWithState", case=False)]
    assert mine["batch"].nunique() >= 8 and mine["state_bytes"].notna().all()
    # what waits is bounded by the delay and not by the tape: buckets and timers, not rows
    assert mine["state_rows"].max() < 60


def brute_barriers(rows, pt, sl):
    out = []
    for inst in ("a", "b"):
        mine = sorted(((r[2], r[1], *r[3:]) for r in rows if r[0] == inst))
        for i, (ts, _, price, _, _, trgt, expires) in enumerate(mine):
            if trgt is None:
                continue
            for t1, _, p1, *_ in mine[i + 1 :]:
                gain = p1 / price - 1
                why = "pt" if gain > pt * trgt else "sl" if gain < -sl * trgt else "time" if t1 >= expires else None
                if why:
                    out.append((inst, ts, t1, round(gain, 12), why))
                    break
    return sorted(out)


@pytest.mark.parametrize("shards", [1, 3])
def test_barriers_over_many_batches(spark, tmp_path, shards):
    rows = tape()
    stream = landed(spark, tmp_path / "in", rows)
    got, progress = finished(spark, O.barrier_monitor(stream, pt=1.0, sl=1.0, shards=shards), tmp_path)
    got = sorted((r.instrument, r.t0.to_pydatetime(), r.t1.to_pydatetime(), round(r.ret, 12), r.touched) for r in got.itertuples())
    want = brute_barriers(old_enough(rows), 1.0, 1.0)
    assert got == want and {w[4] for w in want} == {"pt", "sl", "time"}


def test_cusum_flushes_silent_instruments(spark, tmp_path):
    """An instrument that gets no more rows is flushed by its timer once the watermark has passed."""
    early = [("quiet", i, T0 + dt.timedelta(seconds=i), 100.0 + 5 * (i % 7), 1, 1, None, None) for i in range(30)]
    late = [("loud", i, T0 + dt.timedelta(minutes=20 + i), 100.0, 1, 1, None, None) for i in range(30)]
    spark.createDataFrame(early, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = O.trade_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files_per_trigger=1)
    got, _ = finished(spark, O.cusum_events(stream, h=12.0), tmp_path)
    batch = spark.createDataFrame(early, SCHEMA).withColumns({"pos": F.col("seq"), "dollar": F.col("price") * F.col("qty")})
    want = B.cusum_filter(batch, h=12.0, value="price").toPandas()
    assert sorted(got["seq"]) == sorted(want["seq"]) and len(want) > 3 and set(got["instrument"]) == {"quiet"}


def test_restart_from_the_checkpoint(spark, tmp_path):
    rows = sorted(tape(), key=lambda r: r[2])
    half = len(rows) // 2
    for part in (rows[:half], rows[half:], []):
        if part:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = O.trade_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
        got, _ = finished(spark, O.tick_bars(stream, n=7), tmp_path)
    mine = [r for r in old_enough(rows) if r[0] == "a"]
    got = got[got["instrument"] == "a"].sort_values("bar_id")
    assert got["bar_id"].tolist() == list(range(len(mine) // 7))
    assert [pd.Timestamp(t) for t in got["ts"]] == [pd.Timestamp(mine[7 * k + 6][2]) for k in range(len(mine) // 7)]

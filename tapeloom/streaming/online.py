"""Structured Streaming forms of the operators that work online.

Order inside an instrument is restored by holding rows until the watermark has passed them; released
rows go through the same marking functions as the batch operators, so both give the same bars.  State
per instrument (``transformWithState``) is the open bar and the marker's numbers as one value, rows newer than the watermark in
a map of time buckets, and a timer that flushes them; the barrier monitor keeps each open event as an entry of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tapeloom.operators import bars as B


def trade_stream(
    spark: SparkSession, path: str, schema: T.StructType, *, delay: str = "10 minutes", files_per_trigger: int | None = None,
    ids: tuple[str, ...] = ("instrument", "seq"),
) -> DataFrame:
    """Trades from landed Parquet files, with a watermark and duplicates dropped inside it."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(ids))


def time_bars(stream: DataFrame, *, width: str, slide: str | None = None) -> DataFrame:
    """Tumbling or sliding bars; a bar appears once the watermark passes its end."""
    at = F.struct("ts", "seq")
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.groupBy(window, "instrument").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("qty").alias("volume"), F.count(F.lit(1)).alias("n_trades"),
    ).select("instrument", F.col("window.start").alias("start"), "open", "high", "low", "close", "volume", "n_trades")


def session_bars(stream: DataFrame, *, gap: str) -> DataFrame:
    """Bars of uninterrupted activity, closed by ``gap`` without trades."""
    at = F.struct("ts", "seq")
    return stream.groupBy(F.session_window("ts", gap), "instrument").agg(
        F.min_by("price", at).alias("open"), F.max_by("price", at).alias("close"), F.sum("qty").alias("volume"), F.count(F.lit(1)).alias("n_trades")
    ).select("instrument", F.col("session_window.start").alias("start"), "open", "close", "volume", "n_trades")


# --------------------------------------------------------------------------- ordered release
Step = Callable[[pd.DataFrame, list[float], list[float]], tuple[pd.DataFrame, list[float], list[float]]]
#: Least width of the time buckets in which rows wait for the watermark; wider ones are this times a power of two.
BUCKET_US = 60_000_000
#: Buckets that rows stored at once are dealt to at most, rows stored at once, rows released at once, and bytes from which a bucket gets a new part.
BUCKETS, STORED, RELEASED, PART_BYTES = 64, 1 << 17, 1 << 16, 1 << 18


def _stored_rows(rows: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _read_rows(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


class _Ordered(StatefulProcessor):
    """Hands the rows of one key to ``release`` in event-time order once the watermark has passed them.

    Rows wait in a map state by time bucket, in parts of bounded size. Buckets are wide where the rows stored at once span a long time,
    and dyadic, so that two either nest or are disjoint: released from the earliest on, disjoint groups of buckets are in order, and
    memory holds some ``RELEASED`` rows or one group, whatever is waiting. A timer at the first waiting row flushes keys that get no more rows.
    """

    def __init__(self, out: T.StructType, order: list[str]):
        self.out, self.order = out.fieldNames(), order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "start long, width long, part long", "rows binary")

    def release(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame | None:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._advance(key, rows, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _store(self, frames: list[pd.DataFrame], parts: dict[tuple[int, int], int]) -> None:
        pool = pd.concat(frames, ignore_index=True)
        at = pool["ts"].astype("datetime64[us]").astype("int64")
        width = BUCKET_US
        while (at.max() - at.min()) // width >= BUCKETS:
            width *= 2
        for start, rows in pool.groupby(at // width * width):
            bucket, part = (int(start), width), parts.get((int(start), width), -1)
            data = self.waiting.getValue((*bucket, part))[0] if part >= 0 else None
            if data is not None and len(data) < PART_BYTES:
                rows = pd.concat((_read_rows(data), rows), ignore_index=True)
            else:
                part += 1
            self.waiting.updateValue((*bucket, part), (_stored_rows(rows),))
            parts[bucket] = part

    def _advance(self, key: tuple, new: Iterable[pd.DataFrame], mark_ms: int) -> Iterator[pd.DataFrame]:
        mark = pd.Timestamp(mark_ms, unit="ms")
        reached = mark.value // 1000
        parts: dict[tuple[int, int], int] = {}
        for start, width, part in self.waiting.keys():
            parts[start, width] = max(part, parts.get((start, width), -1))
        frames, held = [], 0
        for f in new:
            if len(f):
                frames.append(f)
                held += len(f)
            if held >= STORED:
                self._store(frames, parts)
                frames, held = [], 0
        if frames:
            self._store(frames, parts)
        ready, held, end = [], 0, None
        for start, width in [*sorted((b for b in parts if b[0] <= reached), key=lambda b: (b[0], -b[1])), (None, None)]:
            if ready and (start is None or (held >= RELEASED and start >= end)):
                pool = pd.concat(ready, ignore_index=True)
                passed = (pool["ts"] < mark).to_numpy()
                if not passed.all():
                    self._store([pool[~passed]], parts)
                if passed.any():
                    out = self.release(key, pool[passed].sort_values(self.order, ignore_index=True))
                    if out is not None and len(out):
                        yield out.assign(instrument=key[0])[self.out]
                ready, held, end = [], 0, None
            if start is not None:
                for part in range(parts.pop((start, width)) + 1):
                    ready.append(_read_rows(self.waiting.getValue((start, width, part))[0]))
                    self.waiting.removeKey((start, width, part))
                    held += len(ready[-1])
                end = start + width if end is None else max(end, start + width)
        for t in [*self.handle.listTimers()]:
            self.handle.deleteTimer(t)
        if parts:  # at the first waiting row, which is in the earliest bucket or in one inside it
            first, end = None, 0
            for at, width in sorted(parts, key=lambda b: (b[0], -b[1])):
                if first is not None and at >= end:
                    break
                end = max(end, at + width)
                for part in range(parts[at, width] + 1):
                    t = _read_rows(self.waiting.getValue((at, width, part))[0])["ts"].min()
                    first = t if first is None else min(first, t)
            self.handle.registerTimer(max(first.value // 1_000_000 + 1, mark_ms + 1))


class _Fold(_Ordered):
    """A marker's numbers and the open bar (or whatever ``step`` keeps open) in a value state."""

    def __init__(self, step: Step, first: list[float], out: T.StructType, order: list[str]):
        super().__init__(out, order)
        self.step, self.first = step, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.numbers = handle.getValueState("numbers", "nums array<double>, open array<double>")

    def release(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame | None:
        nums, opened = map(list, self.numbers.get()) if self.numbers.exists() else (list(self.first), [])
        result, nums, opened = self.step(rows, nums, opened)
        self.numbers.update(([float(v) for v in nums], [float(v) for v in opened]))
        return result


def _stateful(stream: DataFrame, processor: StatefulProcessor, out: T.StructType, *more: str) -> DataFrame:
    """Spark renames columns that begin with an underscore on their way to a processor, so there must be none."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    rocks = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    if stream.sparkSession.conf.get(provider, "") != rocks:  # map states and timers need it
        stream.sparkSession.conf.set(provider, rocks)
    return stream.groupBy("instrument", *more).transformWithStateInPandas(processor, out, "Append", "EventTime")


def _ordered(stream: DataFrame, step: Step, init: list[float], out: T.StructType, order: list[str]) -> DataFrame:
    """Run ``step(rows, numbers, open)`` over each instrument's rows in event-time order."""
    return _stateful(stream, _Fold(step, init, out, order), out)


BAR_SCHEMA = T.StructType(
    [
        T.StructField("instrument", T.StringType()),
        T.StructField("bar_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "vwap")],
        T.StructField("n_trades", T.LongType()),
    ]
)


def _bar_step(marker) -> Step:
    """Closed bars from marked rows; ``open`` holds (bar_id, n, open, high, low, value, volume)."""

    def step(rows: pd.DataFrame, nums: list[float], opened: list[float]):
        ends, nums = marker(rows, nums)
        bar, n, o, hi, lo, pv, v = opened or [0.0, 0.0, 0.0, -np.inf, np.inf, 0.0, 0.0]
        price, qty, at = rows["price"].to_numpy(dtype=float), rows["qty"].to_numpy(dtype=float), np.flatnonzero(ends)
        first = np.concatenate(([0], at + 1))
        first = first[first < len(rows)]
        opens, count = price[first], np.diff(first, append=len(rows))
        high, low = np.maximum.reduceat(price, first), np.minimum.reduceat(price, first)
        value, volume = np.add.reduceat(price * qty, first), np.add.reduceat(qty, first)
        opens[0] = o if n else opens[0]
        count[0] += int(n)
        high[0], low[0], value[0], volume[0] = max(hi, high[0]), min(lo, low[0]), value[0] + pv, volume[0] + v
        k = len(at)
        out = pd.DataFrame(
            {
                "bar_id": int(bar) + np.arange(k), "ts": rows["ts"].iloc[at].array, "open": opens[:k], "high": high[:k], "low": low[:k],
                "close": price[at], "vwap": value[:k] / volume[:k], "n_trades": count[:k],
            }
        )
        left = [opens[k:], high[k:], low[k:], value[k:], volume[k:]]
        rest = [float(count[k]), *[float(x[0]) for x in left]] if len(first) > k else [0.0, 0.0, -np.inf, np.inf, 0.0, 0.0]
        return out, nums, [float(bar + k), *rest]

    return step


def tick_bars(stream: DataFrame, *, n: int) -> DataFrame:
    counted = stream.withColumn("one", F.lit(1).cast("long"))
    return _ordered(counted, _bar_step(B.threshold_marker("one", float(n))), [0.0], BAR_SCHEMA, ["ts", "seq"])


def threshold_bars(stream: DataFrame, *, measure: str, threshold: float) -> DataFrame:
    """Volume (``qty``) or dollar bars."""
    return _ordered(stream, _bar_step(B.threshold_marker(measure, threshold)), [0.0], BAR_SCHEMA, ["ts", "seq"])


def run_bars(stream: DataFrame, *, init_ticks: int = 10, prev_bars: int = 3, measure: str | None = None) -> DataFrame:
    return _ordered(stream, _bar_step(B.run_marker(init_ticks, prev_bars, measure)), [0.0] * 9, BAR_SCHEMA, ["ts", "seq"])


def imbalance_bars(
    stream: DataFrame, *, init_ticks: int = 10, prev_bars: int = 3, measure: str | None = None, floor: str = "signed"
) -> DataFrame:
    flow = F.col("side") if measure is None else F.col("side") * F.col(measure)
    flowed = stream.withColumn("flow", flow.cast("double"))
    marker = B.imbalance_marker("flow", init_ticks, prev_bars, floor)
    return _ordered(flowed, _bar_step(marker), [0.0, 0.0, float(init_ticks), 0.0, 0.0, 0.0], BAR_SCHEMA, ["ts", "seq"])


def cusum_events(stream: DataFrame, *, h: float, value: str = "price") -> DataFrame:
    """Times at which the symmetric CUSUM fires."""
    marker = B.cusum_marker(value, h)

    def step(rows: pd.DataFrame, nums: list[float], opened: list[float]):
        hit, nums = marker(rows, nums)
        return rows.loc[hit, ["ts", "seq", value]], nums, opened

    out = T.StructType([stream.schema[c] for c in ("instrument", "ts", "seq", value)])
    return _ordered(stream, step, [0.0] * 4, out, ["ts", "seq"])


def _first_touches(price: np.ndarray, ts: np.ndarray, start: np.ndarray, level: np.ndarray, up: np.ndarray, down: np.ndarray, end: np.ndarray, size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """For each event the first row after ``start`` that touches it, and its gain (row -1: none).

    Blocks of rows meet only events that their price range or last time can touch.
    """
    row, gain = np.full(len(start), -1), np.full(len(start), np.nan)
    for a in range(0, len(price), size):
        p, t = price[a : a + size], ts[a : a + size]
        live = np.flatnonzero((row < 0) & (start < a + len(p) - 1))
        near = live[(p.max() / level[live] - 1 > up[live]) | (p.min() / level[live] - 1 < down[live]) | (t[-1] >= end[live])]
        if len(near):
            move = p[None, :] / level[near, None] - 1
            hit = ((move > up[near, None]) | (move < down[near, None]) | (t[None, :] >= end[near, None])) & (a + np.arange(len(p)) > start[near, None])
            found = hit.any(axis=1)
            at = hit.argmax(axis=1)[found]
            row[near[found]], gain[near[found]] = a + at, move[found, at]
    return row, gain


class _Barriers(_Ordered):
    """Open events in a map state, one entry per event, and their nearest levels in a value state, so that released rows which reach none
    of them read no event."""

    def __init__(self, pt: float, sl: float, out: T.StructType, order: list[str]):
        super().__init__(out, order)
        self.pt, self.sl = pt, sl

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getMapState("open", "t0 long, seq long", "price double, trgt double, expires long")
        self.nearest = handle.getValueState("nearest", "above double, below double, expires long")

    def release(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame | None:
        us = lambda x: x.astype("datetime64[us]").astype("int64").to_numpy()
        price, ts = rows["price"].to_numpy(float), us(rows["ts"])
        mine = rows["trgt"].notna().to_numpy() & (rows["shard"].to_numpy() == key[1])
        above, below, soonest = self.nearest.get() if self.nearest.exists() else (np.inf, -np.inf, np.iinfo(np.int64).max)
        held = []
        if price.max() > above or price.min() < below or ts[-1] >= soonest:
            held = [(*k, *v) for k, v in self.open.iterator()]
        at = np.flatnonzero(mine)
        new = list(zip(ts[at].tolist(), rows["seq"].to_numpy()[at].tolist(), price[at].tolist(), rows["trgt"].to_numpy(float)[at].tolist(), us(rows["expires"].iloc[at]).tolist(), strict=True))
        events = [*held, *new]
        if not events:
            return None
        t0, level, trgt, end = (np.array([e[i] for e in events]) for i in (0, 2, 3, 4))
        up = np.where(self.pt > 0, self.pt * trgt, np.inf)
        down = np.where(self.sl > 0, -self.sl * trgt, -np.inf)
        row, gain = _first_touches(price, ts, np.concatenate((np.full(len(held), -1), at)).astype(int), level, up, down, end)
        for i, e in enumerate(events):
            if row[i] >= 0 and i < len(held):
                self.open.removeKey(e[:2])
            elif row[i] < 0 and i >= len(held):
                self.open.updateValue(e[:2], e[2:])
        left = row < 0
        # a step of one part in 10^9 keeps the levels on the near side of what the exact test finds
        edge = (level * (1 + up))[left].min(initial=np.inf) * (1 - 1e-9), (level * (1 + down))[left].max(initial=-np.inf) * (1 + 1e-9), int(end[left].min(initial=np.iinfo(np.int64).max))
        known = (above, below, soonest) if not held else (np.inf, -np.inf, np.iinfo(np.int64).max)
        self.nearest.update((float(min(edge[0], known[0])), float(max(edge[1], known[1])), min(edge[2], known[2])))
        done = np.flatnonzero(~left)
        why = np.where(gain[done] > up[done], "pt", np.where(gain[done] < down[done], "sl", "time"))
        return pd.DataFrame({"t0": t0[done].astype("datetime64[us]"), "t1": ts[row[done]].astype("datetime64[us]"), "ret": gain[done], "touched": why})


def barrier_monitor(stream: DataFrame, *, pt: float, sl: float, shards: int = 1) -> DataFrame:
    """Labels events as soon as a barrier is touched or their time is up.

    ``stream`` carries bars (instrument, ts, seq, price); rows opening an event also carry its ``trgt``
    and ``expires``.  The first row at or after ``expires`` is the vertical barrier. The open events of an instrument are dealt to
    ``shards`` states, each of which gets all its bars.
    """
    out = T.StructType.fromDDL("instrument string, t0 timestamp, t1 timestamp, ret double, touched string")
    dealt = stream.withColumn("shard", F.pmod(F.xxhash64("seq"), F.lit(shards)).cast("long")).withColumn("dealt", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")))
    return _stateful(dealt, _Barriers(pt, sl, out, ["ts", "seq"]), out, "dealt")


# --------------------------------------------------------------------------- incremental job
PROGRESS = "batch long, rows_in long, watermark string, operator string, state_rows long, state_bytes long"


def run_available(stream: DataFrame, sink: str, checkpoint: str) -> DataFrame:
    """Process all landed files once into Parquet; a rerun continues from the checkpoint.

    Each micro-batch replaces its own folder, so a repeated batch does not duplicate rows. Returns one row per micro-batch and
    stateful operator (``PROGRESS``): rows read, watermark, and the rows and bytes its state holds.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    told = [
        (p["batchId"], p["numInputRows"], p.get("eventTime", {}).get("watermark"), o["operatorName"], o["numRowsTotal"], o["memoryUsedBytes"])
        for p in query.recentProgress for o in p["stateOperators"]
    ]
    return stream.sparkSession.createDataFrame(told, PROGRESS)

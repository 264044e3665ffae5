"""Quality by compression: how much better a dictionary of good text fits than one of bad text, as a calibrated probability.

Two dictionaries hold windows of labelled documents of each class. A text is compressed in consecutive blocks of ``BLOCK`` bytes, each
against both, and the sizes of its blocks are added. Three features go through a logistic curve: the difference of the two sizes
per byte, the smaller size per byte, and the difference per byte times the root of the bytes up to one block (the weight of the
evidence, which stops growing where the text has a full block). None of them changes with length beyond one block, so a text of any
length is scored by its mean block. Other labelled documents of the sample (their whole texts) calibrate the curve.

Learned from: ``SAMPLE`` labelled doc_ids in order of the id's hash, one row each, half for the dictionaries and half for the curve; a
dictionary holds ``zdict.DICT_BYTES`` of windows of ``zdict.WINDOW_CHARS`` code points, those of the smallest hashes (so of no
particular ids). Scores cover all rows and whole texts.

Nulls: a null text counts as empty; empty texts get the curve's value for no evidence. Null quality or doc_id teaches nothing. Without
both classes every score is the share of good rows (0.5 if none). Repeated rows each get their row; of rows that repeat a labelled
doc_id one (by the text's hash) teaches. Equal features give equal scores. Extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import bucket_of, small_batches
from tapeloom.llm.zdict import compressors, raw_dictionary, text_window

SAMPLE = 8_000
THRESHOLD = 0.3
#: Bytes of one block; a dictionary reaches over several blocks, so it helps the last byte of a text as much as the first.
BLOCK = 16 << 10


def _features(text: bytes, tools: dict) -> tuple[float, float, float]:
    n, raw = len(text) + 1, memoryview(text)
    blocks = [raw[k : k + BLOCK] for k in range(0, len(raw), BLOCK)] or [raw]
    good, bad = (sum(len(tools[k].compress(x)) for x in blocks) for k in (1, 0))
    return (bad - good) / n, (bad - good) / n * min(n, BLOCK) ** 0.5, min(good, bad) / n


def _curve(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps with a small ridge: weights, means and deviations."""
    mean, dev = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack(((x - mean) / dev, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * len(x) / 1000 * np.eye(len(w)) + 1e-9 * np.eye(len(w))
        w -= np.linalg.solve(hess, z.T @ (p - y) + 1e-2 * len(x) / 1000 * w)
    return w, mean, dev


def learn(docs: DataFrame, labels: DataFrame, fold: int = 0, folds: int = 5, sample: int = SAMPLE) -> dict:
    """Dictionaries and curve from labelled rows outside the held-out fold."""
    marked = labels.where(F.col("quality").isin(0, 1) & (bucket_of(F.col("doc_id"), folds) != fold)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumn("tune", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)) == 1)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # ``sample`` ids at most
    rows = rows.groupBy("doc_id", "quality", "tune").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("x")).select("doc_id", "quality", "tune", "x.text")
    parts: dict[int, list[bytes]] = {0: [], 1: []}
    for r in rows.where("not tune").select("quality", "doc_id", text_window(F.col("text"), F.col("doc_id")).alias("w")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        parts[r["quality"]].append(r["w"].encode())
    model = {"dicts": {k: raw_dictionary(p) for k, p in parts.items()}, "curve": None}
    total = sum(map(len, parts.values()))
    model["prior"] = len(parts[1]) / total if total else 0.5
    if not all(parts.values()):
        return model
    dicts = model["dicts"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = compressors(dicts)
        for b in small_batches(batches):
            f = [_features(t.encode(), tools) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"y": [float(q) for q in b.column(0).to_pylist()], **{f"f{i}": [v[i] for v in f] for i in range(3)}})

    tune = np.array(rows.where("tune").select("quality", "text").mapInArrow(measure, "y double, f0 double, f1 double, f2 double").collect(), float)
    if len(tune) and 0 < tune[:, 0].mean() < 1:
        model["curve"] = _curve(tune[:, 1:], tune[:, 0])
    return model


def with_quality(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score and predicted; a projection over the rows, texts are read whole."""
    schema = T.StructType([*(f for f in docs.schema.fields if f.name not in ("score", "predicted")), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = compressors(model["dicts"])
        for b in small_batches(batches):
            if model["curve"] is None:
                scores = np.full(b.num_rows, float(model["prior"]))
            else:
                w, mean, dev = model["curve"]
                x = np.array([_features((t or "").encode(), tools) for t in b.column("text").to_pylist()], float).reshape(-1, 3)
                scores = 1 / (1 + np.exp(-np.clip(((x - mean) / dev) @ w[:-1] + w[-1], -30, 30)))
            keep = [f.name for f in schema.fields[:-2]]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], schema=pa.schema([*(b.schema.field(c) for c in keep), ("score", pa.float64()), ("predicted", pa.int32())]))

    return docs.drop("score", "predicted").mapInArrow(predict, schema)

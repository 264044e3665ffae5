"""Best-two-fit packing of token sequences.

A bin is filled greedily (longest piece that fits, again and again); then its smallest piece is replaced by the two unpacked
pieces whose lengths together fill the gap plus that piece most tightly, as long as that fills more. Only documents
longer than a sequence are cut: into whole sequences, after a first piece that may be shorter. Pieces are dealt at random to
groups of about ``GROUP_PIECES``; the bins that a group leaves open cost less than one part in a thousand, and a group's state
is a count per length, so no task sees the whole table.

Nulls: a null text holds the end id alone, a null doc_id is a document like others. Repeated rows are documents
of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.bpe import encoder
from tapeloom.llm.common import small_batches, stored

GROUP_PIECES = 8_000
PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of the ids of each text followed by ``end_id``, with the crc32 of their little-endian 32-bit ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in small_batches(batches):
            doc, row, piece, start, length, crc = out = ([], [], [], [], [], [])
            ids = enc.encode_many([t or "" for t in b.column(2).to_pylist()])
            for d, r, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), ids, strict=True):
                x, at, i = x + end, 0, 0
                total = len(x) // 4
                while at < total:
                    n = (total % capacity or capacity) if i == 0 else capacity
                    doc.append(d)
                    row.append(r)
                    piece.append(i)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(x[4 * at : 4 * (at + n)]))
                    at, i = at + n, i + 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(cut, PIECES)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length (1 to ``capacity``), ties in the given order."""
    left = np.bincount(lengths, minlength=capacity + 1)
    order = np.argsort(lengths, kind="stable")
    first = np.concatenate(([0], np.cumsum(left)))[:-1]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fit = np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0)).tolist()  # the longest left that is at most x
    count, taken = left.tolist(), first.tolist()

    def take(n: int, by: int) -> None:
        count[n] -= by
        if by > 0 and count[n] == 0:
            below, x = fit[n - 1], n
            while x <= capacity and fit[x] == n:
                fit[x] = below
                x += 1
        elif by < 0 and count[n] == 1:
            x = n
            while x <= capacity and fit[x] < n:
                fit[x] = n
                x += 1

    number = 0
    while fit[capacity]:
        inside, gap = [], capacity
        while gap and (n := fit[gap]):
            take(n, 1)
            inside.append(n)
            gap -= n
        while gap and inside:
            small = inside.pop()  # greedy filling goes from long to short
            room, best = gap + small, (small, 0)
            a = fit[room]
            while a and 2 * a >= room - a and a + fit[min(a, room - a)] > 0:
                b = fit[min(a, room - a)]
                if b == a and count[a] < 2:
                    b = fit[a - 1]
                if b and a + b > sum(best):
                    best = (a, b)
                    if a + b == room:
                        break
                if 2 * a <= sum(best):
                    break
                a = fit[a - 1]
            if not best[1]:
                inside.append(small)
                break
            take(small, -1)
            for n in best:
                take(n, 1)
                inside.append(n)
            inside.sort(reverse=True)
            gap = room - sum(best)
        at = 0
        for n in inside:
            i = order[taken[n]]
            taken[n] += 1
            bins[i], offsets[i] = number, at
            at += n
        number += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Sequence number and offset of each piece; ``pieces`` is written once, as its rows are counted first."""
    pieces = stored(pieces, "pieces")
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    slot = F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(groups))

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "row", "piece"], na_position="first", kind="stable", ignore_index=True)
        bins, offsets = best_two_fit(frame["length"].to_numpy(), capacity)
        frame["sequence_id"] = frame["slot"] * (1 << 32) + bins
        frame["offset"] = offsets
        return frame[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    return pieces.withColumn("slot", slot).groupBy("slot").applyInPandas(place, PLACED)


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    return pack(token_pieces(docs, tokenizer, end_id, capacity), capacity)

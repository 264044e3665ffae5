"""Exact top-k inner products by tiled matrix products.

Vectors are packed as rows of small integers where they fit. Queries and candidates are dealt to a grid of cells, up to ``SIDE`` blocks
on each side, through an equi-join on the cell (never a cross join): each side is copied to the cells of its row or column only. A task
multiplies blocks of queries with blocks of candidates, keeps k per query and tile, merges them as it goes, and the lists of the
cells are merged by a tree of fan-in ``FAN_IN``, so no task holds more than a bounded number of lists.

Components become floor(256 * x). Products are exact: float64 where no sum can pass 2**53, else Python integers, reduced to 64 bits
by wrapping. Vectors that are null or hold null or non-finite components, or lack an id, take no part; vectors of
another length than a query's are no candidates of it. Of rows that repeat an id the smallest vector of whole numbers stays; a task hands
on equal rows once. Ties go to the smaller id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
FAN_IN = 16
#: Blocks on one side of a cell at most, and cells among which a small table is dealt.
SIDE, CELLS = 32, 32
TOP = "query_id long, rank int, vec_id long, score long"
LISTS = "q_block long, c_group long, query_id long, vec_id long, score long"
_KINDS = {2: "<i2", 4: "<i4", 8: "<f8"}


def packed(vectors: DataFrame, is_query: Column) -> DataFrame:
    """(vec_id, is_query, dim, kind, data) of the vectors that take part: whole numbers of 2 or 4 bytes, or doubles where
    they are larger; 256 times a component must be finite too."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * 256 < F.lit(float("inf")))), F.lit(False))
    rows = vectors.where("vec_id is not null").where(fine).select("vec_id", F.coalesce(is_query, F.lit(False)).alias("is_query"), x.alias("x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set = set()  # bounded; what is forgotten is only handed on again
        for b in batches:
            edges = b.column(2).offsets.to_numpy()
            flat = np.floor(256 * b.column(2).values.to_numpy())
            keep, dims, kinds, data = [], [], [], []
            for i, (v, start, end) in enumerate(zip(b.column(0).to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                row = flat[start:end]
                most = np.abs(row).max(initial=0)
                kind = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
                raw = row.astype(_KINDS[kind]).tobytes()
                if (v, raw) in done:
                    continue
                if len(done) >= 1 << 14:
                    done.clear()
                done.add((v, raw))
                keep.append(i)
                dims.append(end - start)
                kinds.append(kind)
                data.append(raw)
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()).take(at), b.column(1).take(at), pa.array(dims, pa.int32()), pa.array(kinds, pa.int32()), pa.array(data, pa.binary())], ["vec_id", "is_query", "dim", "kind", "data"])

    return rows.mapInArrow(pack, "vec_id long, is_query boolean, dim int, kind int, data binary")


def _one_per_id(rows: pd.DataFrame) -> pd.DataFrame:
    """Sorted by id, the smallest vector of each."""
    rows = rows.sort_values("vec_id", kind="stable")
    again = rows["vec_id"].duplicated(keep=False).to_numpy()
    if again.any():
        twice = rows[again]
        order = sorted(range(len(twice)), key=lambda i: (twice["vec_id"].iat[i], np.frombuffer(twice["data"].iat[i], _KINDS[twice["kind"].iat[i]]).tolist()))
        rows = pd.concat((rows[~again], twice.iloc[order].drop_duplicates("vec_id"))).sort_values("vec_id", kind="stable")
    return rows


def _tiles(rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of one length: ids, matrix of doubles, and the largest component."""
    for _, same in rows.groupby("dim"):
        for i in range(0, len(same), BLOCK):
            part = same.iloc[i : i + BLOCK]
            out = np.empty((len(part), part["dim"].iat[0]))
            for kind, rows_of in part.assign(at=range(len(part))).groupby("kind"):
                out[rows_of["at"].to_numpy()] = np.frombuffer(b"".join(rows_of["data"]), _KINDS[kind]).reshape(len(rows_of), -1) if out.shape[1] else 0
            yield part["vec_id"].to_numpy(np.int64), out, float(np.abs(out).max(initial=0))


def _wrapped(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Products of whole numbers of any size, modulo 2**64."""
    whole = [np.frompyfunc(int, 1, 1)(x) for x in (q, c.T)]
    return (whole[0].dot(whole[1]) & 0xFFFFFFFFFFFFFFFF).astype(np.uint64).view(np.int64)


def tile_top(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, exact: bool) -> list[tuple[np.ndarray, ...]]:
    """For each query of the tile: ids and scores of its best k candidates; candidates are in order of id."""
    s = (q @ c.T).astype(np.int64) if exact else _wrapped(q, c)
    own = q_ids[:, None] == c_ids[None, :]
    out = []
    room = s.shape[1] - own.sum(1)
    low = np.where(own, np.iinfo(np.int64).min, s)
    cut = np.partition(low, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(q), np.iinfo(np.int64).min)
    for i in range(len(q)):
        at = np.flatnonzero((low[i] >= cut[i]) & ~own[i])
        at = at[np.argsort(~s[i][at], kind="stable")][: min(k, room[i])]
        out.append((c_ids[at], s[i][at]))
    return out


def merged(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id."""
    order = np.lexsort((ids, ~scores))  # ~x falls as x rises, without overflow
    return order[:k]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The k best other rows of each query row: query_id, rank, vec_id, score; ``is_query`` refers to vec_id."""
    n, m = vectors.agg(F.count("vec_id"), F.count_if(F.coalesce(is_query, F.lit(False)))).first()  # sizes of the grid only
    c_blocks, q_blocks = max(1, -(-n // BLOCK)), max(1, -(-m // BLOCK))
    q_groups = -(-q_blocks // SIDE)
    c_groups = max(-(-c_blocks // SIDE), min(c_blocks, -(-CELLS // q_groups)))
    rows = packed(vectors, is_query)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    cand = rows.drop("is_query").withColumn("c_group", F.pmod(F.xxhash64("vec_id"), F.lit(c_groups))).withColumn("q_group", every(q_groups))
    quer = packed(vectors.where(F.coalesce(is_query, F.lit(False))), is_query).drop("is_query").withColumn("q_block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(q_blocks)))
    quer = quer.withColumn("q_group", F.col("q_block") % q_groups).withColumn("c_group", every(c_groups))

    def cell(key: tuple, qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or cs.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("q_block", "c_group", "query_id", "vec_id", "score")})
        qs, best = _one_per_id(qs), {}
        block = dict(zip(qs["vec_id"].tolist(), qs["q_block"].tolist(), strict=True))
        queries = list(_tiles(qs))
        for c_ids, cv, c_most in _tiles(_one_per_id(cs)):
            for q_ids, qv, q_most in queries:
                if qv.shape[1] != cv.shape[1]:
                    continue
                exact = q_most * c_most * max(1, qv.shape[1]) < 2.0**53
                for i, (ids, scores) in zip(q_ids.tolist(), tile_top(qv, q_ids, cv, c_ids, k, exact), strict=True):
                    if i in best:
                        ids, scores = np.concatenate((best[i][0], ids)), np.concatenate((best[i][1], scores))
                    keep = merged(ids, scores, k)
                    best[i] = (ids[keep], scores[keep])
        made = [(block[i], key[1], i, v, s) for i, (ids, scores) in best.items() for v, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        return pd.DataFrame(made, columns=["q_block", "c_group", "query_id", "vec_id", "score"])

    lists = quer.groupBy("q_group", "c_group").cogroup(cand.groupBy("q_group", "c_group")).applyInPandas(cell, LISTS)

    def tree(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return frame.groupby("query_id", sort=False).head(k)

    while c_groups > 1:
        lists = lists.withColumn("c_group", F.floor(F.col("c_group") / FAN_IN)).groupBy("q_block", "c_group").applyInPandas(tree, LISTS)
        c_groups = -(-c_groups // FAN_IN)

    def ranked(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        frame["rank"] = frame.groupby("query_id").cumcount() + 1
        return frame[["query_id", "rank", "vec_id", "score"]]

    return lists.groupBy("q_block").applyInPandas(ranked, TOP)

"""Allocation over many (universe, window) groups: Spark computes the moments, each group solves one
small matrix."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.plans.series import div, reuse


# --------------------------------------------------------------------------- moments
#: Assets on one side of a tile of the matrix; bytes of moments that a task holds before it hands them on; parts in which the
#: moments of one tile are merged first.
TILE, HELD_BYTES, PARTS = 128, 128 << 20, 64


class _Moments:
    """Pairwise-complete centred moments of two tiles of assets: counts, means of either side over common rows, co-moments."""

    __slots__ = ("n", "x", "y", "c")

    def __init__(self, n: np.ndarray, x: np.ndarray, y: np.ndarray, c: np.ndarray):
        self.n, self.x, self.y, self.c = n, x, y, c

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray) -> _Moments:
        """Of the columns of two blocks of the same rows, NaN where a value is missing."""
        has_a, has_b = ~np.isnan(a), ~np.isnan(b)
        # columns are shifted by their means in the block, so products stay small
        shift_a, shift_b = (np.where(h.any(0), np.where(h, v, 0).sum(0) / np.maximum(1, h.sum(0)), 0) for v, h in ((a, has_a), (b, has_b)))
        u, v = np.where(has_a, a - shift_a, 0), np.where(has_b, b - shift_b, 0)
        p, q = has_a.astype(float), has_b.astype(float)
        n = p.T @ q
        some = np.maximum(1, n)
        x, y = u.T @ q / some, p.T @ v / some
        return cls(n, x + shift_a[:, None], y + shift_b[None, :], u.T @ v - n * x * y)

    def add(self, o: _Moments) -> _Moments:
        """Pairwise update with the moments of other rows."""
        n = self.n + o.n
        some = np.maximum(1, n)
        dx, dy = o.x - self.x, o.y - self.y
        c = self.c + o.c + dx * dy * self.n * o.n / some
        return _Moments(n, self.x + dx * o.n / some, self.y + dy * o.n / some, c)

    def tobytes(self) -> bytes:
        return np.stack((self.n, self.x, self.y, self.c)).tobytes()

    @classmethod
    def frombytes(cls, raw: bytes, shape: tuple[int, int]) -> _Moments:
        return cls(*np.frombuffer(raw, float).reshape(4, *shape))


def covariance(wide: DataFrame, assets: Sequence[str], *, by: Sequence[str]) -> DataFrame:
    """Long sample covariance and correlation (by..., a, b, cov, corr) of columns, over the rows that have both values.

    Tiled Gram matrices: a task turns its rows into centred moments per tile pair of ``TILE`` x ``TILE`` assets and merges them as it
    reads, so rows are never shuffled; moments of one tile pair are merged by pairwise updates, in ``PARTS`` parts and then
    together. The plan does not grow with the number of assets.
    """
    assets, by = sorted(assets), list(by)
    count = len(assets)
    tiles = [(t, min(count, t + TILE)) for t in range(0, count, TILE)]
    pairs = [(i, j) for i in range(len(tiles)) for j in range(i, len(tiles))]
    keys = [wide.schema[k] for k in by]
    made = T.StructType([*keys, T.StructField("_i", T.IntegerType()), T.StructField("_j", T.IntegerType()), T.StructField("_m", T.BinaryType())])
    names = made.fieldNames()

    def gather(frames):
        held: dict[tuple, list[_Moments]] = {}
        room = max(1, HELD_BYTES // (32 * count * count + 1))

        def told():
            rows = [(*k, i, j, m.tobytes()) for k, ms in held.items() for (i, j), m in zip(pairs, ms, strict=True)]
            held.clear()
            return pd.DataFrame(rows, columns=names)

        for frame in frames:
            groups = frame.groupby(by, dropna=False, sort=False) if by else [((), frame)]
            for key, rows in groups:
                x = rows[assets].to_numpy(float)
                blocks = [x[:, a:z] for a, z in tiles]
                new = [_Moments.of(blocks[i], blocks[j]) for i, j in pairs]
                key = tuple(None if v is pd.NaT or v != v else v for v in key)
                held[key] = [m.add(n) for m, n in zip(held[key], new, strict=True)] if key in held else new
                if len(held) >= room:
                    yield told()
        if held:
            yield told()

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        (a, z), (c, e) = tiles[rows["_i"].iat[0]], tiles[rows["_j"].iat[0]]
        total = None
        for raw in rows["_m"]:
            m = _Moments.frombytes(raw, (z - a, e - c))
            total = m if total is None else total.add(m)
        return rows.iloc[:1][[*by, "_i", "_j"]].assign(_m=[total.tobytes()])[names]

    def cells(frames):
        for rows in frames:
            for r in rows.to_dict("records"):
                (a, z), (c, e) = tiles[r["_i"]], tiles[r["_j"]]
                m = _Moments.frombytes(r["_m"], (z - a, e - c))
                cov = np.where(m.n > 1, m.c / np.maximum(1, m.n - 1), np.nan)
                for flip in (False, True) if r["_i"] != r["_j"] else (False,):
                    left, right, v = (assets[c:e], assets[a:z], cov.T) if flip else (assets[a:z], assets[c:e], cov)
                    out = pd.DataFrame({"a": np.repeat(left, len(right)), "b": np.tile(right, len(left)), "cov": v.ravel()})
                    yield out.assign(**{k: [r[k]] * len(out) for k in by})[[*by, "a", "b", "cov"]]

    rows = wide.select(*by, *(F.col(c).cast("double").alias(c) for c in assets))
    parts = rows.mapInPandas(gather, made).withColumn("_p", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    merged = parts.groupBy(*by, "_i", "_j", "_p").applyInPandas(merge, made).groupBy(*by, "_i", "_j").applyInPandas(merge, made)
    long = T.StructType([*keys, T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("cov", T.DoubleType())])
    cov = reuse(merged.mapInPandas(cells, long)).withColumn("cov", F.nanvl("cov", F.lit(None)))
    var = cov.where("a = b").select(*by, "a", F.sqrt("cov").alias("_d"))
    for side in ("a", "b"):
        other = var.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(by)), F.col("a").alias("_asset"), F.col("_d").alias(f"_d{side}"))
        same = F.col(side) == F.col("_asset")
        for i, k in enumerate(by):
            same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
        cov = cov.join(other, same).drop("_asset", *(f"_k{i}" for i in range(len(by))))
    rho = F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(div(F.col("cov"), F.col("_da") * F.col("_db")))
    return cov.select(*by, "a", "b", "cov", rho.alias("corr"))


def inverse_variance(cov: DataFrame, *, by: Sequence[str]) -> DataFrame:
    diag = cov.where(F.col("a") == F.col("b")).select(*by, F.col("a").alias("asset"), div(F.lit(1.0), F.col("cov")).alias("_i"))
    total = diag.groupBy(*by).agg(F.sum("_i").alias("_t"))
    return diag.join(total, list(by)).select(*by, "asset", (F.col("_i") / F.col("_t")).alias("w"))


def correlation_distance(cov: DataFrame) -> DataFrame:
    return cov.withColumn("dist", F.sqrt(F.greatest((1 - F.col("corr")) / 2, F.lit(0.0))))


def distance_of_distances(dist: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """Euclidean distance between the columns of each group's distance matrix.

    A row of the matrix is one vector; blocks of vectors meet on a grid of cells, each pair of blocks once.
    """
    by = list(by)
    row = dist.groupBy(*by, "a").agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "dist"))), lambda x: x["dist"]).alias("v"))
    row = row.withColumn("_n", F.ceil(F.size("v") / F.lit(TILE))).withColumn("_t", F.pmod(F.xxhash64("a"), F.col("_n")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_o")
    cells = row.select(*by, "a", "v", "_t", other).select(*by, "a", "v", "_t", F.least("_t", "_o").alias("_lo"), F.greatest("_t", "_o").alias("_hi"))
    schema = T.StructType([*(dist.schema[k] for k in by), T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("dist2", T.DoubleType())])

    def cell(rows: pd.DataFrame) -> pd.DataFrame:
        low = rows["_t"].to_numpy() == rows["_lo"].iat[0]
        v, names = np.array(rows["v"].tolist(), float), rows["a"].to_numpy()
        sides = [(low, low)] if rows["_lo"].iat[0] == rows["_hi"].iat[0] else [(low, ~low)]
        out = []
        for p, q in sides:
            gap = np.array([np.sqrt(((v[q] - x) ** 2).sum(axis=1)) for x in v[p]])
            left, right = np.repeat(names[p], q.sum()), np.tile(names[q], p.sum())
            out.append(pd.DataFrame({"a": left, "b": right, "dist2": gap.ravel()}))
            if p is not q:
                out.append(pd.DataFrame({"a": right, "b": left, "dist2": gap.ravel()}))
        whole = pd.concat(out)
        return whole.assign(**{k: [rows[k].iat[0]] * len(whole) for k in by})[[*by, "a", "b", "dist2"]]

    return cells.groupBy(*by, "_lo", "_hi").applyInPandas(cell, schema)


def cluster_variance(cov: DataFrame, clusters: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """Variance of each cluster under inverse-variance weights; ``clusters`` is (by..., asset, cluster)."""
    keys = [*by, "cluster"]
    inner = (
        cov.join(clusters.select(*by, F.col("asset").alias("a"), F.col("cluster")), [*by, "a"])
        .join(clusters.select(*by, F.col("asset").alias("b"), F.col("cluster").alias("_cb")), [*by, "b"])
        .where(F.col("cluster") == F.col("_cb"))
    )
    w = inverse_variance(inner, by=keys)
    return (
        inner.join(w.select(*keys, F.col("asset").alias("a"), F.col("w").alias("_wa")), [*keys, "a"])
        .join(w.select(*keys, F.col("asset").alias("b"), F.col("w").alias("_wb")), [*keys, "b"])
        .groupBy(*keys)
        .agg(F.sum(F.col("_wa") * F.col("cov") * F.col("_wb")).alias("cluster_var"))
    )


# --------------------------------------------------------------------------- per-group matrix steps
def _square(pdf: pd.DataFrame, value: str) -> tuple[list, np.ndarray]:
    m = pdf.pivot(index="a", columns="b", values=value).sort_index(axis=0).sort_index(axis=1)
    return list(m.index), m.to_numpy(dtype=float)


def _per_group(cov: DataFrame, by: Sequence[str], fields: list[tuple[str, T.DataType]], solve) -> DataFrame:
    schema = T.StructType([cov.schema[b] for b in by] + [T.StructField(n, t) for n, t in fields])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = solve(pdf)
        for b in by:
            out[b] = pdf[b].iloc[0]
        return out[schema.fieldNames()]

    return cov.groupBy(*by).applyInPandas(run, schema)


def _leaf_order(dist: np.ndarray) -> list[int]:
    """Leaf order of the single-linkage tree, older and smaller cluster ids first."""
    n = len(dist)
    nodes = {i: [i] for i in range(n)}
    gap = dist.astype(float).copy()
    np.fill_diagonal(gap, np.inf)
    ids = list(range(n))
    nxt = n
    while len(ids) > 1:
        i, j = np.unravel_index(np.argmin(gap), gap.shape)
        i, j = min(i, j), max(i, j)
        left, right = sorted((ids[i], ids[j]))
        nodes[nxt] = nodes[left] + nodes[right]
        merged = np.minimum(gap[i], gap[j])
        gap[i], gap[:, i] = merged, merged
        gap[i, i] = np.inf
        gap = np.delete(np.delete(gap, j, 0), j, 1)
        ids[i] = nxt
        del ids[j]
        nxt += 1
    return nodes[ids[0]]


def _ivp_variance(v: np.ndarray) -> float:
    w = 1.0 / np.diag(v)
    w /= w.sum()
    return float(w @ v @ w)


def _bisect(v: np.ndarray, order: list[int], w: np.ndarray) -> None:
    if len(order) < 2:
        return
    left, right = order[: len(order) // 2], order[len(order) // 2 :]
    a, b = _ivp_variance(v[np.ix_(left, left)]), _ivp_variance(v[np.ix_(right, right)])
    share = 1 - a / (a + b)
    w[left] *= share
    w[right] *= 1 - share
    _bisect(v, left, w)
    _bisect(v, right, w)


def hierarchical_risk_parity(cov: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """Tree-ordered recursive bisection weights for every group of the long covariance table."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names, v = _square(pdf, "cov")
        rho = _square(pdf, "corr")[1]
        d = np.sqrt(np.maximum((1 - rho) / 2, 0))
        d2 = np.sqrt(((d[:, None, :] - d[None, :, :]) ** 2).sum(axis=2))
        w = np.ones(len(names))
        order = _leaf_order(d2)
        _bisect(v, order, w)
        rank = {a: i for i, a in enumerate(order)}
        return pd.DataFrame({"asset": names, "w": w, "leaf": [rank[i] for i in range(len(names))]})

    return _per_group(cov, by, [("asset", T.StringType()), ("w", T.DoubleType()), ("leaf", T.IntegerType())], solve)


def pca_weights(cov: DataFrame, *, by: Sequence[str], target: float = 1.0, risk: Sequence[float] | None = None) -> DataFrame:
    """Weights carrying the given risk share per principal component (default: all on the smallest)."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names, v = _square(pdf, "cov")
        val, vec = np.linalg.eigh(v)
        val, vec = val[::-1], vec[:, ::-1]
        share = np.zeros(len(val)) if risk is None else np.asarray(risk, dtype=float)
        if risk is None:
            share[-1] = 1.0
        return pd.DataFrame({"asset": names, "w": vec @ (target * np.sqrt(share / val))})

    return _per_group(cov, by, [("asset", T.StringType()), ("w", T.DoubleType())], solve)


def risk_concentration(cov: DataFrame, weights: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """Risk share of every principal component and the portfolio concentration of the group."""
    own = weights.select(*by, F.col("asset").alias("a"), F.col("w").alias("_w"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names, v = _square(pdf, "cov")
        w = pdf.drop_duplicates("a").set_index("a")["_w"].reindex(names).to_numpy(dtype=float)
        if not np.isclose(w.sum(), 1.0, atol=1e-6):
            raise ValueError("weights must sum to one")
        val, vec = np.linalg.eigh(v)
        theta = (vec.T @ w) ** 2 * val
        theta /= theta.sum()
        live = theta[theta > 0]
        h = 1 - math.exp(-float((live * np.log(live)).sum())) / len(theta)
        return pd.DataFrame({"component": range(len(theta)), "theta": theta, "concentration": h})

    fields = [("component", T.IntegerType()), ("theta", T.DoubleType()), ("concentration", T.DoubleType())]
    return _per_group(cov.join(own, [*by, "a"]), by, fields, solve)


def concentration_from_shares(theta: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """1 - exp(entropy of the risk shares) / N."""
    t = F.col("theta")
    entropy = -F.sum(F.when(t > 0, t * F.log(F.when(t > 0, t))).otherwise(0.0))
    return theta.groupBy(*by).agg((1 - F.exp(entropy) / F.count(F.lit(1))).alias("concentration"))


# --------------------------------------------------------------------------- rolling comparison
def allocation_comparison(wide: DataFrame, assets: Sequence[str], *, lookback: int, step: int) -> DataFrame:
    """Out-of-sample compounded return and variance of inverse-variance and tree allocations.

    ``wide`` is (universe, pos, asset columns).  Rebalance ``k`` estimates on the ``lookback`` rows before
    position ``lookback + k * step`` and holds for ``step`` rows.
    """
    last = F.floor((F.col("_n") - lookback) / step) - 1
    n = wide.groupBy("universe").agg(F.count(F.lit(1)).alias("_n"))
    sized = wide.join(n, "universe").where(last >= 0)
    lo = F.greatest(F.ceil((F.col("pos") - lookback + 1) / step), F.lit(0)).cast("long")
    hi = F.least(F.floor(F.col("pos") / step), last).cast("long")
    est = sized.where(lo <= hi).withColumn("rebalance", F.explode(F.sequence(lo, hi)))
    cov = covariance(est, assets, by=["universe", "rebalance"])
    w = inverse_variance(cov, by=["universe", "rebalance"]).withColumn("method", F.lit("ivp")).unionByName(
        hierarchical_risk_parity(cov, by=["universe", "rebalance"]).drop("leaf").withColumn("method", F.lit("hrp"))
    )
    weights = w.groupBy("universe", "rebalance", "method").agg(F.map_from_entries(F.collect_list(F.struct("asset", "w"))).alias("_w"))
    k = F.floor((F.col("pos") - lookback) / step).cast("long")
    held = sized.where((F.col("pos") >= lookback) & (k <= last)).withColumn("rebalance", k).join(weights, ["universe", "rebalance"])
    ret = F.lit(0.0)
    for a in assets:
        ret = ret + F.col(a) * F.col("_w")[a]
    return held.withColumn("_r", ret).groupBy("universe", "method").agg(
        F.count(F.lit(1)).alias("n_oos"),
        (F.exp(F.sum(F.log1p("_r"))) - 1).alias("total_return"),
        F.var_samp("_r").alias("variance"),
    )


# --------------------------------------------------------------------------- trajectories
def horizon_parameters(wide: DataFrame, assets: Sequence[str], *, horizon: int, lookback: int, cost_scale: float = 0.02) -> DataFrame:
    """Mean, cost and date range per (universe, horizon, asset) over the last rows, in equal windows."""
    n = wide.groupBy("universe").agg((F.max("pos") + 1).alias("_n"))
    need = horizon * lookback
    tail = wide.join(n, "universe").withColumn(
        "_o", F.when(F.col("_n") >= need, F.col("pos") - F.col("_n") + need).otherwise(F.raise_error(F.lit("series too short")))
    )
    tail = tail.where(F.col("_o") >= 0).withColumn("h", F.floor(F.col("_o") / lookback).cast("int"))
    cells = F.array(*[F.struct(F.lit(a).alias("asset"), F.col(f"_m_{a}").alias("mean"), (F.col(f"_s_{a}") * cost_scale).alias("c")) for a in assets])
    out = tail.groupBy("universe", "h").agg(
        *[F.avg(a).alias(f"_m_{a}") for a in assets], *[F.stddev_samp(a).alias(f"_s_{a}") for a in assets],
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )
    return out.withColumn("_c", F.explode(cells)).select("universe", "h", "first_date", "last_date", "_c.*")


def horizon_covariance(wide: DataFrame, assets: Sequence[str], *, horizon: int, lookback: int) -> DataFrame:
    n = wide.groupBy("universe").agg((F.max("pos") + 1).alias("_n"))
    o = F.col("pos") - F.col("_n") + horizon * lookback
    tail = wide.join(n, "universe").where(o >= 0).withColumn("h", F.floor(o / lookback).cast("int"))
    return covariance(tail, assets, by=["universe", "h"])


def weight_grid(k: int, n: int) -> np.ndarray:
    """All signed splits of ``k`` units over ``n`` assets, in generation order (zero duplicates kept)."""
    rows = []
    for combo in combinations_with_replacement(range(n), k):
        units = np.bincount(combo, minlength=n) / k
        rows.extend(units * np.asarray(s) for s in product((-1, 1), repeat=n))
    return np.asarray(rows)


def count_trajectories(k: int, n: int, horizon: int) -> int:
    return (math.comb(k + n - 1, n - 1) * 2**n) ** horizon


def weight_grid_table(universes: DataFrame, *, k: int, n: int) -> DataFrame:
    """Every universe with its numbered candidate weights, grown asset by asset on the cluster."""
    grid = universes.select("universe").withColumn("units", F.array().cast("array<int>")).withColumn("_left", F.lit(k))
    for _ in range(n - 1):
        grid = grid.withColumn("_u", F.explode(F.sequence(F.lit(0), F.col("_left")))).select(
            "universe", F.concat("units", F.array("_u")).alias("units"), (F.col("_left") - F.col("_u")).alias("_left")
        )
    grid = grid.select("universe", F.concat("units", F.array("_left")).alias("units"))
    signs = F.array(*[F.array(*[F.lit(s) for s in c]) for c in product((-1, 1), repeat=n)])
    return grid.withColumn("_s", F.explode(signs)).select(
        "universe", F.zip_with("units", "_s", lambda u, s: u * s / F.lit(float(k))).alias("w")
    )


def best_trajectory(params: DataFrame, cov: DataFrame, *, k: int | None = None, chunk: int = 20_000) -> DataFrame:
    """Highest-Sharpe weight path over the horizons, each universe scanning its whole candidate space.

    The candidate number encodes the path, so the space is cut into ranges that tasks score and reduce
    to one row each; the first maximum wins.
    """
    per_h = params.groupBy("universe", "h").agg(F.array_sort(F.collect_list(F.struct("asset", "mean", "c"))).alias("p"))
    cov_h = cov.groupBy("universe", "h").agg(F.array_sort(F.collect_list(F.struct("a", "b", "cov"))).alias("v"))
    packed = per_h.join(cov_h, ["universe", "h"]).groupBy("universe").agg(
        F.array_sort(F.collect_list(F.struct("h", F.col("p.mean").alias("mu"), F.col("p.c").alias("c"), F.col("v.cov").alias("v")))).alias("hs")
    )
    sized = packed.withColumns({"_n": F.size(F.col("hs")[0]["mu"]), "_h": F.size("hs")}).withColumn("_k", F.lit(k) if k else F.col("_n"))
    # Whole numbers throughout; a space beyond 64 bits raises instead of vanishing.
    splits = "aggregate(sequence(1, _k), 1L, (a, i) -> (a * (_n - 1 + i)) div i)"
    grid = sized.withColumn("_grid", F.expr(f"aggregate(sequence(1, _n), {splits}, (a, i) -> a * 2L)"))
    jobs = (
        grid.withColumn("_size", F.expr("aggregate(sequence(1, _h), 1L, (a, i) -> a * _grid)"))
        .withColumn("_jobs", F.expr(f"(_size + {chunk - 1}) div {chunk}"))
        .withColumn("_outer", F.explode(F.expr("sequence(0L, (_jobs - 1) div 4096)")))
        .withColumn("_job", F.explode(F.expr("sequence(_outer * 4096, least(_outer * 4096 + 4095, _jobs - 1))")))
        .withColumn("lo", F.col("_job") * chunk)
        .withColumn("hi", F.least(F.col("lo") + chunk, F.col("_size")))
        .select("universe", "lo", "hi", F.col("hs.mu").alias("mu"), F.col("hs.c").alias("c"), F.col("hs.v").alias("v"))
        .repartition("universe", "lo")
    )
    out = T.StructType.fromDDL("universe string, traj long, sr double, w array<array<double>>")

    def score(batches):
        grids: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                mu = np.stack([np.asarray(x, dtype=float) for x in r.mu])
                c = np.stack([np.asarray(x, dtype=float) for x in r.c])
                h, n = mu.shape
                v = np.stack([np.asarray(x, dtype=float).reshape(n, n) for x in r.v])
                if (k or n, n) not in grids:
                    grids[k or n, n] = weight_grid(k or n, n)
                grid = grids[k or n, n]
                ids = np.arange(r.lo, r.hi)
                gain, risk, prev = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros((len(ids), n))
                path = []
                for s in range(h):
                    w = grid[(ids // len(grid) ** (h - 1 - s)) % len(grid)]
                    cost = (c[s] * np.sqrt(np.abs(w - prev))).sum(axis=1)
                    # the published objective charges each horizon's cost once
                    gain += w @ mu[s] - cost
                    risk += np.einsum("ij,jk,ik->i", w, v[s], w)
                    prev = w
                    path.append(w)
                sr = np.where(risk > 0, gain / np.sqrt(np.where(risk > 0, risk, 1.0)), -np.inf)
                b = int(np.argmax(sr))
                rows.append((r.universe, int(ids[b]), float(sr[b]), [p[b].tolist() for p in path]))
            yield pd.DataFrame(rows, columns=["universe", "traj", "sr", "w"])

    best = jobs.mapInPandas(score, out)
    return best.groupBy("universe").agg(F.min_by(F.struct("traj", "sr", "w"), F.struct(-F.col("sr"), "traj")).alias("_b")).select("universe", "_b.*")


def static_weights(params: DataFrame, cov: DataFrame) -> DataFrame:
    """Per horizon the fully invested mean-variance direction V^-1 a."""
    mu = params.select("universe", "h", F.col("asset").alias("a"), F.col("mean").alias("_mu"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names, v = _square(pdf, "cov")
        a = pdf.drop_duplicates("a").set_index("a")["_mu"].reindex(names).to_numpy(dtype=float)
        w = np.linalg.solve(v, a)
        w = w / float(a @ w)
        return pd.DataFrame({"asset": names, "w": w / np.abs(w).sum()})

    return _per_group(cov.join(mu, ["universe", "h", "a"]), ["universe", "h"], [("asset", T.StringType()), ("w", T.DoubleType())], solve)

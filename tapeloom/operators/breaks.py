"""Structural-break statistics on ``(instrument, pos, y)`` series (y: log price).

Sup-statistics compare every start with every end.  Blocks of starts meet blocks of ends as tiles:
each tile is a vectorised array step that returns one value per end, so the quadratic work spreads
over (instrument, block pair) and no (start, end) row is ever produced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.plans.series import KEYS, div, lagged, packed, reuse, running, task_count

TILE, STRIPES = 512, 16


# --------------------------------------------------------------------------- recursive residuals
def recursive_residuals(df: DataFrame, *, y: str, x: Sequence[str], min_sample: int) -> DataFrame:
    """Standardised one-step forecast errors of expanding least squares.

    Moments are running sums; each row then solves its own small system in Arrow batches.
    """
    p = len(x)
    if min_sample <= p:
        raise ValueError("min_sample must exceed the number of regressors")
    cells = {f"_m{i}_{j}": F.col(x[i]) * F.col(x[j]) for i in range(p) for j in range(i, p)}
    cells |= {f"_v{i}": F.col(x[i]) * F.col(y) for i in range(p)} | {"_q": F.col(y) * F.col(y)}
    sums = running(df, {n: ("sum", e.cast("double")) for n, e in cells.items()}, exclusive=True).where(F.col("pos") >= min_sample)
    schema = T.StructType([*[df.schema[c] for c in (*KEYS, "pos")], T.StructField("omega", T.DoubleType())])

    def solve(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            n = len(pdf)
            m, v = np.empty((n, p, p)), np.empty((n, p))
            for i in range(p):
                v[:, i] = pdf[f"_v{i}"]
                for j in range(p):
                    m[:, i, j] = pdf[f"_m{min(i, j)}_{max(i, j)}"]
            inv = np.linalg.inv(m)
            beta = np.einsum("nij,nj->ni", inv, v)
            xt = pdf[list(x)].to_numpy(dtype=float)
            t = pdf["pos"].to_numpy()
            s2 = (pdf["_q"].to_numpy() - np.einsum("ni,ni->n", beta, v)) / (t - p)
            f = s2 * (1 + np.einsum("ni,nij,nj->n", xt, inv, xt))
            om = (pdf[y].to_numpy() - np.einsum("ni,ni->n", xt, beta)) / np.sqrt(np.maximum(f, 0))
            yield pd.DataFrame({**{c: pdf[c] for c in (*KEYS, "pos")}, "omega": om})

    return sums.mapInPandas(solve, schema)


def recursive_cusum(df: DataFrame, *, y: str, x: Sequence[str], min_sample: int) -> DataFrame:
    """Cumulative standardised recursive residuals with their 95% band."""
    om = recursive_residuals(df, y=y, x=x, min_sample=min_sample)
    sd = om.groupBy(*KEYS).agg(F.stddev_pop("omega").alias("_sd"))
    run = running(om.withColumn("_i", F.col("pos") - min_sample), {"_s": ("sum", F.col("omega"))}, pos="_i")
    return run.join(sd, list(KEYS)).select(
        *KEYS, "pos", "omega", div(F.col("_s"), F.col("_sd")).alias("s"), (1.96 * F.sqrt("_i")).alias("band_95")
    )


# --------------------------------------------------------------------------- tiles
def _field(name: str):
    return lambda x: x[name].cast("double")


def _blocks(df: DataFrame, cols: Sequence[str], size: int) -> DataFrame:
    return packed(df, cols, size=size).select(*KEYS, "blk", *[F.transform("rows", _field(c)).alias(c) for c in cols])


def _starts(blocks: DataFrame, cols: Sequence[str]) -> DataFrame:
    return blocks.select(*KEYS, F.col("blk").alias("_sblk"), *[F.col(c).alias(f"_s_{c}") for c in cols])


def _known(near: DataFrame, blocks: DataFrame) -> DataFrame:
    """End blocks with the best departure of each end from its own block and the one before."""
    own = near.where(F.col("blk") == F.col("_sblk")).select(*KEYS, "blk", F.col("_v").alias("_own"))
    prior = near.where(F.col("blk") > F.col("_sblk")).select(*KEYS, "blk", F.col("_v").alias("_prior"))
    both = blocks.join(own, [*KEYS, "blk"]).join(prior, [*KEYS, "blk"])
    return both.withColumn("_known", F.zip_with("_own", "_prior", lambda a, b: F.greatest(a, b))).drop("_own", "_prior")


def _far_tiles(near: DataFrame, blocks: DataFrame, y: str, size: int) -> DataFrame:
    """(end block, start block) pairs, further than neighbours, that could hold a departure not below one already known.

    ``near`` has each end block's values and the best departure of each end (``_known``). Ends are taken in stripes: no end of a stripe
    departs from a start block by more than (stripe's maximum - block's minimum) / sqrt(shortest gap), or longest gap if that
    is negative. Rounding keeps the order of these operations, so a tile left out cannot matter, ties included.
    """
    step = max(1, size // STRIPES)
    piece = lambda c, i: F.slice(c, i * step + 1, step)
    stripe = lambda i: F.struct(
        (F.col("blk") * size + i * step).alias("at"), F.array_max(piece(y, i)).alias("hi"), F.array_min(piece("_known", i)).alias("known")
    )
    count = F.ceil(F.size(y) / step).cast("int")
    ends = near.withColumn("_e", F.transform(F.sequence(F.lit(0), count - 1), stripe)).where(F.col("blk") >= 2)
    pairs = ends.select(*KEYS, "blk", "_e", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blk") - 2)).alias("_sblk"))
    floor = blocks.select(*KEYS, F.col("blk").alias("_sblk"), F.array_min(y).alias("_lo"))

    def open_(e: Column) -> Column:
        rise = e["hi"] - F.col("_lo")
        gap = F.when(rise > 0, e["at"] - (F.col("_sblk") + 1) * size + 1).otherwise(e["at"] + step - 1 - F.col("_sblk") * size)
        return rise / F.sqrt(gap.cast("double")) >= e["known"]

    return pairs.join(floor, [*KEYS, "_sblk"]).where(F.exists("_e", open_)).select(*KEYS, "blk", "_sblk")


def _departures(y: str, size: int):
    def best(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Best departure of each end from a block of starts; tiles leave in slices of a few MB."""
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                rows, vs, ns = pdf.iloc[at : at + 64], [], []
                for e, s, b, a in zip(rows[y], rows[f"_s_{y}"], rows["blk"], rows["_sblk"]):
                    e, s = np.asarray(e, dtype=float), np.asarray(s, dtype=float)
                    gap = (b * size + np.arange(len(e)))[:, None] - (a * size + np.arange(len(s)))[None, :]
                    ok = gap > 0
                    val = np.where(ok, (e[:, None] - s[None, :]) / np.sqrt(np.where(ok, gap, 1)), -np.inf)
                    n = val.argmax(axis=1)
                    v = val[np.arange(len(e)), n]
                    vs.append(np.where(np.isfinite(v), v, -np.inf))
                    ns.append(a * size + n)
                yield rows[[*KEYS, "blk", "_sblk"]].assign(_v=vs, _n=ns)

    return best


def level_shift_sup(df: DataFrame, *, y: str = "y", min_sample: int = 3, size: int = TILE) -> DataFrame:
    """Largest standardised departure of each end from all earlier reference levels.

    Output per end: statistic, reference position (first maximum), 95% critical value there.  Each end block meets itself and
    the block before; of the others only those whose bound is not below what these gave.
    """
    moves = lagged(df.select(*KEYS, "pos", y), {"_p": F.col(y)}).withColumn("_d2", F.pow(F.col(y) - F.col("_p"), 2))
    var = running(moves, {"_ss": ("sum", F.col("_d2"))})
    var = var.withColumn("_sig", F.sqrt(div(F.col("_ss"), (F.col("pos") - 1).cast("double")))).select(*KEYS, "pos", y, "_sig")

    doubles = T.ArrayType(T.DoubleType())
    fields = [df.schema[c] for c in KEYS] + [T.StructField("blk", T.LongType()), T.StructField("_sblk", T.LongType())]
    met_type = T.StructType([*fields, T.StructField("_v", doubles), T.StructField("_n", T.ArrayType(T.LongType()))])

    best, blocks = _departures(y, size), reuse(_blocks(var, [y], size))
    starts = _starts(blocks, [y])
    close = blocks.withColumn("_sblk", F.explode(F.sequence(F.greatest(F.col("blk") - 1, F.lit(0)), "blk")))
    near = reuse(close.join(starts, [*KEYS, "_sblk"]).mapInPandas(best, met_type))
    far = blocks.join(_far_tiles(_known(near, blocks), blocks, y, size), [*KEYS, "blk"]).join(starts, [*KEYS, "_sblk"])
    met = near.unionByName(far.mapInPandas(best, met_type))
    scored = met.select(*KEYS, "blk", F.posexplode(F.arrays_zip(F.col("_v").alias("v"), F.col("_n").alias("n"))).alias("_i", "_b"))
    sup = (
        scored.where(F.col("_b.v") > float("-inf"))
        .groupBy(*KEYS, (F.col("blk") * size + F.col("_i")).alias("pos"))
        .agg(F.max(F.struct(F.col("_b.v").alias("v"), (-F.col("_b.n")).alias("n"))).alias("_m"))
    )
    n_star = -F.col("_m.n")
    return (
        sup.join(var.select(*KEYS, "pos", "_sig"), [*KEYS, "pos"])
        .where((F.col("pos") >= min_sample) & (F.col("_sig") > 0))
        .select(
            *KEYS, "pos", (F.col("_m.v") / F.col("_sig")).alias("s"), n_star.alias("n_star"),
            F.sqrt(4.6 + F.log(F.col("pos") - n_star)).alias("critical_95"),
        )
    )


# --------------------------------------------------------------------------- one-break unit-root test
def chow_table(df: DataFrame, *, y: str = "y") -> DataFrame:
    """t-statistic of a switch to explosiveness at every position ``k``, from suffix sums."""
    prev = lagged(df.select(*KEYS, "pos", y), {"_l": F.col(y)}).withColumn("_d", F.col(y) - F.col("_l"))
    run = running(prev, {"_xy": ("sum", F.col("_l") * F.col("_d")), "_xx": ("sum", F.col("_l") * F.col("_l"))}, exclusive=True)
    tot = prev.groupBy(*KEYS).agg(
        F.sum(F.col("_l") * F.col("_d")).alias("_txy"), F.sum(F.col("_l") * F.col("_l")).alias("_txx"),
        F.sum(F.col("_d") * F.col("_d")).alias("_tyy"), F.count(F.lit(1)).alias("n"),
    )
    out = run.join(tot, list(KEYS))
    xy = F.col("_txy") - F.coalesce("_xy", F.lit(0.0))
    xx = F.col("_txx") - F.coalesce("_xx", F.lit(0.0))
    delta = div(xy, xx)
    s2 = div(F.col("_tyy") - delta * xy, (F.col("n") - 2).cast("double"))
    feasible = (F.col("pos") >= 1) & (F.col("pos") < F.col("n") - 1)
    return out.where(feasible).select(*KEYS, F.col("pos").alias("k"), "n", div(delta, F.sqrt(div(s2, xx))).alias("dfc"))


def chow_at(df: DataFrame, *, tau: float, y: str = "y") -> DataFrame:
    """The statistic at one break fraction (half-even rounding of tau * n)."""
    return chow_table(df, y=y).where(F.col("k") == F.rint(F.col("n") * F.lit(tau)).cast("long"))


def chow_sup(df: DataFrame, *, tau0: float = 0.15, step: float | None = None, y: str = "y") -> DataFrame:
    """Largest statistic over all feasible breaks (or a fixed grid of fractions); first maximum."""
    t = chow_table(df, y=y)
    if step is None:
        t = t.where((F.col("k") >= F.ceil(F.col("n") * F.lit(tau0))) & (F.col("k") <= F.floor(F.col("n") * F.lit(1 - tau0))))
    else:
        taus = [float(v) for v in np.arange(tau0, 1 - tau0 + 1e-12, step)]
        t = t.where(F.array_contains(F.array(*[F.rint(F.col("n") * F.lit(v)).cast("long") for v in taus]), F.col("k")))
    return t.where(F.col("dfc").isNotNull()).groupBy(*KEYS).agg(F.max(F.struct("dfc", (-F.col("k")).alias("k"), "n")).alias("_m")).select(
        *KEYS, F.col("_m.dfc").alias("sdfc"), (-F.col("_m.k") / F.col("_m.n")).alias("tau_star")
    )


# --------------------------------------------------------------------------- explosiveness
def regression_design(df: DataFrame, *, y: str = "y", lags: int = 1, constant: str = "nc") -> DataFrame:
    """Rows (dy, level, d1..dL[, one, trend, trend2]) of the unit-root regression."""
    out = lagged(df.select(*KEYS, "pos", y), {"level": F.col(y)}).withColumn("dy", F.col(y) - F.col("level"))
    for i in range(1, lags + 1):
        out = lagged(out, {f"d{i}": F.col("dy")}, n=i)
    out = out.where(F.col(f"d{lags}" if lags else "dy").isNotNull())
    j = (F.col("pos") - lags - 1).cast("double")
    extra = {}
    if constant != "nc":
        extra["one"] = F.lit(1.0)
        if constant[:2] == "ct":
            extra["trend"] = j
        if constant == "ctt":
            extra["trend2"] = j * j
    return out.withColumns(extra).drop(y) if extra else out.drop(y)


def design_columns(lags: int, constant: str) -> list[str]:
    return ["level", *[f"d{i}" for i in range(1, lags + 1)], *{"nc": [], "c": ["one"], "ct": ["one", "trend"], "ctt": ["one", "trend", "trend2"]}[constant]]


def least_squares(design: DataFrame, x: Sequence[str], *, y: str = "dy", by: Sequence[str] = KEYS) -> DataFrame:
    """Coefficients and variances per group from one pass of moments (by..., term, beta, var)."""
    p = len(x)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    m = design.groupBy(*by).agg(
        *[F.sum(F.col(x[i]) * F.col(x[j])).alias(f"_m{i}_{j}") for i, j in pairs],
        *[F.sum(F.col(x[i]) * F.col(y)).alias(f"_v{i}") for i in range(p)],
        F.sum(F.col(y) * F.col(y)).alias("_q"), F.count(F.lit(1)).alias("_n"),
    )
    schema = T.StructType([m.schema[b] for b in by] + [T.StructField("term", T.StringType()), T.StructField("beta", T.DoubleType()), T.StructField("var", T.DoubleType())])

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                a = np.array([[r[f"_m{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], dtype=float)
                v = np.array([r[f"_v{i}"] for i in range(p)], dtype=float)
                inv = np.linalg.inv(a)
                b = inv @ v
                s2 = (r["_q"] - b @ v) / (r["_n"] - p)
                rows += [{**{k: r[k] for k in by}, "term": x[i], "beta": float(b[i]), "var": float(s2 * inv[i, i])} for i in range(p)]
            yield pd.DataFrame(rows, columns=schema.fieldNames())

    return m.mapInPandas(solve, schema)


def sup_adf(df: DataFrame, *, y: str = "y", min_length: int, lags: int = 1, constant: str = "nc", size: int = TILE) -> DataFrame:
    """Backward-sup unit-root statistic for every end position (``pos`` = end).

    A block of ends meets its own starts, those of the block before, and the first start of every block; further tiles are formed
    only where their bound (:func:`_window_bound`) is not below what these gave, first for whole blocks of starts, then for sixteenths of
    them, of which the totals suffice. So rows meet only where a sixteenth stays open. A window's moments are local sums of its edge blocks
    and totals of the blocks between, each around the origin of the end block, so nothing is the difference of two long sums.
    Windows whose regressors are collinear have no statistic.
    """
    p = len(design_columns(lags, constant))
    raw = ["level", *[f"d{i}" for i in range(1, lags + 1)], "dy"]
    design = regression_design(df, y=y, lags=lags, constant="nc").withColumn("pos", F.col("pos") - (lags + 1))
    blocks = reuse(_blocks(design, raw, size))
    least, first_end = max(min_length - lags, p + 1), min_length - 1
    cells = p * (p + 1) // 2 + p + 1

    doubles = T.ArrayType(T.DoubleType())
    cell, tasks, part = [*KEYS, "blk"], task_count(df.sparkSession), max(1, size // STRIPES)
    totals_type = T.StructType([*[blocks.schema[c] for c in cell], T.StructField("_t", doubles), T.StructField("_parts", doubles)])

    def totals(batches):
        for pdf in batches:
            rows, parts = [], []
            for b, *arrays in zip(pdf["blk"], *[pdf[c] for c in raw]):
                block = np.stack([np.asarray(a, dtype=float) for a in arrays])
                mid = _origin(block, constant)
                z = np.nan_to_num(_cells(_around(block, 0, mid, constant, size)))
                rows.append(np.concatenate(([b, mid], z.sum(axis=1))))
                parts.append(np.concatenate(([mid], np.add.reduceat(z, np.arange(0, z.shape[1], part), axis=1).T.ravel())))
            yield pdf[cell].assign(_t=rows, _parts=parts)

    sums = reuse(blocks.repartition(tasks, *cell).mapInPandas(totals, totals_type))
    per_series = (
        sums.groupBy(*KEYS).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("blk", "_t"))), lambda x: x["_t"])).alias("_totals"))
    )
    prior = blocks.select(*KEYS, (F.col("blk") + 1).alias("blk"), *[F.col(c).alias(f"_s_{c}") for c in raw])
    near = blocks.repartition(tasks, *cell).join(prior, cell, "left").join(F.broadcast(per_series), list(KEYS))
    arrays_of = lambda r, prefix="": np.stack([np.asarray(r[prefix + c], dtype=float) for c in raw])
    met_type = T.StructType(
        [*[blocks.schema[c] for c in cell], T.StructField("_best", doubles), T.StructField("_far", T.ArrayType(T.LongType())), T.StructField("_between", T.ArrayType(doubles))]
    )

    def meet_near(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                b, block = int(r["blk"]), arrays_of(r)
                mid = _origin(block, constant)
                own = _cells(_around(block, 0, mid, constant, size))
                upto = np.cumsum(np.nan_to_num(own), axis=1)
                ends = np.arange(block.shape[1])
                before = np.hstack((np.zeros((len(own), 1)), upto[:, :-1]))
                best = _tile_best(upto, -before, ends, ends, ~np.isnan(own).any(axis=0), p, least)
                if b:
                    z = _cells(_around(arrays_of(r, "_s_"), -1, mid, constant, size))
                    back = np.cumsum(np.nan_to_num(z)[:, ::-1], axis=1)[:, ::-1]
                    best = np.fmax(best, _tile_best(upto, back, ends, np.arange(z.shape[1]) - size, ~np.isnan(z).any(axis=0), p, least))
                far, between = [], []
                if b > 1:
                    table = np.asarray(r["_totals"], dtype=float).reshape(-1, cells + 2)
                    table = table[table[:, 0] < b]
                    since = np.cumsum(_moved(table[:, 2:], table[:, 0] - b, table[:, 1] - mid, constant, p)[::-1], axis=0)[::-1]  # from the start of block k on
                    best, far = _open_blocks(upto, since, ends, best, p, least, size)
                    between = [since[a + 1].tolist() for a in far]
                best[b * size + ends < first_end] = np.nan
                yield pd.DataFrame({**{c: [r[c]] for c in (*KEYS, "blk")}, "_best": [best], "_far": [far], "_between": [between]})

    met = reuse(near.mapInPandas(meet_near, met_type))
    open_type = T.StructType([f for f in met_type.fields if f.name != "_best"] + [T.StructField("_parts", T.ArrayType(T.ArrayType(T.LongType())))])
    pairs = met.select(*cell, F.explode(F.arrays_zip("_far", "_between")).alias("_x")).select(*cell, F.col("_x._far").alias("_sblk"), F.col("_x._between").alias("_between"))
    coarse = pairs.join(sums.select(*KEYS, F.col("blk").alias("_sblk"), "_parts"), [*KEYS, "_sblk"]).repartition(tasks, *cell)
    coarse = coarse.groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct("_sblk", "_between", "_parts")), asc=False).alias("_x"))
    coarse = coarse.select(*cell, *[F.col(f"_x.{c}").alias(c) for c in ("_sblk", "_between", "_parts")])

    def sift(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                b, block = int(r["blk"]), arrays_of(r)
                mid, ends, best = _origin(block, constant), np.arange(block.shape[1]), np.array(r["_best"], dtype=float)
                upto = np.cumsum(np.nan_to_num(_cells(_around(block, 0, mid, constant, size))), axis=1)
                far = np.asarray(r["_sblk"], dtype=np.int64)
                held = np.stack([np.asarray(x, dtype=float) for x in r["_parts"]])
                since, n = [], -(-size // part)
                for a, x, rest in zip(far, held, r["_between"]):
                    own = _moved(x[1:].reshape(n, cells), np.full(n, float(a - b)), np.full(n, x[0] - mid), constant, p)
                    since.append(np.cumsum(np.vstack((np.asarray(rest, dtype=float), own[::-1])), axis=0)[::-1])
                left = _open_parts(upto, np.array(since), ends, (b - far) * size, best, p, part)
                kept = [i for i, o in enumerate(left) if len(o)]
                between = [np.asarray(r["_between"][i], dtype=float).tolist() for i in kept]
                yield pd.DataFrame({**{c: [r[c]] for c in cell}, "_far": [far[kept].tolist()], "_between": [between], "_parts": [[left[i].tolist() for i in kept]]})

    sifted = coarse.join(blocks, cell).join(met.select(*cell, "_best"), cell).mapInPandas(sift, open_type)
    pairs = sifted.select(*cell, F.explode(F.arrays_zip("_far", "_between", "_parts")).alias("_x")).select(
        *cell, F.col("_x._far").alias("_sblk"), F.col("_x._between").alias("_between"), F.col("_x._parts").alias("_parts")
    )
    starts = blocks.select(*KEYS, F.col("blk").alias("_sblk"), *[F.col(c).alias(f"_s_{c}") for c in raw])
    tiles = pairs.join(starts, [*KEYS, "_sblk"]).repartition(tasks, *cell).join(blocks, cell)
    far_type = T.StructType([*[blocks.schema[c] for c in cell], T.StructField("_best", doubles)])

    def meet_far(batches):
        at, best = None, None
        for pdf in batches:
            for r in pdf.to_dict("records"):
                key, block = tuple(r[c] for c in (*KEYS, "blk")), arrays_of(r)
                if key != at:
                    if at is not None:
                        yield pd.DataFrame({**{c: [v] for c, v in zip((*KEYS, "blk"), at)}, "_best": [best]})
                    at, best, mid, ends = key, np.full(block.shape[1], np.nan), _origin(block, constant), np.arange(block.shape[1])
                    upto = np.cumsum(np.nan_to_num(_cells(_around(block, 0, mid, constant, size))), axis=1)
                shift = int(r["_sblk"]) - int(r["blk"])
                z = _cells(_around(arrays_of(r, "_s_"), shift, mid, constant, size))
                back = np.cumsum(np.nan_to_num(z)[:, ::-1], axis=1)[:, ::-1] + np.asarray(r["_between"], dtype=float)[:, None]
                cut = (np.asarray(r["_parts"], dtype=int)[:, None] * part + np.arange(part)).ravel()
                cut = cut[cut < size]
                found = _tile_best(upto, back[:, cut], ends, cut + shift * size, ~np.isnan(z[:, cut]).any(axis=0), p, least)
                found[key[-1] * size + ends < first_end] = np.nan
                best = np.fmax(best, found)
        if at is not None:
            yield pd.DataFrame({**{c: [v] for c, v in zip((*KEYS, "blk"), at)}, "_best": [best]})

    scored = met.select(*cell, "_best").unionByName(tiles.mapInPandas(meet_far, far_type)).select(*KEYS, "blk", F.posexplode("_best").alias("_i", "_v"))
    return (
        scored.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy(*KEYS, (F.col("blk") * size + F.col("_i") + lags + 1).alias("pos"))
        .agg(F.max("_v").alias("sadf"))
    )


def _origin(block: np.ndarray, constant: str) -> float:
    """Level around which a block's moments are taken; only a regression with a constant may move it."""
    return 0.0 if constant == "nc" or np.isnan(block[0]).all() else float(np.nanmean(block[0]))


def _around(block: np.ndarray, shift: int, mid: float, constant: str, size: int) -> np.ndarray:
    """Columns (constant, trend, trend2, differences, level, response) of a block ``shift`` blocks from the origin of the trend."""
    level, moves = block[0] - mid, block[1:]
    time = shift + np.arange(block.shape[1]) / size
    powers = [time**k for k in range({"nc": 0, "c": 1, "ct": 2, "ctt": 3}[constant])]
    return np.stack([*powers, *moves[:-1], level, moves[-1]])


def _cells(z: np.ndarray) -> np.ndarray:
    """Products of all column pairs (upper triangle, row by row)."""
    i, j = np.triu_indices(len(z))
    return z[i] * z[j]


def _moved(cells: np.ndarray, shift: np.ndarray, rise: np.ndarray, constant: str, p: int) -> np.ndarray:
    """Moments of blocks around their own origins, around an origin ``-shift`` blocks and ``-rise`` in level away."""
    if constant == "nc":
        return cells
    m, (i, j) = p + 1, np.triu_indices(p + 1)
    full = np.empty((len(cells), m, m))
    full[:, i, j] = full[:, j, i] = cells
    to = np.tile(np.eye(m), (len(cells), 1, 1))
    to[:, p - 1, 0] = rise
    if constant in ("ct", "ctt"):
        to[:, 1, 0] = shift
    if constant == "ctt":
        to[:, 2, 0], to[:, 2, 1] = shift**2, 2 * shift
    return (to @ full @ to.transpose(0, 2, 1))[:, i, j]


def _partial(w: list[np.ndarray], p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Square sums of level and response and their product, all other columns partialled out, and where no pivot vanished."""
    at = {ij: n for n, ij in enumerate(zip(*np.triu_indices(p + 1)))}
    sound = np.ones(w[0].shape, dtype=bool)
    scale = w[at[p - 1, p - 1]] * 1e-13
    for k in range(p - 1):
        pivot = w[at[k, k]]
        if k:
            sound &= pivot > least_pivot[k]
        else:
            sound &= pivot > 0
            least_pivot = [w[at[n, n]] * 1e-13 for n in range(p - 1)]
        inverse = 1.0 / pivot
        for i in range(k + 1, p + 1):
            f = w[at[k, i]] * inverse
            for j in range(i, p + 1):
                w[at[i, j]] = w[at[i, j]] - f * w[at[k, j]]
    level = w[at[p - 1, p - 1]]
    return level, w[at[p - 1, p]], w[at[p, p]], sound & (level > scale)


def _tile_best(ends: np.ndarray, starts: np.ndarray, e: np.ndarray, s: np.ndarray, valid: np.ndarray, p: int, least: int, width: int = 64) -> np.ndarray:
    """Largest t-statistic of the level per end over a block of starts; moments of a window are ``ends + starts``."""
    best = np.full(len(e), np.nan)
    with np.errstate(all="ignore"):
        for a in range(0, len(s), width):
            part = slice(a, a + width)
            rows = (e[None, :] - s[part, None] + 1).astype(float)
            ok = (rows >= least) & valid[part, None]
            if not ok.any():
                continue
            level, both, own, sound = _partial([x[None, :] + y[part, None] for x, y in zip(ends, starts)], p)
            t = both * np.sqrt((rows - p) / (level * own - both * both))
            t[~(ok & sound & np.isfinite(t))] = -np.inf
            top = t.max(axis=0)
            best = np.fmax(best, np.where(np.isfinite(top), top, np.nan))
    return best


def _window_bound(inner: tuple, outer: tuple, n_inner: np.ndarray, n_outer: np.ndarray, p: int) -> np.ndarray:
    """Largest t-statistic that a window between two nested ones can have.

    With R the square sum of residuals and R0 that without the level, t^2 = (n - p)(R0 / R - 1), and both only grow with the window. If
    R0 of the inner one exceeds R of the outer one, no window between them, nor any that counts rows in part, has t = 0, so all have
    the sign of the inner one.
    """
    (a1, b1, q1, ok1), (a0, b0, q0, ok0) = inner, outer
    r1, r0 = q1 - b1 * b1 / a1, q0 - b0 * b0 / a0
    lowest, highest = q1 / r0 - 1 - 1e-9, q0 / r1 - 1 + 1e-9
    bound = np.where((lowest > 0) & (b1 < 0), -np.sqrt((n_inner - p) * np.maximum(lowest, 0)), np.sqrt((n_outer - p) * np.maximum(highest, 0)))
    usable = ok1 & ok0 & (n_inner > p) & (r1 > 1e-12 * q1) & (r0 > 1e-12 * q0) & np.isfinite(bound)
    return np.where(usable, bound, np.inf)


def _open_blocks(ends: np.ndarray, since: np.ndarray, e: np.ndarray, best: np.ndarray, p: int, least: int, size: int, width: int = 64) -> tuple[np.ndarray, list[int]]:
    """Best statistics with the windows from each block's first start added, and the blocks that may hold a better one.

    ``since[k]`` has the moments from the start of block ``k`` to the end block; the last one is the neighbour, met already.
    """
    n, bounds, best = len(since), [], best.copy()
    with np.errstate(all="ignore"):
        for lo in range(0, n - 1, width):
            k = np.arange(lo, min(lo + width, n - 1) + 1)
            rows = (e[None, :] + (n - k[:, None]) * size + 1).astype(float)
            parts = _partial([x[None, :] + y[k, None] for x, y in zip(ends, since.T)], p)
            level, both, own, sound = parts
            t = both * np.sqrt((rows - p) / (level * own - both * both))
            t[~(sound & np.isfinite(t) & (rows >= least))] = -np.inf
            top = t.max(axis=0)
            best = np.fmax(best, np.where(np.isfinite(top), top, np.nan))
            bounds.append(_window_bound(tuple(x[1:] for x in parts), tuple(x[:-1] for x in parts), rows[1:], rows[:-1], p))
    known = np.where(np.isnan(best), -np.inf, best)
    known = known - 1e-7 * (1 + np.abs(known))
    return best, np.flatnonzero((np.vstack(bounds) >= known[None, :]).any(axis=1)).tolist()


def _open_parts(ends: np.ndarray, since: np.ndarray, e: np.ndarray, gap: np.ndarray, best: np.ndarray, p: int, part: int, width: int = 4) -> list[np.ndarray]:
    """Of each far block the parts of ``part`` starts that may hold a better statistic than ``best``.

    ``since[k, j]`` has the moments from the start of part ``j`` of block ``k`` to the end block, ``gap[k]`` rows after that block's
    start; the last ``j`` is where the next block starts.
    """
    left, known = [], np.where(np.isnan(best), -np.inf, best)
    known = known - 1e-7 * (1 + np.abs(known))
    with np.errstate(all="ignore"):
        for lo in range(0, len(since), width):
            rows = (e + gap[lo : lo + width, None, None] - np.arange(since.shape[1])[:, None] * part + 1).astype(float)
            sums = _partial([x + y[..., None] for x, y in zip(ends, np.moveaxis(since[lo : lo + width], -1, 0))], p)
            bound = _window_bound(tuple(x[:, 1:] for x in sums), tuple(x[:, :-1] for x in sums), rows[:, 1:], rows[:, :-1], p)
            left += [np.flatnonzero(b) for b in (bound >= known).any(axis=-1)]
    return left

"""Ordered-series primitives that never need one task per instrument.

A series is the set of rows sharing ``keys`` (normally ``instrument``), totally ordered by a dense
0-based ``pos``.  There is one plan for all sizes: rows are cut into blocks of
``tapeloom.series.block_rows`` consecutive positions, work is done per ``(keys, block)`` and only one
summary row per block crosses blocks.  A short series is one block; one holding a third of a 100 TB
tape is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.sources.storage import scratch

KEYS = ("instrument",)
BLOCK_ROWS = 1 << 18


def div(a: Column, b: Column) -> Column:
    """Division with null for a zero divisor (ANSI mode raises otherwise)."""
    return a / F.nullif(b, F.lit(0))


def reuse(df: DataFrame) -> DataFrame:
    """Write a table that several branches of one job read to the shared folder, and read it back.

    This cuts lineage (a lost executor costs nothing upstream), keeps later scans column-pruned and
    gives later size checks the true size.
    """
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _conf(spark: SparkSession, name: str, default) -> str:
    return spark.conf.get(f"tapeloom.series.{name}", str(default))


def block_rows(df: DataFrame) -> int:
    return int(_conf(df.sparkSession, "block_rows", BLOCK_ROWS))


def task_count(spark: SparkSession) -> int:
    """Tasks for a step whose rows are few and costly, and which the size of its input would leave to a handful of tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


# --------------------------------------------------------------------------- positions
def position(df: DataFrame, order: Sequence[str], *, keys: Sequence[str] = KEYS, name: str = "pos") -> DataFrame:
    """Dense 0-based position in ``order`` within ``keys`` (``order`` must be total).

    Sample-based range partitioning gives even partitions whatever the skew of the keys, writing the
    table freezes the partition numbers, and per-partition counts supply the offsets.
    """
    keys, order = list(keys), list(order)
    ranged = reuse(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    cell = keys + ["_part"]
    offsets = (
        ranged.groupBy(*cell)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_off",
            F.coalesce(
                F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .drop("_n")
    )
    local = F.row_number().over(Window.partitionBy(*cell).orderBy(*order))
    return (
        ranged.withColumn("_rn", local)
        .join(offsets, cell)
        .withColumn(name, (F.col("_off") + F.col("_rn") - 1).cast("long"))
        .drop("_rn", "_off", "_part")
    )


def _block(pos: str, size: int) -> Column:
    return F.floor(F.col(pos) / F.lit(size)).cast("long")


# --------------------------------------------------------------------------- running aggregates
_AGG = {
    "sum": F.sum,
    "count": F.count,
    "max": F.max,
    "min": F.min,
}


def _over(kind: str, expr: Column, w: WindowSpec) -> Column:
    if kind == "last":
        return F.last(expr, ignorenulls=True).over(w)
    return _AGG[kind](expr).over(w)


def running(
    df: DataFrame,
    specs: dict[str, tuple[str, Column]],
    *,
    keys: Sequence[str] = KEYS,
    pos: str = "pos",
    exclusive: bool = False,
) -> DataFrame:
    """Prefix aggregates (``sum``/``count``/``max``/``min``/``last`` non-null) in ``pos`` order."""
    keys = list(keys)
    frame = (Window.unboundedPreceding, -1 if exclusive else 0)
    cell = keys + ["_blk"]
    base = df.withColumn("_blk", _block(pos, block_rows(df))).withColumns(
        {f"_x_{n}": e for n, (_, e) in specs.items()}
    )
    totals = base.groupBy(*cell).agg(
        *[
            (
                F.max_by(f"_x_{n}", F.when(F.col(f"_x_{n}").isNotNull(), F.col(pos)))
                if k == "last"
                else _AGG[k](f"_x_{n}")
            ).alias(f"_t_{n}")
            for n, (k, _) in specs.items()
        ]
    )
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(
        *cell,
        *[
            _over("sum" if k == "count" else k, F.col(f"_t_{n}"), before).alias(f"_c_{n}")
            for n, (k, _) in specs.items()
        ],
    )
    w = Window.partitionBy(*cell).orderBy(pos).rowsBetween(*frame)
    local = base.withColumns({f"_l_{n}": _over(k, F.col(f"_x_{n}"), w) for n, (k, _) in specs.items()})
    joined = local.join(carries, cell)
    out = {}
    for n, (k, _) in specs.items():
        here, carry = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if k == "last":
            out[n] = F.coalesce(here, carry)
        elif k in ("max", "min"):
            out[n] = (F.greatest if k == "max" else F.least)(here, carry)
        else:
            both = F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))
            out[n] = _fill(k, F.when(here.isNotNull() | carry.isNotNull(), both))
    drop = ["_blk"] + [f"_{p}_{n}" for n in specs for p in "xlc"]
    return joined.withColumns(out).drop(*drop)


def _fill(kind: str, c: Column) -> Column:
    return F.coalesce(c, F.lit(0)) if kind == "count" else c


def running_product(df: DataFrame, x: Column, name: str, *, keys: Sequence[str] = KEYS, pos: str = "pos") -> DataFrame:
    """Prefix product that keeps the sign and survives zeros (null factors count as one)."""
    out = running(
        df,
        {
            "_log": ("sum", F.when(x != 0, F.log(F.abs(F.when(x != 0, x))))),
            "_neg": ("sum", F.when(x < 0, 1).otherwise(0)),
            "_zero": ("max", F.when(x == 0, 1).otherwise(0)),
        },
        keys=keys,
        pos=pos,
    )
    sign = F.when(F.col("_zero") == 1, 0).when(F.col("_neg") % 2 == 1, -1).otherwise(1)
    return out.withColumn(name, sign * F.exp(F.coalesce("_log", F.lit(0.0)))).drop("_log", "_neg", "_zero")


# --------------------------------------------------------------------------- exact quantiles
def quantiles(df: DataFrame, x: str, probs: Sequence[float], *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Exact linearly interpolated quantiles per key as columns ``q0, q1, ...``.

    Ranks come from :func:`position`, so no group's values are gathered in one buffer.
    """
    keys = list(keys)
    ranked = position(df.where(F.col(x).isNotNull()).select(*keys, x), [x], keys=keys, name="_rank")
    n = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    out = []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(float(p))
        lo = F.max(F.when(F.col("_rank") == F.floor(h), F.col(x)))
        hi = F.max(F.when(F.col("_rank") == F.ceil(h), F.col(x)))
        frac = F.max(h - F.floor(h))
        out.append((lo + (hi - lo) * frac).alias(f"q{i}"))
    return ranked.join(n, keys).groupBy(*keys).agg(*out)


# --------------------------------------------------------------------------- bounded frames
def framed(
    df: DataFrame,
    build: Callable[[WindowSpec], dict[str, Column]],
    *,
    keys: Sequence[str] = KEYS,
    pos: str = "pos",
    before: int = 0,
    after: int = 0,
) -> DataFrame:
    """Window expressions whose frames reach at most ``before`` rows back and ``after`` ahead.

    ``build(w)`` gets a partitioned, ordered window and returns ``{name: Column}``.  Each block borrows
    the neighbouring rows it needs (a halo) and drops them afterwards.
    """
    keys = list(keys)
    size = max(block_rows(df), before, after)
    blk, offset = _block(pos, size), F.col(pos) % size
    homes = [F.struct(blk.alias("b"), F.lit(False).alias("h"))]
    if before:
        homes.append(F.when(offset >= size - before, F.struct((blk + 1).alias("b"), F.lit(True).alias("h"))))
    if after:
        homes.append(F.when((offset < after) & (blk > 0), F.struct((blk - 1).alias("b"), F.lit(True).alias("h"))))
    spread = df.withColumn("_home", F.explode(F.array_compact(F.array(*homes))))
    w = Window.partitionBy(*keys, "_home.b").orderBy(pos)
    return spread.withColumns(build(w)).where(~F.col("_home.h")).drop("_home")


def lagged(df: DataFrame, cols: dict[str, Column], *, n: int = 1, keys=KEYS, pos: str = "pos") -> DataFrame:
    """``n`` rows back (``n`` < 0: ahead)."""
    return framed(
        df,
        lambda w: {k: F.lag(c, n).over(w) if n > 0 else F.lead(c, -n).over(w) for k, c in cols.items()},
        keys=keys,
        pos=pos,
        before=max(n, 0),
        after=max(-n, 0),
    )


# --------------------------------------------------------------------------- as-of lookup
def asof(
    left: DataFrame,
    right: DataFrame,
    cols: dict[str, str],
    *,
    left_on: Column,
    right_on: Column,
    keys: Sequence[str] = KEYS,
    forward: bool = False,
    strict: bool = False,
) -> DataFrame:
    """For each left row the nearest right row at or before (``forward``: at or after) its time.

    ``cols`` maps output name to right column.  ``left_on``/``right_on`` are LONG sort keys, so both
    sides become one ordered series and the lookup is a running last-non-null: no range join. Even range
    partitions are scanned on their own and pass their newest right row on.
    """
    keys = list(keys)
    sign = -1 if forward else 1
    payload = F.struct(*[F.col(c).alias(n) for n, c in cols.items()])
    lcols = [c for c in left.columns if c not in keys]
    lstruct = F.struct(*[F.col(c) for c in lcols])
    rtype = right.select(payload.alias("p")).schema["p"].dataType
    ltype = left.select(lstruct.alias("l")).schema["l"].dataType
    both = left.where(left_on.isNotNull()).select(
        *keys, (left_on * sign).alias("_t"), F.lit(0 if strict else 1).alias("_s"), lstruct.alias("_l"),
        F.lit(None).cast(rtype).alias("_r"),
    ).unionByName(
        right.where(right_on.isNotNull()).select(
            *keys, (right_on * sign).alias("_t"), F.lit(1 if strict else 0).alias("_s"),
            F.lit(None).cast(ltype).alias("_l"), payload.alias("_r"),
        )
    )
    cell = [*keys, "_part"]
    ranged = reuse(both.repartitionByRange(*keys, "_t", "_s").withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    newest = ranged.groupBy(*cell).agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.struct("_t", "_s"))).alias("_n"))
    carry = newest.select(*cell, F.last("_n", ignorenulls=True).over(before).alias("_c"))
    here = F.last("_r", ignorenulls=True).over(Window.partitionBy(*cell).orderBy("_t", "_s").rowsBetween(Window.unboundedPreceding, 0))
    found = ranged.withColumn("_h", here).join(carry, cell).withColumn("_m", F.coalesce("_h", "_c"))
    return found.where(F.col("_l").isNotNull()).select(
        *keys, *[F.col("_l")[c].alias(c) for c in lcols], *[F.col("_m")[n].alias(n) for n in cols]
    )


def asof_many(left: DataFrame, right: DataFrame, lookups: Sequence[tuple[dict[str, str], Column, bool]], *, right_on: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """Several lookups of each left row in one ordered pass: ``lookups`` are (cols, left_on, forward), as in :func:`asof`.

    Each lookup puts the left row's number into the one series at its own time; right rows are there once. A forward lookup stands
    before right rows of its time and a backward one after them, and the last row before or the first row after it, in its
    own partition or carried from the next one that has any, is what it finds. The findings of a left row meet at last.
    """
    keys, names = list(keys), sorted({c for cols, _, _ in lookups for c in cols.values()})
    rows = reuse(left.withColumn("_id", F.monotonically_increasing_id()).withColumns({f"_at{i}": on for i, (_, on, _) in enumerate(lookups)}))
    payload = F.struct(*[F.col(c) for c in names])
    ptype = right.select(payload.alias("p")).schema["p"].dataType
    mark = [F.struct(F.col(f"_at{i}").alias("t"), F.lit(0 if ahead else 2).alias("s"), F.lit(i).alias("k")) for i, (_, _, ahead) in enumerate(lookups)]
    asked = rows.select(*keys, "_id", F.explode(F.array(*mark)).alias("_x")).where("_x.t IS NOT NULL")
    series = asked.select(*keys, F.col("_x.t").alias("_t"), F.col("_x.s").alias("_s"), F.col("_x.k").alias("_k"), "_id", F.lit(None).cast(ptype).alias("_r")).unionByName(
        right.where(right_on.isNotNull()).select(*keys, right_on.alias("_t"), F.lit(1).alias("_s"), F.lit(None).cast("int").alias("_k"), F.lit(None).cast("long").alias("_id"), payload.alias("_r"))
    )
    cell = [*keys, "_part"]
    series = reuse(series.repartitionByRange(*keys, "_t", "_s").withColumn("_part", F.spark_partition_id()))
    has = F.when(F.col("_r").isNotNull(), F.struct("_t", "_s"))
    ends = series.groupBy(*cell).agg(F.max_by("_r", has).alias("_newest"), F.min_by("_r", has).alias("_oldest"))
    by_part = Window.partitionBy(*keys).orderBy("_part")
    carry = ends.select(
        *cell,
        F.last("_newest", ignorenulls=True).over(by_part.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_oldest", ignorenulls=True).over(by_part.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    inside = Window.partitionBy(*cell).orderBy("_t", "_s")
    here = series.withColumns(
        {
            "_b": F.last("_r", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
            "_f": F.last("_r", ignorenulls=True).over(Window.partitionBy(*cell).orderBy(F.desc("_t"), F.desc("_s")).rowsBetween(Window.unboundedPreceding, 0)),
        }
    ).where(F.col("_id").isNotNull())
    found = here.join(carry, cell).select("_id", "_k", F.when(F.col("_s") == 0, F.coalesce("_f", "_after")).otherwise(F.coalesce("_b", "_before")).alias("_m"))
    found = found.groupBy("_id").agg(*[F.first(F.when(F.col("_k") == i, F.col("_m")), ignorenulls=True).alias(f"_m{i}") for i in range(len(lookups))])
    out = [F.col(f"_m{i}")[c].alias(n) for i, (cols, _, _) in enumerate(lookups) for n, c in cols.items()]
    return rows.join(found, "_id", "left").select(*left.columns, *out)


# --------------------------------------------------------------------------- exponential weights
def ewm_sums(
    df: DataFrame, cols: dict[str, Column], beta: float, *, keys: Sequence[str] = KEYS, pos: str = "pos"
) -> DataFrame:
    """``sum_i beta**(pos-i) * x_i`` for each column, over all rows up to ``pos``.

    Blocks are as long as ``beta**-length`` stays below 1e60; what lies two blocks back has weight
    below 1e-60 and cannot change a double, so only the previous block's total is carried.
    """
    keys = list(keys)
    size = max(1, int(60 * math.log(10) / -math.log(beta)))
    cell = keys + ["_eb"]
    lb = math.log(beta)
    base = df.withColumn("_eb", _block(pos, size)).withColumn("_ej", (F.col(pos) % size).cast("double"))
    base = base.withColumns({f"_x_{n}": c for n, c in cols.items()})
    w = Window.partitionBy(*cell).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumns(
        {f"_l_{n}": F.sum(F.col(f"_x_{n}") * F.exp(F.col("_ej") * -lb)).over(w) for n in cols}
    )
    totals = base.groupBy(*cell).agg(
        *[F.sum(F.col(f"_x_{n}") * F.exp((size - 1 - F.col("_ej")) * lb)).alias(f"_t_{n}") for n in cols]
    ).withColumn("_eb", F.col("_eb") + 1)
    joined = local.join(totals, cell, "left")
    out = {
        n: F.exp(F.col("_ej") * lb) * F.col(f"_l_{n}")
        + F.coalesce(F.exp((F.col("_ej") + 1) * lb) * F.col(f"_t_{n}"), F.lit(0.0))
        for n in cols
    }
    return joined.withColumns(out).drop("_eb", "_ej", *[f"_{p}_{n}" for n in cols for p in "xlt"])


# --------------------------------------------------------------------------- stateful folds
State = list[float]
FoldFn = Callable[[pd.DataFrame, State], tuple[pd.DataFrame, State]]


def fold(
    df: DataFrame,
    fn: FoldFn,
    init: State,
    schema: T.StructType,
    *,
    keys: Sequence[str] = KEYS,
    pos: str = "pos",
    forgets: bool = True,
) -> DataFrame:
    """Sequential fold with carried state, exact and without one task per key.

    ``fn(rows, state)`` consumes one run of consecutive rows and returns output rows plus the state
    after them; states are finite numbers.  ``schema`` describes the output (which must keep ``keys``); a ``_blk`` column is
    added so callers can number outputs across blocks with :func:`block_offsets`.

    All blocks are first folded in parallel from ``init``; each block's entry state is
    then replaced by its predecessor's exit state and only blocks whose entry changed are folded
    again, until nothing changes.  That fixpoint is the sequential result.  Reset folds forget their
    past at the first common reset, so a few rounds suffice; the number of rounds can never exceed
    the number of blocks.

    A fold that never forgets (``forgets=False``) would find every later block stale in every round. It runs as a wavefront instead:
    round ``b`` folds block ``b`` of every series once, from the exit state of block ``b - 1``, so the work is linear in the rows;
    series advance side by side. Either way a round reads only the folders of the blocks that it folds.
    """
    keys = list(keys)
    out = T.StructType(list(schema.fields) + [T.StructField("_blk", T.LongType())])
    names = out.fieldNames()

    def tidy(res: pd.DataFrame, b: int) -> pd.DataFrame:
        return res.assign(_blk=b)[names]

    cell = keys + ["_blk"]
    base = reuse(df.withColumn("_blk", _block(pos, block_rows(df))))
    last = base.agg(F.max("_blk")).first()[0] or 0

    def first_block(rows: pd.DataFrame) -> pd.DataFrame:
        return tidy(fn(rows.drop(columns="_blk").sort_values(pos, ignore_index=True), list(init))[0], 0)

    if last == 0:  # every series is one block, whose entry state is known
        return base.groupBy(*cell).applyInPandas(first_block, out)
    stype = T.StructType(
        [base.schema[k] for k in cell]
        + [T.StructField("_in", T.ArrayType(T.DoubleType())), T.StructField("_out", T.ArrayType(T.DoubleType()))]
    )
    path = scratch(df.sparkSession, "blocks")
    base.repartition(*cell).write.partitionBy("_blk").parquet(path)
    base = df.sparkSession.read.schema(base.schema).parquet(path)

    def step(rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or entry.empty:
            return pd.DataFrame({f.name: pd.Series(dtype=object) for f in stype})
        state = list(entry["_in"].iloc[0])
        after = fn(rows.drop(columns="_blk").sort_values(pos, ignore_index=True), list(state))[1]
        head = {k: [rows[k].iloc[0]] for k in cell}
        return pd.DataFrame({**head, "_in": [state], "_out": [[float(v) for v in after]]})

    def advance(todo: DataFrame, blocks: list[int] | None) -> DataFrame:
        """Entry and exit states of the blocks in ``todo`` (keys, _blk, _in); ``blocks`` are their numbers."""
        stale = base if blocks is None else base.where(F.col("_blk").isin(blocks))
        stale = stale.join(todo.select(*cell), cell, "left_semi")
        return stale.groupBy(*cell).cogroup(todo.groupBy(*cell)).applyInPandas(step, stype)

    first = F.array(*[F.lit(float(v)) for v in init]) if init else F.array().cast("array<double>")
    todo = base.select(*cell).distinct().withColumn("_in", first)
    if forgets:
        known = _settled(reuse(todo), advance, first, keys, last)
    else:
        folder, todo = scratch(df.sparkSession, "states"), reuse(todo.where("_blk = 0"))
        for b in range(last + 1):
            advance(todo, [b]).write.parquet(f"{folder}/round={b}")
            done = df.sparkSession.read.schema(stype).parquet(f"{folder}/round={b}")
            todo = done.select(*keys, (F.col("_blk") + 1).alias("_blk"), F.col("_out").alias("_in"))
        known = df.sparkSession.read.schema(stype).parquet(folder)

    def emit(rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({n: [] for n in names})
        b = int(rows["_blk"].iloc[0])
        res = fn(rows.drop(columns="_blk").sort_values(pos, ignore_index=True), list(entry["_in"].iloc[0]))[0]
        return tidy(res, b)

    return base.groupBy(*cell).cogroup(known.select(*cell, "_in").groupBy(*cell)).applyInPandas(emit, out)


def _settled(todo: DataFrame, advance: Callable[[DataFrame, list[int] | None], DataFrame], first: Column, keys: list[str], last: int) -> DataFrame:
    """States (keys, _blk, _in, _out) after rounds that fold the blocks whose entry state has changed, until none has."""
    cell, known, blocks = [*keys, "_blk"], None, None
    by_block = Window.partitionBy(*keys).orderBy("_blk")
    rounds = last + 2
    for n in range(rounds + 1):
        if n == rounds:
            raise RuntimeError("fold state does not settle: states must be finite numbers")
        fresh = advance(todo, blocks)
        if known is not None:
            fresh = fresh.unionByName(known.join(todo.select(*cell), cell, "left_anti"))
        known = reuse(fresh)
        entries = known.withColumn("_want", F.coalesce(F.lag("_out").over(by_block), first))
        todo = reuse(entries.where(~F.col("_want").eqNullSafe(F.col("_in"))).select(*cell, F.col("_want").alias("_in")))
        few = [r[0] for r in todo.select("_blk").distinct().limit(1001).collect()]
        if not few:
            break
        blocks = few if len(few) <= 1000 else None
    return known


def _compose(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix compositions of x -> a x + b, by doubling steps."""
    a, b, s = a.copy(), b.copy(), 1
    while s < len(a):
        b[s:] = a[s:] * b[:-s] + b[s:]
        a[s:] = a[s:] * a[:-s]
        s *= 2
    return a, b


def affine_scan(
    df: DataFrame, a: Column, b: Column, name: str, *, init: float = 0.0, keys: Sequence[str] = KEYS, pos: str = "pos"
) -> DataFrame:
    """``name`` = the state before each row of the recurrence ``state' = a * state + b``, started at ``init``.

    Each block is one affine map; the maps of a series (one row per block) are composed, then the blocks
    run from their entry states, all in parallel: two passes whatever the number of blocks.
    """
    keys = list(keys)
    cell = keys + ["_blk"]
    base = reuse(df.withColumns({"_blk": _block(pos, block_rows(df)), "_a": a.cast("double"), "_b": b.cast("double")}))
    maps = T.StructType([base.schema[k] for k in cell] + [T.StructField(c, T.DoubleType()) for c in ("_a", "_b")])

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(pos)
        x, y = _compose(rows["_a"].to_numpy(), rows["_b"].to_numpy())
        return rows.iloc[-1:][cell].assign(_a=x[-1], _b=y[-1])

    def enter(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_blk")
        x, y = _compose(rows["_a"].to_numpy(), rows["_b"].to_numpy())
        return rows.assign(_a=0.0, _b=np.concatenate(([init], (x * init + y)[:-1])))

    entries = base.select(*cell, pos, "_a", "_b").groupBy(*cell).applyInPandas(whole, maps).groupBy(*keys).applyInPandas(enter, maps)
    out = T.StructType([*(f for f in base.schema.fields if f.name not in ("_blk", "_a", "_b")), T.StructField(name, T.DoubleType())])
    names = out.fieldNames()

    def run(rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        rows, x0 = rows.sort_values(pos), float(entry["_b"].iloc[0])
        x, y = _compose(rows["_a"].to_numpy(), rows["_b"].to_numpy())
        return rows.assign(**{name: np.concatenate(([x0], (x * x0 + y)[:-1]))})[names]

    return base.groupBy(*cell).cogroup(entries.groupBy(*cell)).applyInPandas(run, out)


def _products(m: np.ndarray) -> np.ndarray:
    """Products m[i] @ ... @ m[0] for every i, by doubling steps."""
    m, s = m.copy(), 1
    while s < len(m):
        m[s:] = m[s:] @ m[:-s]
        s *= 2
    return m


def linear_scan(
    df: DataFrame, matrix: Sequence[Sequence[Column]], names: Sequence[str], init: Sequence[float], *, keys: Sequence[str] = KEYS, pos: str = "pos"
) -> DataFrame:
    """``names`` = the state vector before each row of the recurrence ``state' = matrix @ state``, started at ``init``.

    As :func:`affine_scan` with a small matrix per row: each block is one matrix, the matrices of a series are composed, then all
    blocks run from their entry vectors, in two passes whatever the number of blocks.
    """
    keys, size = list(keys), len(names)
    cell = keys + ["_blk"]
    flat = F.array(*[c.cast("double") for row in matrix for c in row])
    base = reuse(df.withColumns({"_blk": _block(pos, block_rows(df)), "_m": flat}))
    arrays = T.ArrayType(T.DoubleType())
    maps = T.StructType([base.schema[k] for k in cell] + [T.StructField("_m", arrays)])
    stack = lambda rows: np.array(rows["_m"].tolist(), float).reshape(len(rows), size, size)

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(pos)
        return rows.iloc[-1:][cell].assign(_m=[_products(stack(rows))[-1].ravel().tolist()])

    def enter(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_blk")
        after = _products(stack(rows)) @ np.array(init, float)
        return rows.assign(_m=[list(init), *after[:-1].tolist()])

    entries = base.select(*cell, pos, "_m").groupBy(*cell).applyInPandas(whole, maps).groupBy(*keys).applyInPandas(enter, maps)
    out = T.StructType([*(f for f in base.schema.fields if f.name not in ("_blk", "_m")), *(T.StructField(n, T.DoubleType()) for n in names)])
    columns = out.fieldNames()

    def run(rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        rows, start = rows.sort_values(pos), np.array(entry["_m"].iloc[0], float)
        states = np.vstack((start[None], (_products(stack(rows)) @ start)[:-1]))
        return rows.assign(**{n: states[:, i] for i, n in enumerate(names)})[columns]

    return base.groupBy(*cell).cogroup(entries.groupBy(*cell)).applyInPandas(run, out)


def block_offsets(df: DataFrame, count: Column, name: str, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add to each row ``name`` = sum of ``count`` over all earlier fold blocks of its series."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offs = (
        df.groupBy(*keys, "_blk")
        .agg(F.sum(count).alias("_n"))
        .withColumn(name, F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("long"))
        .drop("_n")
    )
    return df.join(offs, keys + ["_blk"]).drop("_blk")


# --------------------------------------------------------------------------- packed blocks
def packed(df: DataFrame, cols: Sequence[str], *, size: int, keys: Sequence[str] = KEYS, pos: str = "pos") -> DataFrame:
    """One row per block of ``size`` positions holding its values in order (bounded arrays)."""
    items = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), *cols)))
    return df.withColumn("blk", _block(pos, size)).groupBy(*keys, "blk").agg(items.alias("rows"))


def span_blocks(df: DataFrame, lo: str, hi: str, *, size: int) -> DataFrame:
    """Explode each position interval into the blocks it overlaps (equi-join key ``blk``)."""
    return df.withColumn("blk", F.explode(F.sequence(_block(lo, size), _block(hi, size))))


def map_blocks(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType,
    *,
    keys: Sequence[str] = KEYS,
    pos: str = "pos",
    before: int = 0,
) -> DataFrame:
    """Vectorised step over bounded blocks of consecutive rows, each with ``before`` borrowed rows.

    ``fn`` sees rows in order and must return the same number of rows; borrowed ones are dropped.
    """
    size = max(block_rows(df), before)
    blk, offset = _block(pos, size), F.col(pos) % size
    homes = [F.struct(blk.alias("b"), F.lit(False).alias("h"))]
    if before:
        homes.append(F.when(offset >= size - before, F.struct((blk + 1).alias("b"), F.lit(True).alias("h"))))
    spread = df.withColumn("_home", F.explode(F.array_compact(F.array(*homes))))
    spread = spread.withColumns({"_b": F.col("_home.b"), "_h": F.col("_home.h")}).drop("_home")
    names = schema.fieldNames()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos, ignore_index=True)
        return fn(pdf.drop(columns=["_b", "_h"]))[~pdf["_h"].to_numpy(dtype=bool)][names]

    return spread.groupBy(*keys, "_b").applyInPandas(run, schema)

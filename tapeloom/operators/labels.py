"""Labels on bars ``(instrument, pos, ts, close)`` for events ``(instrument, t0, ...)``.

Event windows are looked up by as-of joins and scanned through bounded blocks of bars, so neither a
long barrier nor a dominant instrument gathers its rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.plans.series import KEYS, asof, asof_many, ewm_sums, framed, lagged, packed, position, running, span_blocks

DAY_US = 86_400_000_000
BLOCK = 256


def us(c: str | Column) -> Column:
    return F.unix_micros(c)


def level(v: float | str) -> Column:
    """A setting: a constant, or the name of a column of the events."""
    return F.col(v) if isinstance(v, str) else F.lit(v)


# --------------------------------------------------------------------------- event windows
def locate(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Add ``p0`` (first bar at or after t0) and ``p1`` (last bar at or before t1; null t1: last bar)."""
    last = bars.groupBy(*KEYS).agg(F.max("pos").alias("_last"))
    far = F.coalesce(us("t1"), F.lit((1 << 62)))
    found = asof_many(events, bars, [({"p0": "pos"}, us("t0"), True), ({"p1": "pos"}, far, False)], right_on=us("ts"))
    return (
        found.join(last, list(KEYS), "left")
        .withColumn("p1", F.coalesce("p1", "_last"))
        .drop("_last")
        .where(F.col("p0").isNotNull())
    )


def range_aggregate(
    bars: DataFrame, spans: DataFrame, sums: dict[str, str], *, id_cols: Sequence[str], size: int = 4096
) -> DataFrame:
    """Per span, the sum over bars ``p0..p1`` of each column (null counts as 0), plus ``n_bars``.

    Differences of prefix sums kept as block total and in-block prefix: a span meets its two edge bars
    only, however many it covers.
    """
    cols = list(dict.fromkeys(sums.values()))
    blk = F.floor(F.col("pos") / size).cast("long")
    base = bars.select(*KEYS, "pos", blk.alias("blk"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    before = Window.partitionBy(*KEYS).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = base.groupBy(*KEYS, "blk").agg(*[F.sum(c).alias(c) for c in cols])
    carry = totals.select(*KEYS, "blk", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"_c_{c}") for c in cols])
    local = Window.partitionBy(*KEYS, "blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    prefix = base.withColumns({f"_l_{c}": F.sum(c).over(local) for c in cols}).join(carry, [*KEYS, "blk"])
    ends = F.array(F.struct(F.col("p0").alias("pos"), F.lit(False).alias("end")), F.struct(F.col("p1").alias("pos"), F.lit(True).alias("end")))
    edges = spans.select(*KEYS, *id_cols, "p0", "p1", F.explode(ends).alias("_e")).select(*KEYS, *id_cols, "p0", "p1", "_e.*")

    def part(c: str) -> Column:
        far = F.sum(F.when(F.col("end"), F.col(f"_c_{c}")).otherwise(-F.col(f"_c_{c}")))
        near = F.sum(F.when(F.col("end"), F.col(f"_l_{c}")).otherwise(F.col(c) - F.col(f"_l_{c}")))
        return F.when(F.col("p1") >= F.col("p0"), far + near).otherwise(0.0)

    out = edges.join(prefix, [*KEYS, "pos"]).groupBy(*KEYS, *id_cols, "p0", "p1").agg(*[part(c).alias(n) for n, c in sums.items()])
    return out.withColumn("n_bars", F.col("p1") - F.col("p0") + 1)


# --------------------------------------------------------------------------- fixed horizon
def fixed_horizon(bars: DataFrame, events: DataFrame, *, horizon: int, tau: float) -> DataFrame:
    """Sign of the return over ``horizon`` bars beyond +-tau (strict); events must fall on a bar."""
    ahead = lagged(bars.select(*KEYS, "pos", "ts", "close"), {"_next": F.col("close")}, n=-horizon)
    r = F.col("_next") / F.col("close") - 1
    return (
        events.select(*KEYS, "t0")
        .join(ahead.withColumnRenamed("ts", "t0"), [*KEYS, "t0"])
        .where(F.col("_next").isNotNull())
        .select(*KEYS, "t0", r.alias("ret"), F.when(r > tau, 1).when(r < -tau, -1).otherwise(0).alias("bin"))
    )


# --------------------------------------------------------------------------- volatility and barriers
def daily_volatility(bars: DataFrame, *, span: int = 100, days: int = 1) -> DataFrame:
    """Bias-corrected exponential deviation of one-day returns; the first value is null."""
    closes = bars.select(*KEYS, "pos", "ts", "close")
    prior = asof(
        closes, closes, {"_prev": "close"}, left_on=us("ts") - days * DAY_US, right_on=us("ts"), strict=True
    ).where(F.col("_prev").isNotNull())
    prior = prior.withColumn("ret", F.col("close") / F.col("_prev") - 1).drop("_prev")
    start = prior.groupBy(*KEYS).agg(F.min("pos").alias("_first"))
    prior = prior.join(start, list(KEYS)).withColumn("k", F.col("pos") - F.col("_first")).drop("_first")
    beta = 1 - 2.0 / (span + 1.0)
    sums = ewm_sums(prior, {"_x": F.col("ret"), "_xx": F.col("ret") * F.col("ret")}, beta, pos="k")
    n = F.col("k") + 1
    w1 = (1 - F.pow(F.lit(beta), n)) / (1 - beta)
    w2 = (1 - F.pow(F.lit(beta * beta), n)) / (1 - beta * beta)
    var = F.col("_xx") / w1 - F.pow(F.col("_x") / w1, 2)
    fixed = F.greatest(var, F.lit(0.0)) * w1 * w1 / (w1 * w1 - w2)
    return sums.withColumn("vol", F.when(F.col("k") > 0, F.sqrt(fixed))).select(*KEYS, "pos", "ts", "close", "ret", "vol")


def vertical_barrier(bars: DataFrame, events: DataFrame, *, days: float | str) -> DataFrame:
    """First bar at or after t0 + days (constant or column) as ``t1``; events without one are absent."""
    until = us("t0") + (level(days) * F.lit(DAY_US)).cast("long")
    found = asof(events.select(*KEYS, "t0", until.alias("_until")), bars, {"t1": "ts"}, left_on=F.col("_until"), right_on=us("ts"), forward=True)
    return found.where(F.col("t1").isNotNull()).drop("_until")


def first_touch(bars: DataFrame, events: DataFrame, *, pt: float | str, sl: float | str, size: int = BLOCK, levels: Sequence[int] | None = None) -> DataFrame:
    """Earliest profit-taking and stop-loss times of each event's path, null when untouched.

    ``events`` has t0, t1 (nullable vertical barrier), trgt and side.  The search goes from coarse to
    fine: of the blocks an event overlaps only the first whole one whose price range reaches the barrier
    is kept (it holds a touch for sure), and the cut ones at the edges before it; bars are read for the last level only.
    ``levels`` are block lengths, each a multiple of the next (256 x ``size``, then ``size``).
    ``pt`` and ``sl`` are constants or columns of the events; a barrier at 0 is switched off.
    """
    levels = levels or (256 * size, size)
    cols = [c for c in events.columns if c not in KEYS]
    spans = locate(bars, events)
    spans = spans.join(bars.select(*KEYS, F.col("pos").alias("p0"), F.col("close").alias("_c0")), [*KEYS, "p0"])
    goals = [F.when(level(v) > 0, F.lit(g)) for g, v in (("pt", pt), ("sl", sl)) if isinstance(v, str) or v > 0]
    untouched = spans.select(*KEYS, *cols, F.lit(None).cast("string").alias("goal"), F.lit(None).cast("timestamp").alias("ts"))
    if goals:
        ranges = spans.withColumns({"goal": F.explode(F.array_compact(F.array(*goals))), "lo": F.col("p0"), "hi": F.col("p1")})
        event = [*KEYS, *cols, "_c0", "p0", "p1", "goal"]

        def hit(price: Column) -> Column:
            gain = (price / F.col("_c0") - 1) * F.col("side")
            return F.when(F.col("goal") == "pt", gain > level(pt) * F.col("trgt")).otherwise(gain < -level(sl) * F.col("trgt"))

        for size in levels:
            blk = F.floor(F.col("pos") / size).cast("long")
            extremes = bars.groupBy(*KEYS, blk.alias("blk")).agg(F.max("close").alias("_hi"), F.min("close").alias("_lo"))
            met = span_blocks(ranges, "lo", "hi", size=size).join(extremes, [*KEYS, "blk"]).where(hit(F.col("_hi")) | hit(F.col("_lo")))
            inside = (F.col("blk") * size >= F.col("p0")) & ((F.col("blk") + 1) * size - 1 <= F.col("p1"))
            found = met.groupBy(*event).agg(F.min(F.when(inside, F.col("blk"))).alias("_whole"), F.collect_set(F.when(~inside, F.col("blk"))).alias("_cut"))
            kept = F.array_compact(F.concat(F.filter("_cut", lambda x: F.col("_whole").isNull() | (x < F.col("_whole"))), F.array("_whole")))
            ranges = found.withColumn("blk", F.explode(kept)).select(
                *event, F.greatest("p0", F.col("blk") * size).alias("lo"), F.least("p1", (F.col("blk") + 1) * size - 1).alias("hi")
            )
        last = F.floor(F.col("pos") / levels[-1]).cast("long").alias("blk")
        path = span_blocks(ranges, "lo", "hi", size=levels[-1]).join(bars.select(*KEYS, "pos", "close", F.col("ts").alias("_ts"), last), [*KEYS, "blk"])
        touches = path.where(F.col("pos").between(F.col("lo"), F.col("hi")) & hit(F.col("close")))
        untouched = untouched.unionByName(touches.select(*KEYS, *cols, "goal", F.col("_ts").alias("ts")))
    at = lambda g: F.min(F.when(F.col("goal") == g, F.col("ts")))
    return untouched.groupBy(*KEYS, *cols).agg(at("sl").alias("sl_ts"), at("pt").alias("pt_ts"))


def barrier_events(
    bars: DataFrame,
    events: DataFrame,
    vol: DataFrame,
    *,
    pt_sl: tuple[float | str, float | str],
    min_ret: float | str,
    t1: DataFrame | None = None,
    num_days: float | str | None = None,
) -> DataFrame:
    """First barrier touched per event.  A ``side`` column makes the barriers asymmetric and is kept;
    without one both use ``pt_sl[0]`` unless the pair is given explicitly.  Settings are constants or columns of
    the events, so events of many configurations can share one job."""
    sided = "side" in events.columns
    settings = list(dict.fromkeys(v for v in (*pt_sl, min_ret, num_days) if isinstance(v, str)))
    base = events.select(*KEYS, "t0", *(["side"] if sided else []), *settings)
    if not sided:
        base = base.withColumn("side", F.lit(1))
    ev = asof(base, vol, {"trgt": "vol"}, left_on=us("t0"), right_on=us("ts"), forward=True)
    ev = ev.where(F.col("trgt") > level(min_ret))
    if num_days is not None:
        t1 = vertical_barrier(bars, ev, days=num_days)
    if t1 is not None:
        ev = ev.join(t1.select(*KEYS, "t0", "t1"), [*KEYS, "t0"], "left")
    else:
        ev = ev.withColumn("t1", F.lit(None).cast("timestamp"))
    hit = first_touch(bars, ev, pt=pt_sl[0], sl=pt_sl[1])
    out = hit.withColumn("t1", F.least("t1", "sl_ts", "pt_ts")).drop("sl_ts", "pt_ts", *settings)
    return out if sided else out.drop("side")


def triple_barrier_events(bars, events, vol, *, pt_sl, min_ret, num_days=None, t1=None) -> DataFrame:
    """Symmetric-side triple barrier with separate profit and loss multiples."""
    return barrier_events(bars, events.drop("side"), vol, pt_sl=pt_sl, min_ret=min_ret, num_days=num_days, t1=t1)


def meta_events(bars, events, vol, *, pt_sl, min_ret, num_days=None, t1=None) -> DataFrame:
    """With ``side``: asymmetric barriers on the sided return; without: symmetric ``pt_sl[0]``."""
    pair = pt_sl if "side" in events.columns else (pt_sl[0], pt_sl[0])
    return barrier_events(bars, events, vol, pt_sl=pair, min_ret=min_ret, num_days=num_days, t1=t1)


def _returns(bars: DataFrame, events: DataFrame) -> DataFrame:
    done = events.where(F.col("t1").isNotNull())
    last = bars.groupBy(*KEYS).agg(F.max_by("close", "pos").alias("_lc"))
    done = asof_many(done, bars, [({"_c0": "close"}, us("t0"), True), ({"_c1": "close"}, us("t1"), True)], right_on=us("ts"))
    exit_ = F.coalesce("_c1", "_lc")
    return done.join(last, list(KEYS)).withColumn("ret", exit_ / F.col("_c0") - 1).drop("_c0", "_c1", "_lc")


def label_returns(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Return over [t0, t1] and its sign (0 kept); open events are dropped."""
    out = _returns(bars, events)
    return out.withColumn("bin", F.signum("ret").cast("int"))


def meta_labels(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Sided return and 0/1 label; without ``side`` the plain sign."""
    if "side" not in events.columns:
        return label_returns(bars, events)
    out = _returns(bars, events).withColumn("ret", F.col("ret") * F.col("side"))
    return out.withColumn("bin", (F.col("ret") > 0).cast("int"))


def drop_rare_labels(events: DataFrame, *, min_pct: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Drop the rarest class while its share is at most ``min_pct`` and three classes remain.

    Classes are few, so the repeated drop becomes windows over the class counts.
    """
    counts = events.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("_n"))
    rank = Window.partitionBy(*keys).orderBy("_n", "bin")
    rest = rank.rowsBetween(0, Window.unboundedFollowing)
    drop = (F.col("_n") / F.sum("_n").over(rest) <= min_pct) & (F.count(F.lit(1)).over(rest) >= 3)
    kept = (
        counts.withColumn("_drop", drop.cast("int"))
        .withColumn("_all", F.min("_drop").over(rank.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("_all") == 0)
        .select(*keys, "bin")
    )
    return events.join(kept, [*keys, "bin"], "left_semi")


def moving_average_side(bars: DataFrame, events: DataFrame, *, window: int = 20) -> DataFrame:
    """+1 where the close known at the event is above its moving average, else -1."""
    ma = framed(
        bars,
        lambda w: {
            "_ma": F.when(
                F.count("close").over(w.rowsBetween(-(window - 1), 0)) == window,
                F.avg("close").over(w.rowsBetween(-(window - 1), 0)),
            )
        },
        before=window - 1,
    )
    found = asof(events, ma, {"_c": "close", "_m": "_ma"}, left_on=us("t0"), right_on=us("ts"))
    up = F.coalesce(F.col("_c") > F.col("_m"), F.lit(False))
    return found.withColumn("side", F.when(up, 1).otherwise(-1)).drop("_c", "_m")


def label_distribution(methods: dict[str, DataFrame]) -> DataFrame:
    """Counts of each label per method, 0 where a method never produced it."""
    frames = [df.select(F.lit(m).alias("method"), F.col("bin").cast("int").alias("bin")) for m, df in methods.items()]
    both = frames[0]
    for f in frames[1:]:
        both = both.unionByName(f)
    return both.groupBy("bin").pivot("method", list(methods)).agg(F.count(F.lit(1))).fillna(0)


def events_with_labels(events: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per event that has both an end and a label."""
    return (
        events.join(labels.select(*KEYS, "t0", "ret", "bin"), [*KEYS, "t0"], "full")
        .where(F.col("t1").isNotNull() & F.col("bin").isNotNull())
    )


def path_barrier_touch(paths: DataFrame, *, width: float, keys: Sequence[str] = ("path",), idx: str = "idx") -> DataFrame:
    """First index at which the compounded log return of a path reaches +-width."""
    run = running(paths, {"_p": ("sum", F.log1p("r"))}, keys=keys, pos=idx)
    return run.where(F.abs("_p") >= width).groupBy(*keys).agg(F.min(idx).alias("touch"))

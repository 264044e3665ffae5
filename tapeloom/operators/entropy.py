"""Entropy features: encodings per observation, messages per bounded window, estimators per message."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.plans.series import KEYS, div, framed, position, quantiles, running

LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _letter(code: Column) -> Column:
    return F.substring(F.lit(LETTERS), code.cast("int") + 1, F.lit(1))


# --------------------------------------------------------------------------- encodings
def binary_code(df: DataFrame, x: str) -> DataFrame:
    """'1' for gains, '0' for losses; zeros are dropped."""
    return df.where(F.col(x) != 0).withColumn("code", F.when(F.col(x) > 0, "1").otherwise("0"))


def quantile_code(df: DataFrame, x: str, *, letters: int = 4, keys: Sequence[str] = KEYS) -> DataFrame:
    """Letter = number of interior quantile edges at or below the value."""
    if not 1 <= letters <= len(LETTERS):
        raise ValueError(f"letters must be 1..{len(LETTERS)}")
    probs = [i / letters for i in range(1, letters)]
    rows = df.where(F.col(x).isNotNull())
    if not probs:
        return rows.withColumn("code", F.lit("0"))
    edges = quantiles(rows, x, probs, keys=keys)
    code = F.lit(0)
    for i in range(len(probs)):
        code = code + (F.col(x) >= F.col(f"q{i}")).cast("int")
    return rows.join(edges, list(keys)).withColumn("code", _letter(code)).drop(*[f"q{i}" for i in range(len(probs))])


def sigma_code(df: DataFrame, x: str, *, sigma: float | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Letter = step of width sigma (default a quarter deviation) above the minimum."""
    rows = df.where(F.col(x).isNotNull())
    s = F.lit(float(sigma)) if sigma is not None else F.stddev_pop(x) / 4
    stats = rows.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), s.alias("_sg"))
    top = F.greatest(F.ceil(div(F.col("_hi") - F.col("_lo"), F.col("_sg"))) - 1, F.lit(0))
    code = F.least(F.floor(div(F.col(x) - F.col("_lo"), F.col("_sg"))), top)
    return rows.join(stats, list(keys)).withColumn("code", _letter(code)).drop("_lo", "_hi", "_sg")


def messages(coded: DataFrame, *, window: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """One string per (instrument, window) of ``window`` consecutive codes; the last may be shorter."""
    dense = position(coded.select(*keys, "pos", "code"), ["pos"], keys=keys, name="_i")
    return dense.groupBy(*keys, F.floor(F.col("_i") / window).cast("long").alias("window")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "code"))), lambda r: r["code"]), "").alias("msg")
    )


# --------------------------------------------------------------------------- estimators per message
def plug_in(msgs: DataFrame, *, word: int, keys: Sequence[str] = (*KEYS, "window")) -> DataFrame:
    """Maximum-likelihood entropy per symbol of ``word``-letter words (the final word is not counted)."""
    long_enough = msgs.where(F.length("msg") > word)
    words = long_enough.select(
        *keys, F.explode(F.transform(F.sequence(F.lit(1), F.length("msg") - word), lambda i: F.substring("msg", i, F.lit(word)))).alias("_w")
    )
    counts = words.groupBy(*keys, "_w").agg(F.count(F.lit(1)).alias("_c"))
    n = F.sum("_c")
    return counts.groupBy(*keys).agg(
        ((F.log2(n.cast("double")) - F.sum(F.col("_c") * F.log2(F.col("_c").cast("double"))) / n) / word).alias("h_plugin")
    )


def lz_words(m: str) -> list[str]:
    """Greedy dictionary of a message: each new word is the shortest not seen before."""
    seen: dict[str, None] = {}
    start = 0
    for end in range(1, len(m) + 1):
        w = m[start:end]
        if w not in seen:
            seen[w] = None
            start = end
    return list(seen)


def with_lempel_ziv(msgs: DataFrame, *, name: str = "words") -> DataFrame:
    @F.pandas_udf("array<string>")
    def parse(msg: pd.Series) -> pd.Series:
        return msg.map(lz_words)

    return msgs.withColumn(name, parse("msg"))


def match_length(msg: str, i: int, n: int) -> int:
    """1 + length of the longest prefix of ``msg[i:i+n]`` starting in the ``n`` symbols before ``i``.

    A longer match exists only where a shorter one does, so the length is grown step by step.
    """
    best = 0
    while best < n:
        w = msg[i : i + best + 1]
        # occurrence may run past i but must start before it
        if msg.find(w, i - n, i + len(w) - 1) < 0:
            break
        if len(w) < best + 1:
            return len(w) + 1
        best += 1
    return best + 1


def entropy_rate(msg: str, window: int | None = None) -> float | None:
    """Average match-length entropy of a message (expanding, or with a fixed window)."""
    half = len(msg) // 2
    if window is not None:
        window = min(window, half)
    points = range(1, half + 1) if window is None else range(window, len(msg) - window + 1)
    if half < 1 or len(points) == 0:
        return None
    return float(np.mean([math.log2((window or i) + 1) / match_length(msg, i, window or i) for i in points]))


def with_entropy_rate(msgs: DataFrame, *, window: int | None = None, name: str = "h_konto") -> DataFrame:
    """Entropy rate and redundancy of each message (Arrow batches of strings)."""

    @F.pandas_udf("double")
    def rate(msg: pd.Series) -> pd.Series:
        distinct = {m: entropy_rate(m, window) for m in msg.unique()}
        return msg.map(distinct).astype(float)

    out = msgs.withColumn(name, rate("msg"))
    out = out.withColumn(name, F.when(~F.isnan(name), F.col(name)))
    width = F.when(F.length("msg") > 1, F.log2(F.length("msg").cast("double")))
    return out.withColumn("redundancy", 1 - F.col(name) / width)


# --------------------------------------------------------------------------- adverse selection
def order_flow_imbalance(bars: DataFrame, *, name: str = "imbalance") -> DataFrame:
    """Buy share of bar volume; one half for an empty bar."""
    b, s = F.col("buy_volume").cast("double"), F.col("sell_volume").cast("double")
    return bars.withColumn(name, F.coalesce(div(b, b + s), F.lit(0.5)))


def average_rank(df: DataFrame, x: str, *, name: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Fractional rank with average ties, through counts of distinct values."""
    keys = list(keys)
    counts = df.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running(position(counts, [x], keys=keys, name="_p"), {"_cum": ("sum", F.col("_c"))}, keys=keys, pos="_p")
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    share = (F.col("_cum") - F.col("_c") + (F.col("_c") + 1) / 2.0) / F.col("_n")
    table = ranked.join(total, keys).select(*keys, x, share.alias(name))
    return df.join(table, [*keys, x])


def adverse_selection(bars: DataFrame, *, letters: int = 5, window: int = 30) -> DataFrame:
    """Rank of the entropy rate of the last ``window`` imbalance codes among all windows of the series."""
    if window % 2 or window < 4:
        raise ValueError("window must be even and at least 4")
    coded = quantile_code(order_flow_imbalance(bars).select(*KEYS, "pos", "imbalance"), "imbalance", letters=letters)
    rolled = framed(
        coded,
        lambda w: {
            "msg": F.when(
                F.count("code").over(w.rowsBetween(-(window - 1), 0)) == window,
                F.array_join(F.collect_list("code").over(w.rowsBetween(-(window - 1), 0)), ""),
            )
        },
        before=window - 1,
    ).where(F.col("msg").isNotNull())
    scored = with_entropy_rate(rolled.select(*KEYS, "pos", "msg"))
    return average_rank(scored, "h_konto", name="adverse_selection").select(*KEYS, "pos", "h_konto", "adverse_selection")


def encoding_report(df: DataFrame, x: str, *, window: int, letters: int = 4, word: int = 1) -> DataFrame:
    """Alphabet size and entropies of the three encodings, averaged over messages."""
    parts = []
    for method, coded in (
        ("binary", binary_code(df, x)), ("quantile", quantile_code(df, x, letters=letters)), ("sigma", sigma_code(df, x)),
    ):
        parts.append(messages(coded, window=window).withColumn("method", F.lit(method)))
    msgs = parts[0].unionByName(parts[1]).unionByName(parts[2])
    even = msgs.withColumn("msg", F.expr("substring(msg, 1, length(msg) - length(msg) % 2)"))
    plug = plug_in(msgs, word=word, keys=(*KEYS, "method", "window"))
    size = msgs.withColumn("_a", F.size(F.array_distinct(F.split("msg", ""))))
    joined = with_entropy_rate(even.where(F.length("msg") > 0)).join(plug, [*KEYS, "method", "window"], "left").join(
        size.select(*KEYS, "method", "window", "_a"), [*KEYS, "method", "window"]
    )
    return joined.groupBy(*KEYS, "method").agg(
        F.max("_a").alias("alphabet"), F.avg("h_plugin").alias("h_plugin"), F.avg("h_konto").alias("h_konto")
    )

"""How far the word use of each source is from the other sources of its language, and which terms make a source stand out.

Terms are runs of letters (and of anything beyond ASCII) with A-Z lowered; a language keeps the terms of at least ``MIN_DOCS`` of its
documents. For a group (lang, source), p of a term is 1 + floor(10^9 (count + 1) / (N + V)), with N the group's occurrences of
kept terms and V the language's number of kept terms; q is the same for the other source, or for the language as a whole. The
divergence of a term is floor((p - q)^2 / q).

Run-length columns: terms with one and the same vector of counts over the sources form one class, however many they are; classes
are ordered by their vectors, so neighbours share counts, and cut into shards. In a shard a source is a column of counts, kept as
runs. For a pair of sources the run boundaries are intersected; a piece's divergence times its length is added up. Shards and
blocks of sources make the grid on which the work is dealt out; sums of shards are added by Spark. Source-by-source rows are the
result asked for; terms take no part in them.

Sums fit 64 bits: the p of a group add up to at most 10^9 + V, so a sum of p^2 / q is below 10^9 (10^9 + V).

Nulls: null text, lang and source are ''. Every row is a document, repeated ones too. A group without terms has p of count 0.
Languages without kept terms give pairs of value 0 and no terms. Ties are ordered by item (UTF-8). Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import small_batches, stored

MIN_DOCS, TOP_TERMS, SCALE = 3, 200, 10**9
#: Classes in one shard, sources in one block, and entries of a task's counter before it is written out.
SHARD, BLOCK, HELD = 4_096, 64, 400_000
#: Parts into which the shards of one language are dealt when they meet its sources.
SALTS = 32

_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counter(text: bytes, step: int = 1 << 20) -> Counter:
    """Occurrences of each term; a long text is split piece by piece."""
    flat, out, at = text.translate(_TERM), Counter(), 0
    while at < len(flat):
        end = flat.find(b" ", at + step)
        end = len(flat) if end < 0 else end
        out.update(flat[at:end].split())
        at = end
    return out


def term_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, term, n, docs), added up; tasks count before anything moves."""
    most = HELD

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = defaultdict(Counter)
        docs: dict[tuple, Counter] = defaultdict(Counter)

        def rows() -> Iterator[pa.RecordBatch]:
            for group, c in n.items():
                words, held = list(c), docs[group]
                for i in range(0, len(words), 1 << 15):
                    part = words[i : i + (1 << 15)]
                    labels = [pa.array([x] * len(part)) for x in group]
                    numbers = [pa.array([x[w] for w in part], pa.int64()) for x in (c, held)]
                    yield pa.RecordBatch.from_arrays([*labels, pa.array(part, pa.binary()).cast(pa.string()), *numbers], ["lang", "source", "term", "n", "docs"])
            n.clear()
            docs.clear()

        size = 0
        for b in small_batches(batches):
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found, c = term_counter(text.encode()), n[lang, source]
                size -= len(c)
                c.update(found)
                size += len(c)
                docs[lang, source].update(found.keys())
                if size > most:
                    yield from rows()
                    size = 0
        yield from rows()

    text = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = text.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def vocabulary(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """A row (lang, term, total, vector) per kept term; the vector lists (source, n) in order of source."""
    vector = F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector")
    by_term = term_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), vector)
    return by_term.where(F.col("docs") >= min_docs).drop("docs")


def rate(n: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE (n + 1) / (total + kept)), exact for any counts."""
    return F.expr(f"1L + (cast({n} + 1L AS decimal(20,0)) * cast({SCALE} AS decimal(11,0))) div cast({total} + {kept} AS decimal(20,0))")


def _shards(classes: DataFrame) -> DataFrame:
    """Run-length columns: a row (lang, shard, source, counts, ends) for each source that occurs in a shard, and one of a
    null source with the shard's length."""
    # ranges by the start of the vector and a hash: Spark samples the keys on the driver, and whole vectors are long
    dealt = classes.repartitionByRange("lang", F.slice("vector", 1, 2), F.xxhash64("vector")).sortWithinPartitions("lang", "vector")

    most = SHARD

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, shard = None, 0
        widths: list[np.ndarray] = []
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        names: dict[str, int] = {}
        held = 0

        def made() -> pa.RecordBatch:
            width = np.concatenate(widths)
            ends = np.cumsum(width)
            at, source, n = (np.concatenate(x) for x in zip(*rows, strict=True))
            by = np.lexsort((at, source))
            at, source, n = at[by], source[by], n[by]
            cuts = np.flatnonzero(np.diff(source)) + 1
            which, counts, stops = [None], [[0]], [[int(ends[-1])]]
            label = list(names)
            for a, z in zip([0, *cuts], [*cuts, len(source)], strict=True):
                column = np.zeros(len(width), np.int64)
                column[at[a:z]] = n[a:z]
                last = np.flatnonzero(np.append(column[1:] != column[:-1], True))
                which.append(label[source[a]])
                counts.append(column[last])
                stops.append(ends[last])
            k = len(which)
            return pa.RecordBatch.from_arrays([pa.array([lang] * k), pa.array([shard] * k, pa.int32()), pa.array(which, pa.string()), pa.array(counts, pa.list_(pa.int64())), pa.array(stops, pa.list_(pa.int64()))], ["lang", "shard", "source", "counts", "ends"])

        for b in batches:
            langs = b.column(0)
            edges = [0, *(np.flatnonzero(langs.slice(1).to_pandas().to_numpy() != langs.slice(0, b.num_rows - 1).to_pandas().to_numpy()) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            for a, z in zip(edges, edges[1:], strict=False):
                while a < z:
                    if lang is not None and (langs[a].as_py() != lang or held >= most):
                        yield made()
                        shard, widths, rows, names, held = shard + 1, [], [], {}, 0
                    lang = langs[a].as_py()
                    part = b.slice(a, min(z - a, most - held))
                    vector = part.column(1)
                    size = np.diff(vector.offsets.to_numpy())
                    entries = vector.flatten()
                    source = entries.field(0).dictionary_encode()
                    local = np.array([names.setdefault(s, len(names)) for s in source.dictionary.to_pylist()], np.int64)
                    rows.append((np.repeat(np.arange(held, held + part.num_rows), size), local[source.indices.to_numpy()], entries.field(1).to_numpy()))
                    widths.append(part.column(2).to_numpy())
                    held += part.num_rows
                    a += part.num_rows
        if held:
            yield made()

    told = dealt.select("lang", "vector", "width").mapInArrow(columns, "lang string, shard int, source string, counts array<long>, ends array<long>")
    return told.withColumn("shard", F.spark_partition_id().cast("long") * 2**31 + F.col("shard"))


def rates(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """p of the counts by whole numbers of any size, once per different count."""
    different, at = np.unique(counts, return_inverse=True)
    return np.array([1 + SCALE * (c + 1) // (total + kept) for c in different.tolist()], np.int64)[at]


def _cell(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums over one shard for the pairs of two blocks of sources, or of one block with itself."""
    rows = rows.sort_values("source")
    lang, one, two = (rows[c].iat[0] for c in ("lang", "low", "high"))
    columns = [(s, rates(np.asarray(c), n, v), np.asarray(e), k) for s, c, e, n, v, k in zip(*(rows[c] for c in ("source", "counts", "ends", "n", "kept", "block")), strict=True)]
    out = []
    for i, (a, p, pe, ka) in enumerate(columns):
        for b, q, qe, kb in columns[:i]:
            if one == two or ka != kb:
                ends = np.union1d(pe, qe)
                length = np.diff(ends, prepend=0)
                x, y = p[np.searchsorted(pe, ends)], q[np.searchsorted(qe, ends)]
                square = (x - y) ** 2
                out += [(lang, a, b, int((square // y * length).sum())), (lang, b, a, int((square // x * length).sum()))]
    return pd.DataFrame(out, columns=["lang", "source", "item", "value"])


def _pairs(classes: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows (lang, source, item, value) for all pairs of sources of a language."""
    runs = stored(_shards(classes), "runs")
    # every source of the language has a column in every shard: its own runs, or one run of zeros
    salted = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    lengths = runs.where("source IS NULL").select("lang", "shard", F.col("ends").alias("whole"), F.pmod(F.xxhash64("shard"), F.lit(SALTS)).cast("int").alias("salt"))
    columns = lengths.join(facts.select("*", salted), ["lang", "salt"]).join(runs.where("source IS NOT NULL"), ["lang", "shard", "source"], "left")
    columns = columns.withColumns({"counts": F.coalesce("counts", F.array(F.lit(0).cast("long"))), "ends": F.coalesce("ends", "whole")})
    columns = columns.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = columns.select("lang", "shard", "source", "n", "kept", "block", "counts", "ends", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    sums = cells.groupBy("lang", "shard", "low", "high").applyInPandas(_cell, "lang string, source string, item string, value long")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    bare = facts.where("kept = 0").select("lang", "source")
    bare = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    return sums.unionByName(bare)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): all other sources ('pair'), and the ``top`` terms used more than in the
    language ('term')."""
    kept = stored(vocabulary(docs, min_docs), "vocabulary")
    classes = stored(kept.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("width")), "classes")
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("all_n"))
    sizes = classes.select("lang", "width", F.explode("vector").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum(F.col("e.n") * F.col("width")).alias("n"))
    facts = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    facts = facts.select("lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "kept", "all_n")))
    facts = facts.withColumn("blocks", F.ceil(F.count(F.lit(1)).over(Window.partitionBy("lang")) / BLOCK)).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")))
    facts = stored(facts, "groups")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(classes, facts).withColumn("rank", F.row_number().over(order))
    used = kept.select("lang", F.col("term").alias("item"), "total", F.explode("vector").alias("e")).select("lang", "item", "total", F.col("e.source").alias("source"), F.col("e.n").alias("count"))
    used = used.join(facts, ["lang", "source"]).withColumns({"p": rate("count", "n", "kept"), "q": rate("total", "all_n", "kept")}).where("p > q")
    told = used.select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(told.withColumn("part", F.lit("term")).select(*columns))

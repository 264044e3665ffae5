"""Lines that many documents share stay in one document only.

Texts are split at line feeds. A line's key is the line without blanks at both ends and with A-Z lowered; keys of at least
``MIN_CHARS`` code points that at least ``MIN_DOCS`` documents hold lose all their lines but those of the largest doc_id.

128-bit hashes of the keys are range-partitioned together with document and position (so a key of any frequency spreads over as many
partitions as its rows need) and sorted, the largest document first. Each partition is streamed once: a run of one hash is settled
as soon as it is seen to its end or has shown enough documents. Only the first and the last run of a partition may go on
elsewhere; one row about each (at most two per partition) settles them. The result is one compressed bitmap of kept lines
per document that loses any; texts take no part in the range shuffle.

Nulls: a null text is one empty line; rows without doc_id are in no document, count for nothing and keep all lines. Rows that repeat a
doc_id are one document: it is counted once, and all its rows keep or lose a line alike; equal rows count as one. Empty texts have one
line. Lines are at home in memory one text at a time, however long. Extra columns stay; added names replace clashing ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import small_batches, stored

MIN_CHARS, MIN_DOCS = 40, 5
BLANKS = " \t\n\x0b\x0c\r"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _with_print(docs: DataFrame) -> DataFrame:
    """Adds the fingerprint that tells apart the rows of one doc_id."""
    return docs.withColumn("_text_print", F.xxhash64(F.coalesce("text", F.lit(""))))


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row (h1, h2, doc_id, text_print, pos) for each line that is long enough; equal rows of a task give theirs once."""
    fields = f"h1 long, h2 long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_print long, pos int"

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set = set()  # a task remembers a bounded number of rows; what it forgets is only written again
        for b in small_batches(batches):
            h1, h2, at, pos = [], [], [], []
            ids, prints = b.column(0), b.column(2)
            for i, (d, text, fp) in enumerate(zip(ids.to_pylist(), b.column(1).to_pylist(), prints.to_pylist(), strict=True)):
                if (d, fp) in done:
                    continue
                if len(done) >= 1 << 17:
                    done.clear()
                done.add((d, fp))
                for k, line in enumerate(text.split("\n")):
                    if len(line) >= min_chars and len(key := line.strip(BLANKS)) >= min_chars:
                        h = xxhash.xxh3_128_intdigest(key.encode().translate(_LOWER))
                        h1.append((h >> 64) - (1 << 63))
                        h2.append((h & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                        at.append(i)
                        pos.append(k)
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), ids.take(rows), prints.take(rows), pa.array(pos, pa.int32())], ["h1", "h2", "doc_id", "text_print", "pos"])

    told = _with_print(docs).where(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars))
    return told.select("doc_id", "text", "_text_print").mapInArrow(keys, fields)


def _changes(*columns: pa.Array) -> np.ndarray:
    """True where a row differs from the one before it (False at the first)."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    for c in columns:
        out[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return out


class _Runs:
    """Streams sorted rows and tells which lines go: ``feed`` for each batch, ``end`` once."""

    def __init__(self, min_docs: int):
        self.min_docs, self.hash, self.ordinal = min_docs, None, -1
        self.docs, self.first, self.last = 0, None, None  # of the open run
        self.waiting: list[pa.Table] = []  # its rows, while it may still turn out rare: those of fewer than min_docs documents

    def _settle(self) -> Iterator[tuple[int, pa.Table]]:
        if self.ordinal > 0 and self.docs >= self.min_docs:
            for t in self.waiting:
                yield 0, t.filter(pc.not_equal(t["doc_id"], self.first))
            self.waiting = []

    def _take(self, rows: pa.Table, docs: int) -> Iterator[tuple[int, pa.Table]]:
        """Rows that go on with the open run, and how many documents they add to it."""
        self.docs, self.last = self.docs + docs, rows["doc_id"][-1]
        if self.ordinal == 0:
            yield 1, rows
            return
        self.waiting.append(rows)
        yield from self._settle()

    def _open(self, rows: pa.Table) -> None:
        self.ordinal, self.hash, self.docs, self.first, self.waiting = self.ordinal + 1, (rows["h1"][0], rows["h2"][0]), 0, rows["doc_id"][0], []

    def _edge(self) -> dict:
        return {"h1": self.hash[0], "h2": self.hash[1], "docs": self.docs, "first_doc": self.first, "last_doc": self.last}

    def feed(self, rows: pa.Table) -> Iterator[tuple[int, pa.Table | dict]]:
        rows = rows.combine_chunks()
        n = rows.num_rows
        h1, h2, doc = (rows[c].chunk(0) for c in ("h1", "h2", "doc_id"))
        run = _changes(h1, h2)
        new = run | _changes(doc)
        goes_on = self.hash is not None and (h1[0], h2[0]) == self.hash
        starts = np.flatnonzero(run)
        edges = [0, *starts.tolist(), n]
        if len(edges) > 3:  # runs that begin and end inside the batch
            a, b = edges[1], edges[-2]
            number = np.cumsum(run[a:b]) - 1
            docs = np.bincount(number, weights=new[a:b]).astype(np.int64)
            first = doc.slice(a, b - a).take(pa.array(starts[:-1] - a)).take(pa.array(number))
            common = (docs >= self.min_docs)[number]
            gone = common & pc.not_equal(doc.slice(a, b - a), first).to_numpy(zero_copy_only=False)
            inner = rows.slice(a, b - a).filter(pa.array(gone))
        head = rows.slice(0, edges[1])
        if goes_on:
            yield from self._take(head, int(new[: edges[1]].sum()) + (doc[0] != self.last))
        else:
            if self.hash is not None:
                yield from self._close()
            self._open(head)
            yield from self._take(head, int(new[: edges[1]].sum()) + 1)
        if len(edges) > 2:
            yield from self._close()
            if len(edges) > 3:
                self.ordinal += len(edges) - 3
                yield 0, inner
            tail = rows.slice(edges[-2])
            self._open(tail)
            yield from self._take(tail, int(new[edges[-2] :].sum()))

    def _close(self) -> Iterator[tuple[int, pa.Table | dict]]:
        """The open run is over: what waits is rare, unless it began elsewhere."""
        self.waiting = []
        if self.ordinal == 0:
            yield 2, self._edge()

    def end(self) -> Iterator[tuple[int, pa.Table | dict]]:
        if self.hash is not None:
            yield from ((1, t) for t in self.waiting)
            yield 2, self._edge()


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """A row (doc_id, text_print, pos) for each line that goes."""
    kind = docs.schema["doc_id"].dataType
    order = ["h1", "h2", F.desc("doc_id"), "text_print", "pos"]
    keys = line_keys(docs, min_chars).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType.fromDDL("kind int, h1 long, h2 long, text_print long, pos int, docs long").add("doc_id", kind).add("last_doc", kind)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, form = _Runs(min_docs), None

        def out(kind: int, x: pa.Table | dict) -> pa.RecordBatch:
            if isinstance(x, dict):
                columns = [[x["h1"]], [x["h2"]], [None], [None], [x["docs"]], [x["first_doc"]], [x["last_doc"]]]
                columns = [[v.as_py() if isinstance(v, pa.Scalar) else v for v in c] for c in columns]
                n = 1
            else:
                n = x.num_rows
                columns = [x["h1"], x["h2"], x["text_print"], x["pos"], [None] * n, x["doc_id"], [None] * n]
            arrays = [pa.array([kind] * n, pa.int32())]
            for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), form, form], strict=True):
                arrays.append(pa.array(c, t) if isinstance(c, list) else c.combine_chunks() if c.num_chunks != 1 else c.chunk(0))
            return pa.RecordBatch.from_arrays(arrays, ["kind", "h1", "h2", "text_print", "pos", "docs", "doc_id", "last_doc"])

        for b in batches:
            if b.num_rows:
                form = b.schema.field("doc_id").type
                for k, x in runs.feed(pa.Table.from_batches([b])):
                    if isinstance(x, dict) or x.num_rows:
                        yield out(k, x)
        for k, x in runs.end():
            if isinstance(x, dict) or x.num_rows:
                yield out(k, x)

    told = keys.mapInArrow(stream, schema).withColumn("part", F.spark_partition_id())
    told = stored(told, "line-runs")
    one = Window.partitionBy("h1", "h2").orderBy("part", F.desc("doc_id"))
    edges = told.where("kind = 2").withColumn("again", (F.col("doc_id") == F.lag("last_doc").over(one)).cast("long"))
    edges = edges.groupBy("h1", "h2").agg((F.sum("docs") - F.sum(F.coalesce("again", F.lit(0)))).alias("n"), F.max("doc_id").alias("keeper"))
    # at most two rows from each partition
    open_ = told.where("kind = 1").join(F.broadcast(edges.where(F.col("n") >= min_docs)), ["h1", "h2"]).where(F.col("doc_id") != F.col("keeper"))
    names = ["doc_id", "text_print", "pos"]
    return told.where("kind = 0").select(*names).unionByName(open_.select(*names))


def packed_bits(dropped: np.ndarray) -> bytes:
    """Keep bits (1: the line stays) up to the last dropped line, compressed; later lines stay."""
    bits = np.ones(-(-(int(dropped.max()) + 1) // 8) * 8, np.uint8)
    bits[dropped] = 0
    return zlib.compress(np.packbits(bits).tobytes())


def keep_bits(keep: bytes | None, n: int) -> np.ndarray:
    out = np.ones(n, bool)
    if keep:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:n]
        out[: len(bits)] = bits
    return out


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """A row (doc_id, text_print, keep) for each text that loses lines; ``keep_bits`` reads the bitmap."""
    gone = dropped_lines(docs, min_chars, min_docs).repartition("doc_id", "text_print").sortWithinPartitions("doc_id", "text_print", "pos")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_print", T.LongType()), T.StructField("keep", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = (pa.concat_tables([rest, t]) if rest is not None else t).combine_chunks()
            if not t.num_rows:
                continue
            starts = np.flatnonzero(_changes(t["doc_id"].chunk(0), t["text_print"].chunk(0)))
            if len(starts):
                yield made(t.slice(0, starts[-1]), starts[:-1])
                t = t.slice(starts[-1])
            rest = t
        if rest is not None and rest.num_rows:
            yield made(rest, np.empty(0, np.int64))

    def made(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        t = t.combine_chunks()
        pos, edges = t["pos"].to_numpy(), [0, *starts.tolist(), t.num_rows]
        first = pa.array(edges[:-1], pa.int64())
        keep = [packed_bits(pos[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        return pa.RecordBatch.from_arrays([t["doc_id"].chunk(0).take(first), t["text_print"].chunk(0).take(first), pa.array(keep, pa.binary())], ["doc_id", "text_print", "keep"])

    return gone.mapInArrow(pack, schema)


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with dropped lines gone from ``text`` (null: empty), n_lines (before) and n_dropped added."""
    added = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    docs = docs.drop("n_lines", "n_dropped", "_keep", "_text_print")
    bitmaps = keep_bitmaps(docs, min_chars, min_docs).select(F.col("doc_id").alias("_doc"), F.col("text_print").alias("_print"), F.col("keep").alias("_keep"))
    whole = _with_print(docs)
    whole = whole.join(bitmaps, (F.col("doc_id") == F.col("_doc")) & (F.col("_text_print") == F.col("_print")), "left").select(*docs.columns, "_keep")
    schema, names = T.StructType([*docs.schema.fields, *added]), docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            texts, n, gone = [], [], []
            for text, keep in zip(b.column("text").to_pylist(), b.column("_keep").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                bits = keep_bits(keep, len(lines)) if keep else None
                texts.append("\n".join(lines) if bits is None else "\n".join([x for x, stay in zip(lines, bits.tolist(), strict=True) if stay]))
                n.append(len(lines))
                gone.append(0 if bits is None else len(lines) - int(bits.sum()))
            columns = [pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_lines", "n_dropped"])

    return whole.mapInArrow(cut, schema)

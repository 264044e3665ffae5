"""Removal of repeated 100-byte strings by a distributed merge sort of suffixes that knows common prefixes.

Sorting every suffix is not needed. Each 100-byte window has an anchor: the place of its smallest hash of ``GRAM`` bytes (the leftmost).
Windows that follow each other with one anchor form a suffix of at most 150 bytes; equal windows have equal anchor bytes, so
only suffixes whose anchor bytes occur again somewhere can hold a repeat.

1. Tasks report the anchor hashes of their texts; those that occur again go back to the tasks that hold them.
2. Tasks sort their suffixes with such anchors into runs without repeats (a repeat inside a run is removed at once), front-code the
   runs (length of the prefix shared with the one before, and the rest) and send them to the bucket of the anchor.
3. A bucket merges its runs with a loser tree that compares known common prefixes first and bytes only beyond them. Equal suffixes
   leave their first holder; different suffixes with equal anchor bytes are then compared window by window.
4. The spans to remove go back to the tasks of the texts, which cut them out.

Anchors with more than ``HOT`` different suffixes (a very common line amid different text) are spread: their windows travel as
suffixes of their own, in the bucket of their content. A run sends one holder per suffix, so a bucket never gets more than
one entry per run for equal text, however common. Texts themselves never move. Steps 1, 2 and 4 read the same scan; a check
of rows and order per task raises an error should the scan not repeat itself.

Positions count bytes of UTF-8. A string is removed where it also starts earlier: in a smaller doc_id, in an earlier row of the same
doc_id (repeated rows), or earlier in its text. A null doc_id comes before all others, a null text is empty, texts below
100 bytes stay whole, an empty table gives no rows. Extra columns stay; added columns replace others of their name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tapeloom.llm.common import small_batches, stored
from tapeloom.sources.storage import scratch

LENGTH, GRAM = 100, 50
HOT, RUN_BYTES, SEGMENT = 2_000, 12 << 20, 4 << 20
_U = np.uint64
_R = 0x9E3779B97F4A7C15
_LOW = _U(0xFFFFFF)
_BYTE = np.random.default_rng(7_919).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
FIRST = -(1 << 63)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, n.bit_length())
        for k, base in enumerate((_R, pow(_R, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, base, np.uint64))), dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def suffixes(text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, content hash, start, length, offset of the anchor) of the suffixes, in pieces of the text."""
    for x in range(0, len(text) - LENGTH + 1, SEGMENT):
        raw = np.frombuffer(text, np.uint8, min(SEGMENT + LENGTH - 1, len(text) - x), x)
        n = len(raw)
        up, down = _power(n + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[:n], dtype=np.uint64)))
        gram = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
        low = (gram & ~_LOW) | np.arange(len(gram), dtype=np.uint64)
        spread, width = low, 1
        while 2 * width <= LENGTH - GRAM + 1:
            spread = np.minimum(spread[:-width], spread[width:])
            width *= 2
        m = n - LENGTH + 1
        rest = LENGTH - GRAM + 1 - width
        anchor = (np.minimum(spread[:m], spread[rest : rest + m]) & _LOW).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        end = np.concatenate((start[1:], [m])) + LENGTH - 1
        at = anchor[start]
        content = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
        yield gram[at], content, start + x, end - start, at - start


def common(a: bytes, b: bytes, h: int) -> int:
    """Length of the common prefix, known to be at least ``h``."""
    n = min(len(a), len(b))
    while h + 16 <= n and a[h : h + 16] == b[h : h + 16]:
        h += 16
    while h < n and a[h] == b[h]:
        h += 1
    return h


def front_coded(items: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Shared prefix lengths, lengths and the remaining bytes of sorted strings of at most 255 bytes."""
    shared, rest, last = bytearray(), [], b""
    for s in items:
        h = common(last, s, 0)
        shared.append(h)
        rest.append(s[h:])
        last = s
    return bytes(shared), bytes(map(len, items)), b"".join(rest)


def decoded(shared: bytes, lengths: bytes, rest: bytes) -> Iterator[tuple[int, bytes]]:
    last, at = b"", 0
    for h, n in zip(shared, lengths, strict=True):
        last = last[:h] + rest[at : at + n - h]
        at += n - h
        yield h, last


def merge(runs: list[Iterable[tuple[int, bytes]]]) -> Iterator[tuple[int, bytes, int, int]]:
    """Loser tree over front-coded sorted runs: (prefix shared with the string before, string, run, place in the run).

    ``known[i]`` is the prefix that run i's string shares with the last winner; the longer one is smaller, and bytes are compared
    only between equal ones, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    feeds = [iter(r) for r in runs]
    now: list[bytes | None] = [None] * size
    known, place = [0] * size, [-1] * size
    for i, f in enumerate(feeds):
        if (x := next(f, None)) is not None:
            now[i], place[i] = x[1], 0
    loser = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser keeps what it shares with the winner."""
        x, y = now[a], now[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        h, g = known[a], known[b]
        if h > g:
            return a, b
        if g > h:
            return b, a
        c = common(x, y, h)
        if x[c:] <= y[c:] if c < len(x) else True:
            known[b] = c
            return a, b
        known[a] = c
        return b, a

    level = list(range(size))
    while len(level) > 1:
        up = []
        for k in range(0, len(level), 2):
            w, l = play(level[k], level[k + 1])
            loser[(size + level[k]) >> ((size // len(level)).bit_length())] = l
            up.append(w)
        level = up
    w = level[0]
    while (s := now[w]) is not None:
        yield known[w], s, w, place[w]
        x = next(feeds[w], None)
        if x is None:
            now[w] = None
        else:
            known[w], now[w] = x
            place[w] += 1
        node = (size + w) >> 1
        while node:
            w, loser[node] = play(w, loser[node])
            node >>= 1


def _blob(a: np.ndarray) -> bytes:
    """Bytes of equal weight together, which packs better in a shuffle."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _unblob(b: bytes, kind: str) -> np.ndarray:
    w = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(w, -1).T).view(kind).reshape(-1)


def _by_task(rows: DataFrame, label: str) -> str:
    path = scratch(rows.sparkSession, label)
    rows.repartition("p").sortWithinPartitions("p").write.partitionBy("p").parquet(path)
    return path


def _mine(folder: str, columns: dict[str, str]) -> list[np.ndarray]:
    """Columns of packed arrays from this task's folder."""
    store, root = pafs.FileSystem.from_uri(folder)
    at = f"{root}/p={TaskContext.get().partitionId()}"
    if store.get_file_info(at).type != pafs.FileType.Directory:
        return [np.empty(0, k) for k in columns.values()]
    t = pq.read_table(at, filesystem=store, columns=list(columns), partitioning=None)
    return [np.concatenate([np.empty(0, k), *(_unblob(v, k) for v in t.column(c).to_pylist() if v is not None)]) for c, k in columns.items()]


class Order:
    """Checksum of a task's rows, so later scans can prove that they see the same rows in the same order."""

    def __init__(self):
        self.value = 0

    def add(self, doc: int | None, text: str | None) -> None:
        self.value = zlib.crc32(b"%d,%d;" % (FIRST if doc is None else doc, -1 if text is None else len(text)), self.value)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> _U(40)) & _U(0xFFFFF)) * _U(buckets)) >> _U(20)


_GRAMS = pa.schema([("bucket", pa.int32()), ("p", pa.int64()), ("grams", pa.binary()), ("kinds", pa.binary()), ("crc", pa.int64())])
_RUNS = pa.schema([("bucket", pa.int32()), ("p", pa.int64()), *((c, pa.binary()) for c in ("shared", "lengths", "rest", "anchor", "doc", "row", "start", "row2", "s2", "e2"))])
REPEATED = "p long, grams binary, hot binary, crc long"
SPANS = "p long, row binary, s binary, e binary"


def _repeated_anchors(docs: DataFrame, buckets: int) -> str:
    """Folder, by task, of the anchor hashes that occur again anywhere, and whether they are hot; and the task's row check."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, order, held, size = TaskContext.get().partitionId(), Order(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            g, c = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            at = np.lexsort((c, g, _bucket(g, buckets)))
            g, c = g[at], c[at]
            first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            new = np.concatenate(([True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])))
            kinds = np.add.reduceat(new.astype(np.uint32), first) * np.uint32(2) + (np.diff(np.concatenate((first, [len(g)]))) > 1)
            g = g[first]
            b = _bucket(g, buckets)
            cut = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(g)]
            for x, y in zip(cut, cut[1:], strict=False):
                delta = np.concatenate((g[x : x + 1], np.diff(g[x:y])))
                yield pa.RecordBatch.from_pydict({"bucket": [int(b[x])], "p": [p], "grams": [_blob(delta)], "kinds": [_blob(kinds[x:y].astype("<u4"))], "crc": [None]}, _GRAMS)

        for b in small_batches(batches):
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                order.add(d, t)
                for gram, content, *_ in suffixes((t or "").encode()):
                    held.append((gram, content))
                    size += len(gram)
                if size > 1 << 20:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()
        yield pa.RecordBatch.from_pydict({"bucket": [buckets + p % buckets], "p": [p], "grams": [None], "kinds": [None], "crc": [order.value]}, _GRAMS)

    def again(frame: pd.DataFrame) -> pd.DataFrame:
        crc = frame[frame["grams"].isna()][["p", "crc"]].assign(grams=None, hot=None)
        rows = frame[frame["grams"].notna()]
        if rows.empty:
            return crc[["p", "grams", "hot", "crc"]]
        each = [np.cumsum(_unblob(x, "<u8"), dtype=np.uint64) for x in rows["grams"]]
        kinds = np.concatenate([_unblob(x, "<u4") for x in rows["kinds"]])
        u, at, n = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        different = np.bincount(at, kinds >> 1, len(u))
        repeated = (n > 1) | (np.bincount(at, kinds & 1, len(u)) > 0)
        out, x = [], 0
        for p, g in zip(rows["p"], each, strict=True):
            mine = at[x : x + len(g)]
            keep = repeated[mine]
            out.append((p, _blob(g[keep]), _blob((different[mine[keep]] > HOT).astype(np.uint8)), None))
            x += len(g)
        return pd.concat([pd.DataFrame(out, columns=["p", "grams", "hot", "crc"]), crc])[["p", "grams", "hot", "crc"]]

    schema = "bucket int, p long, grams binary, kinds binary, crc long"
    return _by_task(docs.mapInArrow(report, schema).groupBy("bucket").applyInPandas(again, REPEATED), "anchors")


def _runs(docs: DataFrame, folder: str, buckets: int) -> DataFrame:
    """Front-coded sorted runs by bucket, and the spans that repeat inside a run."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, order = TaskContext.get().partitionId(), Order()
        wanted, hot = _mine(folder, {"grams": "<u8", "hot": "u1"})
        at = np.argsort(wanted, kind="stable")
        wanted, hot = wanted[at], hot[at]
        texts: list[tuple[int, int, bytes]] = []
        found: list[tuple[np.ndarray, ...]] = []
        row = size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not found:
                return
            gram, content, start, length, anchor, owner = (np.concatenate(c) for c in zip(*found, strict=True))
            rank = np.empty(len(texts), np.int64)
            rank[np.array(sorted(range(len(texts)), key=lambda i: texts[i][:2]))] = np.arange(len(texts))
            by = np.lexsort((start, rank[owner], content, gram))
            first = np.concatenate(([True], (gram[by][1:] != gram[by][:-1]) | (content[by][1:] != content[by][:-1])))
            rows = np.array([t[1] for t in texts], np.int64)
            gone = by[~first]
            s2, e2, r2 = joined(rows[owner[gone]], start[gone], start[gone] + length[gone])
            empty = {c: [None] for c in _RUNS.names}
            yield pa.RecordBatch.from_pydict(empty | {"bucket": [buckets + p % buckets], "p": [p], "row2": [_blob(r2.astype("<u4"))], "s2": [_blob(s2.astype("<u4"))], "e2": [_blob(e2.astype("<u4"))]}, _RUNS)
            by = by[first]
            bucket = _bucket(mix(gram[by]), buckets).astype(np.int64)
            items = []
            for k, g in zip(by.tolist(), bucket.tolist(), strict=True):
                o, x, n = owner[k], int(start[k]), int(length[k])
                items.append((g, texts[o][2][x : x + n], int(anchor[k]), o, x))
            of = np.searchsorted(wanted, gram[by])
            hot_items = []
            for i in np.flatnonzero(hot[of]).tolist():
                _, s, _, o, x = items[i]
                items[i] = None
                for j in range(len(s) - LENGTH + 1):
                    w = s[j : j + LENGTH]
                    hot_items.append((zlib.crc32(w) * buckets >> 32, w, 255, o, x + j))
            items = [x for x in items if x is not None] + hot_items
            items.sort(key=lambda x: x[:2])
            x = 0
            while x < len(items):
                y = x
                while y < len(items) and items[y][0] == items[x][0]:
                    y += 1
                part = items[x:y]
                shared, lengths, rest = front_coded([i[1] for i in part])
                o = [i[3] for i in part]
                yield pa.RecordBatch.from_pydict(empty | {
                    "bucket": [items[x][0]], "p": [p], "shared": [shared], "lengths": [lengths], "rest": [rest], "anchor": [bytes(i[2] for i in part)],
                    "doc": [_blob(np.array([texts[i][0] for i in o], "<i8"))], "row": [_blob(np.array([texts[i][1] for i in o], "<u4"))], "start": [_blob(np.array([i[4] for i in part], "<u4"))],
                }, _RUNS)
                x = y

        for b in small_batches(batches):
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                order.add(d, t)
                raw, i = (t or "").encode(), len(texts)
                texts.append((FIRST if d is None else d, row, raw))
                row += 1
                size += len(raw)
                for gram, content, start, length, anchor in suffixes(raw):
                    k = np.searchsorted(wanted, gram)
                    k[k == len(wanted)] = 0
                    hit = np.flatnonzero(wanted[k] == gram) if len(wanted) else np.empty(0, np.int64)
                    if len(hit):
                        found.append((gram[hit], content[hit], start[hit], length[hit], anchor[hit], np.full(len(hit), i)))
                if size > RUN_BYTES:
                    yield from flush()
                    texts, found, size = [], [], 0
        yield from flush()
        check_order(folder, order)

    names = ", ".join(f"{f.name} {'int' if f.name == 'bucket' else 'long' if f.name == 'p' else 'binary'}" for f in _RUNS)
    return docs.mapInArrow(write, names)


def check_order(folder: str, order: Order) -> None:
    store, root = pafs.FileSystem.from_uri(folder)
    at = f"{root}/p={TaskContext.get().partitionId()}"
    seen = [] if store.get_file_info(at).type != pafs.FileType.Directory else [c for c in pq.read_table(at, filesystem=store, columns=["crc"], partitioning=None).column(0).to_pylist() if c is not None]
    if set(seen) != {order.value}:
        raise RuntimeError("the scan of the documents gave other rows than before; write them to a table first")


def joined(row: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans per row as (starts, ends, rows), sorted; spans that touch become one."""
    if not len(row):
        return s, e, row
    at = np.lexsort((s, row))
    row, s, e = row[at], s[at], e[at]
    shift = row * (int(e.max()) + 2)  # rows apart on one line
    top = np.maximum.accumulate(e + shift)
    new = np.concatenate(([True], s[1:] + shift[1:] > top[:-1]))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(row)])) - 1
    return s[first], top[last] - shift[last], row[first]


def _resolve(frame: pd.DataFrame) -> pd.DataFrame:
    """Spans to remove that one bucket finds, by task."""
    gone: dict[int, list[tuple[int, int, int]]] = {}
    own = frame[frame["row2"].notna()]
    out = [(p, r, s, e) for p, r, s, e in zip(own["p"], own["row2"], own["s2"], own["e2"], strict=True)]
    runs = frame[frame["shared"].notna()]
    meta = [(p, a, _unblob(d, "<i8").tolist(), _unblob(r, "<u4").tolist(), _unblob(s, "<u4").tolist()) for p, a, d, r, s in zip(runs["p"], runs["anchor"], runs["doc"], runs["row"], runs["start"], strict=True)]
    groups: dict[bytes, list[tuple]] = {}

    def settle(text: bytes, holders: list[tuple]) -> None:
        first = min(holders)
        for h in holders:
            if h is not first:
                gone.setdefault(h[2], []).append((h[3], h[1], h[1] + len(text)))
        if first[4] < 255:
            groups.setdefault(text[first[4] : first[4] + GRAM], []).append((first, text))

    last, holders = b"", []
    for h, s, run, i in merge([decoded(*x) for x in zip(runs["shared"], runs["lengths"], runs["rest"], strict=True)]):
        p, anchor, doc, row, start = meta[run]
        if holders and not (h == len(s) == len(last)):
            settle(last, holders)
            holders = []
        last = s
        holders.append((doc[i], start[i], p, row[i], anchor[i]))
    if holders:
        settle(last, holders)
    for same in groups.values():
        if len(same) > 1:
            same.sort(key=lambda x: x[0])
            seen: set[bytes] = set()
            for (_, start, p, row, _), text in same:
                for j in range(len(text) - LENGTH + 1):
                    w = text[j : j + LENGTH]
                    if w in seen:
                        gone.setdefault(p, []).append((row, start + j, start + j + LENGTH))
                    else:
                        seen.add(w)
    for p, spans in gone.items():
        row, s, e = np.array(spans, np.int64).T
        s, e, row = joined(row, s, e)
        out.append((p, _blob(row.astype("<u4")), _blob(s.astype("<u4")), _blob(e.astype("<u4"))))
    return pd.DataFrame(out, columns=["p", "row", "s", "e"])


DIGEST = (("n_bytes", T.LongType(), pa.int64()), ("n_removed", T.LongType(), pa.int64()), ("n_spans", T.LongType(), pa.int64()), ("kept_sha256", T.StringType(), pa.string()))


def without_repeats(docs: DataFrame, buckets: int | None = None, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep_text``, text cut to the remaining bytes (broken
    characters at a cut are dropped from the text, not from the digest)."""
    two = docs.select("doc_id", "text")
    buckets = buckets or max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    folder = _repeated_anchors(two, buckets)
    spans = _by_task(_runs(two, folder, buckets).groupBy("bucket").applyInPandas(_resolve, SPANS), "spans")
    plain = [f for f in docs.schema.fields if f.name not in {n for n, *_ in DIGEST} and (keep_text or f.name != "text")]
    schema = T.StructType([*plain, *(T.StructField(n, k) for n, k, _ in DIGEST)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, at, base = Order(), None, 0
        for b in small_batches(batches):
            if at is None:
                row, s, e = (x.astype(np.int64) for x in _mine(spans, {"row": "<u4", "s": "<u4", "e": "<u4"}))
                s, e, row = joined(row, s, e)
                at = 0
            n, size = b.num_rows, len(row)
            ends = np.searchsorted(row, np.arange(base, base + n), side="right").tolist()
            rows, kept_texts = [], []
            for d, t, end in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), ends, strict=True):
                order.add(d, t)
                raw, kept, x = (t or "").encode(), [], 0
                for i in range(at, end):
                    kept.append(raw[x : s[i]])
                    x = int(e[i])
                kept.append(raw[x:])
                left = b"".join(kept)
                rows.append((len(raw), len(raw) - len(left), end - at, hashlib.sha256(left).hexdigest()))
                kept_texts.append(t if end == at else left.decode(errors="ignore"))
                at = end
            base += n
            made = [pa.array(c, k) for c, (_, _, k) in zip(zip(*rows, strict=True), DIGEST, strict=True)]
            fields = [b.schema.field(f.name) for f in plain]
            columns = [pa.array(kept_texts, pa.string()) if f.name == "text" else b.column(f.name) for f in plain]
            yield pa.RecordBatch.from_arrays([*columns, *made], schema=pa.schema([*fields, *((k, a) for k, _, a in DIGEST)]))
        if base:
            check_order(folder, order)

    return docs.drop(*(n for n, *_ in DIGEST)).mapInArrow(cut, schema)

"""BPE encoding and decoding with content-defined chunks that are encoded once for all documents.

1. A rolling hash over the last 16 bytes cuts every text into chunks of about ``MEAN`` bytes at the same places in equal passages.
   Each task reports the hashes of its chunks; hashes that several tasks report are shared, the lowest task owns them.
2. Owners encode their shared chunks, once each, and the ids travel to the tasks that need them.
3. Every document is put together: ids of shared chunks are looked up, the others are encoded (once per task), and each
   join of two chunks is repaired: the text between a safe blank before and after the join is encoded anew, and the places move
   outwards until the new ids agree exactly with the old ones on both sides.

Texts never move: what a task needs is kept in one folder per task of the scan. Should a later scan be cut otherwise, a
task finds less in its folder and encodes more, with the same ids. Added tokens in a text split it first, as the library does.

Nulls: a null text is empty, a null doc_id gets its row. Repeated rows each get their row; an empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.bpe import Encoder, encoder
from tapeloom.llm.common import small_batches, stored
from tapeloom.sources.storage import scratch

MEAN, LEAST = 1024, 256
#: Chunk ids that a task remembers besides the shared ones.
LOCAL_CHUNKS = 20_000
_MIX = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(256, dtype=np.uint64) << np.uint64(40))
_SAFE = re.compile(rb"(?<=[!-~]) (?=[!-~])")
ROWS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def cut_places(text: bytes) -> list[int]:
    """Content-defined ends of chunks, the last one being the end of the text; never inside a character."""
    n = len(text)
    if n <= LEAST:
        return [n]
    raw = np.frombuffer(text, np.uint8)
    h, mult = _MIX[raw], 0xD6E8FEB86659FD93
    for width in (1, 2, 4, 8):  # after these steps h covers 16 bytes
        m = np.uint64(pow(mult, width, 1 << 64))
        h[width:] = h[width:] + m * h[:-width]
    ends, last = [], 0
    for i in (np.flatnonzero((h >> np.uint64(40)) % np.uint64(MEAN) == 0) + 1).tolist():
        while i < n and text[i] & 0xC0 == 0x80:
            i += 1
        if i - last >= LEAST and i < n:
            ends.append(i)
            last = i
    return [*ends, n]


def chunks(text: bytes) -> list[bytes]:
    """Chunks that each hold two safe blanks at least, unless the whole text has fewer."""
    out, last = [], 0
    for end in cut_places(text):
        piece = text[last:end]
        if sum(1 for _ in islice(_SAFE.finditer(piece), 4)) == 4:
            out.append(piece)
            last = end
    if last < len(text):
        tail = text[last:]
        if out:
            out[-1] += tail
        else:
            out.append(tail)
    return out


def name_of(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _segments(enc: Encoder, text: str) -> list[str]:
    """Ordinary text and added tokens in turn."""
    if not any(a in text for a in enc.added):
        return [text]
    return re.split("(" + "|".join(map(re.escape, sorted(enc.added, key=len, reverse=True))) + ")", text)


class Assembler:
    """Ids of whole texts from ids of their chunks; ``shared`` maps chunk names to ids."""

    def __init__(self, enc: Encoder, shared: dict[bytes, bytes]):
        self.enc, self.shared, self.local = enc, shared, {}
        self.bytes_of = enc.bytes_of_ids()
        self.sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.encoded = self.repairs = 0

    def chunk_ids(self, parts: list[bytes]) -> dict[bytes, np.ndarray]:
        """Ids by chunk; chunks that are new to this task are encoded in one call."""
        names = {p: name_of(p) for p in parts}
        if len(self.local) > LOCAL_CHUNKS:
            self.local = {k: v for k in names.values() if (v := self.local.get(k)) is not None}
        new = {k: p for p, k in names.items() if k not in self.shared and k not in self.local}
        self.encoded += len(new)
        self.local.update(zip(new, self.enc.encode_many([p.decode() for p in new.values()]), strict=True))
        return {p: np.frombuffer(self.shared[k] if k in self.shared else self.local[k], "<u4") for p, k in names.items()}

    def window(self, left: bytes, right: bytes, grow: int) -> tuple[int, int, int, int] | None:
        """Around the join of two chunks: places of safe blanks, two before it and two behind, ``grow`` steps away; None if they
        run out. Between the outer and the inner place the ids must agree."""
        near = 64 * (grow + 4)
        base = max(0, len(left) - near)
        before = [base + m.start() for m in _SAFE.finditer(left[base:])]
        if len(before) < grow + 2:
            before = [m.start() for m in _SAFE.finditer(left)]
        behind = [m.start() for m in islice(_SAFE.finditer(right), grow + 2)]
        if len(before) < grow + 2 or len(behind) < grow + 2:
            return None
        return before[-grow - 2], before[-grow - 1], behind[grow], behind[grow + 1]

    def repaired(self, a: np.ndarray, b: np.ndarray, at: tuple[int, int, int, int], new: np.ndarray) -> tuple[int, np.ndarray, int] | None:
        """Ids of ``a`` to keep, ids of the join, first id of ``b`` to keep; None if the new ids do not agree on both sides."""
        x, y = (np.concatenate(([0], np.cumsum(self.sizes[i]))) for i in (a, b))
        p0, p1 = np.searchsorted(x, at[:2])
        q0, q1 = np.searchsorted(y, at[2:])
        n, m = p1 - p0, q1 - q0
        if len(new) >= n + m and np.array_equal(new[:n], a[p0:p1]) and np.array_equal(new[len(new) - m :], b[q0:q1]):
            return int(p0), new[: len(new) - m], int(q0)
        return None

    def texts_ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without added tokens; chunks and joins of all of them are encoded together."""
        parts = [chunks(t.encode()) if t else [] for t in texts]
        ids = self.chunk_ids([c for p in parts for c in p])
        joins = [(i, k, self.window(p[k], p[k + 1], 0)) for i, p in enumerate(parts) for k in range(len(p) - 1)]
        text_at = lambda i, k, at: (parts[i][k][at[0] :] + parts[i][k + 1][: at[3]]).decode()
        fresh = iter(self.enc.encode_many([text_at(*j) for j in joins if j[2]]))
        fixed: dict[tuple[int, int], tuple | None] = {}
        for i, k, at in joins:
            grow, found = 0, None
            while at and found is None:
                new = next(fresh) if grow == 0 else self.enc.encode_many([text_at(i, k, at)])[0]
                found = self.repaired(ids[parts[i][k]], ids[parts[i][k + 1]], at, np.frombuffer(new, "<u4"))
                grow += 1
                at = self.window(parts[i][k], parts[i][k + 1], grow) if found is None else at
            fixed[i, k] = found
        out = []
        for i, p in enumerate(parts):
            made, begin = [], 0
            for k in range(len(p) - 1):
                join = fixed[i, k]
                if join is None or join[0] < begin:  # no agreement inside these two chunks: no chunk is used
                    made = None
                    break
                made += [ids[p[k]][begin : join[0]], join[1]]
                begin = join[2]
                self.repairs += 1
            if made is None:
                out.append(np.frombuffer(self.enc.encode_many([texts[i]])[0], "<u4"))
            else:
                out.append(np.concatenate([*made, ids[p[-1]][begin:]]) if p else np.empty(0, "<u4"))
        return out

    def ids_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        split = [_segments(self.enc, t) for t in texts]
        got = iter(self.texts_ids([s for segments in split for s in segments[::2]]))
        out = []
        for segments in split:
            each = [next(got) if i % 2 == 0 else np.array([self.enc.tok.token_to_id(s)], "<u4") for i, s in enumerate(segments)]
            out.append(each[0] if len(each) == 1 else np.concatenate(each))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode(errors="replace")


def _task_rows(folder: str, columns: list[str]) -> dict:
    """The rows that lie in this task's folder."""
    store, root = pafs.FileSystem.from_uri(folder)
    at = f"{root}/p={TaskContext.get().partitionId()}"
    if store.get_file_info(at).type != pafs.FileType.Directory:
        return {c: [] for c in columns}
    t = pq.read_table(at, filesystem=store, columns=columns, partitioning=None)
    return {c: t.column(c).to_pylist() for c in columns}


def _named_chunks(enc: Encoder, batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes]]:
    for t in batch.column(1).to_pylist():
        if t:
            for s in _segments(enc, t)[::2]:
                if s:
                    for c in chunks(s.encode()):
                        yield name_of(c), c


def by_task(rows: DataFrame, label: str) -> str:
    """Rows with a task number ``p``, written to a folder with one subfolder per task."""
    path = scratch(rows.sparkSession, label)
    rows.repartition("p").sortWithinPartitions("p").write.partitionBy("p").parquet(path)
    return path


def shared_chunk_ids(docs: DataFrame, tokenizer: str) -> str:
    """Encode every chunk that more than one task of the scan holds, once; returns the folder of ids by task."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, p, seen = encoder(tokenizer), TaskContext.get().partitionId(), set()
        for b in small_batches(batches):
            new = {k for k, _ in _named_chunks(enc, b)} - seen
            seen |= new
            yield pa.RecordBatch.from_pydict({"h": list(new), "p": [p] * len(new)}, pa.schema([("h", pa.binary()), ("p", pa.int64())]))

    named = stored(docs.mapInArrow(name, "h binary, p long"), "chunks")
    owners = named.groupBy("h").agg(F.min("p").alias("p"), F.count("*").alias("n")).where("n > 1").select("h", "p")
    mine = by_task(owners, "owned")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, todo = encoder(tokenizer), set(_task_rows(mine, ["h"])["h"])
        for b in small_batches(batches):
            if todo:
                got = {k: c for k, c in _named_chunks(enc, b) if k in todo}
                todo -= got.keys()
                ids = enc.encode_many([c.decode() for c in got.values()])
                yield pa.RecordBatch.from_pydict({"h": list(got), "ids": ids}, pa.schema([("h", pa.binary()), ("ids", pa.binary())]))

    return by_task(named.join(docs.mapInArrow(encode, "h binary, ids binary"), "h"), "shared-ids")


def encoded_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): tokens, and digests of the ids and of the decoded text."""
    docs = docs.select("doc_id", "text")
    folder = shared_chunk_ids(docs, tokenizer)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _task_rows(folder, ["h", "ids"])
        work = Assembler(encoder(tokenizer), dict(zip(got["h"], got["ids"], strict=True)))
        for b in small_batches(batches):
            rows = []
            for d, ids in zip(b.column(0).to_pylist(), work.ids_many([t or "" for t in b.column(1).to_pylist()]), strict=True):
                rows.append((d, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(work.decode(ids).encode()).hexdigest()))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(assemble, ROWS)

"""Length-delimited binary token records with masked checksums and a separate offset index.

File: 16 bytes of head (magic, bytes per id), then one frame per document::

    u64 length | u32 masked crc32 of those 8 bytes | payload | u32 masked crc32 of the payload

The payload is one flag byte (1: the document has no id), the document id (i64) and the ids. The index file beside it
holds (doc_id i64, has_id u8, offset u64, n_ids u64) per frame and its own masked crc32, so a reader can fetch frames in any
order. Files hold ascending ranges of doc_id. They are written through ``pyarrow.fs``, that is to any store it opens.

Nulls: a null text has only the end id, a null doc_id is a document of its own that sorts first. Repeated ids keep all
their rows, in order of text. An empty table gives no files and no rows. Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.bpe import encoder
from tapeloom.llm.common import small_batches, stored
from tapeloom.sources.storage import scratch

MAGIC = b"TAPEREC1"
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("n_ids", "<u8")])
MANIFEST = "shard long, path string, n_docs long, n_tokens long, n_bytes long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, offset long"


def masked(data: bytes) -> int:
    """crc32 rotated right by 15 plus a constant, so a checksum of checksums is not trivial."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def read_frame(f) -> bytes | None:
    """The next payload, None at the end; raises ValueError when bytes are missing or changed."""
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != struct.unpack_from("<I", head, 8)[0]:
        raise ValueError("record length is damaged")
    n = struct.unpack_from("<Q", head)[0]
    body = f.read(n + 4)
    if len(body) < n + 4 or masked(body[:n]) != struct.unpack_from("<I", body, n)[0]:
        raise ValueError("record is damaged")
    return body[:n]


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Encode every text, append ``end_id``, write the shards; returns the manifest (one row per shard that counts).

    Shards are the range partitions of doc_id, so no task holds more than a share of the rows; a task keeps one batch
    in memory. A lost task's files carry another name than its successor's and are not in the manifest.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, out, index, at, total = encoder(tokenizer), TaskContext.get().partitionId(), None, [], 16, 0
        width = "<u2" if max(enc.tok.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else "<u4"
        end = np.array([end_id], "<u4").tobytes()
        store, root = open_store(folder)
        path = f"{root}/shard-{shard:07d}-{uuid.uuid4().hex}"
        for b in small_batches(batches):
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{path}.rec", buffer_size=1 << 20)
                out.write(MAGIC + struct.pack("<II", np.dtype(width).itemsize, 0))
            ids = enc.encode_many([t or "" for t in b.column(1).to_pylist()])
            for d, x in zip(b.column(0).to_pylist(), ids, strict=True):
                values = np.frombuffer(x + end, "<u4")
                data = frame(struct.pack("<Bq", d is None, d or 0) + values.astype(width).tobytes())
                out.write(data)
                index.append((d or 0, d is not None, at, len(values)))
                at += len(data)
                total += len(values)
        if out is not None:
            out.close()
            raw = np.array(index, INDEX).tobytes()
            with store.open_output_stream(f"{path}.idx") as f:
                f.write(raw + struct.pack("<I", masked(raw)))
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [len(index)], "n_tokens": [total], "n_bytes": [at]})

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_index(store: pafs.FileSystem, path: str) -> np.ndarray:
    with store.open_input_stream(f"{path}.idx") as f:
        raw = f.read()
    if masked(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError(f"index of {path} is damaged")
    return np.frombuffer(raw[:-4], INDEX)


def read_at(store: pafs.FileSystem, path: str, offset: int) -> bytes:
    """The payload of one frame found through the index, for shuffled reads."""
    with store.open_input_file(f"{path}.rec") as f:
        f.seek(offset)
        return read_frame(f)


def read_records(manifest: DataFrame, root_of: str) -> DataFrame:
    """One row per document from the files: ids before it, its ids with the end id, their crc32, shard and file offset.

    Each shard is read as a stream by one task; its first id's number comes from the shard totals alone.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(root_of)
        for b in batches:
            for m in b.to_pylist():
                index, start, rows = read_index(store, m["path"]), m["base"], []
                with store.open_input_stream(f"{m['path']}.rec", buffer_size=1 << 20) as f:
                    head = f.read(16)
                    if head[:8] != MAGIC:
                        raise ValueError(f"{m['path']} is not a record file")
                    width = f"<u{struct.unpack_from('<I', head, 8)[0]}"
                    for entry in index:
                        payload = read_frame(f)
                        none, d = struct.unpack_from("<Bq", payload)
                        ids = np.frombuffer(payload, width, offset=9).astype("<u4")
                        if len(ids) != entry["n_ids"] or d != entry["doc_id"]:
                            raise ValueError(f"{m['path']} and its index differ")
                        rows.append((None if none else d, start, len(ids), zlib.crc32(ids.tobytes()), m["shard"], int(entry["offset"])))
                        start += len(ids)
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                    if read_frame(f) is not None:
                        raise ValueError(f"{m['path']} is longer than its index")
                if rows:
                    yield _batch(rows)

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, or few small rows would become one task
    return based.repartitionByRange(tasks, "shard").mapInArrow(scan, ROWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset")
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)


def token_records(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write ``docs`` (doc_id, text) as record files in the shared folder and read them back."""
    folder = scratch(docs.sparkSession, "records")
    return read_records(write_records(docs, folder, tokenizer, end_id), folder)

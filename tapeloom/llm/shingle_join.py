"""Exact Jaccard join of 5-word shingle sets by partitioned parity sketches.

A set's shingle hashes are dealt to the ``p`` words of a sketch by hash range, and each word is the XOR of its hashes, so the
number of words in which two sketches differ is at most the symmetric difference of the sets. Two sets of s and l shingles with
Jaccard similarity of 3/4 or more differ in (s + l) / 7 shingles at most; with more words than that, some words must agree. Sizes fall
in bands of ratio 4/3, a pair has one scheme: the band of its larger set; every set writes the sketches of its own band and
of the next. Words are joined on (scheme, place, value):

* A word without shingles says nothing; a set whose empty words use up its guarantee ``g`` (words that must agree and are not
  empty) writes them too.
* Words that at most ``FEW`` sets share give pairs with the number of shared words; a pair with fewer shared words than its guarantee,
  words of larger groups included, is no link.
* In larger groups a set is left out when it has fewer such words than its guarantee, as then each of its links also shares
  another word. The others are linked to the smallest member first; members still apart afterwards are compared block by
  block through parity bits, whose Hamming distance bounds the difference from below.

``near_duplicates`` verifies candidates on the texts: first one partner per set, then only pairs that are still in different components.
``jaccard_join`` and ``jaccard_links`` verify every candidate, large groups tile by tile, and give all links. Equal sets are one node
from the start. ``near_duplicates`` emits no group in pairs; nothing of the corpus reaches the driver but one fixed-size bitmap.

Words are runs of characters other than blank and \\x09 to \\x0D after A-Z are lowered. Sets with fewer than five words are
the whole sequence; without words the set is empty and linked with nothing. Nulls: a null text is empty; rows with null doc_id
count shingles but take no part in links (null component). Rows that repeat a doc_id are one node: a link of one is a link of
all. An empty table gives no rows. Other columns are ignored. Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import small_batches, stored
from tapeloom.llm.components import components

WIDTH, FEW, FLUSH, TILE, SKETCH_BITS = 5, 8, 1 << 21, 512, 2048
BITMAP_PARTS, TILE_BYTES = 128, 8 << 20
_U = np.uint64
_RNG = np.random.default_rng(20_240_229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_PLACE = _RNG.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * _U(2) + _U(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_R = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


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


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    raw = np.frombuffer((text or "").encode().lower(), np.uint8)
    n = len(raw)
    if not n:
        return np.empty(0, np.uint64)
    word = np.concatenate(([False], ~_BLANK[raw], [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = _power(n + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[:n], dtype=np.uint64)))
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    m = len(h)
    if m < WIDTH:
        return mix(np.array([np.bitwise_xor.reduce(mix(h * _PLACE[:m])) + _U(m)], np.uint64))
    s = h[: m - WIDTH + 1] * _PLACE[0]
    for k in range(1, WIDTH):
        s = mix(s) + h[k : m - WIDTH + 1 + k] * _PLACE[k]
    return np.unique(mix(s))


def _bands(top: int) -> list[int]:
    lows = [1]
    while lows[-1] <= top:
        lows.append(max(lows[-1] + 1, -(-4 * lows[-1] // 3)))
    return lows


_LOWS = np.array(_bands(1 << 40), np.int64)


def band_of(n: int) -> int:
    return int(np.searchsorted(_LOWS, n, side="right")) - 1


def words_of(band: int) -> int:
    """Sketch words of a scheme: its largest difference, room for empty words and a few spare ones."""
    most = int(_LOWS[band + 1]) - 1
    return 2 * most // 7 + 1 + most // 28 + min(3, most // 4)


def sketch_keys(h: np.ndarray, band: int) -> tuple[np.ndarray, int]:
    """Keys of the sketch words that the set writes in a scheme (8 bits of scheme, 56 of hash), and its guarantee."""
    n, p = len(h), words_of(band)
    largest = min(4 * n // 3, int(_LOWS[band + 1]) - 1)
    differ = (n + largest) // 7
    place = ((h >> _U(32)) * _U(p)) >> _U(32)  # rises with the hash
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    value = np.bitwise_xor.reduceat(h, first)
    key = mix(mix(value) + place[first] + _U(1))
    g = p - differ - (p - len(first))
    if g < 1:
        none = np.setdiff1d(np.arange(p), place[first].astype(np.int64)).astype(np.uint64)
        key = np.concatenate((key, mix(none + _U(0xABCDEF0123456789))))
    return (_U(band) << _U(56)) | (key >> _U(8)), g


def _planes(a: np.ndarray) -> bytes:
    """Bytes of equal weight together: what is constant then takes no room in the shuffle."""
    return a.view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1)


ROW = "bucket int, keys binary, docs binary, a long, n long, scheme int, g0 int, g1 int, fp binary"
FOUND = "kind int, a long, b long, scheme int, n long, g0 int, g1 int, fp binary"
_ROW = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("a", pa.int64()), ("n", pa.int64()), ("scheme", pa.int32()), ("g0", pa.int32()), ("g1", pa.int32()), ("fp", pa.binary())])


def _postings(docs: DataFrame, buckets: int) -> DataFrame:
    """Sorted runs of (key, doc_id) per bucket, and one row about each document in buckets from ``buckets`` on."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about, seen, keys, ids, held = TaskContext.get().partitionId() % buckets + buckets, set(), [], [], 0

        def run() -> Iterator[pa.RecordBatch]:
            k, d = np.concatenate(keys), np.repeat(np.array([i for i, _ in ids], np.int64), [c for _, c in ids])
            bucket = ((k & _U(0xFFFF)) * _U(buckets)) >> _U(16)
            order = np.lexsort((k, bucket))
            k, d, bucket = k[order], d[order], bucket[order]
            cut = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(k)]
            for x, y in zip(cut, cut[1:], strict=False):
                delta = np.concatenate((k[x : x + 1], k[x + 1 : y] - k[x : y - 1]))
                row = {"bucket": [int(bucket[x])], "keys": [_planes(delta)], "docs": [_planes(d[x:y])]}
                yield pa.RecordBatch.from_pydict({c: row.get(c, [None]) for c in _ROW.names}, _ROW)

        for b in small_batches(batches):
            info: dict[str, list] = {c: [] for c in _ROW.names}
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h, g, band, fp = shingle_hashes(t), (0, 0), -1, None
                if len(h):
                    band = band_of(len(h))
                    fp = _fingerprint(h)
                    made = [sketch_keys(h, band), sketch_keys(h, band + 1)]
                    g = (made[0][1], made[1][1])
                    if d is not None and fp not in seen:
                        seen.add(fp)
                        for k, _ in made:
                            keys.append(k)
                            ids.append((d, len(k)))
                            held += len(k)
                for c, v in zip(_ROW.names, (about, None, None, d, len(h), band, *g, fp), strict=True):
                    info[c].append(v)
                if held > FLUSH:
                    yield from run()
                    keys, ids, held = [], [], 0
            yield pa.RecordBatch.from_pydict(info, _ROW)
        if held:
            yield from run()

    return docs.mapInArrow(write, ROW)


def _match(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: pairs (kind 0: a, b, shared words), members of large groups (kind 1: smallest member, member, words), documents (2)."""
    if frame["keys"].isna().all():
        return frame.assign(kind=2, b=None)[["kind", "a", "b", "scheme", "n", "g0", "g1", "fp"]]
    k = np.concatenate([np.cumsum(_from_planes(x), dtype=np.uint64) for x in frame["keys"]])
    d = np.concatenate([_from_planes(x).view(np.int64) for x in frame["docs"]])
    order = np.argsort(k, kind="stable")
    k, d = k[order], d[order]
    edge = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
    start, size = edge[:-1], np.diff(edge)
    scheme = (k >> _U(56)).astype(np.int64)
    found = []
    for m in range(2, FEW + 1):
        s = start[size == m]
        if len(s):
            rows = np.sort(d[s[:, None] + np.arange(m)], axis=1)
            for i in range(m):
                for j in range(i + 1, m):
                    found.append(np.column_stack((np.zeros(len(s), np.int64), rows[:, i], rows[:, j], scheme[s])))
    s = start[size > FEW]
    if len(s):
        m = size[size > FEW]
        at = np.repeat(s - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(m.sum())
        low = np.minimum.reduceat(d[at], np.concatenate(([0], np.cumsum(m)[:-1])))
        found.append(np.column_stack((np.ones(len(at), np.int64), np.repeat(low, m), d[at], scheme[at])))
    empty = pd.DataFrame(columns=["kind", "a", "b", "scheme", "n"])
    if found:
        all_ = pd.DataFrame(np.concatenate(found), columns=["kind", "a", "b", "scheme"])
        all_ = all_[(all_["kind"] == 1) | (all_["a"] != all_["b"])]
        empty = all_.groupby(["kind", "a", "b", "scheme"], sort=False).size().reset_index(name="n")
    return empty.assign(g0=None, g1=None, fp=None)[["kind", "a", "b", "scheme", "n", "g0", "g1", "fp"]]


def _linked(one: np.ndarray, two: np.ndarray, share: int = 75) -> bool:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both > 0 and 100 * both >= share * (len(one) + len(two) - both)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose texts are linked."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, last = zstandard.ZstdDecompressor(), (None, None)
        for b in small_batches(batches):
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if last[0] != x:
                    last = (x, shingle_hashes(unpack.decompress(x).decode()))
                keep.append(_linked(last[1], shingle_hashes(unpack.decompress(y).decode())))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    x = texts.select(F.col("doc_id").alias("a"), F.col("z").alias("x"))
    y = texts.select(F.col("doc_id").alias("b"), F.col("z").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(test, "a long, b long")


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap of BITMAP_PARTS x 4 KB of the ids' hashes, whatever their number."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP_PARTS * 32768))
    got = ids.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 32768).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect()
    out = np.zeros(BITMAP_PARTS * 4096, np.uint8)
    for r in got:
        bits = np.frombuffer(r["bits"], np.uint8)
        out[r["part"] * 4096 : r["part"] * 4096 + len(bits)] |= bits
    return out


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Packed texts of (at least) the given documents, written once."""
    bits = _bitmap(ids)
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP_PARTS * 32768))
    # bitmap_bit_position(s) is (s - 1) mod 32768 for positive s; it is taken from Spark so both sides agree.
    place = (F.floor(slot / 32768) * 32768 + F.bitmap_bit_position(slot)).cast("long")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=3)
        for b in small_batches(batches):
            at = b.column(2).to_numpy(zero_copy_only=False)
            b = b.filter(pa.array((bits[at >> 3] >> (at & 7) & 1).astype(bool)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tool.compress((t or "").encode()) for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "z"])

    rows = docs.where("doc_id is not null").select("doc_id", "text", place.alias("place"))
    return stored(rows.mapInArrow(pack, "doc_id long, z binary").join(ids, "doc_id", "left_semi"), "texts")


def _apart(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of members of one large group (grp, doc_id, component) that lie in different components and whose parity bits differ no
    more than linked sets do; members meet block by block."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in small_batches(batches):
            n, out = [], []
            for z in b.column(1).to_pylist():
                h = shingle_hashes(unpack.decompress(z).decode())
                n.append(len(h))
                out.append(np.packbits(np.bincount((h & _U(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1 == 1).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "size", "bits"])

    split = members.groupBy("grp").agg(F.countDistinct("component").alias("k"), F.count("*").alias("m")).where("k > 1")
    rows = members.join(split, "grp").withColumn("blocks", F.ceil(F.col("m") / TILE).cast("long"))
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("doc_id"), "blocks")).join(texts.mapInArrow(bits, "doc_id long, size long, bits binary"), "doc_id")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    tiles = rows.withColumn("o", other).select("grp", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "doc_id", "component", "size", "bits", "blk")

    def tile(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("doc_id", ignore_index=True)
        w = np.frombuffer(b"".join(f["bits"]), np.uint64).reshape(len(f), -1)
        size, comp, ids = f["size"].to_numpy(), f["component"].to_numpy(), f["doc_id"].to_numpy()
        out = []
        for k in range(len(f) - 1):
            away = np.bitwise_count(w[k] ^ w[k + 1 :]).sum(1, dtype=np.int64)
            small, large = np.minimum(size[k], size[k + 1 :]), np.maximum(size[k], size[k + 1 :])
            hit = np.flatnonzero((comp[k + 1 :] != comp[k]) & (ids[k + 1 :] != ids[k]) & (4 * small >= 3 * large) & (7 * away <= small + large)) + k + 1
            out.append(np.column_stack((np.full(len(hit), ids[k]), ids[hit])))
        return pd.DataFrame(np.concatenate(out) if out else np.empty((0, 2), np.int64), columns=["a", "b"])

    return tiles.groupBy("grp", "i", "j").applyInPandas(tile, "a long, b long").distinct()


def _candidates(docs: DataFrame, buckets: int | None, key: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents; (doc_id, rep, fp) of every set; pairs (p, q) of representatives that share few-set words; members (grp, p) of large
    groups. A representative is a struct of the columns ``key`` of its set: rep alone or rep and fp."""
    docs = docs.select("doc_id", "text")
    buckets = buckets or max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = stored(_postings(docs, buckets).groupBy("bucket").applyInPandas(_match, FOUND), "found")
    about = found.where("kind = 2").select(F.col("a").alias("doc_id"), F.col("n").alias("n_shingles"), "scheme", "g0", "g1", "fp")
    nodes = about.where("doc_id is not null and fp is not null")
    sets = stored(nodes.join(nodes.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fp").select("doc_id", "rep", "fp").distinct(), "sets")
    bound = nodes.select("doc_id", F.explode(F.array(F.struct("scheme", F.col("g0").alias("g")), F.struct((F.col("scheme") + 1).alias("scheme"), F.col("g1").alias("g")))).alias("x"))
    bound = bound.groupBy("doc_id", "x.scheme").agg(F.min("x.g").alias("g"))

    crowd = found.where("kind = 1").groupBy("a", "b", "scheme").agg(F.sum("n").alias("n"))
    crowded = crowd.groupBy(F.col("b").alias("doc_id"), "scheme").agg(F.sum("n").alias("h"))
    own = sets.select("doc_id", F.struct(*key).alias("p")).distinct()  # a word of a doc_id with several sets may be any one's
    limits = stored(bound.join(crowded, ["doc_id", "scheme"], "left").na.fill(0, ["h"]).join(own, "doc_id"), "limits")
    of = lambda c: limits.select(F.col("doc_id").alias(c), "scheme", F.col("g").alias(f"g{c}"), F.col("h").alias(f"h{c}"), F.col("p").alias(f"p{c}"))
    few = found.where("kind = 0").groupBy("a", "b", "scheme").agg(F.sum("n").alias("n"))
    few = few.join(of("a"), ["a", "scheme"]).join(of("b"), ["b", "scheme"]).where("n + least(ha, hb) >= greatest(ga, gb)")
    few = few.select(F.least("pa", "pb").alias("p"), F.greatest("pa", "pb").alias("q")).where("p <> q").distinct()
    many = crowd.join(of("b"), ["b", "scheme"]).where("hb >= gb").select(F.xxhash64("a", "scheme").alias("grp"), F.col("pb").alias("p")).distinct()
    return about, sets, stored(few, "few"), stored(many, "crowds")


def near_duplicates(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id that links reach). Links within a
    component are tested only as far as they are needed to connect it; ``jaccard_join`` has them all."""
    about, sets, few, many = _candidates(docs, buckets, ["rep"])
    few, many = few.select("p.rep", F.col("q.rep").alias("b")).toDF("a", "b"), many.select("grp", F.col("p.rep").alias("doc_id"))
    node_of = sets.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    same = sets.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))  # only rows that repeat an id add links
    star = many.join(many.groupBy("grp").agg(F.min("doc_id").alias("a")), "grp").select("a", F.col("doc_id").alias("b"))
    star = star.where("a <> b").distinct()

    ids = few.select(F.col("a").alias("doc_id")).union(few.select("b")).union(star.select("a")).union(many.select("doc_id")).distinct()
    texts = _texts(docs, ids)
    first = stored(few.union(star).groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
    edges = stored(_verified(first, texts).union(same.where("a <> b")), "links")
    comp = components(edges)
    at = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    rest = few.join(at("a"), "a", "left").join(at("b"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    crowds = many.join(at("doc_id"), "doc_id", "left").select("grp", "doc_id", F.coalesce("cdoc_id", "doc_id").alias("component"))
    rest = rest.union(_apart(crowds, texts)).distinct().join(first, ["a", "b"], "left_anti")
    comp = components(edges.union(_verified(rest, texts)))
    out = about.join(node_of, "doc_id", "left").join(comp, F.col("rep") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


# --------------------------------------------------------------------------- all links
def _fingerprint(h: np.ndarray) -> bytes:
    return np.array([h.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(h)) + _U(len(h))], np.uint64).tobytes()


LINK = "a long, fa binary, b long, fb binary"


def _tasks(df: DataFrame) -> int:
    """Tasks for steps whose rows are few and costly; by the size of its input such a step would get a task or two."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _verified_sets(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (p, q) of sets that are linked, as LINK; of a doc_id with several texts the one with the set's fingerprint counts."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, last = zstandard.ZstdDecompressor(), (None, None, None)
        for b in small_batches(batches):
            keep = []
            for fa, fb, x, y in zip(*(b.column(c).to_pylist() for c in (1, 3, 4, 5)), strict=True):
                if last[0] != x:
                    h = shingle_hashes(unpack.decompress(x).decode())
                    last = (x, h, _fingerprint(h))
                other = shingle_hashes(unpack.decompress(y).decode())
                keep.append(last[2] == fa and _fingerprint(other) == fb and _linked(last[1], other))
            yield b.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))

    flat = pairs.select(F.col("p.rep").alias("a"), F.col("p.fp").alias("fa"), F.col("q.rep").alias("b"), F.col("q.fp").alias("fb"))
    x = texts.select(F.col("doc_id").alias("a"), F.col("z").alias("x"))
    y = texts.select(F.col("doc_id").alias("b"), F.col("z").alias("y"))
    dealt = flat.join(y, "b").repartition(_tasks(flat), "a").sortWithinPartitions("a")  # a text that many meet is read once
    return dealt.join(x, "a").select("a", "fa", "b", "fb", "x", "y").mapInArrow(test, LINK)


def _shared(one: list[np.ndarray], two: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of another, ``width`` shingles at a time."""
    both = np.intersect1d(np.unique(np.concatenate(one)), np.unique(np.concatenate(two)), assume_unique=True)
    out = np.zeros((len(one), len(two)), np.int64)
    at = [[np.flatnonzero(np.isin(both, h, assume_unique=True)) for h in side] for side in (one, two)]
    for x in range(0, len(both), width):
        parts = []
        for side in at:
            m = np.zeros((len(side), width), np.float32)
            for k, i in enumerate(side):
                lo, hi = np.searchsorted(i, (x, x + width))
                m[k, i[lo:hi] - x] = 1
            parts.append(m)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    return out


def _homes(many: DataFrame) -> DataFrame:
    """``many`` (grp, p) with each set's ``home``, the largest of its groups. Sets of one home meet there and in no other group, so
    groups whose members all have one other home are left out."""
    sized = many.join(many.groupBy("grp").agg(F.count("*").alias("m")), "grp")
    at_home = sized.groupBy("p").agg(F.max(F.struct("m", "grp"))["grp"].alias("home"))
    rows = many.join(at_home, "p")
    new = rows.groupBy("grp").agg(F.min("home").alias("x"), F.max("home").alias("y")).where("x <> y or x = grp").select("grp")
    return stored(rows.join(new, "grp").select("grp", "p", "home"), "homes")


def _crowd_links(many: DataFrame, texts: DataFrame) -> DataFrame:
    """All linked pairs of sets of one large group (grp, p, home), as LINK; blocks of at most about TILE sets or TILE_BYTES of packed text
    meet as tiles."""
    rows = many.select("grp", F.col("p.rep").alias("doc_id"), F.col("p.fp").alias("fp"), "home").join(texts, "doc_id")
    size = rows.groupBy("grp").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum(F.length("z")) / TILE_BYTES)).cast("long").alias("blocks"))
    rows = rows.join(size, "grp").withColumn("blk", F.pmod(F.xxhash64("fp"), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    tiles = rows.withColumn("o", other).select("grp", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "doc_id", "fp", "home", "z", "blk")

    def tile(f: pd.DataFrame) -> pd.DataFrame:
        unpack, sides = zstandard.ZstdDecompressor(), {}
        i, j, grp = (int(f[c].iloc[0]) for c in ("i", "j", "grp"))
        if f["home"].nunique() == 1 and f["home"].iloc[0] != grp:
            return pd.DataFrame(columns=["a", "fa", "b", "fb"])
        for d, fp, home, z, blk in zip(f["doc_id"], f["fp"], f["home"], f["z"], f["blk"], strict=True):
            h = shingle_hashes(unpack.decompress(z).decode())
            if _fingerprint(h) == bytes(fp):
                sides.setdefault(int(blk), {})[(int(d), bytes(fp))] = (h, home)
        one, two = (list(sides.get(k, {}).items()) for k in (i, j))
        if not one or not two:
            return pd.DataFrame(columns=["a", "fa", "b", "fb"])
        both = _shared([h for _, (h, _) in one], [h for _, (h, _) in two])
        n, m = (np.array([len(h) for _, (h, _) in side]) for side in (one, two))
        u, v = (np.array([home for _, (_, home) in side]) for side in (one, two))
        hit = (both > 0) & (100 * both >= 75 * (n[:, None] + m[None, :] - both)) & ((u[:, None] != v[None, :]) | (u[:, None] == grp))
        found = [(*min(one[x][0], two[y][0]), *max(one[x][0], two[y][0])) for x, y in np.argwhere(np.triu(hit, 1) if i == j else hit)]
        return pd.DataFrame(found, columns=["a", "fa", "b", "fb"])

    return tiles.repartition(_tasks(tiles), "grp", "i", "j").groupBy("grp", "i", "j").applyInPandas(tile, LINK)


def _all_links(docs: DataFrame, buckets: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    about, sets, few, many = _candidates(docs, buckets, ["rep", "fp"])
    p = sets.select(F.struct("rep", "fp").alias("p")).distinct()
    twice = p.groupBy("p.rep").count().where("count > 1").select("rep")
    p = p.join(twice, F.col("p.rep") == F.col("rep")).select("rep", "p")  # sets of one representative, where a doc_id has several
    few = few.union(p.join(p.withColumnRenamed("p", "q"), "rep").where("p < q").select("p", "q")).distinct()
    ids = few.select(F.col("p.rep").alias("doc_id")).union(few.select("q.rep")).union(many.select("p.rep")).distinct()
    texts = _texts(docs.select("doc_id", "text"), ids)
    many = _homes(many)
    home = many.select("p", "home").distinct()
    few = few.join(home, "p", "left").join(home.toDF("q", "other"), "q", "left").where("home is null or other is null or home <> other").select("p", "q")
    return about, sets, stored(_verified_sets(few, texts).union(_crowd_links(many, texts)).distinct(), "links")


def jaccard_links(docs: DataFrame, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The join: all links (a, fa, b, fb) between different sets, each named by its smallest doc_id and its fingerprint, once; and the
    membership (doc_id, rep, fp) of documents in sets, as documents with equal sets are linked too."""
    _, sets, links = _all_links(docs, buckets)
    return links, sets


def jaccard_join(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """``near_duplicates`` and n_links: to how many other doc_ids the row's document is linked. Every link is verified. Its work grows with
    the number of links, in a large family with the square of its different texts."""
    about, sets, links = _all_links(docs, buckets)
    node_of = sets.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.count("*").alias("k"), F.min("fp").alias("f"))
    # Documents of one set only share that set's count; one of several sets has its own, over the union of what they reach.
    node_of = node_of.withColumn("key", F.when(F.col("k") == 1, F.col("f")).otherwise(F.encode(F.lpad(F.col("doc_id").cast("string"), 24, " "), "utf-8"))).drop("f")
    member = stored(sets.drop("rep").join(node_of, "doc_id"), "members")
    near = links.select(F.col("fa").alias("fp"), F.col("fb").alias("to")).union(links.select("fb", "fa")).union(sets.select("fp", "fp").distinct())
    reach = stored(member.select("key", "fp").distinct().join(near, "fp").select("key", F.col("to").alias("fp")).distinct(), "reach")
    ones = member.where("k = 1").groupBy("fp").agg(F.count("*").alias("n"))
    ones = reach.join(ones, "fp").groupBy("key").agg(F.sum("n").alias("n_one"))
    more = reach.join(member.where("k > 1").select("fp", "doc_id"), "fp").groupBy("key").agg(F.countDistinct("doc_id").alias("n_more"))
    comp = components(links.select("a", "b").union(sets.select("rep", "doc_id")))
    out = about.join(node_of, "doc_id", "left").join(comp, F.col("rep") == F.col("node"), "left").join(ones, "key", "left").join(more, "key", "left")
    n = F.when(F.col("key").isNull(), F.lit(0)).otherwise(F.coalesce("n_one", F.lit(0)) + F.coalesce("n_more", F.lit(0)) - 1)
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"), n.cast("long").alias("n_links"))

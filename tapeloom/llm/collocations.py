"""Phrases of two to five words that occur together more often than their parts explain, per language.

Texts (A-Z lowered) are split at punctuation and line ends into pieces, these at blanks into words. f of a phrase is the number of its
places within pieces. A candidate occurs at least ``MIN_COUNT`` times; its score is the smallest floor(1000 a n / (l r)) over the
ways to cut it in two, with a, l and r the counts of phrase, first part and rest and n the language's words. Candidates inside a
longer one of the same count are dropped, the first ``TOP`` of each language stay.

Weighted automata: a task gathers shards of text, sorts the distinct word windows of a shard and builds from them, window by
window, a minimal acyclic transducer whose states hold counts (``CountTransducer``). Its parts below the prefixes of one range (first
words, each with a part of its second words) become a row; Spark brings the rows of one prefix range together, and they are united
with their weights summed. Phrases read off the united automata meet their parts by a join: the composition of all cuts of the
candidates with the counts.

Which windows to enter is known from a round before: words and pairs of words are counted by 64-bit hashes, and those with
``MIN_COUNT`` or more set bits of a filter of at most ``FILTER_BYTES``. A part of a frequent phrase is frequent, so windows need not
reach over a pair outside the filter; a pair let in by chance costs time only, as all counts are exact in the end.

Nulls: a null text is empty, a null lang is ``und``. Every row counts, repeated ones too. Ties: smaller cut; then phrases by count, then
by UTF-8 bytes. Long texts are split piece by piece. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import marshal
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import small_batches, stored

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2_000
SHARD_BYTES, FILTER_BYTES = 12 << 20, 64 << 20
#: Prefix ranges of a language: a first word with a part of its second words (``FAN`` parts) lies in one of them. They are the tasks that
#: can unite automata side by side, and a shard gives at most one row to each.
RANGES, FAN = 1024, 8
BREAK = b"."
_FLAT = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes, step: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words in order, ``BREAK`` between pieces, in lists of bounded size."""
    flat, at = text.translate(_FLAT), 0
    while at < len(flat):
        end = flat.find(b" ", at + step)
        end = len(flat) if end < 0 else end
        yield flat[at:end].replace(b"\n", b" . ").split()
        at = end


class Shard:
    """Word numbers of many texts of one language; number 0 is a break."""

    def __init__(self) -> None:
        self.table: dict[bytes, int] = defaultdict(itertools.count().__next__)
        self.table[BREAK]
        self.parts: list[np.ndarray] = []

    def add(self, text: bytes) -> None:
        for words in tokens(text):
            self.parts.append(np.fromiter(map(self.table.__getitem__, words), np.int32, len(words)))
        self.parts.append(np.zeros(1, np.int32))

    def arrays(self, lang: str) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Numbers, words by number, and the words' hashes."""
        seed = xxhash.xxh64_intdigest(lang.encode())
        return np.concatenate(self.parts), list(self.table), np.array([xxhash.xxh64_intdigest(w, seed) for w in self.table], np.uint64)


def _shards(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[str, np.ndarray, list[bytes], np.ndarray]]:
    """Shards of about ``most`` bytes of a task's rows (lang, text)."""
    held: dict[str, Shard] = defaultdict(Shard)
    size = 0
    for b in small_batches(batches):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            raw = text.encode()
            held[lang].add(raw)
            size += len(raw)
            if size > most:
                yield from ((k, *x.arrays(k)) for k, x in held.items())
                held.clear()
                size = 0
    yield from ((k, *x.arrays(k)) for k, x in held.items())


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * _MIX + b) * _MIX
    return h ^ (h >> np.uint64(29))


def _pieces(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where(F.length("text") > 0)


def frequent_hashes(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Hashes of the words and word pairs that occur ``min_count`` times (and of none that occur less, but for collisions)."""

    most = SHARD_BYTES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, words, hashes in _shards(batches, most):
            n = np.bincount(ids, minlength=len(words))[1:]
            both = (ids[:-1] > 0) & (ids[1:] > 0)
            key, times = np.unique(ids[:-1][both].astype(np.int64) * len(words) + ids[1:][both], return_counts=True)
            h = np.concatenate((hashes[1:][n > 0], pair_hashes(hashes[key // len(words)], hashes[key % len(words)])))
            c = np.concatenate((n[n > 0], times))
            for i in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + (1 << 16)].view(np.int64)), pa.array(c[i : i + (1 << 16)])], ["h", "n"])

    return _pieces(docs).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).select("h")


class Filter:
    """Two bits for each hash; never says no to one that was put in."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for p in (h & self.mask, (h >> np.uint64(33)) & self.mask):
            out &= (self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out


def filter_of(hashes: DataFrame, most: int = FILTER_BYTES) -> Filter:
    """The filter of a stored table of hashes; it is put together in pieces, and its size is bounded by ``most`` bytes."""
    size = min(max(1 << 16, 1 << (2 * hashes.count()).bit_length()), most)
    mask, chunk = 8 * size - 1, 1 << 13
    at = F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 33).bitwiseAND(mask))).alias("p")

    def piece(key, rows):
        bits = np.zeros(8 * chunk, np.uint8)
        bits[rows["p"].to_numpy() % (8 * chunk)] = 1
        rows = rows.iloc[:1][["part"]].copy()
        rows["bits"] = [np.packbits(bits, bitorder="little").tobytes()]
        return rows

    places = hashes.select(at).distinct().withColumn("part", F.expr(f"p div {8 * chunk}"))
    bits = np.zeros(size, np.uint8)
    for r in places.groupBy("part").applyInPandas(piece, "part long, bits binary").collect():  # ``most`` bytes in all
        bits[r["part"] * chunk : (r["part"] + 1) * chunk] = np.frombuffer(r["bits"], np.uint8)
    return Filter(bits)


class CountTransducer:
    """Minimal acyclic automaton over word numbers, built from sorted word windows one after another.

    A state is (weight, ((word, state), ...)): the weight is the number of windows that pass it. States behind the last common prefix
    of two windows are final and are looked up in the register, so equal ones are held once.
    """

    def __init__(self) -> None:
        self.states: list[tuple[int, tuple]] = []
        self.register: dict[tuple[int, tuple], int] = {}
        self.open: list[tuple[int, int, list]] = [(0, 0, [])]  # word, windows before it, arcs of the states along the last window
        self.last = np.zeros(0, np.int64)
        self.seen = 0

    def _close(self, depth: int) -> None:
        states, register, path = self.states, self.register, self.open
        while len(path) > depth:
            word, before, arcs = path.pop()
            state = (self.seen - before, tuple(arcs))
            number = register.setdefault(state, len(states))
            if number == len(states):
                states.append(state)
            path[-1][2].append((word, number))

    def extend(self, rows: np.ndarray, times: np.ndarray) -> None:
        """Sorted distinct windows (0 after the last word) that come after all before."""
        above = np.vstack((np.pad(self.last, (0, rows.shape[1] - len(self.last)))[None], rows[:-1]))
        common = np.cumprod((rows == above) & (rows > 0), axis=1).sum(axis=1)
        for row, n, c, t in zip(rows.tolist(), (rows > 0).sum(axis=1).tolist(), common.tolist(), times.tolist(), strict=True):
            if len(self.open) > c + 1:
                self._close(c + 1)
            self.open += [(w, self.seen, []) for w in row[c:n]]
            self.seen += t
        if len(rows):
            self.last = rows[-1]

    def finish(self) -> list[tuple[int, int]]:
        """Arcs of the start state."""
        self._close(1)
        return self.open[0][2]

    def below(self, firsts: dict[int, list], weight: int, words: list[bytes]) -> bytes:
        """One range as an automaton of its own, words in place of numbers: ``firsts`` has the weight and the arcs of its first words."""
        place: dict[int, int] = {}
        out: list[tuple[int, tuple]] = []

        def walk(number: int) -> int:
            if number not in place:
                n, more = self.states[number]
                out.append((n, tuple([(words[w], walk(s)) for w, s in more])))
                place[number] = len(out) - 1
            return place[number]

        start = []
        for first, (n, *arcs) in firsts.items():
            out.append((n, tuple([(words[w], walk(s)) for w, s in arcs])))
            start.append((words[first], len(out) - 1))
        out.append((weight, tuple(start)))
        return marshal.dumps(out)


def unite(node: list, states: list[tuple[int, tuple]], at: int) -> None:
    """Adds an automaton's weights to a tree of [weight, {word: node}]."""
    weight, arcs = states[at]
    node[0] += weight
    for word, target in arcs:
        below = node[1].get(word)
        if below is None:
            below = node[1][word] = [0, {}]
        unite(below, states, target)


def windows(ids: np.ndarray, passes: np.ndarray, longest: int) -> np.ndarray:
    """A row of ``longest`` word numbers (0: none) from each place that a pair which passes begins at."""
    at = np.flatnonzero(passes)
    out = np.zeros((len(at), longest), np.int64)
    out[:, 0] = ids[at]
    goes = np.ones(len(at), bool)
    passes = np.concatenate((passes, np.zeros(longest, bool)))
    for k in range(1, longest):
        goes = goes & passes[at + k - 1]
        out[goes, k] = ids[at[goes] + k]
    return out


def shard_rows(ids: np.ndarray, words: list[bytes], hashes: np.ndarray, known: Filter, longest: int, count: int = RANGES) -> Iterator[tuple[int, bytes]]:
    """Rows (range, automaton) of one shard; the start state of range 0 weighs all words."""
    n = np.bincount(ids, minlength=len(words))
    n[0] = 0
    told = np.flatnonzero((n > 0) & known(hashes))
    both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    passes = np.zeros(len(ids), bool)
    passes[both] = known(pair_hashes(hashes[ids[both]], hashes[ids[both + 1]]))
    # numbers in byte order of the words, for what takes part
    used = np.unique(np.concatenate((told, ids[passes], ids[1:][passes[:-1]])))
    order = used[np.argsort(np.array([words[i] for i in used], object), kind="stable")] if len(used) else used
    rank = np.zeros(len(words), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    named = [b"", *(words[i] for i in order)]
    home, fan = (np.append(0, (hashes[order] >> np.uint64(k)) % np.uint64(m)).astype(int).tolist() for k, m in ((20, count), (40, FAN)))
    ranges: dict[int, dict[int, list]] = defaultdict(dict)
    ranges[0] = {}
    for i, times in zip(rank[told].tolist(), n[told].tolist(), strict=True):
        ranges[home[i]][i] = [times]
    automaton = CountTransducer()
    rows = windows(rank[ids], passes, longest)
    if len(rows):
        bits = len(named).bit_length()
        automaton.extend(*(np.unique(rows, axis=0, return_counts=True) if longest * bits > 126 else _distinct(rows, bits)))
    for first, state in automaton.finish():
        for word, target in automaton.states[state][1]:
            ranges[(home[first] + 131 * fan[word]) % count].setdefault(first, [0]).append((word, target))
    for r, firsts in ranges.items():
        yield r, automaton.below(firsts, int(n.sum()) if r == 0 else 0, named)


def _distinct(rows: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows and their number, by two packed keys."""
    half = (rows.shape[1] + 1) // 2
    keys = [np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)]
    for k in range(rows.shape[1]):
        keys[k >= half] = keys[k >= half] << bits | rows[:, k]
    order = np.lexsort((keys[1], keys[0]))
    a, b = keys[0][order], keys[1][order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(rows)])
    return rows[order[first]], np.diff(np.append(first, len(rows)))


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = MAX_WORDS) -> DataFrame:
    """Rows (lang, phrase, size, f) of all phrases of up to ``longest`` words that occur ``min_count`` times; size 0 has the
    number of words."""
    hashes = stored(frequent_hashes(docs, min_count), "frequent")
    known = docs.sparkSession.sparkContext.broadcast(filter_of(hashes, FILTER_BYTES))  # at most so many bytes
    most, count = SHARD_BYTES, RANGES

    def automata(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, words, hashes in _shards(batches, most):
            rows = shard_rows(ids, words, hashes, known.value, longest, count)
            while part := list(itertools.islice(rows, 512)):
                r, blob = zip(*part, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(r, pa.int32()), pa.array(blob, pa.binary())], ["lang", "part", "automaton"])

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree = None, [0, {}]

        def told() -> Iterator[tuple[str, bytes, int, int]]:
            lang, part = key
            if part == 0:
                yield lang, b"", 0, tree[0]
            for first, top in tree[1].items():
                if top[0] >= min_count:  # elsewhere the first word has no weight, its longer phrases may
                    yield lang, first, 1, top[0]
                stack = [((first, w), n) for w, n in top[1].items()]
                while stack:
                    phrase, node = stack.pop()
                    if node[0] >= min_count:
                        yield lang, b" ".join(phrase), len(phrase), node[0]
                        stack += [((*phrase, w), n) for w, n in node[1].items()]

        def batch(rows: list) -> pa.RecordBatch:
            lang, phrase, size, f = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(size, pa.int32()), pa.array(f, pa.int64())], ["lang", "phrase", "size", "f"])

        rows: list = []
        for b in batches:
            for lang, part, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (lang, part) != key:
                    rows += told() if key else ()
                    key, tree = (lang, part), [0, {}]
                    if len(rows) > 10_000:
                        yield batch(rows)
                        rows = []
                states = marshal.loads(blob)
                unite(tree, states, len(states) - 1)
        rows += told() if key else ()
        if rows:
            yield batch(rows)

    ranges = ["lang", "part"]
    shards = _pieces(docs).mapInArrow(automata, "lang string, part int, automaton binary")
    shards = stored(shards, "automata")  # Spark samples what it range-partitions: without this they would be built twice
    return shards.repartitionByRange(*ranges).sortWithinPartitions(*ranges).mapInArrow(united, "lang string, phrase string, size int, f long")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = MAX_WORDS, top: int = TOP) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score)."""
    counts = stored(phrase_counts(docs, min_count, longest), "phrases")
    wide = "decimal(20,0)"
    phrases = counts.where("size >= 2").withColumn("words", F.split("phrase", " "))
    cuts = phrases.withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", F.array_join(F.expr("slice(words, 1, k)"), " ").alias("first"), F.array_join(F.expr("slice(words, k + 1, size)"), " ").alias("rest"))
    one = counts.where("size >= 1")
    cuts = cuts.join(one.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(one.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(counts.where("size = 0").select("lang", F.col("f").alias("n")), "lang")
    score = F.expr(f"(cast(a AS {wide}) * cast(n AS {wide}) * cast(1000 AS decimal(4,0))) div (cast(l AS {wide}) * cast(r AS {wide}))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    # a phrase inside a longer one of its count is also inside one that is longer by one word, as counts never grow with length
    longer = phrases.where("size >= 3").select("lang", "f", F.explode(F.expr("array(array_join(slice(words, 1, size - 1), ' '), array_join(slice(words, 2, size - 1), ' '))")).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

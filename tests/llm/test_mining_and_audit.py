"""Phrases, source divergence and line dedup against brute force and closed cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tapeloom.llm import collocations, divergence, line_dedup

DOC = "doc_id long, text string, lang string, source string, n_lines string, rank int, score double"


def rows_of(kind: int):
    rng = random.Random(kind)
    pool = ["the", "of", "and", "ab", "Éx", "x#y", "q\x01", "w-w", "ñu", "12", *(f"v{i}" for i in range(25))]
    rows = []
    for i in range(260):
        t = " ".join(rng.choices(pool, weights=[9, 8, 7, *[1] * (len(pool) - 3)], k=rng.choice([0, 1, 4, 30, 90])))
        if i % 3 == 0:
            t += rng.choice([". ", "\n", ",", " "]) + "kind regards from us all" + rng.choice(["", "!", " the of", "\t \x0cand"])
        if i % 7 == 0:
            t = t.upper().replace(" ", "  ")
        rows.append((i, t, ("en", "de", None)[i % 3], f"s{i % 4}" if i % 11 else None, "clash", 7, 0.5))
    return [*rows, (300, None, "en", "s1", None, None, None), (301, "", "fr", "only", None, None, None), (302, "zz " * 3000, "fr", "long", None, None, None), rows[5], rows[5], (None, "the of and", "en", "s2", None, None, None), (303, None, "fr", None, None, None, None)]


# phrases


def brute_phrases(rows, least, longest=5, top=2000):
    counts, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        often = {p: f for p, f in c.items() if f >= least}
        found = []
        for p, a in often.items():
            if len(p) < 2 or any(f >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, f in often.items()):
                continue
            score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least,shard,size,top", [(5, 12 << 20, 64 << 20, 2000), (3, 2_000, 1 << 16, 2000), (20, 500, 8 << 10, 7)])
def test_phrases(spark, monkeypatch, least, shard, size, top):
    """Small shards, a filter that lets almost all pass and few top rows change nothing."""
    monkeypatch.setattr(collocations, "SHARD_BYTES", shard)
    monkeypatch.setattr(collocations, "FILTER_BYTES", size)
    monkeypatch.setattr(collocations, "RANGES", 3 if shard == 500 else 1024)
    rows = rows_of(1)
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    got = collocations.collocations(docs, min_count=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_phrases(rows, least, top=top)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 10
    assert collocations.collocations(docs.limit(0), min_count=least).count() == 0


def test_transducer_is_minimal_and_united():
    """Equal continuations are one state, and the union has the sums."""
    a = collocations.CountTransducer()
    a.extend(np.array([(1, 2, 3), (4, 2, 3)]), np.array([2, 2]))
    a.extend(np.array([(4, 2, 5), (6, 0, 0)]), np.array([1, 1]))
    arcs = dict(a.finish())
    assert len(a.states) == len(set(a.states)) == 6 and a.states[arcs[4]][0] == 3 and a.states[arcs[1]][0] == 2
    rng = np.random.default_rng(3)
    words = [b"", *(f"w{i}".encode() for i in range(6))]
    want, tree = Counter(), [0, {}]
    for _ in range(20):
        shard = Counter(tuple(int(x) for x in rng.integers(1, 7, rng.integers(1, 6))) for _ in range(40))
        t = collocations.CountTransducer()
        t.extend(np.array([(*w, *[0] * (5 - len(w))) for w in sorted(shard)]), np.array([shard[w] for w in sorted(shard)]))
        firsts = {w: [t.states[i][0], *t.states[i][1]] for w, i in t.finish()}
        states = collocations.marshal.loads(t.below(firsts, 0, words))
        collocations.unite(tree, states, len(states) - 1)
        for w, n in shard.items():
            for k in range(1, len(w) + 1):
                want[w[:k]] += n
    got, stack = {}, [((), tree)]
    while stack:
        path, node = stack.pop()
        got[path] = node[0]
        stack += [((*path, words.index(w)), x) for w, x in node[1].items()]
    assert {k: v for k, v in got.items() if k} == dict(want)


def test_filter_never_says_no(spark):
    rng = np.random.default_rng(8)
    h = rng.integers(-(1 << 63), 1 << 63, 5000)
    f = collocations.filter_of(spark.createDataFrame([(int(x),) for x in h], "h long"))
    other = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    assert f(h.view(np.uint64)).all() and f(other).mean() < 0.1


def test_wide_scores(spark, monkeypatch):
    """Products beyond 64 bits."""
    counts = spark.createDataFrame([("en", "", 0, 9 * 10**15), ("en", "a", 1, 4 * 10**12), ("en", "b", 1, 3 * 10**12), ("en", "a b", 2, 10**12)], "lang string, phrase string, size int, f long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_: counts)
    (r,) = collocations.collocations(counts.limit(0)).collect()
    assert (r["l"], r["r"], r["score"]) == (4 * 10**12, 3 * 10**12, 1000 * 10**12 * 9 * 10**15 // (12 * 10**24))


# divergence


def brute_divergence(rows, least=3, top=200):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        text, lang, source = (x or "" for x in (text, lang, source))
        w = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        groups.add((lang, source))
        count[lang, source].update(w)
        docs[lang].update(set(w))
    out = []
    for lang in {x for x, _ in groups}:
        kept = [w for w, n in docs[lang].items() if n >= least]
        mine = [s for x, s in groups if x == lang]

        def p(c):
            n = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 1) // (n + len(kept)) for w in kept}

        rate = {s: p(count[lang, s]) for s in mine}
        whole = p(sum((count[lang, s] for s in mine), Counter()))
        for s in mine:
            f = lambda q: {w: (rate[s][w] - q[w]) ** 2 // q[w] for w in kept}  # noqa: E731, B023
            pairs = sorted((-sum(f(rate[o]).values()), o.encode()) for o in mine if o != s)
            out += [(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pairs)]
            terms = sorted((-v, w.encode()) for w, v in f(whole).items() if count[lang, s][w] and rate[s][w] > whole[w])[:top]
            out += [(lang, s, "term", w.decode(), -v, i + 1) for i, (v, w) in enumerate(terms)]
    return sorted(out)


@pytest.mark.parametrize("shard,block,held,top", [(4096, 64, 400_000, 200), (3, 2, 10, 4), (1, 1, 1, 200)])
def test_divergence(spark, monkeypatch, shard, block, held, top):
    """Shards of few classes, blocks of one source and counters that are written at once change nothing."""
    for name, value in (("SHARD", shard), ("BLOCK", block), ("HELD", held)):
        monkeypatch.setattr(divergence, name, value)
    rows = rows_of(2)
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    got = divergence.divergence(docs, top=top)
    want = brute_divergence(rows, top=top)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 100
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_rates_beyond_64_bits():
    n = 3 * 10**13
    assert divergence.rates(np.array([0, n, 7, n]), 4 * 10**13, 10).tolist() == [1 + 10**9 * (c + 1) // (4 * 10**13 + 10) for c in (0, n, 7, n)]


def test_rates_in_sql(spark):
    n = 3 * 10**13
    df = spark.createDataFrame([(n, 4 * 10**13, 10), (0, 0, 1)], "n long, total long, kept long")
    assert [r[0] for r in df.select(divergence.rate("n", "total", "kept")).collect()] == [1 + 10**9 * (n + 1) // (4 * 10**13 + 10), 1 + 10**9]


# lines


def brute_lines(rows, chars=40, least=5):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    held = defaultdict(set)
    for d, text, *_ in rows:
        for line in (text or "").split("\n"):
            if d is not None and len(key(line)) >= chars:
                held[key(line)].add(d)
    out = []
    for d, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if d is None or len(key(x)) < chars or len(held[key(x)]) < least or d == max(held[key(x)])]
        out.append((-1 if d is None else d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def line_rows():
    rng = random.Random(4)
    common = [f"line {i} that many documents share é " + "x" * rng.randint(5, 30) for i in range(12)]
    edge = ["e" * 39, "e" * 40, " " * 50, "é" * 40]
    rows = []
    for i in range(400):
        lines = [rng.choice([*edge, f"own line of document {i} number {k} and more"]) for k in range(rng.randint(0, 4))]
        lines += rng.sample(common, rng.randint(0, 3)) * rng.choice([1, 1, 3])
        if i % 2:
            lines.append("The Very Common line that half of all documents have \x0b")
        if i % 50 == 0:
            lines.append("four documents only have this one, and no fifth " + "abc"[i // 200])
        rng.shuffle(lines)
        lines = [f" \t{x.upper()}\r" if rng.random() < 0.2 else x for x in lines]
        rows.append((i * 7 % 401, "\n".join(lines), "en", "s", "clash", 1, 0.1))
    long = "\n".join(common * 3000)
    return [*rows, rows[3], rows[3], (rows[8][0], rows[9][1], None, None, None, None, None), (None, rows[1][1], None, None, None, None, None), (900, None, None, None, None, None, None), (901, "", None, None, None, None, None), (-5, long, None, None, None, None, None), (902, "\n\n", None, None, None, None, None)]


@pytest.mark.parametrize("partitions,batch", [(4, 10_000), (23, 7), (1, 3)])
def test_lines(spark, partitions, batch):
    """Runs that cross batches and many partitions, repeated rows, one line in half of all documents."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, (str(partitions), str(batch), "false"), strict=True):
            spark.conf.set(n, v)
        rows = line_rows()
        docs = spark.createDataFrame(rows, DOC).repartition(5)
        out = line_dedup.without_repeated_lines(docs)
        got = out.collect()
        assert out.columns == ["doc_id", "text", "lang", "source", "rank", "score", "n_lines", "n_dropped"]
        want = brute_lines(rows)
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in got) == want
        assert sum(r[2] for r in want) > 30_000
        maps = line_dedup.keep_bitmaps(docs).collect()
        assert len({(r["doc_id"], r["text_print"]) for r in maps}) == len(maps) and sum(len(r["keep"]) for r in maps) < 40 * len(maps)
        assert line_dedup.without_repeated_lines(docs.limit(0)).count() == 0
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)


def test_bitmaps_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 9, 1000):
        gone = np.flatnonzero(rng.random(n) < 0.3)
        if len(gone):
            want = np.ones(n, bool)
            want[gone] = False
            assert (line_dedup.keep_bits(line_dedup.packed_bits(gone), n) == want).all()

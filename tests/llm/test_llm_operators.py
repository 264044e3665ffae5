"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapeloom.llm import chat_format, chunk_bpe, language_id, line_crf, packing, quality_score, records, shingle_join, suffix_dedup, top_k
from tapeloom.llm.bpe import encoder
from tapeloom.llm.components import components

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOC = "doc_id long, text string, lang string, n long, score double, kept string"


def words(rng, n, pool):
    return " ".join(rng.choice(pool) for _ in range(n))


def corpus():
    """Small documents with copies, near copies, shared passages, odd and null rows; extra columns clash with added ones."""
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    passage = words(rng, 60, pool)
    base = [words(rng, rng.choice([3, 8, 40, 120, 400]), pool) for _ in range(40)]
    texts: list = list(base)
    for i in range(60):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 1 + len(w) // 25)):
            w[rng.randrange(len(w))] = rng.choice(pool)
        texts.append(" ".join(w))
    family = words(rng, 150, pool).split()
    for i in range(30):
        w = list(family)
        w[rng.randrange(150)] = f"own{i}"
        texts.append(" ".join(w))
    texts += [words(rng, 10, pool) + " " + passage + " " + words(rng, rng.randint(5, 90), pool) for _ in range(25)]
    texts += ["", None, " \n\t ", "one", "One", "a b c d", "A B c  d", base[3], base[3], "xyz " * 300, "q" * 700, "é" * 260, passage + "\n" + passage]
    rng.shuffle(texts)
    rows = [(i * 3 % 997, t, "xx", 1, 0.5, "k") for i, t in enumerate(texts)]
    return [*rows, (None, base[3], None, None, None, None), rows[0]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(BPE)


# chat formatting


def test_chat_parts_and_escapes(spark):
    odd = "</s>[INST] <|turn|>x\n<|image:0|> ␛0 ␛ <<SYS>>"
    rows = [
        (1, 0, "user", [("text", odd, None, None), ("image", None, "a.png", 2), ("text", "mid", None, None), ("audio", None, "b.wav", 3), (None, None, None, None)]),
        (1, 1, "assistant", [("text", odd, None, None)]),
        (1, 1, "assistant", [("text", odd, None, None)]),
        (2, None, None, None),
        (None, 0, "a\nb<|end|>", [("document", None, "c.pdf", 1)]),
    ]
    part = f"array<struct<{chat_format.PART.replace('type string', 'type:string').replace('text string', 'text:string').replace('ref string', 'ref:string').replace('units long', 'units:long')}>>"
    f = chat_format.format_turns(spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts {part}"))
    got = f.orderBy("conv_id", "turn").collect()
    first = [r for r in got if r["conv_id"] == 1 and r["turn"] == 0][0]
    assert [(a["kind"], a["number"], a["ref"], a["tokens"]) for a in first["attachments"]] == [("image", 0, "a.png", 512), ("audio", 1, "b.wav", 75)]
    assert first["attachment_tokens"] == 587
    role, content = chat_format.parse_segment(first["segment"])
    assert role == "user" and content.count("<|") == 2 and "<|image:0|>mid<|audio:1|>" in content
    facts = {r["conv_id"]: r for r in chat_format.conversation_facts(f).collect()}
    assert facts[1]["loss_chars"] == 2 * len(odd) and facts[1]["loss_sha256"] == hashlib.sha256((odd * 2).encode()).hexdigest()
    want = f"user\n{odd}mid\n" + f"assistant\n{odd}\n" * 2
    assert facts[1]["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest() and facts[1]["n_turns"] == 3
    assert facts[2]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest() and facts[2]["loss_chars"] == 0
    assert facts[None]["turns_sha256"] == hashlib.sha256(b"a\nb<|end|>\n\n").hexdigest()


def test_chat_ties_by_plain_text(spark):
    """Turns of one number and role are ordered by their text as it came, control strings or not."""
    texts = ["a", "a b", "<s>a", "a\n", "[INST]", "␛", "<|x", "zz", "", "Ω", "␛1"]
    turns = spark.createDataFrame([(1, 0, "user", t) for t in texts], "conv_id long, turn int, role string, text string")
    (got,) = chat_format.conversation_facts(chat_format.format_turns(chat_format.with_text_part(turns))).collect()
    want = "".join(f"user\n{t}\n" for t in sorted(texts, key=str.encode))
    assert got["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_chat_unescape_is_inverse(spark):
    rng = random.Random(2)
    bits = ["␛", "<", "|", ">", "[INST]", "</s>", "<s>", "0", "1", "9", "x", "\n", "<<SYS>>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escaped(F.col("t")).alias("e"), chat_format.escaped_role(F.col("t")).alias("r")).collect()
    for r in got:
        assert chat_format.unescape(r["e"]) == r["t"] == chat_format.unescape(r["r"])
        assert not any(c in r["e"] for c in chat_format.CONTROL) and "\n" not in r["r"]


# near duplicates


def brute_links(rows):
    sets = []
    for d, t, *_ in rows:
        w = [x.decode() for x in (t or "").encode().lower().split()]
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())))
    group = {d: d for d, _ in sets if d is not None}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if None not in (a, b) and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((top(a), top(b)))
                group[y] = x
    return sorted((d if d is not None else -1, len(s), top(d) if d is not None else -1) for d, s in sets)


@pytest.mark.parametrize("few", [8, 2])
def test_near_duplicates(docs, few, monkeypatch):
    monkeypatch.setattr(shingle_join, "FEW", few)
    monkeypatch.setattr(shingle_join, "TILE", 4)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in shingle_join.near_duplicates(docs).collect())
    assert got == brute_links([tuple(r) for r in docs.collect()])


def brute_pairs(rows):
    """Number of linked other doc_ids of every doc_id, and linked pairs of different sets."""
    sets = defaultdict(set)
    for d, t, *_ in rows:
        w = [x.decode() for x in (t or "").encode().lower().split()]
        s = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
        if d is not None and s:
            sets[s].add(d)
    near, pairs, all_ = defaultdict(set), 0, list(sets)
    for i, s in enumerate(all_):
        for t in all_[: i + 1]:
            if 100 * len(s & t) >= 75 * len(s | t):
                pairs += s != t
                for x in sets[s]:
                    near[x] |= sets[t]
                for x in sets[t]:
                    near[x] |= sets[s]
    return {d: len(v - {d}) for d, v in near.items()}, pairs


@pytest.mark.parametrize("few", [8, 2])
def test_all_links(spark, docs, few, monkeypatch):
    """Every link is found and counted, repeated doc_ids with other texts included."""
    monkeypatch.setattr(shingle_join, "FEW", few)
    monkeypatch.setattr(shingle_join, "TILE", 4)
    rows = [tuple(r)[:2] for r in docs.collect()]
    texts = [t for _, t in rows if t and len(t) > 300]
    rows += [(rows[k][0], texts[k]) for k in range(0, 40, 3)]
    many = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    links, pairs = brute_pairs(rows)
    got = shingle_join.jaccard_join(many).collect()
    assert len(got) == len(rows) and {(r["doc_id"], r["n_links"]) for r in got} == {(d, links.get(d, 0)) for d, _ in rows}
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in shingle_join.near_duplicates(many).collect())
    found, _ = shingle_join.jaccard_links(many)
    assert found.count() == found.distinct().count() == pairs > 400


def test_crowds_meet_once(spark, monkeypatch):
    """A family whose words make many groups is compared in few of them, gives each link once, and its tiles go to all tasks."""
    monkeypatch.setattr(shingle_join, "FEW", 2)
    monkeypatch.setattr(shingle_join, "TILE", 8)
    rng = random.Random(21)
    base = [f"w{rng.randrange(10**6)}" for _ in range(240)]
    rows = []
    for i in range(60):
        w = list(base)
        for at in rng.sample(range(240), rng.randint(0, 5)):
            w[at] = f"x{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, sets, _, many = shingle_join._candidates(docs, None, ["rep", "fp"])
    homes = shingle_join._homes(many)
    assert homes.count() < many.count() / 2 and homes.select("p").distinct().count() == many.select("p").distinct().count()
    texts = shingle_join._texts(docs, many.select("p.rep").distinct().toDF("doc_id"))
    found = shingle_join._crowd_links(homes, texts)
    assert found.rdd.getNumPartitions() == shingle_join._tasks(docs)
    assert found.count() == found.distinct().count() > 300
    links, pairs = brute_pairs(rows)
    assert {(r["doc_id"], r["n_links"]) for r in shingle_join.jaccard_join(docs).collect()} == {(d, links.get(d, 0)) for d, _ in rows}
    assert shingle_join.jaccard_links(docs)[0].count() == pairs


def test_sketch_guarantee():
    """Linked sets share at least as many non-empty words, in the scheme of the larger, as either guarantees."""
    rng = np.random.default_rng(4)
    for n in [1, 2, 3, 5, 7, 9, 17, 40, 77, 130, 400, 1500]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            drop = rng.integers(0, n // 7 + 1)
            b = np.unique(np.concatenate((a[drop:], rng.integers(0, 1 << 63, int(drop), dtype=np.uint64))))
            if not len(b) or not shingle_join._linked(a, b):
                continue
            scheme = shingle_join.band_of(max(len(a), len(b)))
            (ka, ga), (kb, gb) = shingle_join.sketch_keys(a, scheme), shingle_join.sketch_keys(b, scheme)
            assert len(np.intersect1d(ka, kb)) >= max(1, ga, gb)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}


# language and quality


def labelled(n=400):
    rng = random.Random(9)
    pools = {k: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(120)] for k, letters in (("aa", "abcdefgh"), ("bb", "ijklmnop"), ("cc", "aeijouqr"))}
    rows = []
    for i in range(n):
        lang = ("aa", "bb", "cc")[i % 3]
        t = words(rng, rng.choice([4, 30, 200]), pools[lang])
        if i % 5 == 0:
            t = " ".join(f"{w.upper()}{rng.choice('#%&')}" for w in t.split())
        rows.append((i, t, lang, len(t), None, None))
    return [*rows, (n, None, "aa", 0, None, None), (n + 1, "12 ## 34", "bb", 0, None, None), (n + 2, "", None, 0, None, None), (None, "abc", None, 0, None, None)]


def test_language(spark, none):
    rows = labelled()
    df = spark.createDataFrame(rows, DOC)
    out = {r["doc_id"]: r for r in language_id.with_language(df, language_id.learn(df)).collect()}
    held = [(r[2], out[r[0]]) for r in rows[:400] if zlib.crc32(str(r[0]).encode()) % 4 == 2 and r[3] > 60]  # four words say little
    assert sum(lang == o["lang_pred"] for lang, o in held) >= 0.97 * len(held)
    assert [out[k]["lang_pred"] for k in (400, 401, 402)] == ["und"] * 3 and all(0 <= o["score"] <= 1 for o in out.values())
    assert out[None]["lang_pred"] in ("aa", "bb", "cc") and len(out) == len(rows)
    assert language_id.with_language(none, language_id.learn(none)).count() == 0
    assert {r["lang_pred"] for r in language_id.with_language(df, {}).collect()} == {"und"}


def test_language_of_a_long_clean_text(spark):
    """10 MB in one language are as clear as 50 KB; a text in two halves is read to its end."""
    rng = random.Random(12)
    pools = {k: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(4000)] for k, letters in (("aa", "abcdefghi"), ("bb", "abcdefghj"))}
    known = language_id.learn(spark.createDataFrame([(i, words(rng, 100, pools[("aa", "bb")[i % 2]]), ("aa", "bb")[i % 2], 0, None, None) for i in range(600)], DOC))
    pages = {k: " ".join(rng.choices(p, k=1_700_000)) for k, p in pools.items()}
    assert all(len(p) > 10_000_000 for p in pages.values())
    rows = [(0, pages["aa"]), (1, pages["bb"]), (2, pages["aa"][:50_000]), (3, pages["aa"][:300_000] + pages["bb"][:600_000])]
    out = language_id.with_language(spark.createDataFrame(rows, "doc_id long, text string"), known)
    got = {r["doc_id"]: r for r in out.select("doc_id", "lang_pred", "score", language_id.accepted().alias("ok")).collect()}
    assert [got[k]["lang_pred"] for k in range(4)] == ["aa", "bb", "aa", "bb"] and all(got[k]["ok"] for k in range(4))
    assert abs(got[0]["score"] / got[2]["score"] - 1) < 0.2


def test_quality(spark, none):
    rows = labelled()
    df = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1, "x") for i in range(400)] + [(None, 1, ""), (401, None, "")], "doc_id long, quality int, text string")
    out = {r["doc_id"]: r for r in quality_score.with_quality(df, quality_score.learn(df, labels)).collect()}
    held = [(i % 5 != 0, out[i]) for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    good, bad = [o["score"] for y, o in held if y], [o["score"] for y, o in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert all(0 <= o["score"] <= 1 and o["predicted"] == (o["score"] >= 0.3) for o in out.values()) and len(out) == len(rows)
    one = quality_score.learn(df, labels.where("quality = 1"))
    assert {r["score"] for r in quality_score.with_quality(df, one).collect()} == {1.0}
    assert quality_score.with_quality(none, quality_score.learn(none, labels)).count() == 0


def test_quality_of_long_texts(spark):
    """The score follows what a text is made of and not its length: 1 KB, 100 KB and 10 MB."""
    rng = random.Random(13)
    pool = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    good = lambda k: " ".join(rng.choices(pool, k=k))
    bad = lambda k: " ".join(w.upper() + "$$$" for w in rng.choices(pool, k=k))
    rows = [(i, (bad if i % 3 == 0 else good)(rng.choice([5, 40, 300])), 0 if i % 3 == 0 else 1) for i in range(900)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    model = quality_score.learn(df, labels)
    long = {}
    for k, f in enumerate((good, bad)):
        for j, n in enumerate((1_000, 100_000, 10_000_000)):
            page = f(150_000 if n > 1e6 else 15_000)
            long[10 * k + j] = (page * (1 + n // len(page)))[:n]
    got = {r["doc_id"]: r for r in quality_score.with_quality(spark.createDataFrame(list(long.items()), "doc_id long, text string"), model).collect()}
    assert all(got[j]["score"] > 0.9 and got[10 + j]["score"] < 0.1 for j in range(3))
    assert abs(got[1]["score"] - got[2]["score"]) < 0.02 and abs(got[11]["score"] - got[12]["score"]) < 0.02
    # ties, and a labelled doc_id that many rows repeat
    twice = quality_score.with_quality(df.union(df), model).groupBy("doc_id").agg(F.countDistinct("score").alias("n"))
    assert twice.where("n > 1").count() == 0
    again = df.unionByName(spark.createDataFrame([(1, t) for _, t, _ in rows], "doc_id long, text string"))
    assert quality_score.learn(again, labels)["curve"] is not None


# tokens


ODD = ["", "a <|endoftext|> b", "<|endoftext|>", "  lead\n\n\nfoo  bar\t\n" * 90, "中文字符" * 900 + " end of it", "  nb  sp " * 200, "it's we'll 'll 's" * 200, ". . . " * 400, "x" * 4000, "a\n", "\na", " a", "a ", "\x1c \x85 b " * 300]


def test_encoder_equals_library(tok):
    texts = ODD + [r[1] or "" for r in corpus()]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder(BPE).encode_many(texts)] == want
    work = chunk_bpe.Assembler(encoder(BPE), {})
    assert [i.tolist() for i in work.ids_many(texts)] == want
    assert work.repairs > 0
    assert [work.decode(np.array(i, "<u4")) for i in want] == [tok.decode(i, skip_special_tokens=False) for i in want]


def test_chunked_documents(spark, docs, none, tok):
    long = words(random.Random(1), 3000, ["alpha", "beta", "gamma,", "Delta", "ünï"])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(5000 + i, t) for i, t in enumerate([*ODD, long, long + " end", "front " + long])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, chunk_bpe.encoded_documents(df, BPE).collect()), key=str)
    want = []
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert chunk_bpe.encoded_documents(none, BPE).count() == 0


def test_records(spark, docs, none, tok, tmp_path):
    folder = f"file://{tmp_path}/r"
    manifest = records.write_records(docs, folder, BPE, 2)
    got = records.read_records(manifest, folder).collect()
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, want = 0, []
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=lambda r: r[1]) == want
    paths = {r["shard"]: r["path"] for r in manifest.collect()}
    for r in got[:20]:  # shuffled reads through the index
        store, _ = records.open_store(folder)
        none_flag, d = struct.unpack_from("<Bq", records.read_at(store, paths[r["shard"]], r["offset"]))
        assert (None if none_flag else d) == r["doc_id"]
    damaged = next(tmp_path.glob("r/*.rec"))
    raw = bytearray(damaged.read_bytes())
    raw[40] ^= 1
    damaged.write_bytes(raw)
    with pytest.raises(Exception, match="damaged"):
        records.read_records(manifest, folder).collect()
    assert records.token_records(none, BPE, 2).count() == 0


def test_packing(docs, none, tok):
    got = packing.packed_documents(docs, BPE, capacity=128).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["sequence_id"]].append(r)
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0])
    for d, rows in by_doc.items():
        want = []
        for ids in texts[d]:
            at, i = 0, 0
            while at < len(ids):
                n = (len(ids) % 128 or 128) if i == 0 else 128
                want.append((i, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
                at, i = at + n, i + 1
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    for rows in by_bin.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 128
    total = sum(r["length"] for r in got)
    assert len(by_bin) <= -(-total // 128) * 1.03 + 1
    assert packing.packed_documents(none, BPE).count() == 0


def test_best_two_fit_beats_greedy():
    lengths = np.array([6, 3, 5, 4, 2])  # greedy filling of 10 takes 6 + 4, then 5 + 3 + 2
    bins, offsets = packing.best_two_fit(lengths, 10)
    assert len(set(bins.tolist())) == 2
    lengths = np.array([7, 2, 5, 4, 1, 1])
    bins, _ = packing.best_two_fit(lengths, 10)
    assert len(set(bins.tolist())) == 2
    rng = np.random.default_rng(0)
    lengths = np.minimum(2048, rng.lognormal(5.5, 1.2, 3000).astype(int) + 1)
    bins, _ = packing.best_two_fit(lengths, 2048)
    assert np.bincount(bins, lengths).max() <= 2048 and bins.max() + 1 <= -(-lengths.sum() // 2048) + 1


# search


def test_top_k(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[10:60] = v[10]  # many ties
    rows = [(int(i), [float(c) for c in x], 1, 2) for i, x in enumerate(v)]
    rows += [(400, None, 1, 2), (450, [1.0, None], 1, 2), (500, [float("nan")] * 8, 1, 2), (550, [float("inf")] * 8, 1, 2), (None, [1.0] * 8, 1, 2), (0, [float(c) for c in v[0]], 1, 2), (600, [3e17, 1.0] + [0.0] * 6, 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score int").repartition(3)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k.top_k(df.select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, 5).collect())
    whole = {i: [int(np.floor(256 * np.float64(np.float32(c)))) for c in x] for i, x, *_ in rows if i is not None and x and all(c is not None and np.isfinite(c) for c in x)}
    wrap = lambda s: (s + 2**63) % 2**64 - 2**63
    want = []
    for q in [i for i in whole if i % 50 == 0]:
        s = sorted((-wrap(sum(a * b for a, b in zip(whole[q], x))), i) for i, x in whole.items() if i != q)[:5]
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert got == sorted(want)
    assert top_k.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_on_a_grid(spark, monkeypatch):
    """Many small cells, vectors of other lengths and repeated ids."""
    monkeypatch.setattr(top_k, "BLOCK", 8)
    monkeypatch.setattr(top_k, "SIDE", 2)
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(size=3 if i % 9 else 5) * (1e6 if i % 13 == 0 else 1)]) for i in range(300)]
    rows += [(i, [float(c) for c in rng.normal(size=3)]) for i in range(0, 300, 10)] + [rows[4]] * 3 + [(777, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = sorted(tuple(r) for r in top_k.top_k(df, F.col("vec_id") % 5 == 0, 4).collect())
    whole = {}
    for i, x in rows:
        v = [int(np.floor(256 * c)) for c in x]
        whole[i] = min(whole.get(i, v), v)
    want = []
    for q in (i for i in whole if i % 5 == 0):
        s = sorted((-sum(a * b for a, b in zip(whole[q], x, strict=True)), i) for i, x in whole.items() if i != q and len(x) == len(whole[q]))[:4]
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert got == sorted(want)


# repeated strings


def brute_repeats(rows, n=100):
    seen, out = set(), []
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        x = (t or "").encode()
        gone = bytearray(len(x))
        for i in range(len(x) - n + 1):
            w = x[i : i + n]
            if w in seen:
                gone[i : i + n] = b"\1" * n
            seen.add(w)
        kept = bytes(c for c, g in zip(x, gone) if not g)
        out.append((d, len(x), sum(gone), sum(1 for i in range(len(x)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("hot", "run"), [(2_000, 12 << 20), (2, 3_000)])
def test_repeated_strings(spark, none, hot, run, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", run)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 400 if hot == 2 else 4 << 20)
    rows = [r for i, r in enumerate(corpus()) if i == 0 or r != corpus()[0]]
    df = spark.createDataFrame(rows, DOC).repartition(5).cache()
    rows = [tuple(r) for r in df.collect()]
    out = suffix_dedup.without_repeats(df, keep_text=True)
    got = out.collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == brute_repeats(rows)
    assert out.columns[:6] == ["doc_id", "text", "lang", "n", "score", "kept"]
    same = {(r["doc_id"], r["text"]) for r in got if r["n_removed"] == 0}
    assert same <= {r[:2] for r in rows}
    assert suffix_dedup.without_repeats(none).count() == 0


# rules and lines


def test_base_rules():
    assert line_crf.base_rules(b"a b c d e f a b c d e") == (11, 11, 0, 0, 10)
    assert line_crf.base_rules("é #x\n\n é #x\né #x\n".encode()) == (6, 9, 3, 1, 0)
    rng = random.Random(8)
    for _ in range(200):
        w = [rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(0, 60))]
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        hit = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 5)}
        assert line_crf.repeat_words([x.encode() for x in w]) == len(hit)


def brute_repeat_words(w):
    seen = defaultdict(list)
    for i in range(len(w) - 4):
        seen[tuple(w[i : i + 5])].append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)})


@pytest.mark.parametrize("vocabulary", [8_192, 32_768, 60_000, 65_536])
def test_repeat_words_of_large_vocabularies(vocabulary):
    """Windows that differ in any one word only, however many words a text has."""
    rng = random.Random(vocabulary)
    w = [f"w{i}" for i in range(vocabulary)]
    assert line_crf.repeat_words([x.encode() for x in [*w, w[0], *w[4097:4101]]]) == 0
    for _ in range(200):
        a = rng.randrange(vocabulary - 5)
        tail = w[a : a + 5]
        if rng.random() < 0.9:
            tail[rng.randrange(5)] = w[(a + rng.choice([1, 2, 4, 64, 2048, 4096, 8191])) % vocabulary]
        w += tail
    assert line_crf.repeat_words([x.encode() for x in w]) == brute_repeat_words(w) > 0


def test_chains_equal_enumeration():
    """Sums over labellings, marginals of lines and of transitions."""
    rng = np.random.default_rng(2)
    seqs = [rng.normal(size=(n, 3)) for n in (3, 1, 5, 4)]
    c, w, t = line_crf.Chains(seqs), rng.normal(size=3), rng.normal(size=(2, 2))
    total, p, pairs, _ = c.marginals(c.x @ w, t)
    lines = np.split(c.at, np.cumsum(c.lengths)[:-1])
    for r, i in enumerate(c.order):
        n, s = len(seqs[i]), seqs[i] @ w
        paths = np.array([[b >> k & 1 for k in range(n)] for b in range(1 << n)])
        weight = np.exp([s @ y + sum(t[a, b] for a, b in zip(y, y[1:], strict=False)) for y in paths])
        assert total[r] == pytest.approx(np.log(weight.sum()))
        assert p[lines[r]] == pytest.approx(weight @ paths / weight.sum())
        for k in range(1, n):
            both = weight[(paths[:, k - 1] == 1) & (paths[:, k] == 0)].sum() / weight.sum()
            assert pairs[lines[r][k], 1, 0] == pytest.approx(both)


def mixed_corpus(rng, n=600):
    """Good documents, and bad ones of which some have a few good lines; the labels tell documents only."""
    pool = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(400)]
    good = lambda: words(rng, 12, pool).capitalize() + "."
    bad = lambda: " ".join(x.upper() + rng.choice(["$$$", "!!", "&&&"]) for x in words(rng, 12, pool).split())
    rows = []
    for i in range(n):
        if i % 4:
            rows.append((i, "\n".join(good() for _ in range(rng.randint(2, 12))), 1))
        else:
            lines = [bad() for _ in range(rng.randint(3, 9))]
            if i % 8:
                lines = [good(), *lines, *([good()] if i % 16 == 4 else [])]
            rows.append((i, "\n".join(lines), 0))
    return rows, good, bad


def test_lines_of_mixed_documents(spark):
    """Labels of documents are enough to find the bad lines between good ones, wherever they stand."""
    rng = random.Random(21)
    rows, good, bad = mixed_corpus(rng)
    df, labels = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    model = line_crf.learn(df, labels)
    assert model[1][0, 1] - model[1][0, 0] > -8 and model[1][1, 0] - model[1][1, 1] > -8  # a change of label has a finite price
    for _ in range(20):
        a, b, c = [[f() for _ in range(n)] for f, n in ((good, 6), (bad, 10), (good, 6))]
        assert line_crf.content_share("\n".join(a + b + c).encode(), model) == pytest.approx(12 / 22, abs=0.03)
        assert line_crf.content_share("\n".join(a + b + a).encode(), model) == pytest.approx(12 / 22, abs=0.03)
    held = mixed_corpus(random.Random(22), 200)[0]
    assert sum((line_crf.content_share(t.encode(), model) >= 0.5) == (q == 1) for _, t, q in held) >= 190
    # a labelled doc_id that many rows repeat teaches once
    again = df.unionByName(spark.createDataFrame([(0, t) for _, t, _ in rows] * 3, "doc_id long, text string"))
    other = line_crf.learn(again, labels)
    assert np.abs(other[0] - model[0]).max() < 2


def test_rules_of_a_long_text():
    rng = random.Random(5)
    rows, good, bad = mixed_corpus(rng)
    model = line_crf.fit([(*line_crf.line_features(t.encode()), q) for _, t, q in rows])
    text = "\n".join([good() for _ in range(30_000)] + [bad() for _ in range(10_000)]).encode()
    assert len(text) > 3_000_000 and line_crf.content_share(text, model) == pytest.approx(0.75, abs=0.02)
    assert line_crf.base_rules(text)[0] == 480_000


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(6)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        s, t = rng.normal(size=n), rng.normal(size=(2, 2))
        worth = lambda y: sum(s[i] * y[i] for i in range(n)) + sum(t[y[i - 1], y[i]] for i in range(1, n))
        best = max(worth([b >> i & 1 for i in range(n)]) for b in range(1 << n))
        assert worth(line_crf.viterbi(s, t).astype(int).tolist()) == pytest.approx(best)


def test_quality_rules(spark, none):
    rng = random.Random(3)
    pool = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 7))) for _ in range(300)]
    clean = lambda: "\n".join(words(rng, 12, pool).capitalize() + "." for _ in range(6))
    junk = lambda: "\n".join(" ".join(w.upper() + "$$$" for w in words(rng, 12, pool).split()) for _ in range(6))
    rows = [(i, junk() if i % 4 == 0 else clean(), "x", 1, None, "k") for i in range(160)] + [(500, None, "", 0, None, ""), (501, "", "", 0, None, ""), (502, clean() + "\n" + "\n".join([junk()] * 5), "", 0, None, ""), (None, clean(), "", 0, None, "")]
    df = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 1) for i in range(100)] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, kept int")
    out = {r["doc_id"]: r for r in line_crf.with_rules(df, line_crf.learn(df, labels)).collect()}
    assert all(out[i]["kept"] == (i % 4 != 0) for i in range(100, 160))
    assert not out[500]["kept"] and not out[501]["kept"] and out[None]["kept"] and not out[502]["kept"]
    assert out[500]["base_failed"] and out[500]["n_words"] == 0
    everything = line_crf.with_rules(df, line_crf.learn(df, labels.where("false"))).where("kept = base_failed")
    assert everything.count() == 0
    assert line_crf.with_rules(none, None).count() == 0

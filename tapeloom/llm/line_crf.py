"""Quality rules with line labels: a linear-chain conditional random field marks each line as content or boilerplate.

Lines are split at line feeds; a line's features are shares of byte kinds, repetition and length. Labels are known for documents only, so
line labels are latent: lines of good documents are content; lines of a bad document are whatever the model holds for most
likely, under the constraint that the document is bad, i.e. that boilerplate lines have more than ``1 - KEEP_SHARE`` of its words.
Weights of features and of transitions are learned in ``ROUNDS`` rounds: the first without transitions from bad documents as a whole,
then each from the line labels that the last model and the constraint give, by quasi-Newton steps on the conditional likelihood.
Viterbi decoding labels all lines of every text; a document is kept when content lines hold at least ``KEEP_SHARE`` of its
words and the base rules pass.

Learned from: ``SAMPLE`` labelled doc_ids in order of the id's hash, one row each, and of each at most ``TRAIN_LINES`` lines, a run that
begins where the id's hash says. Everything else covers all rows and whole texts.

Nulls: a null text has no words and fails the base rules; null labels or ids teach nothing. Without both classes all lines are
content. Repeated rows each get their row; of rows that repeat a labelled doc_id one (by the text's hash) teaches. Ties between labels go to
content. Extra columns stay; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import small_batches

SAMPLE, TRAIN_LINES, KEEP_SHARE, ROUNDS = 4_000, 256, 0.5, 4
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"
#: Continuation bytes of UTF-8 and white space: what is left after their removal is one byte per code point in words.
_NOT_COUNTED = bytes([*range(0x80, 0xC0), 0x20, *range(0x09, 0x0E)])
_WINDOW = 5

_KIND = np.full(256, 6, np.int64)  # 0 lower, 1 upper, 2 digit, 3 symbol, 4 stop, 5 blank, 6 other letter, 7 other mark
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[c for c in range(33, 48)] + [*range(58, 65), *range(91, 97), *range(123, 127)]] = 7
_KIND[list(SYMBOLS)] = 3
_KIND[list(b".,;:?")] = 4
_KIND[[0x20, *range(0x09, 0x0E)]] = 5
N_FEATURES = 16


def repeat_words(words: list[bytes], width: int = _WINDOW) -> int:
    """Words inside windows of ``width`` words that the text holds twice or more."""
    n = len(words)
    if n <= width:
        return 0
    table: dict[bytes, int] = {}
    ids = np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, n)
    key = ids[: n - width + 1]
    for i in range(1, width):
        if int(key.max()) >= (1 << 62) // len(table):  # the next product would not fit
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(table) + ids[i : n - width + 1 + i]
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[at] > 1)
    if not len(twice):
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + width, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def base_rules(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), len(text.translate(None, _NOT_COUNTED)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A row of features per line, and the words of each line."""
    lines = text.split(b"\n")
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    kinds = _KIND[np.frombuffer(text, np.uint8)]
    owner = np.repeat(np.arange(len(lines)), lengths + 1)[: len(kinds)]
    counts = np.bincount(owner * 8 + kinds, minlength=8 * len(lines)).reshape(-1, 8)[: len(lines)].astype(float)
    split = [x.split() for x in lines]
    words = np.fromiter(map(len, split), np.int64, len(lines))
    different = np.fromiter((len(set(x)) for x in split), np.int64, len(lines))
    pairs = np.fromiter((len(set(zip(x, x[1:], strict=False))) for x in split), np.int64, len(lines))
    seen: set[bytes] = set()
    again = np.fromiter(((x in seen) or bool(seen.add(x)) for x in lines), bool, len(lines))
    marks = counts[:, :5].sum(1) + counts[:, 6] + counts[:, 7] + 1
    w = words + 1.0
    out = np.column_stack((
        np.ones(len(lines)), counts[:, 1] / marks, np.minimum(counts[:, 1] / w, 4) / 4, counts[:, 2] / marks, counts[:, 3] / marks,
        np.minimum(counts[:, 3] / w, 2), np.minimum(counts[:, 4] / w, 1), counts[:, 7] / marks, np.minimum(counts[:, 7] / w, 2),
        different / w, np.log1p(words) / 5, words == 0, again & (words > 0), counts[:, 1] > 0.5 * marks, counts[:, 3] > 0.25 * w,
        (np.maximum(words - 1, 0) - pairs) / w,
    ))
    return out, words


class Chains:
    """Lines of many documents, laid out by place: all first lines, then all second lines of those that have one, and so on."""

    def __init__(self, sequences: list[np.ndarray]):
        self.order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        self.lengths = np.array([len(sequences[i]) for i in self.order])
        self.active = [int((self.lengths > k).sum()) for k in range(self.lengths.max(initial=0))]
        self.start = np.concatenate(([0], np.cumsum(self.active))).astype(int)
        self.at = np.concatenate([self.start[: n] + r for r, n in enumerate(self.lengths)])  # place of each line, document by document
        self.x = self.spread(np.concatenate([sequences[i] for i in self.order]))

    def spread(self, by_document: np.ndarray) -> np.ndarray:
        out = np.empty_like(by_document)
        out[self.at] = by_document
        return out

    def marginals(self, score: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Log of the sum over all labellings (per document), probability of content per line and of each transition per line."""
        top, n = len(self.active), self.active[0]
        alpha, beta = np.zeros((len(score), 2)), np.zeros((len(score), 2))
        lines = [slice(self.start[k], self.start[k + 1]) for k in range(top)]
        e = np.column_stack((np.zeros(len(score)), score))
        alpha[lines[0]] = e[lines[0]]
        for k in range(1, top):
            before = alpha[lines[k - 1]][: self.active[k]]
            alpha[lines[k]] = np.logaddexp(before[:, :1] + t[0], before[:, 1:] + t[1]) + e[lines[k]]
        for k in range(top - 1, 0, -1):
            after = e[lines[k]] + beta[lines[k]]
            beta[lines[k - 1]][: self.active[k]] = np.logaddexp(after[:, :1] + t[:, 0], after[:, 1:] + t[:, 1])
        total = np.logaddexp(*(alpha[: n] + beta[: n]).T)
        mine = np.concatenate([total[:m] for m in self.active])
        p = np.exp(alpha[:, 1] + beta[:, 1] - mine)
        pairs = np.zeros((len(score), 2, 2))
        for k in range(1, top):
            m = self.active[k]
            pairs[lines[k]] = np.exp(alpha[lines[k - 1]][:m, :, None] + t + (e[lines[k]] + beta[lines[k]])[:, None, :] - total[:m, None, None])
        return total, p, pairs, e


def _minimum(f, v: np.ndarray, steps: int) -> np.ndarray:
    """Quasi-Newton steps (BFGS) with backtracking; ``f`` gives value and gradient."""
    value, grad = f(v)
    inverse = np.eye(len(v))
    for _ in range(steps):
        move = -inverse @ grad
        slope = float(grad @ move)
        if slope > -1e-10:
            break
        rate = min(1.0, 4.0 / (np.abs(move).max() + 1e-12))
        while (new := f(v + rate * move))[0] > value + 1e-4 * rate * slope and rate > 1e-6:
            rate /= 2
        s, y = rate * move, new[1] - grad
        if (sy := float(s @ y)) > 1e-12:
            left = np.eye(len(v)) - np.outer(s, y) / sy
            inverse = left @ inverse @ left.T + np.outer(s, s) / sy
        done = value - new[0] < 1e-7
        v, (value, grad) = v + s, new
        if done:
            break
    return v


def _weights(chains: Chains, labels: np.ndarray, linked: bool, start: np.ndarray, ridge: float, steps: int) -> np.ndarray:
    """Feature weights and transition scores for given line labels; both labels count alike."""
    x, k = chains.x, chains.x.shape[1]
    share = np.array([(labels == 0).sum(), (labels == 1).sum()], float)
    weight = 0.5 / np.maximum(1, share)[labels]
    top, n = len(chains.active), chains.active[0]
    by_doc = np.zeros(n)
    for j in range(top):
        by_doc[: chains.active[j]] += weight[chains.start[j] : chains.start[j + 1]]
    by_doc /= chains.lengths
    line = np.concatenate([by_doc[:m] for m in chains.active])
    before = np.concatenate([np.zeros(n, int), *(chains.start[j - 1] + np.arange(chains.active[j]) for j in range(1, top))])
    real = np.zeros((2, 2))
    np.add.at(real, (labels[before[n:]], labels[n:]), line[n:])

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        w, t = v[:k], v[k:].reshape(2, 2)
        if not linked:
            score = x @ w
            p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
            fit = (weight * (np.logaddexp(0, score) - labels * score)).sum()
            return fit + ridge * (w @ w) / 2, np.concatenate((x.T @ (weight * (p - labels)) + ridge * w, np.zeros(4)))
        score = x @ w
        total, p, pairs, _ = chains.marginals(score, t)
        fit = by_doc @ total - (line * labels * score).sum() - (real * t).sum()
        return fit + ridge * (v @ v) / 2, np.concatenate((x.T @ (line * (p - labels)), ((line[:, None, None] * pairs).sum(0) - real).ravel())) + ridge * v

    return _minimum(loss, start, steps)


def line_labels(score: np.ndarray, words: np.ndarray, t: np.ndarray, keep_share: float = KEEP_SHARE) -> np.ndarray:
    """Most likely labels of a bad document's lines (True: content); then the lines likeliest to be boilerplate are that too, until
    content has less than ``keep_share`` of the words."""
    content = viterbi(score, t)
    order = np.argsort(score, kind="stable")
    order = order[content[order]]
    over = words[content].sum() - np.concatenate(([0], np.cumsum(words[order])))
    content[order[: int((over >= max(keep_share * words.sum(), 1e-9)).sum())]] = False
    return content


def fit(documents: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = ROUNDS, ridge: float = 1e-3, steps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Weights of ``content`` against ``boilerplate`` and the 2 x 2 transition scores from (line features, line words, quality)."""
    documents = [d for d in documents if len(d[0])]
    chains = Chains([f for f, _, _ in documents])
    documents = [documents[i] for i in chains.order]
    labels = [np.full(len(f), q == 1) for f, _, q in documents]
    v = np.zeros(N_FEATURES + 4)
    for r in range(rounds):
        v = _weights(chains, chains.spread(np.concatenate(labels)).astype(int), r > 0, v, ridge, steps)
        w, t = v[:N_FEATURES], v[N_FEATURES:].reshape(2, 2)
        labels = [old if q else line_labels(f @ w, words, t) for (f, words, q), old in zip(documents, labels, strict=True)]
    return w, t


def viterbi(score: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Most likely labels (True: content) given each line's score for content; ties go to content."""
    n = len(score)
    (t00, t01), (t10, t11) = t.tolist()
    a, b, back = 0.0, float(score[0]), []
    for s in score[1:].tolist():
        to0, to1 = a + t00 > b + t10, a + t01 > b + t11  # True: from boilerplate
        back.append((to0, to1))
        a, b = (a + t00 if to0 else b + t10), s + (a + t01 if to1 else b + t11)
    out = np.empty(n, bool)
    now = b >= a
    out[-1] = now
    for i in range(n - 2, -1, -1):
        now = not (back[i][1] if now else back[i][0])
        out[i] = now
    return out


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray] | None:
    chosen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    lines = F.split("text", "\n")
    room = F.greatest(F.size(lines) - TRAIN_LINES, F.lit(0)) + 1
    run = F.array_join(F.slice(lines, (F.pmod(F.xxhash64("doc_id", F.lit(3)), room) + 1).cast("int"), TRAIN_LINES), "\n")
    rows = docs.where(F.length("text") > 0).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", run.alias("text"))  # ``sample`` ids at most
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text", "quality")).alias("x")).select("doc_id", "x.quality", "x.text")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            told = [line_features(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "quality": b.column(1), "f": [f.astype("<f4").tobytes() for f, _ in told], "words": [w.astype("<i4").tobytes() for _, w in told]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.select("doc_id", F.col("quality").cast("int"), F.col("text").cast("binary")).mapInArrow(measured, f"doc_id {kind}, quality int, f binary, words binary").collect()
    seqs = [(np.frombuffer(r["f"], "<f4").reshape(-1, N_FEATURES).astype(float), np.frombuffer(r["words"], "<i4"), r["quality"]) for r in sorted(got, key=lambda r: r["doc_id"])]
    return fit(seqs) if len({q for _, _, q in seqs}) == 2 else None


def content_share(text: bytes, model: tuple[np.ndarray, np.ndarray] | None) -> float:
    if model is None:
        return 1.0
    f, words = line_features(text)
    return float(words[viterbi(f @ model[0], model[1])].sum() / max(1, words.sum()))


def with_rules(docs: DataFrame, model, keep_share: float = KEEP_SHARE) -> DataFrame:
    """Adds the base counts, base_failed, content_share and kept; a projection over the rows, texts are read whole."""
    names = [*FIELDS, "base_failed", "content_share", "kept"]
    kinds = [*[T.LongType()] * len(FIELDS), T.BooleanType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*(f for f in docs.schema.fields if f.name not in names), *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])
    arrow = [*[pa.int64()] * len(FIELDS), pa.bool_(), pa.float64(), pa.bool_()]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = [f.name for f in schema.fields[: -len(names)]]
        for b in small_batches(batches):
            rows = []
            for t in b.column("text").to_pylist():
                text = (t or "").encode()
                base = base_rules(text)
                failed = base_failed(base[0], base[4])
                share = 0.0 if not base[0] else content_share(text, model)
                rows.append((*base, failed, share, not failed and share >= keep_share))
            made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *made], schema=pa.schema([*(b.schema.field(c) for c in keep), *zip(names, arrow, strict=True)]))

    return docs.drop(*names).mapInArrow(judge, schema)

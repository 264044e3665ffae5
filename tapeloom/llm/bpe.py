"""Token ids of whole texts by the tokenizers library, with words encoded once per task."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: Words remembered per task; beyond it the memory starts anew (ids never change by this).
MEMO_WORDS = 1_000_000
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_UNSAFE = object()
_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, equal to ``encode(text, add_special_tokens=False).ids``.

    A byte-level pre-tokenizer always cuts before a single blank between two other characters, and around a line
    feed between two other characters; what follows such a cut is encoded as if the text began there. Texts are cut
    at these places only, every piece is encoded by the library once, and the ids are put together. Texts with white space in a row
    are cut at the safe blanks alone. Texts that hold an added token's string, and tokenizers of another
    kind, go through the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        pre = repr(self.tok.pre_tokenizer)
        self.cuts = self.tok.normalizer is None and "ByteLevel(add_prefix_space=False" in pre and "use_regex=True" in pre
        self.memo: dict[str, object] = {}
        self.ends = dict(zip(("", "\n"), self._ids([" ", "\n"]), strict=True)) if self.cuts else {}  # of a text that ends so
        self.sizes = np.array([len(b) for b in self.bytes_of_ids()], np.int64)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that a safe cut separates, in one call; the tokens' bytes tell where a piece ends."""
        ids = self.tok.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids
        raw = array("I", ids).tobytes()
        ends = np.cumsum([len(p.encode()) for p in pieces])
        reach = np.cumsum(self.sizes[np.frombuffer(raw, np.uint32)])
        at = np.searchsorted(reach, ends)
        if len(reach) != at[-1] + 1 or not np.array_equal(reach[at], ends):
            return self._ids(pieces)
        at = ((at + 1) * 4).tolist()
        return [raw[x:y] for x, y in zip([0, *at[:-1]], at, strict=True)]

    def _learn(self, words: set[str]) -> None:
        """A word follows a blank, or is a line feed and what follows that."""
        self.memo.update(dict.fromkeys(words, _UNSAFE))
        fit = [w for w in words if (x := w[1:] if w[:1] == "\n" else w) and not x[0].isspace() and not x[-1].isspace()]
        for i in range(0, len(fit), 2048):
            part = fit[i : i + 2048]
            self.memo.update(zip(part, self._joined([w if w[0] == "\n" else " " + w for w in part]), strict=True))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; no nulls."""
        if not self.cuts:
            return self._ids(texts)
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        words = [t.replace("\n", " \n").split(" ") if t and not any(a in t for a in self.added) else None for t in texts]
        new: set[str] = set()
        for w in words:
            if w:
                new.update(w[1:])
        new = new.difference(memo)
        if new:
            self._learn(new)
        firsts = iter(self._ids([w[0] for w in words if w]))
        out = []
        for t, w in zip(texts, words, strict=True):
            if w is None:
                out.append(self._ids([t])[0] if t else b"")
                continue
            first, last = next(firsts), self.ends.get(w[-1]) if len(w) > 1 else None
            parts = [first, *map(memo.__getitem__, w[1:] if last is None else w[1:-1])]
            if last is not None:
                parts.append(last)
            try:
                if w[0][-1:].isspace() or (last is not None and not (w[-2] and memo.get(w[-2], w[0]) is not _UNSAFE)):
                    raise TypeError
                out.append(b"".join(parts))
            except TypeError:  # a piece that is not safe by itself
                pieces = _SAFE_SPACE.split(t)
                out.append(b"".join(self._ids([pieces[0], *(" " + x for x in pieces[1:])])))
        return out

    def bytes_of_ids(self) -> list[bytes]:
        """What each id stands for; added tokens stand for their text."""
        table = _byte_letters()
        size = self.tok.get_vocab_size(with_added_tokens=True)
        added = {i: t.content.encode() for i, t in self.tok.get_added_tokens_decoder().items()}
        return [added[i] if i in added else bytes(table[c] for c in self.tok.id_to_token(i) or "") for i in range(size)]


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}

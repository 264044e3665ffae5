"""Exponential averages of a whole past for any span, from a bounded sketch of it.

The most recent values (4,096 to 8,191) are kept as they are; older ones lie in dyadic blocks, each as the sums of its values against
the first ``DEGREE`` Chebyshev polynomials of their place. A block is never longer than its distance from the present, so where a
weight exp(-k * age) matters at all (above 1e-16) the polynomials give it to double precision. Blocks depend on positions
only: a tape cut anywhere, or read as a stream, leads to the same sketch.
"""

from __future__ import annotations

import math

import numpy as np
from numpy.polynomial import chebyshev

CHUNK, DEGREE = 4096, 64
_T = 2 * (np.arange(CHUNK)[::-1] + 0.5) / CHUNK - 1  # age inside a chunk on [-1, 1], the oldest first
_BASIS = chebyshev.chebvander(_T, DEGREE - 1)


def _shifted(shift: float) -> np.ndarray:
    """Matrix that moves moments on half a block to the whole block."""
    rows = [chebyshev.chebinterpolate(lambda t, k=k: np.cos(k * np.arccos(np.clip(t / 2 + shift, -1, 1))), DEGREE - 1) for k in range(DEGREE)]
    return np.array(rows)


_OLDER, _NEWER = _shifted(0.5), _shifted(-0.5)


class FlowHistory:
    """Append values, ask for the seeded recursive average of all of them."""

    def __init__(self):
        self.seen, self.first = 0, 0.0
        self.recent = np.empty(0)
        self.blocks: list[tuple[int, int, np.ndarray]] = []  # (chunks, end chunk, moments), the oldest first

    def append(self, x: np.ndarray) -> None:
        if self.seen == 0 and len(x):
            self.first = float(x[0])
        self.seen += len(x)
        self.recent = np.concatenate((self.recent, x))
        while len(self.recent) >= 2 * CHUNK:
            base = (self.seen - len(self.recent)) // CHUNK + 1
            self.blocks.append((1, base, self.recent[:CHUNK] @ _BASIS))
            self.recent = self.recent[CHUNK:]
            self._merge(base)

    def _merge(self, base: int) -> None:
        i = 0
        while i + 1 < len(self.blocks):
            (n, end, a), (m, end2, b) = self.blocks[i], self.blocks[i + 1]
            if n == m and (end - n) % (2 * n) == 0 and base - end2 >= 2 * n:
                self.blocks[i : i + 2] = [(2 * n, end2, _OLDER @ a + _NEWER @ b)]
                i = max(0, i - 1)
            else:
                i += 1

    def average(self, window: float) -> float:
        """The average of all values that a recursion with smoothing 2 / (window + 1), started at the first value, ends with."""
        a = 2.0 / (window + 1.0)
        if a >= 1.0:
            return float(self.recent[-1])
        k = -math.log1p(-a)
        reach = int(-math.log(1e-16) / k) + 1
        x = self.recent[-reach:]
        total = a * float(np.dot(x, (1.0 - a) ** np.arange(len(x) - 1, -1, -1)))
        if reach >= self.seen:
            total += (1 - a) * math.exp(-k * (self.seen - 1)) * self.first
        for n, end, moments in reversed(self.blocks):
            age, length = self.seen - end * CHUNK, n * CHUNK
            if age > reach:
                break
            c = chebyshev.chebinterpolate(lambda t, length=length: np.exp(-k * ((t + 1) * length / 2 - 0.5)), DEGREE - 1)
            total += a * math.exp(-k * age) * float(c @ moments)
        return total

    def state(self) -> list[float]:
        out = [float(self.seen), self.first, float(len(self.recent)), *self.recent.tolist(), float(len(self.blocks))]
        for n, end, moments in self.blocks:
            out += [float(n), float(end), *moments.tolist()]
        return out

    @classmethod
    def of(cls, state: list[float]) -> FlowHistory:
        h = cls()
        if state:
            h.seen, h.first, n = int(state[0]), state[1], int(state[2])
            h.recent = np.array(state[3 : 3 + n], float)
            at = 4 + n
            for _ in range(int(state[3 + n])):
                h.blocks.append((int(state[at]), int(state[at + 1]), np.array(state[at + 2 : at + 2 + DEGREE], float)))
                at += 2 + DEGREE
        return h

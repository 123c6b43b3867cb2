"""Hashes of words, word shingles and byte strings for many texts at once; they run inside tasks."""

from __future__ import annotations

import random

#: Odd multiplier of the polynomial hashes and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
UNDO = pow(BASE, -1, 1 << 64)
#: Bytes of text that are hashed together.
BLOCK = 1 << 18


def byte_values():
    """A fixed random 64-bit value for each byte."""
    import numpy as np

    draw = random.Random(2024)
    return np.array([draw.getrandbits(64) for _ in range(256)], np.uint64)


def powers(base: int, n: int):
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    import numpy as np

    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(x):
    """Finaliser that spreads every bit of 64-bit values."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class ShingleSets:
    """Distinct word shingles of texts as sorted 64-bit hashes. Words stand between ASCII white space, A-Z in lower case."""

    def __init__(self, width: int):
        import numpy as np

        self.width = width
        self.values = byte_values()
        self.up = self.down = powers(BASE, 0)  # as long as the longest block so far
        draw = random.Random(7)
        self.places = np.array([draw.getrandbits(64) | 1 for _ in range(width)], np.uint64)

    def of(self, texts: list[str]):
        """One array for each text; empty for a text without words."""
        block, size = [], 0
        for t in texts:
            b = t.encode().lower()
            if block and size + len(b) > BLOCK:
                yield from self._block(block)
                block, size = [], 0
            block.append(b)
            size += len(b) + 1
        if block:
            yield from self._block(block)

    def _block(self, texts: list[bytes]):
        import numpy as np

        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        if len(raw) > len(self.up):
            self.up, self.down = powers(BASE, len(raw)), powers(UNDO, len(raw))
        gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=1))
        starts, ends = edge[::2], edge[1::2]
        total = np.cumsum(self.values[raw] * self.up[:len(raw)], dtype=np.uint64)
        words = total[ends - 1] - np.where(starts > 0, total[starts - 1], np.uint64(0))
        words = mix(words * self.down[starts] + (ends - starts).astype(np.uint64))
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
        w = self.width
        if len(words) >= w:
            runs = np.zeros(len(words) - w + 1, np.uint64)
            for k in range(w):
                runs += words[k:k + len(runs)] * self.places[k]
            runs = mix(runs)
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            n = hi - lo
            if n >= w:
                yield np.unique(runs[lo:hi - w + 1])
            elif n:
                yield mix((words[lo:hi] * self.places[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
            else:
                yield np.zeros(0, np.uint64)

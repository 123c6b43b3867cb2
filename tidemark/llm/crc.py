"""CRC-32 of any run of bytes in a buffer, from the running CRCs of one scan.

A CRC register without its final inversion is linear over GF(2): the register after ``a`` and then ``b`` is that of
``a`` moved on by len(b) zero bytes, xor that of ``b`` alone. So the CRC of a run follows from the registers at its two
ends, with the part before the run cancelled by a move of the run's length.
"""

from __future__ import annotations

from functools import cache

#: Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Items that a scan goes through one by one, side by side with the other rows of as many.
ROW = 32
ONES = 0xFFFFFFFF


@cache
def _bytes_table():
    """Register after each single byte."""
    import numpy as np

    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(POLYNOMIAL), c >> 1)
    return c


def _apply(move, c):
    """Registers ``c`` moved on; ``move`` has the moved registers of the values of each byte."""
    return move[0][c & 255] ^ move[1][(c >> 8) & 255] ^ move[2][(c >> 16) & 255] ^ move[3][c >> 24]


@cache
def power_move(k: int):
    """Tables that move a register on by 2 ** k zero bytes."""
    import numpy as np

    if k:
        half = power_move(k - 1)
        return np.stack([_apply(half, row) for row in half])
    one = _bytes_table()
    rows = [np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)]
    return np.stack([one[r & 255] ^ (r >> 8) for r in rows])


@cache
def _short_moves():
    """Tables of the moves by 0 .. ROW - 1 bytes."""
    import numpy as np

    own = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])]
    while len(own) < ROW:
        own.append(np.stack([_apply(power_move(0), r) for r in own[-1]]))
    return np.stack(own)


def moved(c, n):
    """Registers ``c`` moved on by ``n`` bytes each."""
    short, low = _short_moves(), n % ROW
    c = short[low, 0, c & 255] ^ short[low, 1, (c >> 8) & 255] ^ short[low, 2, (c >> 16) & 255] ^ short[low, 3, c >> 24]
    rest, k = n // ROW, ROW.bit_length() - 1
    while (rest > 0).any():
        odd = (rest & 1).nonzero()[0]
        c[odd] = _apply(power_move(k), c[odd])
        rest, k = rest >> 1, k + 1
    return c


def running(items, k: int = 0):
    """Register before each item and after the last; ``items`` are the registers of single items of 2 ** k bytes."""
    import numpy as np

    n = len(items)
    rows = -(-(n + 1) // ROW)
    grid = np.zeros(rows * ROW, np.uint32)
    grid[:n] = items
    grid = grid.reshape(rows, ROW)
    before, state = np.empty_like(grid), np.zeros(rows, np.uint32)
    step = power_move(k)
    go = (lambda c: step[0][c & 255] ^ (c >> 8)) if k == 0 else (lambda c: _apply(step, c))
    for j in range(ROW):
        before[:, j] = state
        state = go(state) ^ grid[:, j]
    if rows > 1:
        outer = running(state, k + ROW.bit_length() - 1)[:rows]
        for j in range(ROW):
            before[:, j] ^= outer
            outer = go(outer)
    return before.reshape(-1)[:n + 1]


class RunningCrc:
    """One scan of a buffer; then the CRC-32 of any of its runs."""

    def __init__(self, buffer):
        self.state = running(_bytes_table()[buffer])

    def of(self, start, end):
        """CRC-32 of buffer[start:end] for arrays of bounds."""
        import numpy as np

        size = end - start
        return self.state[end] ^ moved(self.state[start] ^ np.uint32(ONES), size) ^ np.uint32(ONES)

"""Run-length index: a run-compressed Burrows-Wheeler transform with suffix-array samples at the ends of its runs.

Queries are streamed from right to left. As long as a query's next character equals the transform's at the current row,
the row follows the last-to-first map and its text position falls by one. Otherwise the stream jumps to the nearest run
of that character above or below, whichever suffix shares more with the current one; both jumps land on ends of runs,
where the text position is sampled.
"""

from __future__ import annotations

import numpy as np

#: Characters of 9 bits in one comparison key, and the least keys whose first character from the right is not 0, and so on.
KEY = 7
GROUPS = np.array([1 << 9 * k for k in range(KEY)])


class RunLengthIndex:
    """Index of a list of byte strings; matches do not run from one string into the next."""

    def __init__(self, strings: list[bytes]):
        text = np.ones(sum(map(len, strings)) + len(strings) + 1, np.int64)  # 1 ends a string, 0 is past the end
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        ends = np.cumsum(lengths + 1)
        inside = np.ones(len(text), bool)
        inside[ends - 1] = inside[-1] = False
        text[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 2
        n = len(text)
        padded = np.concatenate([text, np.zeros(10 * KEY, np.int64)])
        key = np.zeros(n + 9 * KEY, np.int64)
        for k in range(KEY):
            key = key << 9 | padded[k:k + len(key)]
        self.key = key
        order = self._sorted_suffixes(key[:n])
        last = text[order - 1]
        starts = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
        self.run_start, self.head = starts, last[starts]
        stops = np.concatenate([starts[1:], [n]]) - 1
        self.start_sample, self.end_sample, self.run_stop = order[starts], order[stops], stops
        sizes = stops - starts + 1
        self.run_of = np.repeat(np.arange(len(starts), dtype=np.int32), sizes)  # the run of a row
        by_char = np.argsort(self.head, kind="stable")
        first_row = np.concatenate([[0], np.cumsum(sizes[by_char])[:-1]])
        self.target = np.empty(len(starts), np.int64)  # the row that the first row of a run maps to
        self.target[by_char] = first_row
        self.runs = len(starts)
        self.of_char = self.head[by_char] * (self.runs + 1) + by_char  # (character, run), ascending
        self.by_char = by_char

    @staticmethod
    def _sorted_suffixes(key):
        """Suffix array by doubling, starting from each suffix's first KEY characters; only what is still tied is sorted again."""
        n, step = len(key), KEY
        order = np.argsort(key)
        tied = np.arange(n)
        value = key[order]
        rank = np.zeros(n + 1, np.int64)  # place of the first suffix of the same start, from 1; past the end: 0
        while True:
            first = np.concatenate([[True], value[1:] != value[:-1]])
            rank[order[tied]] = tied[np.maximum.accumulate(np.where(first, np.arange(len(tied)), 0))] + 1
            tied = tied[~(first & np.append(first[1:], True))]
            if not len(tied):
                return order
            own = order[tied]
            value = rank[own] * (n + 1) + rank[np.minimum(own + step, n)]
            by = np.argsort(value)
            order[tied], value = own[by], value[by]
            step *= 2

    def _common(self, a, b):
        """Length of the common start of text suffixes a and b, up to 8 * KEY."""
        length = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        for step in range(8):
            x = self.key[a[live] + KEY * step] ^ self.key[b[live] + KEY * step]
            length[live] += KEY - np.searchsorted(GROUPS, x, "right")  # characters before the highest that differs
            live = live[x == 0]
            if not len(live):
                break
        return length

    def matching(self, queries: list[bytes], least: int):
        """For each query, flags (as bits of an integer) of the starts from which ``least`` characters stand in the index.

        ``least`` is at most 8 * KEY, a query has at most 63 such starts.
        """
        lengths = np.fromiter(map(len, queries), np.int64, len(queries))
        out = np.zeros(len(queries), np.uint64)
        ids = np.argsort(-lengths, kind="stable")
        raw = np.frombuffer(b"".join(queries), np.uint8).astype(np.int64) + 2
        ends = np.cumsum(lengths)[ids]
        lengths = lengths[ids]
        row = np.zeros(len(ids), np.int64)
        place = np.full(len(ids), self.start_sample[0])
        match = np.zeros(len(ids), np.int64)
        for step in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -step))  # queries longer than step stand first
            c = raw[ends[:live] - 1 - step]
            r, p, m = row[:live], place[:live], match[:live]
            run = self.run_of[r]
            jump = np.flatnonzero(self.head[run] != c)
            p, m = p - 1, m + 1
            if len(jump):
                cj = c[jump]
                at = np.searchsorted(self.of_char, cj * (self.runs + 1) + run[jump])
                best = np.full(len(jump), -1)
                to_row, to_place = np.zeros(len(jump), np.int64), np.full(len(jump), self.start_sample[0] + 1)
                to_run = np.zeros(len(jump), np.int64)
                for which, rows, samples in ((at - 1, self.run_stop, self.end_sample), (at, self.run_start, self.start_sample)):
                    there = np.flatnonzero((which >= 0) & (which < self.runs) & (best < match[jump]))
                    other = self.by_char[which[there]]
                    same = self.head[other] == cj[there]
                    there, other = there[same], other[same]
                    shared = match[jump[there]]
                    open_ = np.flatnonzero(shared)
                    shared[open_] = np.minimum(shared[open_], self._common(place[jump[there[open_]]], samples[other[open_]]))
                    better = shared > best[there]
                    there, other, shared = there[better], other[better], shared[better]
                    best[there], to_run[there] = shared, other
                    to_row[there], to_place[there] = rows[other], samples[other]
                r = r.copy()
                r[jump], run[jump] = to_row, to_run
                p[jump], m[jump] = to_place - 1, best + 1
            row[:live] = np.where(m > 0, self.target[run] + r - self.run_start[run], 0)
            place[:live] = np.where(m > 0, p, self.start_sample[0])
            match[:live] = m
            start = lengths[:live] - 1 - step
            if step + 1 >= least:
                hit = np.flatnonzero((m >= least) & (start < 64))
                out[ids[hit]] |= np.uint64(1) << start[hit].astype(np.uint64)
            # A query whose match cannot reach the least length with what is left of it is done.
            able = m + start >= least
            if 4 * np.count_nonzero(able) < 3 * live:
                keep = np.flatnonzero(able)
                ids, lengths, ends, row, place, match = (x[keep] for x in (ids, lengths, ends, row, place, match))
        return out

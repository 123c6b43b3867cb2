import hashlib
import math
import random

import numpy as np
import pytest

from tidemark.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, near string, x string"


def _plain(rows, parts, k, rounds, scale=1024):
    """Codes, errors and codebooks by comparing everything in whole numbers."""
    x = {i: [math.floor(scale * v) for v in e] for i, e, *_ in rows if e and all(v is not None and math.isfinite(v) for v in e)}
    d = len(next(iter(x.values()))) // parts
    part = lambda i, p: x[i][p * d:(p + 1) * d]
    books = [[part(i, p) for i in sorted(x)[:k]] for p in range(parts)]

    def assign(i, p):
        return min((sum((a - b) ** 2 for a, b in zip(part(i, p), e, strict=True)), n) for n, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for i in x:
                own.setdefault(assign(i, p)[1], []).append(part(i, p))
            books[p] = [[sum(c) // len(own[n]) for c in zip(*own[n], strict=True)] if n in own else e for n, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return {i: ([assign(i, p)[1] for p in range(parts)], sum(assign(i, p)[0] for p in range(parts))) for i in x}, digest


def _vectors(seed, n, size=8, spread=0.3):
    draw = random.Random(seed)
    centres = [[draw.uniform(-1, 1) for _ in range(size)] for _ in range(6)]
    return [(i * 3, [float(np.float32(c + draw.gauss(0, spread))) for c in draw.choice(centres)], i % 3 or None, "n", "x") for i in range(n)]


def _codes(row):
    return np.frombuffer(row.codes, np.uint16).tolist()


@pytest.mark.parametrize(("k", "spread"), [(16, 0.3), (40, 0.05), (3, 0.3), (1, 0.3)])
def test_codes_equal_those_of_a_whole_comparison(spark, k, spread):
    rows = _vectors(k, 150, spread=spread)
    rows += [(1000 + i, rows[i][1], 7, "n", "x") for i in range(10)]  # repeated vectors tie
    coded, books = vc.compress(spark.createDataFrame(rows, SCHEMA).repartition(5), 4, k, 4)
    want, digest = _plain(rows, 4, k, 4)
    assert {r.vec_id: (_codes(r), r.error) for r in coded.collect()} == want and books.digest == digest


def test_bounds_spare_most_distances():
    draw = np.random.default_rng(1)
    centres = draw.integers(-1000, 1000, (40, 4))
    x = (centres[draw.integers(0, 40, 2000)] + draw.integers(-40, 40, (2000, 4))).astype(np.int64)
    entries, new = centres.astype(np.int64), (centres + draw.integers(-6, 7, centres.shape)).astype(np.int64)
    state = vc.search_all(x, entries, 5)
    moves = np.sqrt(((new - entries) ** 2).sum(1).astype(float)) * (1 + vc.SLACK)
    code, near, lower, outer, needed = vc.search(x, new, moves, *state)
    d = vc._squares(x, new)
    assert (code == d.argmin(1)).all()
    assert (needed == 0).mean() > 0.5 and (needed == 6).mean() < 0.1
    assert (lower <= np.sqrt(np.take_along_axis(d, near.astype(int), 1))).all()
    rest = d.astype(float)
    np.put_along_axis(rest, np.concatenate([code[:, None], near], 1).astype(int), np.inf, 1)
    assert (outer <= np.sqrt(rest.min(1))).all()
    assert vc.list_length(5, {1: 9, 3: 2, 6: 4}) == 3 and vc.list_length(5, {6: 4}) == 5 and vc.list_length(5, {}) == 5


def test_large_components_stay_exact():
    x = np.array([[1 << 26, -(1 << 26)], [3, 4]], np.int64)
    assert vc._squares(x, -x).tolist() == [[sum((int(a) + int(b)) ** 2 for a, b in zip(r, s, strict=True)) for s in x] for r in x]


def test_odd_vectors(spark):
    good = [(5, [0.5, -0.25, 1.0, 2.0], 1, "n", "x"), (None, [0.1, 0.2, 0.3, 0.4], None, "n", "x"), (5, [0.5, -0.25, 1.0, 2.0], None, "n", "x"),
            (5, [9.0, 9.0, 9.0, 9.0], 1, "n", "x")]
    bad = [(1, None, 1, "n", "x"), (2, [], 1, "n", "x"), (3, [1.0, None, 1.0, 1.0], 1, "n", "x"), (4, [1.0, math.nan, 1.0, 1.0], 1, "n", "x"),
           (6, [math.inf] * 4, 1, "n", "x"), (7, [1.0] * 8, 1, "n", "x"), (8, [1.0] * 5, 1, "n", "x"), (9, [1e30] * 4, 1, "n", "x")]
    coded, books = vc.compress(spark.createDataFrame(good + bad, SCHEMA), 4, 2, 4)
    got = vc.with_label_error(coded).collect()
    assert len(got) == 4 and books.entries.shape == (4, 2, 1)
    for label in (1, None):
        same = [r for r in got if r.label == label]
        assert all(r.label_error == sum(s.error for s in same) for r in same) and same
    none, books = vc.compress(spark.createDataFrame(bad[:2], SCHEMA))
    assert none.count() == 0 and books.entries.size == 0 and len(books.digest) == 64
    assert vc.with_label_error(none).select(vc.code_text(none.codes).alias("code")).count() == 0

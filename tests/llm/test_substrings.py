import random

import pytest

from tests.llm import plain
from tidemark.llm import substrings
from tidemark.llm.run_index import RunLengthIndex


def _result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_matching_statistics_agree_with_search():
    draw = random.Random(1)
    for _ in range(60):
        letters = draw.choice([2, 4, 60])
        strings = [bytes(draw.randrange(97, 97 + letters) for _ in range(draw.randrange(5, 90))) for _ in range(draw.randrange(1, 8))]
        queries = [bytes(draw.randrange(97, 98 + letters) for _ in range(draw.randrange(5, 80))) for _ in range(5)] + [s[:80] for s in strings]
        least = draw.choice([5, 10, 50])
        for q, got in zip(queries, RunLengthIndex(strings).matching(queries, least), strict=True):
            assert got == sum(1 << j for j in range(min(64, max(0, len(q) - least + 1))) if any(q[j:j + least] in s for s in strings))


def test_the_transform_of_repeated_text_has_few_runs():
    once = bytes(random.Random(3).randrange(97, 123) for _ in range(400))
    assert RunLengthIndex([once] * 50).runs < 3 * RunLengthIndex([once]).runs


def test_hopeless_queries_are_dropped(monkeypatch):
    """A query that can no longer match the least length is not streamed to its start."""
    draw, calls, common = random.Random(4), [], RunLengthIndex._common
    text = lambda n: bytes(draw.randrange(97, 123) for _ in range(n))
    index = RunLengthIndex([text(80) for _ in range(40)])
    monkeypatch.setattr(RunLengthIndex, "_common", lambda self, a, b: calls.append(len(a)) or common(self, a, b))
    assert not index.matching([text(80) for _ in range(50)], 50).any()
    assert len(calls) <= 2 * 40


def test_windows_of_equal_hash_are_told_apart(monkeypatch):
    import numpy as np

    draw = random.Random(6)
    segments = sorted({bytes(draw.randrange(97, 99) for _ in range(8)) * 9 for _ in range(40)})
    docs, left = np.array([draw.randrange(9) for _ in segments]), np.arange(len(segments))
    want = [sum(1 << j for j in range(23) if any(s[j:j + 50] in o for o, d in zip(segments, docs, strict=True) if d < docs[i]))
            for i, s in enumerate(segments)]
    assert [int(b) for _, b in substrings._by_window(segments, docs, left)] == want and any(want)
    monkeypatch.setattr(substrings.Windows, "whole", lambda self, raw: np.zeros(len(raw) - 49, np.uint64))
    assert [int(b) for _, b in substrings._by_window(segments, docs, left)] == want


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_marks_do_not_depend_on_the_number_of_rounds(rounds, monkeypatch):
    import numpy as np

    monkeypatch.setattr(substrings, "ROUNDS", rounds)
    draw = random.Random(5)
    core = bytes(draw.randrange(97, 123) for _ in range(80))
    segments = []
    for _ in range(30):
        s = bytearray(core)
        s[draw.randrange(80)] = 65 + draw.randrange(2)
        segments.append(bytes(s))
    segments = sorted(set(segments))
    docs = np.array([draw.randrange(12) for _ in segments])
    got = substrings.marked(segments, docs, np.zeros(len(segments), np.uint64))
    for i, s in enumerate(segments):
        want = sum(1 << j for j in range(31) if any(s[j:j + 50] in o for o, d in zip(segments, docs, strict=True) if d < docs[i]))
        assert got[i] == want


def test_repeats_go_and_first_copies_stay(spark):
    draw = random.Random(9)
    lines = [line[:draw.randrange(49, 90)] for line in plain.sentences(2, 12)]
    rows = [(i, "\n".join(draw.choice(lines) if draw.random() < 0.6 else plain.sentences(100 * i + k, 1, 8)[0] for k in range(6)))
            for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1][7:]), (102, "ab" * 4000), (103, "x" + "ab" * 3000), (104, rows[5][1][:49])]
    got = _result(substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == sorted(((d, *v) for d, v in plain.removed(rows).items()), key=str)
    assert sum(r[2] for r in got) > 5000


def test_odd_rows_and_an_empty_table(spark):
    got = _result(substrings.remove_repeats(plain.odd(spark)))
    # Rows with an equal id are not earlier than one another; null ids are last.
    rows = plain.odd_rows()
    order = {i: r[0] if r[0] is not None else 10**9 for i, r in enumerate(rows)}
    want = []
    for i, r in enumerate(rows):
        earlier = [(0, x[1]) for k, x in enumerate(rows) if order[k] < order[i]]
        text = "\0".join(t or "" for _, t in earlier)
        want.append((r[0], *plain.removed([(0, text), (1, r[1])])[1]))
    assert got == sorted(want, key=str)
    assert substrings.remove_repeats(plain.empty(spark)).count() == 0

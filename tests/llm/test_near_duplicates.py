import random

import numpy as np
import pytest

from tests.llm import plain
from tidemark.llm import linking
from tidemark.llm import near_duplicates as nd
from tidemark.llm.hashing import ShingleSets


def _near_copies(seed, n, groups):
    draw = random.Random(seed)
    bases = plain.sentences(seed, groups, 60)
    rows = []
    for i in range(n):
        w = draw.choice(bases).split()
        for _ in range(draw.choice([0, 1, 2, 4, 12])):
            w[draw.randrange(len(w))] = f"x{draw.randrange(10**6)}"
        rows.append((i * 3, " ".join(w)))
    return rows


@pytest.mark.parametrize(("width", "percent"), [(2, 80), (5, 80)])
def test_components_agree_with_all_pairs(spark, width, percent):
    rows = _near_copies(width, 150, 12) + [(1001, ""), (1002, None), (1003, "Word"), (1004, "word"), (1005, "two words")]
    got = {r.doc_id: r for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()}
    want = plain.components(rows, width, percent)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (want[i] == i) and r.n_shingles == len(plain.shingles(dict(rows)[i], width)) for i, r in got.items())


def test_a_large_group_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(linking, "SETS", 16)
    monkeypatch.setattr(linking, "BROADCAST_ROWS", 0)
    rows = _near_copies(8, 120, 2)
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == plain.components(rows, 2, 80)


def test_odd_rows_and_an_empty_table(spark):
    got = nd.near_duplicates(plain.odd(spark), 2, 80).collect()
    assert len(got) == len(plain.odd_rows())
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id in (1, 2, 12)} == {(1, -5), (2, -5), (12, -5)}
    assert {(r.component_id, r.kept) for r in got if r.doc_id is None} == {(-5, False), (None, True)}
    assert all(r.kept and r.n_shingles == 0 for r in got if r.doc_id in (3, 4, 5))
    assert nd.near_duplicates(plain.empty(spark)).count() == 0
    kept = nd.drop_near_duplicates(plain.odd(spark), 2, 80)
    assert kept.columns == plain.odd(spark).columns
    assert {1, 2, 12}.isdisjoint(r.doc_id for r in kept.collect())


def test_one_row_of_a_component_stays_whatever_the_ids(spark):
    a, b, c, d = plain.sentences(6, 4, 60)
    rows = [(7, a, 0), (7, a, 1), (None, a, 2), (None, a + " more", 3), (3, a, 4), (None, b, 5), (None, b, 6), (8, c, 7), (8, d, 8),
            (None, "", 9), (None, None, 10), (9, c, 11), (8, c, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key long").repartition(3)
    kept = nd.drop_near_duplicates(docs, 5, 80)
    got = sorted(r.row_key for r in kept.collect())
    assert kept.columns == docs.columns and len(got) == 6
    assert {4, 8, 9, 10} < set(got) and len({5, 6} & set(got)) == len({7, 12} & set(got)) == 1


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)]
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = {r.node: r.label for r in linking.connected(df).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 150), 100)}
    assert linking.connected(df.where("a < 0")).count() == 0


def test_sketches_merge_and_estimate():
    draw = np.random.default_rng(1)
    for similarity in (0.3, 0.8, 0.95):
        n, pairs = 400, 60
        both = int(2 * n * similarity / (1 + similarity))
        sets = [draw.integers(0, 2**64, 2 * n - both, dtype=np.uint64) for _ in range(pairs)]
        a, b = nd.sketches([s[:n] for s in sets]), nd.sketches([s[n - both:] for s in sets])
        assert (np.maximum(a, b) == nd.sketches(sets)).all()
        got = nd.estimate(a, b, np.full(pairs, float(n)), np.full(pairs, float(n)))
        assert abs(got.mean() - similarity) < 0.03


def test_shingle_sets_are_those_of_the_words():
    texts = ["A b\tC a B c a b", "", "solo", "x y", "a b c a b c"]
    for width in (1, 2, 5):
        assert [len(s) for s in ShingleSets(width).of(texts)] == [len(plain.shingles(t, width)) for t in texts]
    one, two = ShingleSets(2).of(["A b c", "zz a B C"])
    assert np.isin(one, two).all()

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import plain
from tests.llm.test_near_duplicates import _near_copies
from tidemark.llm import linking
from tidemark.llm import signature_tree as st
from tidemark.llm.hashing import ShingleSets


def _got(spark, rows, width, percent):
    found = st.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()
    assert all(r.n_shingles == len(plain.shingles(dict(rows)[r.doc_id], width)) for r in found)
    return {r.doc_id: r.component_id for r in found}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (1, 70)])
def test_components_agree_with_all_pairs(spark, width, percent):
    rows = _near_copies(width, 150, 12) + [(1001, ""), (1002, None), (1003, "Word"), (1004, "word"), (1005, "two words"), (1006, "two WORDS")]
    rows += [(2000 + i, " ".join(f"k{j}" for j in range(n))) for i, n in enumerate([9, 10, 11, 12, 13, 18, 19, 20, 21, 40, 44, 45])]
    assert _got(spark, rows, width, percent) == plain.components(rows, width, percent)


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(linking, "SETS", 16)
    monkeypatch.setattr(linking, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(st, "BROADCAST_ROWS", 0)
    rows = _near_copies(8, 140, 2)
    for percent in (80, 93):
        assert _got(spark, rows, 3, percent) == plain.components(rows, 3, percent)


def test_linked_sets_share_a_route():
    draw = np.random.default_rng(3)
    for n in (1, 2, 5, 9, 10, 19, 20, 100, 999):
        for percent in (70, 90):
            for _ in range(20):
                a = draw.integers(0, 2**64, n, dtype=np.uint64)
                gone, new = (int(draw.integers(0, n // 4 + 1)) for _ in "ab")
                b = np.concatenate([a[gone:], draw.integers(0, 2**64, new, dtype=np.uint64)])
                if not len(b) or 100 * (n - gone) < percent * (n + new):
                    continue
                values, counts = st.routes([np.sort(a), np.sort(b)], percent)
                assert set(values[:counts[0]].tolist()) & set(values[counts[0]:].tolist()), (n, gone, new)


def test_the_tree_prunes_and_loses_nothing():
    sets = list(ShingleSets(3).of([t for _, t in _near_copies(5, 300, 40)] + plain.sentences(2, 300, 60)))
    label, seen = np.arange(len(sets)), [0, 0]
    links = st.tree_links(sets, label, np.zeros(len(sets), int), 90, seen)
    want = {i: i for i in range(len(sets))}
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j], assume_unique=True))
            if 100 * both >= 90 * (len(a) + len(sets[j]) - both):
                old, new = want[i], want[j]
                want = {k: new if v == old else v for k, v in want.items()}
    assert len({(want[i], int(label[i])) for i in want}) == len(set(want.values())) == len(set(label.tolist()))
    assert len(links) == len(sets) - len(set(label.tolist()))  # a forest
    pairs = len(sets) * (len(sets) - 1) // 2
    assert seen[0] < pairs / 4 and seen[1] < pairs / 100


def test_two_sides_are_compared_across_only():
    sets = list(ShingleSets(1).of(["a b c d e f g h i j", "a b c d e f g h i j k", "x y z", "a b c d e f g h i j l", "x y z"]))
    side = np.array([0, 0, 0, 1, 1])
    links = st.tree_links(sets, np.arange(5), side, 90)
    assert {tuple(map(int, p)) for p in links} == {(0, 3), (2, 4)}
    assert st.tree_links([], np.zeros(0, int), np.zeros(0, int), 90) == []


def test_odd_rows_and_an_empty_table(spark):
    odd = plain.odd(spark).withColumn("set_key", F.lit("x")).withColumn("route", F.lit(1)).withColumn("routes", F.lit("y"))
    got = st.similar_documents(odd, 3, 90).collect()
    assert len(got) == len(plain.odd_rows())
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id in (1, 2, 12)} == {(1, 1), (2, 1), (12, 1)}
    assert {r.component_id for r in got if r.doc_id is None} == {1, None}
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id for r in got if r.doc_id in (3, 4, 5))
    assert st.similar_documents(plain.empty(spark)).count() == 0

"""The large-table path of every ordering primitive against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import ordered as O
from tidemark.functions.small import pin
from tidemark.operators import sampling as R

RNG = random.Random(3)
# One key holds most rows and one value a third of them.
ROWS = [("hot", 7.0 if RNG.random() < 0.4 else round(RNG.expovariate(0.1), 3)) for _ in range(3000)]
ROWS += [("cold", round(RNG.gauss(0, 1), 2)) for _ in range(50)] + [("cold", None), ("empty", None)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "k string, v double").repartition(7)


@pytest.mark.parametrize("limit", [10**6, 100])
def test_quantiles_equal_numpy(table, limit):
    probs = {"lo": 0.0, "q1": 0.1, "q2": 1 / 3, "mid": 0.5, "q4": 0.95, "hi": 1.0}
    got = {r.k: r for r in O.quantiles(table, ["k"], "v", probs, limit).collect()}
    for k in ("hot", "cold"):
        vals = [v for key, v in ROWS if key == k and v is not None]
        assert got[k].n == len(vals)
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(float(np.percentile(vals, 100 * p)), abs=1e-12)
    assert got["empty"].n == 0 and got["empty"].mid is None


@pytest.mark.parametrize("limit", [10**6, 100])
def test_ranks_share_ties(table, limit):
    got = O.value_ranks(table, ["k"], "v", {"n_big": (F.col("v") > 7).cast("long")}, limit).collect()
    for k in ("hot", "cold"):
        vals = sorted(v for key, v in ROWS if key == k and v is not None)
        mine = {r.v: r for r in got if r.k == k}
        assert set(mine) == set(vals)
        for v in set(vals):
            lo, n = vals.index(v), vals.count(v)
            r = mine[v]
            assert (r.n, r.n_below, r.n_total) == (n, lo, len(vals))
            assert r.avg_rank == lo + (n + 1) / 2
            assert r.n_big == (n if v > 7 else 0)


def test_null_keys_survive_the_large_path(spark):
    rows = [(None, float(i)) for i in range(300)] + [("x", float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.m for r in O.quantiles(df, ["k"], "v", {"m": 0.5}, 50).collect()}
    assert got == {None: 149.5, "x": 149.5}


@pytest.mark.parametrize("limit", [10**6, 40])
def test_numbering_is_a_total_order(spark, limit):
    rows = [(float(i % 5), f"id{i:04d}") for i in range(500)]
    df = spark.createDataFrame(rows, "v double, id string").repartition(6)
    out = O.numbered(df, [F.col("v"), F.col("id")], "rn", limit).collect()
    want = {r: i + 1 for i, r in enumerate(sorted(rows))}
    assert {(r.v, r.id): r.rn for r in out} == want


def test_pin_keeps_rows_and_falls_back(spark):
    df = spark.range(5).withColumn("x", F.lit("a"))
    assert sorted(r.id for r in pin(df).collect()) == [0, 1, 2, 3, 4]
    assert pin(df, 3) is df


# ------------------------------------------------------------------ samples


def test_quantile_strata_follow_rank_edges(spark):
    df = spark.createDataFrame([(f"m{i:02d}", float(i // 2)) for i in range(11)], "id string, v double")
    got = {r.id: r.stratum for r in R.quantile_strata(df, "v", "id").collect()}
    # Ranks 1..11, edges 1, 3, 5, 7, 9, 11: the first stratum is closed on both sides.
    want = [0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert [got[f"m{i:02d}"] for i in range(11)] == want


def test_sample_does_not_depend_on_order_or_partitions(spark):
    rows = [(f"m{i}", i % 3) for i in range(200)]
    a = R.sample_per_stratum(spark.createDataFrame(rows, "id string, s int").repartition(5), "s", "id", 10)
    b = R.sample_per_stratum(spark.createDataFrame(rows[::-1], "id string, s int").coalesce(1), "s", "id", 10)
    assert set(a.collect()) == set(b.collect()) and a.count() == 30
    c = R.sample_per_stratum(spark.createDataFrame(rows, "id string, s int"), "s", "id", 10, seed=1)
    assert set(c.collect()) != set(a.collect())


def test_sample_takes_the_lowest_keys_exactly(spark):
    import hashlib

    rows = [(f"m{i}", 0) for i in range(3000)]
    got = {r.id for r in R.sample_per_stratum(spark.createDataFrame(rows, "id string, s int"), "s", "id", 37).collect()}
    want = sorted((hashlib.md5(f"42|m{i}".encode()).hexdigest(), f"m{i}") for i in range(3000))[:37]
    assert got == {m for _, m in want}


def test_small_strata_are_taken_whole(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "id string, s int")
    assert R.sample_per_stratum(df, "s", "id", 5).count() == 3


def test_row_quotas_are_proportional_with_the_rest_to_the_largest(spark):
    df = spark.createDataFrame([("low",)] * 33 + [("mid",)] * 33 + [("high",)] * 34, "s string")
    got = {r.s: r.quota for r in R.row_quotas(df, "s", 10).collect()}
    assert got == {"low": 3, "mid": 3, "high": 4}
    assert {r.s: r.quota for r in R.row_quotas(df, "s", 500).collect()} == {"low": 33, "mid": 33, "high": 34}


def test_proportional_rows_share_keys_between_horizons(spark):
    rows = [(f"s{i % 7}", i, "low" if i % 7 < 4 else "high") for i in range(700)]
    df = spark.createDataFrame(rows, "series_id string, off int, stratum string")
    one = R.proportional_rows(df, "stratum", ["series_id", "off"], 50)
    assert one.count() == 50
    shorter = R.proportional_rows(df.where("off < 690"), "stratum", ["series_id", "off"], 50)
    same = one.join(shorter, ["series_id", "off"], "left_semi").count()
    assert same >= 45


def test_halves_and_groups(spark):
    ids = spark.createDataFrame([(f"v{i}",) for i in range(23)], "series_id string")
    g = R.halves_and_groups(ids, "series_id", 10, 5, "S", "G").collect()
    assert len({r.member for r in g}) == 23
    assert sum(r.env == "S" for r in g) == 10 and sum(r.env == "G" for r in g) == 10 and sum(r.env == "rest" for r in g) == 3
    assert all(r.series_id == r.member for r in g if r.env == "S")
    assert {r.series_id for r in g if r.env == "G"} == {"G_00", "G_01"}


def test_more_than_a_hundred_groups_keep_their_own_numbers(spark):
    ids = spark.createDataFrame([(f"v{i}",) for i in range(760)], "series_id string")
    g = R.halves_and_groups(ids, "series_id", 10, 5, "S", "G").where("env = 'G'").groupBy("series_id").count().collect()
    assert {r.series_id for r in g} == {f"G_{i:02d}" for i in range(150)} and {r["count"] for r in g} == {5}


def test_half_of_the_ids_and_no_repeated_ids(spark):
    ids = spark.createDataFrame([(f"v{i}",) for i in range(23)], "series_id string")
    g = R.halves_and_groups(ids, "series_id", None, 5, "S", "G").collect()
    assert sum(r.env == "S" for r in g) == 11
    with pytest.raises(ValueError, match="not unique"):
        R.halves_and_groups(ids.unionByName(ids.limit(1)), "series_id", 10, 5, "S", "G")


def test_strict_group_mean(spark):
    from helpers import grid_table

    d = grid_table(spark, {"a": [1, 2, None], "b": [3, 4, 5]}).withColumn(
        "is_interp", (F.col("series_id") == "a") & (F.col("bucket") >= 1))
    groups = spark.createDataFrame([("G", "g0", "a"), ("G", "g0", "b"), ("rest", "", "c")],
                                   "env string, series_id string, member string")
    out = R.strict_group_mean(d, groups).orderBy("bucket").collect()
    assert [r.y for r in out] == [2, 3, None]
    assert [r.is_interp for r in out] == [False, True, False]


@pytest.mark.parametrize("small", [True, False])
def test_medians_of_several_columns(spark, small):
    df = spark.createDataFrame([("x", 1.0, None), ("x", 3.0, 5.0), ("y", 7.0, 1.0)], "k string, a double, b double")
    got = {r.k: (r.a_p50, r.b_p50) for r in O.medians(df, ["k"], ["a", "b"], small).collect()}
    assert got == {"x": (2.0, 5.0), "y": (7.0, 1.0)}
    assert O.is_small(df) and not O.is_small(df, 2)

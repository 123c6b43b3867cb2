import math
import os
import random
from itertools import product

import pytest

from helpers import by_key
from tidemark.plans import rank_tests as H
from tidemark.plans import scorecards as C
from tidemark.plans import transfer as T

PAIRS = "k string, a double, b double"

SF = "/root/testdata/sf0.01"


def _normal(z):
    return math.erfc(abs(z) / math.sqrt(2))


def _avg_ranks(vals):
    s = sorted(vals)
    return [s.index(v) + (s.count(v) + 1) / 2 for v in vals]


def test_wilcoxon_against_brute_force(spark):
    rng = random.Random(5)
    rows = [("x", round(rng.gauss(0.3, 1), 1), round(rng.gauss(0, 1), 1)) for _ in range(60)]
    r = H.wilcoxon(spark.createDataFrame(rows, PAIRS), ["k"]).first()
    d = [round(a - b, 9) for _, a, b in rows]
    nz = [v for v in d if v]
    ranks = _avg_ranks([abs(v) for v in nz])
    up = sum(k for k, v in zip(ranks, nz) if v > 0)
    n = len(nz)
    stat = min(up, n * (n + 1) / 2 - up)
    ties = sum(t ** 3 - t for t in (ranks.count(k) for k in set(ranks)))
    z = (stat - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    assert r.statistic == stat and r.z == pytest.approx(z) and r.p == pytest.approx(_normal(z))
    assert r.n_series == 60 and r.n_a_lower == sum(v < 0 for v in d)


def test_equal_samples_give_p_one(spark):
    r = H.wilcoxon(spark.createDataFrame([("x", float(i), i + 1e-12) for i in range(12)], PAIRS), ["k"]).first()
    assert r.p == 1.0 and r.statistic is None


def test_direction_is_the_median_of_differences(spark):
    # The difference of the medians is positive, the median difference negative.
    rows = [("x", a, b) for a, b in ((1, 2), (2, 3), (9, 4), (10, 11), (11, 12))]
    r = H.wilcoxon(spark.createDataFrame([(k, float(a), float(b)) for k, a, b in rows], PAIRS), ["k"]).first()
    assert r.a_p50 - r.b_p50 > 0 and r.diff_p50 == -1


def test_mann_whitney_against_pair_counting(spark):
    a, b = [1.0, 2.0, 2.0, 5.0, 9.0], [2.0, 3.0, 4.0, 4.0, 0.5, 7.0]
    rows = [("x", "a", v) for v in a] + [("x", "b", v) for v in b]
    r = H.mann_whitney(spark.createDataFrame(rows, "k string, side string, value double"), ["k"]).first()
    u = sum(1.0 if x > y else 0.5 if x == y else 0.0 for x, y in product(a, b))
    assert r.u_a == u and r.rank_biserial == pytest.approx(2 * u / 30 - 1)
    ranks = _avg_ranks(a + b)
    ties = sum(t ** 3 - t for t in (ranks.count(k) for k in set(ranks)))
    var = 30 / 12 * (12 - ties / (11 * 10))
    z = (max(u, 30 - u) - 15 - 0.5) / math.sqrt(var)
    assert r.p == pytest.approx(_normal(z) if z > 0 else 1.0)


def test_mann_whitney_effect_is_positive_when_a_costs_more(spark):
    rows = [("x", "a", 10.0 + i) for i in range(20)] + [("x", "b", float(i)) for i in range(10)]
    r = H.mann_whitney(spark.createDataFrame(rows, "k string, side string, value double"), ["k"]).first()
    assert r.rank_biserial == 1.0 and r.p < 1e-4
    one_sided = spark.createDataFrame([("x", "a", 1.0)], "k string, side string, value double")
    assert H.mann_whitney(one_sided, ["k"]).count() == 0


def test_spearman(spark):
    rows = [("m", float(i), float(i ** 3)) for i in range(10)] + [("flat", 1.0, float(i)) for i in range(5)]
    got = {r.k: r for r in H.spearman(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert got["m"].rho == pytest.approx(1.0) and got["flat"].rho is None
    # r = 0.6 on ten points: t = 2.1213 with 8 degrees of freedom, two-sided p = 0.0667.
    from tidemark.functions.tails import _t_two_sided

    assert _t_two_sided(0.6 * math.sqrt(8 / (1 - 0.36)), 8) == pytest.approx(0.06669, abs=1e-4)
    assert _t_two_sided(0.0, 5) == pytest.approx(1.0) and _t_two_sided(1.0, 1) == pytest.approx(0.5)
    assert _t_two_sided(1.959964, 1e6) == pytest.approx(0.05, abs=1e-5)


def test_spearman_p_of_a_perfect_correlation(spark):
    rows = [(k, float(i), sign * i) for k, n, sign in (("up", 5, 1.0), ("down", 5, -1.0), ("two", 2, 1.0)) for i in range(n)]
    got = {r.k: (r.rho, r.p) for r in H.spearman(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert got == {"up": (1.0, 0.0), "down": (-1.0, 0.0), "two": (1.0, None)}


def test_holm(spark):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate((0.01, 0.03, 0.03, 0.04, 0.2))] + [("g", 9, 0.5)],
                               "fam string, i int, p double")
    got = by_key(H.holm(df, ["fam"]), "i", "p_holm")
    assert [got[i] for i in range(5)] == pytest.approx([0.05, 0.12, 0.12, 0.12, 0.2]) and got[9] == 0.5
    assert H.holm(df, []).where("i = 0").first().p_holm == pytest.approx(0.06)


def test_verdict(spark):
    df = spark.createDataFrame([(1, 0.01, -1.0), (2, 0.01, 1.0), (3, 0.2, -1.0), (4, 0.01, 0.0)], "i int, p_holm double, e double")
    assert by_key(H.verdict(df, "e", "neg", "pos"), "i", "verdict") == {
        1: "neg", 2: "pos", 3: "no_difference", 4: "significant_zero_median"}


PER = "env string, h int, series_id string, model string, mae double"


def _per(spark, n=12):
    rows = []
    for i in range(n):
        rows += [("E", 1, f"s{i}", "naive", 10.0 + i), ("E", 1, f"s{i}", "good", 9.0 + i - 0.01 * i),
                 ("E", 1, f"s{i}", "same", 10.0 + i)]
    return spark.createDataFrame(rows, PER)


def test_model_pairs_and_reference_table(spark):
    per = _per(spark)
    t = H.compare_models(per, ["naive", "good", "same"])
    got = {(r.model_a, r.model_b): r for r in t.collect()}
    assert set(got) == {("naive", "good"), ("naive", "same"), ("good", "same")}
    assert got["naive", "good"].better == "good" and got["naive", "same"].better == "inconclusive"
    ref = {r.model: r for r in H.models_vs_reference(t, per).collect()}
    assert ref["good"].beats_reference and ref["good"].n_better == 12 and ref["good"].diff_p50 < 0
    assert not ref["same"].beats_reference and ref["same"].ratio == 1.0


def test_fewer_than_ten_series_are_not_tested(spark):
    assert H.compare_models(_per(spark, 9), ["naive", "good"]).count() == 0


TR = "source string, target string, mode string, h int, model string, series_id string, mae double"


def _transfer(spark):
    rows = []
    for i in range(20):
        for mode in ("N0", "N1", "N2"):
            rows += [("A", "A", mode, 1, "m", f"a{i}", 1.0 + i / 100), ("B", "B", mode, 1, "m", f"b{i}", 1.0 + i / 100),
                     ("A", "B", mode, 1, "m", f"b{i}", 1.1 + i / 100 if mode == "N0" else 1.0 + i / 100),
                     ("B", "A", mode, 1, "m", f"a{i}", 3.0 + i / 100)]
    rows.append(("A", "B", "N0", 1, "m", "zero", 1.0))
    rows.append(("B", "B", "N0", 1, "m", "zero", 0.0))
    return spark.createDataFrame(rows, TR)


def test_loss_table_and_its_tests(spark):
    tr = _transfer(spark)
    loss = H.loss_table(tr, tr.where("source = target"))
    assert loss.where("source = target").count() == 0
    assert loss.where("series_id = 'zero'").first().loss is None
    t = {(r.source, r.mode): r for r in H.transfer_vs_diagonal(loss).collect()}
    assert t["A", "N0"].verdict == "transfer_worse" and t["A", "N1"].verdict == "no_difference"
    assert t["A", "N0"].n_series == 21 and t["A", "N1"].loss_p50 == 1.0
    med = {r.source: r for r in H.loss_medians(H.transfer_vs_diagonal(loss)).collect()}
    assert med["A"].N1 == 1.0 and med["B"].N0 > 2.5


def test_median_loss_needs_no_test(spark):
    tr = _transfer(spark)
    loss = H.loss_table(tr, tr.where("source = target"))
    want = H.transfer_vs_diagonal(loss).select(*H.TRANSFER_KEYS, "loss_p50")
    assert sorted(map(str, H.median_loss(loss).select(*want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_scorecard_scores_only_what_it_asks_for(spark, monkeypatch):
    from checks import queries_tests as Q

    asked = [("B", "C", "N0"), ("A", "B", "N1"), ("B", "A", "N1")]
    whole = {tuple(r)[:6]: tuple(r)[6:] for r in Q._loss(spark, SF).collect()}
    seen, own = [], Q._loss
    monkeypatch.setattr(Q, "_loss", lambda *a: seen.append(own(*a)) or seen[0])
    Q.loss_scorecard(spark, SF).collect()
    got = {tuple(r)[:6]: tuple(r)[6:] for r in seen[0].collect()}
    want = {k: v for k, v in whole.items() if k[:3] in asked}
    assert got.keys() == want.keys() and {k[:3] for k in got} == set(asked)
    assert all(v == pytest.approx(want[k]) for k, v in got.items())


def test_asymmetry_direction(spark):
    tr = _transfer(spark)
    loss = H.loss_table(tr, tr.where("source = target"))
    a = H.asymmetry(loss, "loss", [(("A", "B"), ("B", "A"))]).where("mode = 'N1'").first()
    assert a.verdict == "reverse_costs_more" and a.rank_biserial == -1.0 and a.agrees_with_medians
    b = H.asymmetry(loss, "loss", [(("B", "A"), ("A", "B"))]).where("mode = 'N1'").first()
    assert b.verdict == "forward_costs_more"


def test_modes_against_raw(spark):
    tr = _transfer(spark)
    t = {(r.source, r.comparison): r.verdict for r in H.modes_vs_raw(
        tr.where("source <> target"), ["source", "target", "h", "model"], ["source", "target", "h"]).collect()}
    assert t["A", "N1_vs_N0"] == "better_than_N0" and t["B", "N1_vs_N0"] == "no_difference"
    n = H.n2_vs_n1(tr.where("source <> target"), ["source", "target", "h", "model"], ["h"]).collect()
    assert all(r.verdict == "no_difference" for r in n)


# ------------------------------------------------------------------ result tables


def test_replacing_rows_touches_only_that_mode_and_horizon(spark):
    base = spark.createDataFrame([("A", "B", m, h, "x", "s", 1.0) for m in ("N0", "N1", "N2") for h in (1, 6)], TR)
    new = spark.createDataFrame([("A", "B", "N1", 1, "x", "s", 2.0), ("A", "B", "N2", 1, "x", "s", 9.0),
                                 ("A", "B", "N2", 6, "x", "s", 3.0)], TR)
    got = {(r["mode"], r.h): r.mae for r in T.final_table(base, new, new, [6]).collect()}
    assert got == {("N0", 1): 1.0, ("N0", 6): 1.0, ("N1", 1): 2.0, ("N1", 6): 1.0, ("N2", 1): 1.0, ("N2", 6): 3.0}


def test_remaining_work_goes_down_to_the_model(spark):
    grid = T.config_grid(spark, [("A", "B"), ("A", "C")], ["N0"], ["on"], [1], ["lr", "rf"])
    done = grid.where("model = 'lr' or target = 'C'")
    w = T.missing_work(grid, done).collect()
    assert len(w) == 1 and [(x.model, x.target) for x in w[0].work] == [("rf", "B")]
    assert T.missing_work(grid, grid).count() == 0


def test_roles(spark):
    rows = [(s, t, "N0", 1, "m", "s", 1.0) for s, t in (("A", "A"), ("A", "B"), ("X", "X"), ("X", "A"))]
    diag, moved, other = T.split_by_role(spark.createDataFrame(rows, TR), ["A", "B"])
    assert (diag.count(), moved.count(), other.count()) == (1, 1, 2)


def test_scorecard_rules(spark):
    items = spark.createDataFrame([("a", 1.0), ("b", 5.0)], "item string, value double")
    rules = C.rules(spark, [("both_low", "a", None, 2.0), ("both_low", "b", None, 2.0), ("a_low", "a", 0.5, 2.0),
                            ("unknown", "c", 1.0, None), ("at_least", "b", 5.0, None)])
    got = by_key(C.evaluate(rules, items), "rule", "holds")
    assert got == {"both_low": False, "a_low": True, "unknown": None, "at_least": True}
    assert by_key(C.evaluate(rules, items, missing=0.0), "rule", "holds")["unknown"] is False


def test_run_comparison_shows_rows_of_one_side(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, v double")
    b = spark.createDataFrame([("x", 1.5), ("z", 3.0)], "k string, v double")
    got = {r.k: (r.first, r.second, r.change) for r in C.compare_runs(a, b, ["k"], "v").select(
        "k", "first", "second", "change").toPandas().astype(object).where(lambda d: d.notna(), None).itertuples()}
    assert got == {"x": (1.0, 1.5, 0.5), "y": (2.0, None, None), "z": (None, 3.0, None)}


def test_small_signed_rank_samples_are_exact(spark):
    """Counted by hand: with n pairs there are 2 ** n sign patterns; few of them reach a small rank sum."""
    def rows(k, signs):
        return [(k, float(i * s), 0.0) for i, s in enumerate(signs, 1)]

    data = (rows("all up", [1] * 10)                   # only the empty set has the sum 0: 2 * 1 / 1024
            + rows("sum 3", [-1, -1] + [1] * 8)        # {}, 1, 2, 3, 1+2: 2 * 5 / 1024
            + rows("sum 4", [1, 1, 1, -1] + [1] * 16)  # further 4, 1+3: 2 * 7 / 2 ** 20
            + rows("even", [1, 1, -1, 1, -1, -1, 1])   # 14 of 28 each way: capped at 1
            + rows("tied", [1] * 10) + [("tied", -10.0, 0.0)]
            + rows("zero", [1] * 10) + [("zero", 0.0, 0.0)]
            + rows("at the limit", [1] * 50) + rows("large", [1] * 51)
            + [("same", 1.0, 1.0)] * 5)
    got = {r.k: r for r in H.wilcoxon(spark.createDataFrame(data, PAIRS), ["k"]).collect()}
    want = {"all up": 2 / 1024, "sum 3": 10 / 1024, "sum 4": 14 / 2**20, "even": 1.0, "at the limit": 2 / 2**50}
    for k, p in want.items():
        assert got[k].p_from == "exact" and got[k].p == pytest.approx(p, rel=1e-12)
    assert {k: got[k].p_from for k in ("tied", "zero", "large", "same")} == {
        "tied": "normal", "zero": "normal", "large": "normal", "same": "equal"}
    assert 0.001 < got["tied"].p < 0.05 and got["same"].p == 1.0

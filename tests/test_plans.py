"""What the physical plans must look like to hold at scale."""

import os
import re
import uuid

import pytest
from pyspark.sql import functions as F

from checks import fleets
from helpers import SMALL, grid_table, raw_table
from tidemark.functions import ordered
from tidemark.functions.ordered import settle
from tidemark.operators import catalog as C
from tidemark.operators import features as X
from tidemark.operators import grid as G
from tidemark.operators import metrics as M
from tidemark.operators import splits as V
from tidemark.operators.baselines import baseline_predictions
from tidemark.plans.rank_tests import model_pairs
from tidemark.sources import sinks as S

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


def test_raw_rows_to_series_metrics_take_two_shuffles_and_no_join(spark):
    raw = raw_table(spark, {"a": [1.0, 2.0, 3.0]})
    g = M.with_mase_scale(G.fleet_grid(raw, SMALL), SMALL)
    m = V.with_split(X.feature_matrix(g, SMALL, carry=("d",)), SMALL)
    per = M.per_series_metrics(baseline_predictions(m, SMALL), ["env", "h", "model", "split", "series_id"])
    p = plan(per)
    assert exchanges(per) == 2 and "Join" not in p and "BatchEvalPython" not in p


def test_all_modes_share_the_series_partitioning(spark):
    g = G.fleet_grid(raw_table(spark, {"a": [1.0, 2.0]}), SMALL)
    for mode in ("N0", "N1", "N2"):
        assert exchanges(X.feature_matrix(g, SMALL, mode=mode)) == 2


def test_catalog_adds_no_shuffle(spark):
    reg = G.regularise(G.to_grid(raw_table(spark, {"a": [1.0]}), SMALL), SMALL)
    assert exchanges(C.profile(reg, SMALL)) == 2


def test_model_pairs_need_no_self_join(spark):
    per = spark.createDataFrame([("E", 1, "s", "a", 1.0)], "env string, h int, series_id string, model string, mae double")
    assert "Join" not in plan(model_pairs(per, ["a", "b"])) and exchanges(model_pairs(per, ["a", "b"])) == 1


def test_scan_reads_only_what_a_fleet_needs(spark):
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    p = plan(fleets.grid(spark, SF, "C"))
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in p


def test_window_filter_reaches_the_parquet_scan(spark, tmp_path):
    S.write_processed(grid_table(spark, {"a": [1.0, 2.0]}), f"{tmp_path}/p")
    d = G.apply_window(S.read_table(spark, f"{tmp_path}/p").where("env = 'E'"), 1, 1)
    p = plan(d)
    assert "GreaterThanOrEqual(bucket,1)" in p and "PartitionFilters: [isnotnull(env" in p and d.count() == 1


def test_bucketed_series_table_is_read_without_a_shuffle(spark):
    t = f"series_{uuid.uuid4().hex[:8]}"
    try:
        S.save_series_table(grid_table(spark, {"a": [float(i) for i in range(30)], "b": [1.0] * 30}), t, 4)
        m = X.feature_matrix(spark.table(t), SMALL)
        assert exchanges(m) == 0 and m.count() == 2 * (30 - 6 - 1) + 2 * (30 - 6 - 3)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_settled_tables_are_written_to_the_named_folder(spark, tmp_path, monkeypatch):
    df = spark.range(10).select(F.col("id"), (F.col("id") % 2).cast("int").alias("h"), F.lit("007").alias("env"))
    assert settle(df).count() == 10
    monkeypatch.setattr(ordered, "stage_folder", lambda s: str(tmp_path))
    out = settle(df, ["env", "h"])
    assert out.columns == df.columns and out.dtypes == df.dtypes and out.where("h = 1").count() == 5
    assert "PartitionFilters: [isnotnull(h" in plan(out.where("h = 1"))
    assert len(os.listdir(tmp_path)) == 1 and {r.env for r in out.collect()} == {"007"}

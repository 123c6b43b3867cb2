import os

import pytest

import __spark_entry__ as entry
from checks import compare

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def test_entry_reproduces_the_known_median(spark):
    rows = {(r.model, r.metric): r for r in entry.entry(spark).collect()}
    assert rows["naive", "mae"].p50 == pytest.approx(16.935125)


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90


@pytest.mark.parametrize("name", ["regular_series", "series_catalog", "gap_structure", "level_ecdf", "burstiness"])
def test_queries_agree_with_sql_on_the_smallest_tables(spark, name):
    note, ok = compare.compare(spark, compare.duck(SF), SF, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_results_do_not_depend_on_the_partition_count(spark):
    q = entry.queries()["baseline_series_metrics"]
    before = sorted(map(str, q(spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        assert sorted(map(str, q(spark, SF).collect())) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")

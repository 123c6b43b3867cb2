import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import logs as L
from tidemark.sources import sinks as S
from tidemark.sources.tables import SPECS, event_fleet



def _vm(path, rows, header="Timestamp [ms];\tCPU cores;\tCPU usage [%]"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join([header, *rows]) + "\n")


def test_vm_logs(spark, tmp_path):
    _vm(f"{tmp_path}/2013-8/1.csv", ["1376314846;\t4;\t93.2", "1376315146;\t4;\toops", "bad;\t4;\t3", "1376315446;\t4;\t1e1"],
        header="Timestamp [ms];\t CPU cores ;\tCPU usage [%] ")
    _vm(f"{tmp_path}/2013-8/22.csv", ["1376314846;\t2;\t0.5"])
    got = L.read_vm_logs(spark, f"{tmp_path}/2013-8/*.csv", "E1").orderBy("series_id", "time_s").collect()
    assert [(r.series_id, r.time_s, r.value) for r in got] == [
        ("E1_1", 1376314846, 93.2), ("E1_1", 1376315446, 10.0), ("E1_22", 1376314846, 0.5)]


def test_months_keep_repeated_file_names_apart(spark, tmp_path):
    for m in ("2013-7", "2013-8"):
        _vm(f"{tmp_path}/{m}/1.csv", ["100;\t1;\t5"])
    d = L.read_vm_logs(spark, f"{tmp_path}/*/*.csv", "E2", month=L.month_of(F.col("_metadata.file_path")), month_required=True)
    assert {r.series_id for r in d.collect()} == {"E2_2013-7_1", "E2_2013-8_1"}
    with pytest.raises(ValueError, match="month"):
        L.read_vm_logs(spark, f"{tmp_path}/*/*.csv", "E2", month_required=True)


def test_vm_log_without_the_value_column(spark, tmp_path):
    _vm(f"{tmp_path}/x/1.csv", ["1;\t2"], header="Timestamp [ms];\tCPU cores")
    with pytest.raises(ValueError, match="CPU usage"):
        L.read_vm_logs(spark, f"{tmp_path}/x/*.csv", "E1")


def test_machine_log_and_frozen_ids(spark, tmp_path):
    with open(f"{tmp_path}/m.csv", "w") as f:
        for m in ("m_1", "m_2", "m_3"):
            f.write(f"{m},0,10,1,,,2,3,-1\n{m},10,20,1,,,2,3,101\n")
        f.write("m_1,20,,1,,,2,3,50\n")
    with open(f"{tmp_path}/ids.txt", "w") as f:
        f.write("# frozen\n\nm_3\n  m_1  \n")
    ids = L.read_frozen_ids(spark, f"{tmp_path}/ids.txt")
    rows = L.read_machine_log(spark, f"{tmp_path}/m.csv", "E3", ids)
    assert {r.series_id for r in rows.collect()} == {"E3_m_1", "E3_m_3"} and rows.count() == 5
    means = {r.series_id: (r["mean"], r.n_values) for r in L.machine_means(rows).collect()}
    assert means["E3_m_1"] == (15.0, 2)
    full = L.read_machine_table(spark, f"{tmp_path}/m.csv")
    assert "mkpi" not in full.columns and full.where("disk_io_percent is null").count() == 6
    scan = L.read_machine_log(spark, f"{tmp_path}/m.csv", "E3")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<machine_id:string,time_stamp:bigint,cpu_util_percent:double>" in scan


def test_fingerprint(spark, tmp_path):
    import hashlib

    _vm(f"{tmp_path}/d/1.csv", ["1;\t2;\t3"])
    _vm(f"{tmp_path}/d/2.csv", ["1;\t2;\t3", "2;\t2;\t3"])
    files = L.fingerprint(spark, str(tmp_path))
    folder = files.first().folder
    size = sum(os.path.getsize(f"{tmp_path}/d/{i}.csv") for i in (1, 2))
    md5 = hashlib.md5(open(f"{tmp_path}/d/1.csv", "rb").read()).hexdigest()
    folders = spark.createDataFrame([(folder, 2, size), ("nowhere", 1, 1)], "folder string, n_files long, total_bytes long")
    samples = spark.createDataFrame([(folder, "1.csv", md5), (folder, "2.csv", "0" * 32)], "folder string, file string, md5 string")
    got = [r.status for r in L.compare_fingerprint(files, folders, samples).orderBy("check").collect()]
    assert sorted(got) == ["md5_differs", "missing", "ok", "ok"]
    big = L.fingerprint(spark, str(tmp_path), md5_up_to=40)
    assert big.where("md5 is null").count() >= 1
    got = {r.check.rsplit("/", 1)[-1]: r.status for r in L.compare_fingerprint(big, folders, samples).collect()}
    assert got["2.csv"] == "not_hashed"


def test_upsert_replaces_keys_and_appends(spark, tmp_path):
    p = f"{tmp_path}/t"
    S.upsert(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), p, ["k"])
    S.upsert(spark.createDataFrame([("b", 20), ("c", 30)], "k string, v int"), p, ["k"])
    assert {r.k: r.v for r in S.read_table(spark, p).collect()} == {"a": 1, "b": 20, "c": 30}
    assert not os.path.exists(p + "__next") and not os.path.exists(p + "__previous")


def test_interrupted_swap_is_recovered(spark, tmp_path):
    p = f"{tmp_path}/t"
    S.upsert(spark.createDataFrame([("a", 1)], "k string, v int"), p, ["k"])
    os.rename(p, p + "__previous")
    S.upsert(spark.createDataFrame([("b", 2)], "k string, v int"), p, ["k"])
    assert {r.k for r in S.read_table(spark, p).collect()} == {"a", "b"}


def test_partition_overwrite_keeps_other_environments(spark, tmp_path):
    p = f"{tmp_path}/c"
    S.upsert_catalog(spark.createDataFrame([("A", 1), ("B", 2)], "env string, v int"), p)
    S.upsert_catalog(spark.createDataFrame([("B", 9)], "env string, v int"), p)
    assert {r.env: r.v for r in S.read_table(spark, p).collect()} == {"A": 1, "B": 9}


def test_processed_and_matrix_tables(spark, tmp_path):
    rows = [("A", "s", 1, 0.5, False), ("B", "s", 1, None, False)]
    df = spark.createDataFrame(rows, "env string, series_id string, bucket long, y double, is_interp boolean")
    S.write_processed(df, f"{tmp_path}/p")
    assert S.read_table(spark, f"{tmp_path}/p").where("env = 'B'").first().y is None
    S.write_matrix(df.withColumn("mode", F.lit("N0")).withColumn("h", F.lit(1)), f"{tmp_path}/m")
    assert os.path.isdir(f"{tmp_path}/m/env=A/mode=N0/h=1")


def test_csv_result_table(spark, tmp_path):
    with open(f"{tmp_path}/r.csv", "w") as f:
        f.write("env,p50\nE1,0.4\n")
    assert S.read_table(spark, f"{tmp_path}/r.csv", "env string, p50 double", "csv").first().p50 == 0.4


def test_epoch_seconds_do_not_depend_on_the_session_zone(spark):
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no driver tables")
    a = event_fleet(spark, d).agg(F.min("time_s")).first()[0]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Ho_Chi_Minh")
    try:
        assert event_fleet(spark, d).agg(F.min("time_s")).first()[0] == a == 1704067798
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert SPECS["A"].grid_s == 3600

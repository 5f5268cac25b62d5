import json
import os

import pytest
from pyspark.sql import Observation, functions as F

from lagweave.operators import reshape
from lagweave.plans.preprocess import preprocess
from lagweave.sources import manifest, store
from test_sources import write_wide


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith((".parquet", ".csv")))


def test_a_table_is_used_again_only_with_an_equal_manifest(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).write.parquet(source)
    rows = spark.read.parquet(source)
    assert store.materialise(rows, path, parameters={"length": 12}) == "absent"
    said = manifest.read_manifest(spark, path)
    assert said["rows"] == 10 and said["parameters"] == {"length": 12} and said["columns"] == [["id", "bigint"]]
    before = files(path)
    assert store.materialise(rows.limit(0), path, parameters={"length": 12}) == "present" and files(path) == before
    assert store.materialise(rows, path, parameters={"length": 24}) == "stale"
    assert store.materialise(rows.selectExpr("id", "1 AS x"), path, parameters={"length": 24}) == "stale"
    assert store.materialise(rows.selectExpr("id", "1 AS x"), path, force=True, parameters={"length": 24}) == "forced"
    spark.range(5).write.mode("append").parquet(source)
    again = spark.read.parquet(source)
    assert store.materialise(again.selectExpr("id", "1 AS x"), path, parameters={"length": 24}) == "stale"
    assert spark.read.parquet(path).count() == 15


@pytest.mark.parametrize("harm, state", [("no manifest", "broken"), ("cut manifest", "broken"), ("lost file", "damaged"), ("other file", "damaged"), ("empty folder", "broken")])
def test_half_written_tables_are_written_anew(spark, tmp_path, harm, state):
    path = tmp_path / "t"
    rows = spark.range(20).repartition(3)
    if harm == "empty folder":
        path.mkdir()
    else:
        store.materialise(rows, str(path))
        if harm == "no manifest":
            (path / manifest.NAME).unlink()
            os.unlink(files(path)[0])
        elif harm == "cut manifest":
            (path / manifest.NAME).write_text('{"rows": 2')
        elif harm == "lost file":
            os.unlink(files(path)[0])
        else:
            spark.range(3).write.mode("append").parquet(str(path))
    assert store.materialise(rows, str(path)) == state
    assert spark.read.parquet(str(path)).count() == 20
    assert store.materialise(rows, str(path)) == "present"


def test_a_write_that_fails_leaves_no_manifest(spark, tmp_path):
    path = str(tmp_path / "t")
    store.materialise(spark.range(5), path)
    bad = spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).alias("v"))
    with pytest.raises(Exception, match="lost"):
        store.materialise(bad, path)
    assert manifest.read_manifest(spark, path) is None
    assert store.materialise(spark.range(7), path) in ("absent", "broken")
    assert spark.read.parquet(path).count() == 7


def test_manifests_do_not_show_in_tables(spark, tmp_path):
    path = str(tmp_path / "c")
    store.materialise(spark.range(4), path, fmt="csv")
    assert spark.read.csv(path, header=True).count() == 4
    assert json.loads((tmp_path / "c" / manifest.NAME).read_text())["table"]["files"] == len(files(path))


def test_preprocess_resumes_and_takes_other_parameters(spark, tmp_path):
    rows = [f"{site},lane,10/{day}/2006,e," + ",".join(str((i * 3 + day) % 17) for i in range(8)) for site in ("1", "2") for day in range(1, 9)]
    write_wide(tmp_path / "wide.csv", rows + [",lane,10/1/2006,e,1,2,3,4,5,6,7,8", "1,lane,13/40/2006,e,1,x,3,4,5,6,7,8", "1,lane,,e", "2,b,10/9/2006,e,1,x,,y,5,6,7,8"], [f"V{i:02d}" for i in range(8)])
    out = str(tmp_path / "out")
    first = preprocess(spark, str(tmp_path / "wide.csv"), out, region=False, length=12)
    assert first["windows"].count() == 2 * 64 + 8 - 2 * 12
    rejects = {r["reason"]: (r["n_rows"], r["n_junk"]) for r in first["rejects"].collect()}
    assert rejects == {"no_id": (1, 0), "no_date": (1, 0), "bad_date": (1, 1), "junk_cells": (1, 2)}
    before = files(out)
    preprocess(spark, str(tmp_path / "wide.csv"), out, region=False, length=12)
    assert files(out) == before
    other = preprocess(spark, str(tmp_path / "wide.csv"), out, region=False, length=24)
    assert "lag_24" in other["windows"].columns and other["windows"].count() == 2 * 64 + 8 - 2 * 24
    assert [f for f in files(out) if "/series/" in f] == [f for f in before if "/series/" in f]  # not written again
    os.unlink([f for f in files(out) if "/series/" in f][0])
    again = preprocess(spark, str(tmp_path / "wide.csv"), out, region=False, length=24)
    assert again["series"].count() == 2 * 64 + 8


def test_rejects_have_reasons_and_the_rest_is_what_cleaning_keeps(spark):
    rows = [("1", "a", "10/1/2006", "1", "2"), (None, "b", "10/1/2006", "1", "zz"), ("n/a", "c", "bad", "1", None), ("2", None, " ", "", "n/a"),
            ("3", "d", "2006-10-01", "12d", "inf"), ("0004", "e", "1/2/2006", "inf", "3"), ("5", "f", None, "1", "1")]
    raw = spark.createDataFrame(rows, "`SCATS Number` string, Location string, Date string, V00 string, V01 string")
    tagged = reshape.tag_wide(raw)
    got = sorted((r["location"] or "", r["reason"], r["n_junk"]) for r in reshape.rejected_rows(tagged).collect())
    assert got == [("", "no_date", 0), ("b", "no_id", 1), ("c", "no_id", 0), ("d", "bad_date", 2), ("e", "junk_cells", 1), ("f", "no_date", 0)]
    kept, clean = reshape.kept_wide(tagged), reshape.clean_wide(raw)
    assert kept.columns == clean.columns and sorted(map(tuple, kept.collect())) == sorted(map(tuple, clean.collect()))
    seen = Observation()
    assert reshape.kept_wide(reshape.count_rejects(tagged, seen)).count() == 2
    counts = {r["reason"]: (r["n_rows"], r["n_junk"]) for r in reshape.reject_counts(spark, seen).collect()}
    assert counts == {"no_id": (2, 1), "no_date": (2, 0), "bad_date": (1, 2), "junk_cells": (1, 1)}


def test_rejects_come_from_one_scan(spark, tmp_path):
    path = str(tmp_path / "raw")
    spark.createDataFrame([("1", "a", "10/1/2006", "1")], "`SCATS Number` string, Location string, Date string, V00 string").write.parquet(path)
    tagged = reshape.count_rejects(reshape.tag_wide(spark.read.parquet(path)), Observation())
    plan = reshape.wide_to_long(reshape.kept_wide(tagged))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("CollectMetrics") == 1


def test_empty_inputs(spark, tmp_path):
    raw = spark.createDataFrame([], "`SCATS Number` string, Location string, Date string, V00 string")
    seen = Observation()
    store.materialise(reshape.wide_to_long(reshape.kept_wide(reshape.count_rejects(reshape.tag_wide(raw), seen))), str(tmp_path / "s"))
    assert {r["n_rows"] for r in reshape.reject_counts(spark, seen).collect()} == {0}
    assert manifest.read_manifest(spark, str(tmp_path / "s"))["rows"] == 0

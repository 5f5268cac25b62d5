"""Shapes of the plans: what must hold for large tables."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from helpers import SERIES, series_rows
from lagweave.operators.lookup import lookup
from lagweave.operators.windows import lag_windows
from lagweave.plans import queries
from lagweave.sources.shared import stored

# Queries that write and read tables, or fit, before they return: their plans are those of the last step, and are checked, too.
PYTHON = set()  # the solver of `fit_ar` is an expression too


def initial_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries.REGISTRY))
def test_no_pairwise_joins_and_no_python(spark, small, name):
    plan = initial_plan(queries.REGISTRY[name](spark, small))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert ("Python" in plan or "InPandas" in plan) == (name in PYTHON)


def test_row_windows_are_cut_by_chunk(spark):
    plan = initial_plan(lag_windows(spark.createDataFrame(series_rows({"a": 50}), SERIES)))
    rows = [w for w in plan.split("\n") if "Window [row_number" in w]
    assert rows
    for line in rows:
        assert re.search(r"\[site_id#\d+, chunk#\d+\], \[ts#", line), line


def test_the_two_uses_of_the_rows_share_one_exchange(spark, tmp_path):
    path = str(tmp_path / "series")
    spark.createDataFrame(series_rows({"a": 500, "b": 100}), SERIES).write.parquet(path)
    windows = lag_windows(spark.read.parquet(path))
    consumed = windows.agg(F.max("ts"), F.max("location"), F.sum("y"), F.sum("lag_12"))
    consumed.collect()
    final = initial_plan(consumed).split("Initial Plan")[0]
    assert "ReusedExchange" in final
    own = "\n".join(line for line in final.split("\n") if "ReusedExchange" not in line)
    # That of the rows, and that of the summaries on their way back.
    assert len(re.findall(r"Exchange hashpartitioning\(site_id#\d+, chunk#\d+", own)) == 2
    assert final.count("FileScan") == 1


def test_rows_are_not_broadcast(spark):
    windows = lag_windows(spark.createDataFrame(series_rows({"a": 50}), SERIES))
    plan = initial_plan(windows)
    assert "BroadcastExchange" not in plan and "SortMergeJoin [site_id" in plan


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_lookup_gives_the_same_with_and_without_broadcast(spark, how):
    rows = spark.createDataFrame([("h", i) for i in range(900)] + [("c", 0), ("x", 1)], "site_id string, ts int")
    table = spark.sql("SELECT * FROM VALUES ('h'), ('c'), ('z') AS t(site_id)")
    table = stored(table if how == "left_semi" else table.withColumn("n", F.length("site_id")), "table")
    small = lookup(rows, table, ["site_id"], how)
    assert "BroadcastHashJoin" in initial_plan(small)
    expected = sorted(map(tuple, small.collect()), key=str)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = lookup(rows, table, ["site_id"], how)
        assert "SortMergeJoin" in initial_plan(large)
        assert sorted(map(tuple, large.collect()), key=str) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(expected) == (902 if how == "left" else 901)


@pytest.mark.parametrize("name", ["minmax_scale", "score_ar1"])
def test_long_rows_do_not_move_for_a_lookup(spark, name):
    folder = "/root/testdata/sf0.01"
    plan = initial_plan(queries.REGISTRY[name](spark, folder))
    top = plan[: plan.index("BroadcastHashJoin")] if "BroadcastHashJoin" in plan else plan
    assert "BroadcastHashJoin [site_id" in plan and "Exchange" not in top and "SortMergeJoin [site_id" not in top


def test_a_query_scans_its_source_once_for_fit_and_score(spark, small):
    plan = initial_plan(queries.REGISTRY["site_metrics"](spark, small))
    assert "user_id" not in plan  # the events are read for the stored windows only


def test_hot_days_are_split_and_nothing_goes_to_one_task(spark, small):
    plan = initial_plan(queries.REGISTRY["lag_windows_per_file"](spark, small))
    own = plan.split("\n")
    single = [k for k, line in enumerate(own) if "SinglePartition" in line]
    assert all("partial_m" in own[k + 1] for k in single), plan  # global aggregates of what the tasks have combined
    assert re.search(r"Window \[row_number.*\[source_file#\d+, chunk#\d+\]", plan)


def test_scan_reads_needed_columns_only(spark, small):
    plan = initial_plan(queries.REGISTRY["profile_hour"](spark, small))
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>", plan)


def test_key_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "series")
    spark.createDataFrame(series_rows({"a": 50, "b": 50}), SERIES).write.parquet(path)
    plan = initial_plan(lag_windows(spark.read.parquet(path)).where(F.col("site_id") == "a"))
    assert "EqualTo(site_id,a)" in plan


def test_every_query_has_a_counterpart_or_a_unit_test():
    only_rows = {"fit_pooled_gbt", "gbt_history"}
    assert set(queries.REGISTRY) - set(entry.oracle_sql()) == only_rows
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["site_id", "hour", "avg_flow"] and rows.count() > 0

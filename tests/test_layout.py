"""Storage that spares an exchange: files ranged by site with an index, and equal buckets."""

import pytest
from pyspark.sql import functions as F

from helpers import SERIES, series_rows
from lagweave.operators.windows import lag_windows
from lagweave.plans import layout, queries
from lagweave.sources import buckets, clustered

SIZES = {**{f"s{k:02}": 60 for k in range(40)}, "hot": 2000}


def windows(spark, sizes=SIZES, length=12):
    return lag_windows(spark.createDataFrame(series_rows(sizes), SERIES), length=length)


def rows_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_one_site_opens_few_files(spark, tmp_path):
    path, rows = str(tmp_path / "windows"), windows(spark)
    assert clustered.write_clustered(rows, path, 12) == "absent"
    files = spark.read.parquet(path).inputFiles()
    assert len(files) >= 10
    small = clustered.read_clustered_site(spark, path, "s07")
    assert len(small.inputFiles()) <= 2 and rows_of(small) == rows_of(rows.where("site_id = 's07'"))
    hot = clustered.read_clustered_site(spark, path, "hot")  # of several files of equal size
    assert 3 <= len(hot.inputFiles()) < len(files) and rows_of(hot) == rows_of(rows.where("site_id = 'hot'"))
    sizes = [r["n_rows"] for r in clustered.file_index(spark, path).collect()]
    assert sum(sizes) == rows.count() and max(sizes) < 3 * sum(sizes) / len(sizes)


@pytest.mark.parametrize("site", ["a", "s07x", "zz"])
def test_an_unknown_site_is_an_error(spark, tmp_path, site):
    path = str(tmp_path / "windows")
    clustered.write_clustered(windows(spark), path, 4)
    with pytest.raises(FileNotFoundError):
        clustered.read_clustered_site(spark, path, site)


def test_empty_tables_and_rows_without_a_site(spark, tmp_path):
    empty = windows(spark).limit(0)
    clustered.write_clustered(empty, str(tmp_path / "empty"), 4)
    with pytest.raises(FileNotFoundError):
        clustered.read_clustered_site(spark, str(tmp_path / "empty"), "s01")
    rows = spark.createDataFrame([(None, 1), ("a", 1), ("a", 1), ("b", 1)], "site_id string, idx long")
    clustered.write_clustered(rows, str(tmp_path / "nulls"), 2)
    assert spark.read.parquet(str(tmp_path / "nulls")).count() == 4
    assert clustered.read_clustered_site(spark, str(tmp_path / "nulls"), "a").count() == 2


def test_the_index_follows_the_files(spark, tmp_path):
    source, path = str(tmp_path / "series"), str(tmp_path / "windows")
    windows(spark).write.parquet(source)

    def write(files):
        return clustered.write_clustered(spark.read.parquet(source), path, files)

    def named():
        return {r["file"] for r in clustered.file_index(spark, path).collect()}

    def there():
        return {f.rsplit("/", 1)[1] for f in spark.read.parquet(path).inputFiles()}

    assert write(6) == "absent" and named() == there()
    assert write(6) == "present" and named() == there()
    assert write(9) == "stale" and named() == there()
    windows(spark, {"s01": 90}).write.mode("overwrite").parquet(source)
    assert write(9) == "stale" and named() == there()
    assert clustered.read_clustered_site(spark, path, "s01").count() == 78


@pytest.mark.parametrize("name", sorted(layout.REGISTRY))
def test_no_pairwise_joins_and_no_python(spark, small, name):
    plan = layout.REGISTRY[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "Python" not in plan


@pytest.fixture
def no_broadcast(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_scoring_in_buckets_moves_nothing(spark, small, no_broadcast):
    tables = layout.bucketed(spark, small)
    scored = layout.score_bucketed(*tables)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 3 and "SelectedBucketsCount" in plan
    found = queries.rounded(scored.select("site_id", "location", "ts", "model_type", "y", "y_hat"))
    assert rows_of(found) == rows_of(queries.score_ar1(spark, small))


def test_a_hot_site_lies_in_several_buckets(spark, tmp_path, no_broadcast):
    rows = windows(spark)
    table = buckets.write_rows(rows, "hot_windows", str(tmp_path / "windows"), 8, 8)
    held = [r["count"] for r in table.where("site_id = 'hot'").groupBy(F.col("_metadata.file_path")).count().collect()]
    assert len(held) >= 3 and max(held) <= 0.6 * sum(held)
    totals = buckets.write_keyed(rows.groupBy("site_id").agg(F.count("*").alias("n")), "hot_totals", str(tmp_path / "totals"), 8, 8)
    joined = table.join(totals, list(buckets.KEYS))
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == rows.count() and joined.where("n <> n_windows").isEmpty()
    buckets.drop_tables(spark, "hot_windows", "hot_totals")
    assert not spark.catalog.tableExists("hot_windows")

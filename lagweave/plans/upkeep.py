"""Queries on tables that are kept: written again or not, rejected rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..operators import history, reshape
from ..operators.sequence import pack_chunks
from ..sources import days, store
from ..sources.manifest import list_files
from ..sources.events import read_table
from ..sources.shared import compiled, discard, fresh_path, stored
from . import queries as base
from .queries import rounded

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    REGISTRY[function.__name__] = compiled(function)
    return function


@query
def materialise_resumes(spark, folder):
    """What a second run finds and writes, after a first one that was lost, had other parameters, other inputs, or lost a file.

    (case, found, n_rows, last): the state that the second run finds, and the rows and largest window number that are there after it.
    """
    series, out = base.supplier_series(spark, folder), []
    source = fresh_path(spark, "resume")
    store.materialise(series, f"{source}/series")
    kept = spark.read.parquet(f"{source}/series")

    def packed(rows):
        return pack_chunks(rows, ("site_id",), ("ts", "location"), "flow", F.date_trunc("YEAR", "ts"))

    # A year of a site, a row per day and flag, is sorted once, as one row; every run computes its windows from these rows.
    years = stored(packed(kept), "packed")

    def write(case, length=12, rows=years, force=False):
        windows = base.win.packed_lag_windows(rows, length=length, made=(1,)).select("site_id", "location", "ts", "idx", "split", "lag_1", "y")
        return store.write_windows(windows, f"{source}/{case}", False, force, {"length": length}, [f"{source}/series"])

    def report(case, found):
        rows = store.read_windows(spark, f"{source}/{case}")
        seen = rows.agg(F.count("*").alias("n_rows"), F.max("idx").alias("last"))
        out.append(seen.select(F.lit(case).alias("case"), F.lit(found).alias("found"), "n_rows", "last"))

    report("absent", write("absent"))
    # A driver that was lost while it wrote: some rows, no manifest.
    some = base.win.packed_lag_windows(packed(kept.where("location = 'A'")), made=(1,))
    some.select("site_id", "location", "ts", "idx", "lag_1", "y", "split").write.partitionBy("split").parquet(f"{source}/broken")
    report("broken", write("broken"))
    write("stale", length=24)
    report("stale", write("stale"))
    write("damaged")
    discard(spark, list_files(spark, [f"{source}/damaged"]).orderBy("path").first()["path"])
    report("damaged", write("damaged"))
    write("present")
    report("present", write("present", rows=years.limit(0)))  # the same manifest: nothing is computed or written
    write("grown")
    later = kept.withColumns({"ts": F.col("ts") + F.expr("interval 10 years"), "flow": F.col("flow") + 1})
    later.write.mode("append").parquet(f"{source}/series")
    report("grown", write("grown", rows=packed(spark.read.parquet(f"{source}/series"))))
    first, *rest = out
    for part in rest:
        first = first.unionByName(part)
    return first


@query
def rejected_rows(spark, folder):
    """Every row of the dirty orders that cleaning drops or changes, with the reason."""
    return reshape.rejected_rows(reshape.tag_wide(base.dirty_orders(spark, folder)))


@query
def reject_counts(spark, folder):
    """Rejects by reason, counted by the pass that writes the series of the rows that stay; with the rows of that series."""
    seen = Observation()
    tagged = reshape.count_rejects(reshape.tag_wide(base.dirty_orders(spark, folder)), seen)
    path = fresh_path(spark, "series")
    store.materialise(reshape.wide_to_long(reshape.kept_wide(tagged)), path)
    written = spark.read.parquet(path).agg(F.lit("kept").alias("reason"), F.count("*").alias("n_rows"), F.lit(0).cast("bigint").alias("n_junk"))
    return reshape.reject_counts(spark, seen).unionByName(written)


def _grown(spark, folder):
    """The series of all sites, kept by days: three appends, one of which comes late and one again."""
    rows, path = base.series(spark, folder), fresh_path(spark, "days")
    day = F.dayofmonth("ts")
    days.append_days(rows.where(day <= 20), path)
    days.append_days(rows.where(day > 24), path)
    days.append_days(rows.where((day > 19) & (day <= 24)), path)  # the twentieth again, and four days late
    days.append_days(rows.limit(0), path)
    return path


@query
def windows_after_append(spark, folder):
    """The windows of a series that grew by days, scaled and split over all of them."""
    return rounded(base._window_columns(days.read_windows(spark, _grown(spark, folder))))


@query
def catalog_after_append(spark, folder):
    """The catalog of a series that grew by days."""
    return days.read_catalog(spark, _grown(spark, folder))


@query
def history_files(spark, folder):
    """Histories of every run written as one CSV file each, by region, and read back: best epoch and where training ends."""
    o, c, n, r = (read_table(spark, folder, t) for t in ("orders", "customer", "nation", "region"))
    placed = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    month = F.date_format("o_orderdate", "yyyy-MM").alias("month")
    model = F.substring("o_orderpriority", 1, 1).alias("model_type")
    measures = [F.round(F.avg("o_totalprice"), 2).alias("loss"), F.round(F.avg("c_acctbal"), 2).alias("mape"), F.min("o_totalprice").alias("val_loss"), F.max("c_acctbal").alias("val_mape")]
    runs = stored(placed.groupBy(F.col("r_name").alias("site_id"), model, month).agg(*measures), "runs")
    path = fresh_path(spark, "histories")
    kinds = runs.select("site_id", "model_type").distinct().collect()  # a file each: as many as runs
    for run in kinds:
        own = runs.where((F.col("site_id") == run["site_id"]) & (F.col("model_type") == run["model_type"])).orderBy("month")
        store.write_history_file(own, f"{path}/per_site/{run['site_id']}/{run['model_type']}_history.csv")
    rows = stored(store.read_history_files(spark, path), "history")
    stops = history.early_stop(rows).select("site_id", "model_type", "stop_epoch", "stopped")
    return history.best_epoch(rows).join(stops, ["site_id", "model_type"])

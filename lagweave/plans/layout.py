"""Queries on order and storage that spare an exchange: permuted order, files ranged by site, equal buckets."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import catalog, forecast, scale
from ..operators.permute import permuted, permuted_tail
from ..operators.lookup import lookup
from ..sources import buckets, clustered
from ..sources.shared import compiled, fresh_path, stored
from . import queries as base
from .queries import rounded

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    REGISTRY[function.__name__] = compiled(function)
    return function


@query
def permuted_train(spark, folder):
    """The train windows of every site in a random order that follows from site, position and seed alone."""
    return permuted(base.train_rows(spark, folder)).select("site_id", "idx", "shuffle_pos")


@query
def permuted_validation_tail(spark, folder):
    """The last tenth of the permuted train windows of every supplier."""
    rows = base.supplier_windows(spark, folder).where(F.col("split") == "train")
    return permuted_tail(rows).select("site_id", "idx", "shuffle_pos", "is_validation")


@query
def clustered_one_site(spark, folder):
    """One site out of pooled files that are ranged by site."""
    path = fresh_path(spark, "clustered")
    clustered.write_clustered(base.windows(spark, folder), path, files=16)
    return rounded(base._window_columns(clustered.read_clustered_site(spark, path, "1")))


@query
def clustered_sites(spark, folder):
    """The rows of the file index add up to the windows; all sites out of the same files."""
    path = fresh_path(spark, "clustered")
    clustered.write_clustered(base.supplier_windows(spark, folder), path, files=8)
    rows = spark.read.parquet(path).groupBy("site_id").agg(F.count(F.lit(1)).alias("n_windows"), F.max("idx").alias("last"))
    indexed = clustered.file_index(spark, path).agg(F.sum("n_rows")).scalar()
    return rows.withColumn("n_indexed", indexed)


def bucketed(spark, folder, n_buckets=8, salts=4):
    """Windows, scalers, coefficients and catalog in equal buckets: (windows, scalers, coefficients, catalog)."""
    rows = stored(base.windows(spark, folder), "windows")
    scalers = rows.groupBy("site_id").agg(F.first("x_min").alias("x_min"), F.first("x_max").alias("x_max"))
    coefs = forecast.fit_model("ar1", rows)
    sites = catalog.site_catalog(base.series(spark, folder)).select("site_id", F.col("location").alias("first_location"))

    def place(table, name, write):
        path = fresh_path(spark, name)
        return write(table, path.rsplit("/", 1)[1].replace("-", "_"), path, n_buckets, salts)

    return (
        place(rows.drop("x_min", "x_max"), "windows", buckets.write_rows),
        place(scalers, "scalers", buckets.write_keyed),
        place(coefs, "coefficients", buckets.write_keyed),
        place(sites, "sites", buckets.write_keyed),
    )


def score_bucketed(windows, scalers, coefs, sites):
    """Test windows scored, unscaled and with the location of their site, by three lookups."""
    test = windows.where(F.col("split") == "test")
    scored = forecast.score_ar(test, coefs, keys=buckets.KEYS)
    unscaled = scale.minmax_inverse(scored, scalers, buckets.KEYS, ("y", "y_hat"))
    return lookup(unscaled, sites, buckets.KEYS, "left")


@query
def score_bucketed_ar1(spark, folder):
    scored = score_bucketed(*bucketed(spark, folder))
    return rounded(scored.select("site_id", "location", "first_location", "ts", "model_type", "y", "y_hat"))

"""Catalogs and quality counts."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .windows import LENGTH, MARGIN


def distinct_sites(df: DataFrame, site: str = "site_id") -> DataFrame:
    return df.select(site).distinct()


def rows_per_site(df: DataFrame, site: str = "site_id") -> DataFrame:
    return df.groupBy(site).agg(F.count("*").alias("n_rows"))


def site_catalog(series: DataFrame, order: Sequence[str] = ("ts", "location")) -> DataFrame:
    """(site_id, location, days, data_points); the location is the first one in `order`.

    Grouped by site and day first: a day's rows are combined map-side and the second step sees one row per site and day,
    so no distinct set is built and no site is gathered whole.
    """
    daily = series.groupBy("site_id", F.to_date("ts").alias("day")).agg(
        F.min(F.struct(*order, F.col("location").alias("first_location"))).alias("first"),
        F.count("*").alias("points"),
    )
    return daily.groupBy("site_id").agg(
        F.min("first")["first_location"].alias("location"),
        F.count("day").alias("days"),
        F.sum("points").alias("data_points"),
    )


def split_sizes(windows: DataFrame, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """(keys, train_samples, test_samples)."""
    return windows.groupBy(*keys).agg(
        F.count_if(F.col("split") == "train").alias("train_samples"),
        F.count_if(F.col("split") == "test").alias("test_samples"),
    )


def quality_counts(series: DataFrame, keys: Sequence[str] = ("site_id",), value: str = "flow") -> DataFrame:
    """(keys, n_rows, n_missing) before zero filling."""
    x = F.col(value)
    return series.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.count_if(x.isNull() | F.isnan(x)).alias("n_missing")
    )


def site_status(series: DataFrame, keys: Sequence[str] = ("site_id",), length: int = LENGTH) -> DataFrame:
    """(keys, n_rows, status): 'ok', or 'too_short' for keys that give no windows."""
    counts = series.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    return counts.withColumn("status", F.when(F.col("n_rows") >= length + MARGIN, "ok").otherwise("too_short"))


def status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count("*").alias("n_sites"))

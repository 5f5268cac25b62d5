"""Pooled windows in files ranged by site, with an index of the files, for any number of sites.

A folder per site suits some thousands of sites. Here rows lie in (site, position) order in files of about equal size, so a file holds
many small sites or a part of a hot one. The index has one row per file: name, least and greatest site, rows. One site is read from the files whose
range has it: one or two for a small site, no listing of folders and no scan of the rest.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from .manifest import describe, files_read, state_of
from .shared import stored
from .store import materialise

INDEX = "_index"  # readers of the table pass over names with an underscore


def write_clustered(
    windows: DataFrame, path: str, files: int, force: bool = False, parameters: Mapping | None = None, inputs: Sequence[str] | None = None
) -> str:
    """Writes the windows in about `files` files and the index of these; returns what `materialise` does.

    Take the size of the table through some hundred MB as the number of files. The ranges are sampled. Rows without a site are kept, in the first file; they belong to no site.
    """
    known = {**(parameters or {}), "files": files}
    spark = windows.sparkSession
    inputs = files_read(windows) if inputs is None else inputs
    known_already = not force and state_of(spark, path, describe(windows, known, inputs)) == "present"
    # The sample for the ranges reads the rows a second time, so they are computed before, unless nothing is written.
    rows = windows if known_already else stored(windows, "windows")
    ranged = rows.repartitionByRange(files, "site_id", "idx").sortWithinPartitions("site_id", "idx")
    state = materialise(ranged, path, force, parameters=known, inputs=inputs)
    rows = spark.read.schema(windows.schema).parquet(path).select("site_id", F.col("_metadata.file_name").alias("file"))
    index = rows.groupBy("file").agg(F.min("site_id").alias("low"), F.max("site_id").alias("high"), F.count(F.lit(1)).alias("n_rows"))
    # Its manifest names the files of the table, so an index of other files is written anew.
    materialise(index.coalesce(1), f"{path}/{INDEX}", inputs=[path])
    return state


def file_index(spark: SparkSession, path: str) -> DataFrame:
    """(file, low, high, n_rows), one row per file."""
    return spark.read.parquet(f"{path}/{INDEX}")


def files_of(spark: SparkSession, path: str, site: str) -> list[str]:
    """The files that can hold rows of a site."""
    found = file_index(spark, path).where(F.lit(str(site)).between(F.col("low"), F.col("high")))
    return [f"{path}/{r['file']}" for r in found.select("file").collect()]  # names of the files of one site


def read_clustered_site(spark: SparkSession, path: str, site: str) -> DataFrame:
    """Windows of one site; only files whose range has it are opened. An unknown site is an error."""
    files = files_of(spark, path, site)
    rows = spark.read.parquet(*files).where(F.col("site_id") == str(site)) if files else None
    if rows is None or rows.isEmpty():
        raise FileNotFoundError(f"no processed data for site {site}")
    return rows

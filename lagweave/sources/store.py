"""Tables written and read between the steps."""

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F
from pyspark.sql.types import StringType

from ..functions.clean import canonical_id
from .manifest import describe, state_of, write_manifest
from .shared import open_writers

CATALOG_SCHEMA = "site_id string, location string, train_samples bigint, test_samples bigint"
#: Partition column of windows by site, and how many groups there are: one site costs the reading of that share of the table.
GROUP, GROUPS = "site_id_group", 256
HISTORY_SCHEMA = "loss double, mape double, val_loss double, val_mape double"


def materialise(
    df: DataFrame, path: str, force: bool = False, fmt: str = "parquet", by: Sequence[str] = (),
    parameters: Mapping | None = None, inputs: Sequence[str] | None = None,
) -> str:
    """Write unless the same table is there, or in any case with `force`; returns in what state the output was found.

    The same is a table whose manifest has the same inputs, parameters and columns and lists the files that are there (see
    `manifest`). Anything else is written anew: the rest of a lost run, a table of other parameters, one that has lost files. The manifest
    comes last. Parameters that change rows but not columns have to be named.
    """
    spark = df.sparkSession
    origin = describe(df, parameters, inputs)
    state = "forced" if force else state_of(spark, path, origin)
    if state == "present":
        return state
    counted = Observation()
    writer = df.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    # A folder is replaced whole, with its manifest, also where the session replaces single partitions.
    writer = writer.option("partitionOverwriteMode", "static")
    (writer.partitionBy(*by) if by else writer).save(path)
    write_manifest(spark, path, origin, counted.get["rows"])
    return state


def with_range_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int, path: str) -> DataFrame:
    """The rows with a `chunk` of about equal size each, cut along (keys, order) whatever their distribution.

    The cuts are sampled, so they are written to `path` with the rows and read back: every later use sees the same ones,
    also after a lost executor. Pass `chunk=F.col("chunk")` to the sequence operators.
    """
    ranged = df.repartitionByRange(parts, *keys, *order).withColumn("chunk", F.spark_partition_id())
    ranged.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _group(site: Column) -> Column:
    return F.pmod(F.xxhash64(site.cast("string")), F.lit(GROUPS)).cast("int")


def write_windows(
    windows: DataFrame, path: str, per_site: bool = True, force: bool = False, parameters: Mapping | None = None, inputs: Sequence[str] | None = None
) -> str:
    """The window table, in folders by split and, if `per_site`, by group of sites; returns what `materialise` does.

    A site's group is a digest of its id, so folders are bounded whatever the number of sites, and lie by site within: one site is read from its
    group's folders. Rows are dealt by (split, group) first: a folder then gets few files, and a hot one, whose share adaptive execution splits,
    several of about equal size. They are not ranged, as the sample for that would compute all windows a second time.
    """
    if not per_site:  # two folders
        with open_writers(windows.sparkSession, 2):
            return materialise(windows, path, force, by=["split"], parameters=parameters, inputs=inputs)
    by = ["split", GROUP]
    dealt = windows.withColumn(GROUP, _group(F.col("site_id"))).hint("rebalance", *by).sortWithinPartitions(*by, "site_id")
    return materialise(dealt, path, force, by=by, parameters=parameters, inputs=inputs)


def _stored_windows(spark: SparkSession, path: str) -> DataFrame:
    """With the group, where there is one. Site ids stay text, also where they are folder names that look like numbers."""
    schema = spark.read.parquet(path).schema
    schema["site_id"].dataType = StringType()
    return spark.read.schema(schema).parquet(path)


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """All windows, pooled."""
    return _stored_windows(spark, path).drop(GROUP)


def read_site(spark: SparkSession, path: str, site: str) -> DataFrame:
    """Windows of one site; only the folders of its group are read. An unknown site is an error."""
    rows = _stored_windows(spark, path).where(F.col("site_id") == str(site))
    if GROUP in rows.columns:
        rows = rows.where(F.col(GROUP) == _group(F.lit(str(site)))).drop(GROUP)
    if rows.isEmpty():
        raise FileNotFoundError(f"no processed data for site {site}")
    return rows


def stored_sites(spark: SparkSession, windows_path: str, catalog_path: str | None = None) -> DataFrame:
    """Sites from the catalog if there is one, else from the window table."""
    if catalog_path:
        try:
            return read_catalog(spark, catalog_path).select("site_id")
        except AnalysisException:
            pass
    return read_windows(spark, windows_path).select("site_id").distinct()


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The per-site catalog CSV, ids as text."""
    rows = spark.read.schema(CATALOG_SCHEMA).csv(path, header=True)
    return rows.withColumn("site_id", canonical_id(F.col("site_id")))


def write_history(history: DataFrame, path: str, force: bool = False) -> None:
    materialise(history, path, force)


def write_history_file(run: DataFrame, path: str) -> None:
    """One run, ordered by epoch, as the CSV that `read_history_files` reads; a run is as short as it has epochs."""
    run.select(*[c.split()[0] for c in HISTORY_SCHEMA.split(", ")]).coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_history_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Per-epoch CSV files named per_site/<site>/<model>_history.csv, or <model>_history.csv for pooled runs; or folders of these names with a file each.

    The epoch is the line number. A file is one run, so it is as short as a run has epochs.
    """
    rows = spark.read.schema(HISTORY_SCHEMA).csv(paths, header=True, recursiveFileLookup=True)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # it is a URI: names may have blanks
    named = rows.select(
        F.nullif(F.regexp_extract(path, r"per_site/([^/]+)/[^/]+_history\.csv", 1), F.lit("")).alias("site_id"),
        F.regexp_extract(path, r"([^/]+)_history\.csv(?:/[^/]+)?$", 1).alias("model_type"),
        F.monotonically_increasing_id().alias("_line"),
        *rows.columns,
    )
    line = Window.partitionBy("site_id", "model_type").orderBy("_line")
    return named.withColumn("epoch", F.row_number().over(line)).drop("_line")


def write_coefficients(coefs: DataFrame, path: str, force: bool = True) -> None:
    """Per-key models are rows of one table; per-site rows have scope 'site', pooled ones 'pooled'."""
    materialise(coefs, path, force)


def save_model(model, folder: str, model_type: str, all_sites: bool = False) -> str:
    """Save a pooled MLlib model under its name; the all-sites variant does not replace the pooled one."""
    path = f"{folder}/{model_type}_{'all_sites' if all_sites else 'pooled'}"
    model.write().overwrite().save(path)
    return path


def load_models(spark: SparkSession, folder: str, readers: dict) -> dict:
    """Pooled models by type, given {model_type: model class}. The pooled name is tried before the all-sites name.

    Types that are not stored are left out.
    """
    models = {}
    for model_type, reader in readers.items():
        for suffix in ("pooled", "all_sites"):
            path = f"{folder}/{model_type}_{suffix}"
            if _exists(spark, f"{path}/metadata"):
                models[model_type] = reader.load(path)
                break
    return models


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path).schema
        return True
    except AnalysisException:
        return False

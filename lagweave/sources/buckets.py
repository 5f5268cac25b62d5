"""Windows and per-site tables stored in equal buckets, so that lookups by site do not move the windows.

Buckets by site alone would put a hot site into one bucket, which one task reads. So the key of a bucket is the site and a salt: windows of a site are dealt to
`salts` parts by position, and tables with one row per site have one for each salt. Where these are too large to be broadcast, scoring and unscaling then join
bucket by bucket, without an exchange of either side.

Tables are registered in the session's catalog under the given name, as the number of buckets is part of a table's description there, and lie
at the given path.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

SALT = "salt"
KEYS = ("site_id", SALT)


def _write(rows: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    # Rows are dealt to tasks as to buckets, so a bucket is one file, sorted.
    dealt = rows.repartition(buckets, *KEYS)
    dealt.write.mode("overwrite").bucketBy(buckets, *KEYS).sortBy(*KEYS).option("path", path).saveAsTable(name)
    return rows.sparkSession.table(name)


def write_rows(windows: DataFrame, name: str, path: str, buckets: int, salts: int) -> DataFrame:
    """Tables with many rows per site, numbered by `idx`; each site goes to `salts` parts. Returns the table, which has a column `salt` more."""
    return _write(windows.withColumn(SALT, F.pmod(F.coalesce(F.col("idx"), F.lit(0)), F.lit(salts)).cast("int")), name, path, buckets)


def write_keyed(table: DataFrame, name: str, path: str, buckets: int, salts: int) -> DataFrame:
    """Tables with one row, or a few, per site, such as scalers, coefficients and the catalog: each row once for every salt."""
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias(SALT)
    return _write(table.select("*", copies), name, path, buckets)


def drop_tables(spark: SparkSession, *names: str) -> None:
    """Takes the names out of the catalog; the files stay."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")

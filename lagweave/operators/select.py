"""Choosing sites and model types."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.fixed_values import LISTING_COLUMNS, REGION_SITES
from .catalog import rows_per_site
from .lookup import lookup


def allowlist(spark: SparkSession, sites: Sequence[str] = REGION_SITES) -> DataFrame:
    """(site_id, ord) from a list of ids in order."""
    return spark.createDataFrame([(s, i) for i, s in enumerate(sites)], "site_id string, ord int")


def allowed_sites(allow: DataFrame, available: DataFrame) -> DataFrame:
    """Allowlisted ids that have data, in allowlist order; all available ids if none is.

    (site_id, ord); `ord` is NULL in the fallback, where sites go by id. The emptiness test is a subquery of the same
    plan, so nothing runs on the driver.
    """
    hits = allow.join(available, "site_id", "left_semi")
    n_hits = hits.agg(F.count("*")).scalar()
    joined = available.join(allow, "site_id", "left")
    return joined.where(F.col("ord").isNotNull() | (n_hits == 0)).select("site_id", "ord")


def with_location(df: DataFrame, sites: DataFrame, unknown: str = "Unknown") -> DataFrame:
    """Adds `location` from a site catalog; `unknown` where the site is absent. The catalog has one row per site."""
    located = lookup(df, sites.select("site_id", "location"), ["site_id"], "left")
    return located.withColumn("location", F.coalesce("location", F.lit(unknown)))


def keep_sites(df: DataFrame, sites: DataFrame) -> DataFrame:
    """Rows of the given sites."""
    return lookup(df, sites.select("site_id").distinct(), ["site_id"], "left_semi")


def rename_by_position(df: DataFrame, names: Sequence[str] = LISTING_COLUMNS) -> DataFrame:
    """Rename columns by position, adding NULL columns where there are too few."""
    missing = [F.lit(None).cast("string").alias(name) for name in names[len(df.columns) :]]
    renamed = [F.col(f"`{old}`").cast("string").alias(new) for old, new in zip(df.columns, names)]
    return df.select(*renamed, *missing)


def listed_sites(listing: DataFrame) -> DataFrame:
    """Rows of a site listing that have a site number."""
    return listing.where(F.col("Site_Number").isNotNull())


def top_sites(df: DataFrame, k: int = 5, site: str = "site_id") -> DataFrame:
    """The k sites with most rows, ties by id."""
    return rows_per_site(df, site).orderBy(F.desc("n_rows"), site).limit(k)


def site_exists(df: DataFrame, site: str) -> DataFrame:
    """One row (site_id, exists)."""
    found = df.where(F.col("site_id") == site).limit(1).agg((F.count("*") > 0).alias("exists"))
    return found.select(F.lit(site).alias("site_id"), "exists")


def first_sites(sites: DataFrame, n: int, order: Sequence[str] = ("ord", "site_id")) -> DataFrame:
    """The first n sites in catalog order."""
    return sites.orderBy(*order).limit(n)


def model_type_in(requested: str, column: Column, known: Sequence[str]) -> Column:
    """Predicate for 'all' or a comma list of model types; case and blanks do not matter, unknown names match nothing."""
    wanted = [x.strip().lower() for x in requested.split(",")]
    if wanted == ["all"]:
        wanted = list(known)
    return F.lower(F.trim(column)).isin([x for x in wanted if x in known])

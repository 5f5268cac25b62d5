"""Wide CSV to long series, catalogs, scalers and windows, each written once and read back."""

from pyspark.sql import DataFrame, Observation, SparkSession

from ..functions.fixed_values import REGION_SITES
from ..operators.catalog import distinct_sites, site_catalog, split_sizes
from ..operators.reshape import count_rejects, kept_wide, reject_counts, tag_wide, wide_to_long
from ..operators.scale import minmax_fit
from ..operators.select import allowed_sites, allowlist, keep_sites, with_location
from ..operators.windows import LENGTH, lag_windows
from ..sources.csv_files import read_wide_days
from ..sources.store import materialise, read_windows, write_windows


def preprocess(
    spark: SparkSession,
    wide_csv: str,
    out: str,
    region: bool = True,
    sites: list[str] | None = None,
    length: int = LENGTH,
    force: bool = False,
    per_site: bool = True,
) -> dict[str, DataFrame]:
    """Writes `series`, `rejects`, `sites_info`, `windows`, `scaler_params` and `site_info` below `out`; returns them read back.

    `region=False` takes all sites, as when there is no site listing. `sites` replaces the default region allowlist. A table
    that is complete and was made from the same inputs with the same parameters is used again; `force` writes all anew.
    """
    series_path, windows_path = f"{out}/series", f"{out}/windows"
    rejects = Observation()
    tagged = count_rejects(tag_wide(read_wide_days(spark, wide_csv)), rejects)
    if materialise(wide_to_long(kept_wide(tagged)), series_path, force) != "present":  # counted by that very pass
        materialise(reject_counts(spark, rejects), f"{out}/rejects", True)
    series = spark.read.parquet(series_path)
    info = site_catalog(series)
    materialise(info, f"{out}/sites_info", force)

    chosen, allowed = series, None
    if region:
        allowed = list(sites or REGION_SITES)
        chosen = keep_sites(series, allowed_sites(allowlist(spark, allowed), distinct_sites(series)))
    by = {"length": length, "sites": allowed, "per_site": per_site}
    write_windows(lag_windows(chosen, length=length), windows_path, per_site, force, by, inputs=[series_path])
    windows = read_windows(spark, windows_path)
    materialise(minmax_fit(chosen, ["site_id"]), f"{out}/scaler_params", force, parameters={"sites": allowed}, inputs=[series_path])
    sizes = with_location(split_sizes(windows), spark.read.parquet(f"{out}/sites_info"))
    sizes = sizes.select("site_id", "location", "train_samples", "test_samples")
    materialise(sizes, f"{out}/site_info", force, "csv", inputs=[windows_path, f"{out}/sites_info"])
    return {
        "series": series,
        "rejects": spark.read.parquet(f"{out}/rejects"),
        "sites_info": spark.read.parquet(f"{out}/sites_info"),
        "windows": windows,
        "scaler_params": spark.read.parquet(f"{out}/scaler_params"),
    }

"""Mean flow by calendar part."""

from pyspark.sql import DataFrame, functions as F

from ..functions.calendar import calendar_part


def flow_profile(series: DataFrame, by: str, site: str = "site_id", ts: str = "ts", value: str = "flow") -> DataFrame:
    """(site, by, avg_flow) with `by` one of hour, day, weekday."""
    return series.groupBy(site, calendar_part(F.col(ts), by).alias(by)).agg(F.avg(value).alias("avg_flow"))

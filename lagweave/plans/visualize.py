"""Tables behind the pattern charts."""

from pyspark.sql import DataFrame, functions as F

from ..operators.profile import flow_profile
from ..operators.select import top_sites


def top_site_profiles(series: DataFrame, by: str = "hour", k: int = 5) -> DataFrame:
    """Profile of the k sites with most rows. The k ids are broadcast: their number is the parameter."""
    top = F.broadcast(top_sites(series, k).select("site_id"))
    return flow_profile(series.join(top, "site_id", "left_semi"), by)

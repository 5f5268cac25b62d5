"""Adapter from event tables to the wide-day layout."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.calendar import slot_columns
from ..functions.fixed_values import SLOT_MINUTES, SLOTS_PER_DAY


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events_to_wide(events: DataFrame, users_per_site: int = 10) -> DataFrame:
    """(site_id, location, day, V00..V95): whole event values summed per slot, NULL where a slot has no event.

    Ten neighbouring users form a site, so the number of sites grows with the table; the event type is the approach.
    """
    slot = F.hour("ts") * F.lit(60 // SLOT_MINUTES) + F.floor(F.minute("ts") / F.lit(SLOT_MINUTES))
    cells = events.select(
        F.expr(f"cast(user_id div {int(users_per_site)} as string)").alias("site_id"),
        F.col("event_type").alias("location"),
        F.to_date("ts").alias("day"),
        slot.cast("int").alias("slot"),
        F.floor("value").cast("double").alias("value"),
    )
    wide = cells.groupBy("site_id", "location", "day").pivot("slot", list(range(SLOTS_PER_DAY))).agg(F.sum("value"))
    return wide.toDF("site_id", "location", "day", *slot_columns())

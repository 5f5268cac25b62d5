"""Slots of the day and calendar parts."""

from pyspark.sql import Column, functions as F

from .fixed_values import SLOT_MINUTES, SLOTS_PER_DAY, WEEKDAY_LABELS


def slot_columns(n: int = SLOTS_PER_DAY) -> list[str]:
    return [f"V{i:02d}" for i in range(n)]


def slot_timestamp(day: Column, slot: Column, minutes: int = SLOT_MINUTES) -> Column:
    """Start of a slot as a zone-free timestamp."""
    return F.timestamp_add("MINUTE", slot * F.lit(minutes), day.cast("timestamp_ntz"))


def calendar_part(ts: Column, by: str) -> Column:
    """Hour 0-23, day of month 1-31 or weekday 0-6 with Monday 0."""
    parts = {"hour": F.hour, "day": F.dayofmonth, "weekday": F.weekday}
    if by not in parts:
        raise ValueError(f"unsupported grouping: {by}")
    return parts[by](ts)


def weekday_label(weekday: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in WEEKDAY_LABELS]), weekday + 1)

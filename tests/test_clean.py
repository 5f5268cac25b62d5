import datetime as dt

import pytest
from pyspark.sql import functions as F

from lagweave.functions.calendar import calendar_part, slot_columns, slot_timestamp, weekday_label
from lagweave.functions.clean import canonical_id, parse_day, parse_number, zero_fill
from lagweave.operators.reshape import clean_wide, time_grid, wide_to_long


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_ids_have_one_form(spark):
    texts = ["0970", "970", "970.0", " 970 ", "000", "0", "", None, "NaN", "A07"]
    assert column(spark, texts, canonical_id) == ["970"] * 4 + ["0", "0", None, None, None, "A07"]
    assert column(spark, [970], canonical_id, "int") == ["970"]


def test_dates_take_padded_and_plain_forms_only(spark):
    texts = ["10/1/2006", "01/02/2006", "13/40/2006", "2006-10-01", "10/1/06", None, "junk"]
    assert column(spark, texts, parse_day) == [dt.date(2006, 10, 1), dt.date(2006, 1, 2), None, None, None, None, None]


def test_numbers(spark):
    texts = [" 12 ", "1e2", "12d", "abc", "", "inf", "-3.5", ".5", None]
    assert column(spark, texts, parse_number) == [12.0, 100.0, None, None, None, None, -3.5, 0.5, None]
    assert column(spark, texts, lambda c: zero_fill(parse_number(c))) == [12.0, 100.0, 0.0, 0.0, 0.0, 0.0, -3.5, 0.5, 0.0]
    assert column(spark, [float("nan"), 2.0, None], zero_fill, "double") == [0.0, 2.0, 0.0]


def test_slots_and_weekdays(spark):
    days = [dt.date(2006, 10, 2), dt.date(2006, 10, 1)]
    assert column(spark, days, lambda c: calendar_part(c, "weekday"), "date") == [0, 6]
    assert column(spark, days, lambda c: weekday_label(calendar_part(c, "weekday")), "date") == ["Mon", "Sun"]
    assert column(spark, days, lambda c: slot_timestamp(c, F.lit(95)), "date") == [
        dt.datetime(2006, 10, 2, 23, 45),
        dt.datetime(2006, 10, 1, 23, 45),
    ]
    with pytest.raises(ValueError):
        calendar_part(F.col("x"), "year")


def test_wide_to_long_keeps_every_slot_and_tolerates_missing_ones(spark):
    rows = [("0970", "x", "10/1/2006", "1", "2", "bad"), ("970.0", "x", "10/2/2006", "4", None, "inf"), (None, "x", "10/1/2006", "1", "1", "1"), ("5", None, "13/1/2006", "1", "1", "1")]
    raw = spark.createDataFrame(rows, "`SCATS Number` string, Location string, Date string, V00 string, V03 string, V95 string")
    got = sorted(tuple(r) for r in wide_to_long(clean_wide(raw)).collect())
    day1, day2 = dt.datetime(2006, 10, 1), dt.datetime(2006, 10, 2)
    last = dt.timedelta(hours=23, minutes=45)
    third = dt.timedelta(minutes=45)
    assert got == [
        ("970", "x", day1, 1.0),
        ("970", "x", day1 + third, 2.0),
        ("970", "x", day1 + last, 0.0),
        ("970", "x", day2, 4.0),
        ("970", "x", day2 + third, 0.0),
        ("970", "x", day2 + last, 0.0),
    ]


def test_full_day_has_96_slots(spark):
    wide = spark.range(1).select(
        F.lit("1").alias("site_id"),
        F.lit("a").alias("location"),
        F.lit(dt.date(2006, 10, 1)).alias("day"),
        *[F.lit(float(i)).alias(c) for i, c in enumerate(slot_columns())],
    )
    rows = wide_to_long(wide).orderBy("ts").collect()
    assert [r["flow"] for r in rows] == [float(i) for i in range(96)]
    assert [r["ts"] for r in rows] == [dt.datetime(2006, 10, 1) + dt.timedelta(minutes=15 * i) for i in range(96)]


def test_time_grid(spark):
    bounds = spark.createDataFrame([("a", dt.datetime(2006, 10, 1), dt.datetime(2006, 10, 1, 1))], "k string, lo timestamp_ntz, hi timestamp_ntz")
    rows = time_grid(bounds, "lo", "hi").orderBy("ts").collect()
    assert [(r["k"], r["ts"].minute, r["ts"].hour) for r in rows] == [("a", 0, 0), ("a", 15, 0), ("a", 30, 0), ("a", 45, 0), ("a", 0, 1)]

import os
import random
import shutil

import pytest
from helpers import SERIES, series_rows
from lagweave.operators.catalog import site_catalog
from lagweave.operators.windows import lag_names, lag_windows
from lagweave.sources import days


@pytest.fixture(scope="module")
def rows():
    got = series_rows({"970": 700, "2000": 330, "31": 60, "short": 15}, seed=5, minutes=60)
    return got + [("late", "x", t, float(k)) for k, (_, _, t, _) in enumerate(sorted(got, key=lambda r: r[2])[-30:])]


COLUMNS = ["site_id", "location", "ts", "chunk", "idx", "n_windows", "n_train", "split", "x_min", "x_max", *lag_names(), "y"]


def table(df):
    return sorted(map(str, df.select(COLUMNS).collect()))


def of_days(spark, rows, wanted):
    return spark.createDataFrame([r for r in rows if r[2].toordinal() in wanted], SERIES)


@pytest.mark.parametrize("seed", range(2))
def test_appends_in_any_order_equal_one_pass(spark, rows, tmp_path, seed):
    rng, path = random.Random(seed), str(tmp_path / "d")
    every = sorted({r[2].toordinal() for r in rows})
    parts = [every[k::3] for k in range(3)] if seed else [every[: len(every) // 2], every[len(every) // 2 :], every[3:5]]
    rng.shuffle(parts)
    for part in parts:
        days.append_days(of_days(spark, rows, set(part)), path)
    whole = spark.createDataFrame(rows, SERIES)
    assert table(days.read_windows(spark, path)) == table(lag_windows(whole))
    key = lambda df: sorted(map(str, df.select("site_id", "location", "days", "data_points").collect()))
    assert key(days.read_catalog(spark, path)) == key(site_catalog(whole))


def test_a_new_day_does_not_read_the_history(spark, rows, tmp_path):
    path = str(tmp_path / "d")
    every = sorted({r[2].toordinal() for r in rows})
    days.append_days(of_days(spark, rows, set(every[:-2])), path)
    shutil.copytree(f"{path}/windows", tmp_path / "copy")
    emptied = []
    for name in ("series", "windows"):  # no file of the days before can be read now
        for folder in os.listdir(f"{path}/{name}"):
            emptied += [f"{path}/{name}/{folder}/{f}" for f in os.listdir(f"{path}/{name}/{folder}")] if folder.startswith("chunk=") else []
    for file in emptied:
        os.truncate(file, 0)
    days.append_days(of_days(spark, rows, set(every[-2:])), path)
    for file in emptied:
        if "/windows/" in file:
            assert os.path.getsize(file) == 0  # nor was it written
            shutil.copy(str(tmp_path / "copy") + file.split("/windows", 1)[1], file)
    assert table(days.read_windows(spark, path)) == table(lag_windows(spark.createDataFrame(rows, SERIES)))


def test_a_lost_append_cannot_be_read_and_is_done_again(spark, rows, tmp_path):
    path = str(tmp_path / "d")
    every = sorted({r[2].toordinal() for r in rows})
    days.append_days(of_days(spark, rows, set(every[:-1])), path)
    lost = sorted(os.listdir(f"{path}/presence"))[-3]
    for name in ("presence", "windows"):  # as after a driver that went away between two tables
        shutil.rmtree(f"{path}/{name}/{lost}")
    with pytest.raises(ValueError, match="lost"):
        days.read_windows(spark, path)
    days.append_days(of_days(spark, rows, {every[-1]}), path)
    assert table(days.read_windows(spark, path)) == table(lag_windows(spark.createDataFrame(rows, SERIES)))


def test_corrected_days_replace_the_old_ones(spark, rows, tmp_path):
    path = str(tmp_path / "d")
    every = sorted({r[2].toordinal() for r in rows})
    wrong = [(s, place, t, x + 1000 if t.toordinal() == every[4] else x) for s, place, t, x in rows]
    days.append_days(spark.createDataFrame(wrong, SERIES), path)
    days.append_days(of_days(spark, rows, {every[4]}), path)
    days.append_days(spark.createDataFrame([], SERIES), path)
    days.append_days(spark.createDataFrame([(None, "a", None, 1.0)], SERIES), path)
    assert table(days.read_windows(spark, path)) == table(lag_windows(spark.createDataFrame(rows, SERIES)))

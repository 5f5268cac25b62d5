import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import SERIES, series_rows
from lagweave.functions.fixed_values import TWO_FILE_ATTRIBUTE
from lagweave.operators.reshape import clean_wide, wide_to_long
from lagweave.operators.windows import lag_names, lag_windows, lag_windows_per_file
from lagweave.plans.preprocess import preprocess
from lagweave.sources import csv_files, store
from lagweave.sources.shared import fresh_path


def write_wide(path, rows, slots=("V00", "V01")):
    path.write_text("﻿Counts per interval,,,,\nSCATS Number,Location,Date,Extra," + ",".join(slots) + "\n" + "\n".join(rows) + "\n")


def test_wide_csv_drops_leading_lines_of_every_file(spark, tmp_path):
    write_wide(tmp_path / "a.csv", ['0970,"X ST, N of Y",10/1/2006,e,1,2', ",Z,10/1/2006,e,1,2"])
    write_wide(tmp_path / "b.csv", ["2000,W,10/2/2006,e,3,", "2000,W,bad,e,3,4"])
    raw = csv_files.read_wide_days(spark, str(tmp_path))
    assert raw.columns == ["SCATS Number", "Location", "Date", "Extra", "V00", "V01"]
    assert raw.count() == 4
    long = sorted(tuple(r) for r in wide_to_long(clean_wide(raw)).collect())
    first, second = dt.datetime(2006, 10, 1), dt.datetime(2006, 10, 2)
    step = dt.timedelta(minutes=15)
    assert long == [
        ("2000", "W", second, 3.0),
        ("2000", "W", second + step, 0.0),
        ("970", "X ST, N of Y", first, 1.0),
        ("970", "X ST, N of Y", first + step, 2.0),
    ]


def test_site_listing(spark, tmp_path):
    path = tmp_path / "listing.csv"
    lead = [f"note {i}" for i in range(9)] + ["Site,Description,Type"]
    path.write_text("\n".join(lead + ["2000,A,INT", ",B,INT", '970,"C, D",POS']) + "\n")
    rows = csv_files.read_site_listing(spark, str(path)).orderBy("Site_Number").collect()
    assert [(r["Site_Number"], r["Location_Description"], r["Site_Type"], r["Unknown4"]) for r in rows] == [
        ("2000", "A", "INT", None),
        ("970", "C, D", "POS", None),
    ]


def test_site_listing_counts_physical_lines(spark, tmp_path):
    lead = ["a", "", "b", "", "", "c", "d", "e", "2000,A,INT", "Site,Description,Type"]  # a line may equal a row
    for name, sites in (("x.txt", ["2000,A,INT", "2001,B,INT"]), ("y.txt", ["2002,C,INT", "2003,D,INT"])):
        (tmp_path / name).write_text("\n".join(lead + sites) + "\n")
    rows = csv_files.read_site_listing(spark, str(tmp_path)).collect()
    assert sorted(r["Site_Number"] for r in rows) == ["2000", "2001", "2002", "2003"]


def test_two_files_may_be_folders(spark, tmp_path):
    values = {"train": [(i * 7) % 13 for i in range(300)], "test": [(i * 5) % 17 for i in range(200)]}
    for name, cells in values.items():
        (tmp_path / name).mkdir()
        for part in range(4):
            own = cells[part * len(cells) // 4 : (part + 1) * len(cells) // 4]
            (tmp_path / name / f"part-{part}.csv").write_text(f"5 Minutes,{TWO_FILE_ATTRIBUTE}\n" + "".join(f"t,{c}\n" for c in own))
    series = csv_files.read_two_files(spark, str(tmp_path / "train"), str(tmp_path / "test"))
    windows = lag_windows_per_file(series, F.col("file_block"), order=("file_block", "file_order"), scale=False).collect()
    for name, cells in values.items():
        own = sorted((r for r in windows if r["split"] == name), key=lambda r: r["idx"])
        assert [[*[r[c] for c in lag_names()], r["y"]] for r in own] == [cells[i : i + 13] for i in range(len(cells) - 12)]


def test_two_files_keep_row_order_across_splits(spark, tmp_path):
    values = {"train": [str((i * 7) % 13) for i in range(3000)], "test": [str((i * 5) % 17) for i in range(2000)]}
    values["train"][5] = ""
    for name, cells in values.items():
        (tmp_path / f"{name}.csv").write_text(f"5 Minutes,{TWO_FILE_ATTRIBUTE}\n" + "".join(f"t{i},{c}\n" for i, c in enumerate(cells)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        series = csv_files.read_two_files(spark, str(tmp_path / "train.csv"), str(tmp_path / "test.csv"))
        assert series.select("file_block").distinct().count() > 4
        windows = lag_windows_per_file(series, F.col("file_block"), order=("file_block", "file_order"), scale=False).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, cells in values.items():
        numbers = [float(c or 0) for c in cells]
        own = sorted((r for r in windows if r["split"] == name), key=lambda r: r["idx"])
        assert [[*[r[c] for c in lag_names()], r["y"]] for r in own] == [numbers[i : i + 13] for i in range(len(numbers) - 12)]


@pytest.fixture(scope="module")
def windows(spark):
    rows = [(s, loc, t, x) for s, loc, t, x in series_rows({"970": 200, "2000": 60, "1e3": 40})]
    return lag_windows(spark.createDataFrame(rows, SERIES)).drop("chunk")


@pytest.mark.parametrize("per_site", [True, False])
def test_windows_round_trip(spark, windows, tmp_path, per_site):
    path = str(tmp_path / "w")
    store.write_windows(windows, path, per_site)
    back = store.read_windows(spark, path).select(windows.columns)
    assert back.exceptAll(windows).isEmpty() and windows.exceptAll(back).isEmpty()
    assert dict(back.dtypes)["site_id"] == "string"


def test_one_site_reads_its_folders_only(spark, windows, tmp_path):
    path = str(tmp_path / "w")
    store.write_windows(windows, path)
    one = store.read_site(spark, path, "970")
    assert one.count() == 188 and {r["site_id"] for r in one.select("site_id").distinct().collect()} == {"970"}
    assert all("site_id=970" in f for f in one.inputFiles()) or "PartitionFilters: [isnotnull(site_id" in one._jdf.queryExecution().toString()
    with pytest.raises(FileNotFoundError):
        store.read_site(spark, path, "1")
    assert {r["site_id"] for r in store.stored_sites(spark, path).collect()} == {"970", "2000", "1e3"}


def test_folders_do_not_grow_with_sites(spark, tmp_path):
    path, sites = str(tmp_path / "w"), 3 * store.GROUPS
    rows = spark.range(sites).select(F.col("id").cast("string").alias("site_id"), F.lit("train").alias("split"), F.col("id").alias("idx"))
    rows = rows.union(spark.createDataFrame([(None, "test", -1)], "site_id string, split string, idx bigint"))
    store.write_windows(rows, path)
    assert len(list((tmp_path / "w").glob("split=train/*"))) <= store.GROUPS
    assert sorted(r["idx"] for r in store.read_windows(spark, path).collect()) == list(range(-1, sites))
    one = store.read_site(spark, path, "77")
    assert [tuple(r[c] for c in rows.columns) for r in one.collect()] == [("77", "train", 77)]
    assert "site_id_group" in one._jdf.queryExecution().toString().split("PartitionFilters: ")[1].split("]")[0]


def test_one_site_of_a_table_in_folders_by_site(spark, windows, tmp_path):
    path = str(tmp_path / "w")
    windows.write.partitionBy("split", "site_id").parquet(path)
    assert store.read_site(spark, path, "970").count() == 188


def test_materialise_keeps_what_is_there(spark, tmp_path):
    path = str(tmp_path / "t")
    store.materialise(spark.range(3), path)
    store.materialise(spark.range(5), path)
    assert spark.read.parquet(path).count() == 3
    store.materialise(spark.range(5), path, force=True)
    assert spark.read.parquet(path).count() == 5


def test_history_files(spark, tmp_path):
    for site, losses in (("2000", [3.0, 2.0]), ("970", [1.0])):
        folder = tmp_path / "per_site" / site
        folder.mkdir(parents=True)
        (folder / "gru_history.csv").write_text("loss,mape,val_loss,val_mape\n" + "".join(f"0.5,1,{x},2\n" for x in losses))
    (tmp_path / "lstm_history.csv").write_text("loss,mape,val_loss,val_mape\n0.5,1,7,2\n")
    rows = store.read_history_files(spark, str(tmp_path)).collect()
    got = sorted((r["site_id"] or "", r["model_type"], r["epoch"], r["val_loss"]) for r in rows)
    assert got == [("", "lstm", 1, 7.0), ("2000", "gru", 1, 3.0), ("2000", "gru", 2, 2.0), ("970", "gru", 1, 1.0)]


def test_shared_folder_is_the_one_the_session_names(spark):
    assert fresh_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_preprocess_end_to_end(spark, tmp_path):
    slots = [f"V{i:02d}" for i in range(96)]
    rows = []
    for site, lanes in (("0970", 2), ("2000", 1), ("9999", 1)):
        for lane in range(lanes):
            for day in range(1, 4):
                cells = ",".join(str((i * (lane + 2) + day) % 37) for i in range(96))
                rows.append(f"{site},{site} lane {lane},10/{day}/2006,e,{cells}")
    write_wide(tmp_path / "wide.csv", rows, slots)
    out = str(tmp_path / "out")
    tables = preprocess(spark, str(tmp_path / "wide.csv"), out, sites=["970", "2000", "1234"])
    info = {r["site_id"]: tuple(r)[1:] for r in tables["sites_info"].collect()}
    assert info == {"970": ("0970 lane 0", 3, 576), "2000": ("2000 lane 0", 3, 288), "9999": ("9999 lane 0", 3, 288)}
    sizes = {r["site_id"]: tuple(r)[1:] for r in store.read_catalog(spark, f"{out}/site_info").collect()}
    assert sizes == {"970": ("0970 lane 0", 394, 170), "2000": ("2000 lane 0", 193, 83)}
    assert {r["site_id"] for r in tables["scaler_params"].collect()} == {"970", "2000"}
    assert tables["windows"].count() == 394 + 170 + 193 + 83

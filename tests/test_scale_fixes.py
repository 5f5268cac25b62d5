"""Changes for larger tables: same results, less work."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from lagweave.functions.rounding import round6
from lagweave.operators import boost, forecast, reshape, windows as win
from lagweave.plans import queries, upkeep
from lagweave.sources import clustered, store


def _windows(spark, sites=3, n=60):
    rng = random.Random(5)
    rows = [(str(s), k, "train", *[rng.random() for _ in range(13)]) for s in range(sites) for k in range(1, n + 1)]
    return spark.createDataFrame(rows, ["site_id", "idx", "split", *win.lag_names(), "y"])


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_round6_is_round(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, 1e-7, -1e-7, 5e-7, -5e-7, 0.1234565, 2.5e-6, -0.4999995, 1e9, 8589.9345915, 1e300, math.inf, -math.inf, math.nan, None]
    values += [rng.uniform(-2, 2) for _ in range(2000)] + [rng.uniform(-1e5, 1e5) for _ in range(1000)]
    values += [(2 * rng.randrange(10**7) + 1) / 2e6 for _ in range(1000)]  # ties
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(F.round("x", 6).alias("a"), round6(F.col("x")).alias("b"))
    assert not [r for r in rows.collect() if repr(r["a"]) != repr(r["b"])]


def test_queries_leave_no_method_to_the_interpreter(spark, tmp_path):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    spark.createDataFrame([(k, k % 3) for k in range(10)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    queries.REGISTRY["site_status"](spark, str(tmp_path)).collect()
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


@pytest.mark.parametrize("bins", [4, 16, 32])
def test_packed_bins_say_what_the_lags_say(spark, bins):
    names = win.lag_names()
    values = [-0.5, 0.0, 1 / bins, 0.999 / bins, 0.5, 1.0, 2.0, math.nan, None]
    rows = spark.createDataFrame([tuple(values[(k + i) % len(values)] for i in range(12)) for k in range(len(values))], ", ".join(f"{c} double" for c in names))
    packed = rows.select(*names, *boost._coded(names, bins))
    middles = [c.alias(f"m{k}") for k, c in enumerate(boost._decoded(names, bins))]
    for row in packed.select("*", *middles).collect():
        for k, c in enumerate(names):
            for border in [b / bins for b in range(1, bins)] + [math.inf]:
                lag = math.nan if row[c] is None else row[c]
                assert (lag < border) == (row[f"m{k}"] < border), (row[c], row[f"m{k}"], border)


def test_trees_read_models_of_known_size_and_bins(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(boost, "stored", lambda df, name, keep=boost.stored: (seen.append((name, df)), keep(df, name))[1])
    boost.fit_boost(_windows(spark), keys=(), rounds=2).collect()
    tables = {name: df for name, df in seen}
    assert not set(win.lag_names()) & set(tables["boost-rows"].columns)  # a number or two instead of twelve
    # Rows join one stored table; a join of two has no known size and was merged by a single key, in one task.
    for found in (df for name, df in seen if name == "splits"):
        assert set(found.columns) == {"_all", "coef", "_splits"}


def test_shuffled_default_has_few_chunks(spark, monkeypatch):
    chunks = []
    monkeypatch.setattr(win, "positions", lambda df, keys, order, chunk, run=win.positions: (chunks.append(df.select(chunk.alias("c"))), run(df, keys, order, chunk))[1])
    rows = _windows(spark).drop("split")
    default = win.shuffled(rows).select("site_id", "idx", "shuffle_pos").collect()
    assert chunks[0].schema["c"].dataType.simpleString() == "string"
    assert max(len(r["c"]) for r in chunks[0].collect()) == 2
    finer = win.shuffled(rows, digits=3).select("site_id", "idx", "shuffle_pos").collect()
    assert sorted(default) == sorted(finer)


def test_written_windows_are_not_sampled(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(store, "materialise", lambda df, path, *a, **b: seen.append(df))
    store.write_windows(_windows(spark), f"{tmp_path}/windows")
    assert "RepartitionByExpression" not in _plan(seen[0]) and "RebalancePartitions" in _plan(seen[0])


def _wide(spark, days=9, text=False):
    rng = random.Random(8)
    start, rows = dt.date(2024, 1, 1), []
    for site, locations in (("7", ["b", "a", None]), ("31", ["x"]), (None, ["a"])):
        for loc in locations:
            for k in rng.sample(range(days), days - 2) + [3, 3]:  # a day that is there twice and days that lack
                cells = [rng.choice([None, math.nan, 0.0, float(rng.randint(0, 9))]) for _ in range(4)]
                rows.append((site, loc, start + dt.timedelta(days=k), *[(None if c is None else str(c)) if text else c for c in cells]))
    rows.append(("7", "a", None, *[("1" if text else 1.0)] * 4))
    slots = ", ".join(f"{c} {'string' if text else 'double'}" for c in ("V00", "V03", "V40", "V95"))
    return spark.createDataFrame(rows, f"site_id string, location string, day date, {slots}")


def _same_rows(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    assert a.count() > 0


@pytest.mark.parametrize("text", [False, True])
@pytest.mark.parametrize("length", [3, 12, 20])
def test_packed_windows_are_the_windows(spark, length, text):
    """Chunks of fewer and of more rows than lags; approaches at the same time, days that lack or come twice."""
    wide = _wide(spark, text=text)
    _same_rows(win.packed_lag_windows(reshape.wide_to_packed(wide), length=length), win.lag_windows(reshape.wide_to_long(wide), length=length))


def test_packed_windows_with_the_day_before(spark):
    wide = _wide(spark)
    made = win.packed_lag_windows(reshape.wide_to_packed(wide, previous=True), made=(1,))
    long = win.lag_windows(forecast.with_previous_period(reshape.wide_to_long(wide)))
    kept = [c for c in long.columns if not c.startswith("lag_") or c == "lag_1"]
    # Rows that come twice have one order only up to the previous value, which is that of the slot for both.
    _same_rows(made, long.select(kept))


def test_windows_of_events_move_days_and_sort_no_rows(spark, small):
    plan = queries.windows(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan
    own = plan.split("\n")
    assert not [line for k, line in enumerate(own) if "Generate" in line and any("Exchange" in later for later in own[:k])]


def test_two_folders_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(store, "materialise", lambda df, path, *a, **b: seen.append(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")))
    store.write_windows(_windows(spark), f"{tmp_path}/pooled", per_site=False)
    store.write_windows(_windows(spark), f"{tmp_path}/by_site")
    assert seen == ["2", "0"] and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_ranged_windows_are_computed_once(spark, tmp_path, monkeypatch):
    stores = []
    monkeypatch.setattr(clustered, "stored", lambda df, name, keep=clustered.stored: (stores.append(name), keep(df, name))[1])
    clustered.write_clustered(_windows(spark), f"{tmp_path}/t", 2)
    assert stores == ["windows"]


def test_pooled_fit_reads_stored_rows(spark, small, monkeypatch):
    seen = []
    monkeypatch.setattr(forecast, "fit_model", lambda kind, rows, keep=forecast.fit_model, **how: (seen.append(rows), keep(kind, rows, **how))[1])
    queries.REGISTRY["fit_pooled_linear"](spark, small)
    assert "FileScan" in seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in _plan(seen[0]) and seen[0].columns == ["split", "lag_2", "lag_1", "y"]


def test_runs_of_a_resume_sort_years_once(spark, small, monkeypatch):
    plans = []
    monkeypatch.setattr(store, "write_windows", lambda rows, *a, keep=store.write_windows: (plans.append(_plan(rows)), keep(rows, *a))[1])
    found = upkeep.REGISTRY["materialise_resumes"](spark, small).collect()
    assert len(plans) == 10 and not any("row_number" in p for p in plans)
    assert {r["case"]: r["found"] for r in found} == {c: c for c in ("absent", "broken", "stale", "damaged", "present")} | {"grown": "stale"}

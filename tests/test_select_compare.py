import csv
import os

import pytest
from pyspark.sql import functions as F

from helpers import SERIES, series_rows
from lagweave.functions.fixed_values import REGION_SITES
from lagweave.operators import catalog, compare, history, select
from lagweave.operators.profile import flow_profile
from lagweave.sources.store import read_history_files

# (site, days, rows) of the published catalog
PUBLISHED_SITES = [
    ("2000", 10944), ("2200", 11904), ("2820", 5856), ("2825", 2976), ("2827", 11904), ("2846", 11904), ("3001", 9120),
    ("3002", 9984), ("3120", 11904), ("3122", 8928), ("3126", 8928), ("3127", 7488), ("3180", 8928), ("3662", 11904),
    ("3682", 11136), ("3685", 7968), ("3804", 11904), ("3812", 11904), ("4030", 8928), ("4032", 11904), ("4034", 11904),
    ("4035", 11904), ("4040", 17856), ("4043", 11904), ("4051", 8928), ("4057", 11712), ("4063", 11904), ("4262", 2496),
    ("4263", 9984), ("4264", 11040), ("4266", 11904), ("4270", 11904), ("4272", 8640), ("4273", 5952), ("4321", 11904),
    ("4324", 8928), ("4335", 5952), ("4812", 7488), ("4821", 11904), ("970", 11808),
]
PUBLISHED_REGION = [
    "2000", "2200", "2820", "2825", "2827", "3002", "3120", "3127", "3180", "3662", "3682",
    "4032", "4043", "4051", "4057", "4262", "4263", "4266", "4270", "4321", "4324", "4335",
]


def site_frame(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "site_id string")


@pytest.fixture(scope="module")
def published(spark):
    path = os.path.join(os.path.dirname(__file__), "fixtures", "published_metrics.csv")
    with open(path) as f:
        rows = [(r["site_id"], r["model_type"], float(r["mape"]), float(r["rmse"]), float(r["r2"]), float(r["mae"])) for r in csv.DictReader(f)]
    return spark.createDataFrame(rows, "site_id string, model_type string, mape double, rmse double, r2 double, mae double")


def test_region_allowlist(spark):
    assert len(REGION_SITES) == len(set(REGION_SITES)) == 141
    available = site_frame(spark, [s for s, _ in PUBLISHED_SITES])
    got = select.allowed_sites(select.allowlist(spark), available).orderBy("ord").collect()
    assert [r["site_id"] for r in got] == PUBLISHED_REGION


def test_allowlist_falls_back_to_all(spark):
    available = site_frame(spark, ["b", "a"])
    got = select.allowed_sites(select.allowlist(spark, ["x"]), available).collect()
    assert sorted(r["site_id"] for r in got) == ["a", "b"]


def test_top_sites_break_ties_by_id(spark):
    sites = spark.createDataFrame(PUBLISHED_SITES, "site_id string, n int")
    rows = sites.select("site_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    assert [r["site_id"] for r in select.top_sites(rows, 4).collect()] == ["4040", "2200", "2827", "2846"]


def test_sites_sort_as_text(spark):
    got = select.first_sites(site_frame(spark, ["970", "2000", "4040"]), 2, ["site_id"]).collect()
    assert [r["site_id"] for r in got] == ["2000", "4040"]


def test_location_lookup_on_hot_key(spark):
    rows = spark.createDataFrame([("h", i) for i in range(500)] + [("x", 0)], "site_id string, ts int")
    sites = spark.createDataFrame([("h", "High St")], "site_id string, location string")
    got = select.with_location(rows, sites).groupBy("location").count().collect()
    assert sorted(tuple(r) for r in got) == [("High St", 500), ("Unknown", 1)]
    kept = select.keep_sites(rows, sites.unionByName(sites))
    assert kept.count() == 500


def test_listing_by_position(spark):
    df = spark.createDataFrame([(7, "a"), (None, "b")], "`x.1` int, y string")
    got = select.listed_sites(select.rename_by_position(df)).collect()
    assert len(got) == 1 and got[0]["Site_Number"] == "7" and got[0]["Location_Description"] == "a" and got[0]["Unknown4"] is None


def test_site_exists(spark):
    sites = site_frame(spark, ["a"])
    assert select.site_exists(sites, "a").first()["exists"] and not select.site_exists(sites, "b").first()["exists"]


def test_model_type_selection(spark):
    types = spark.createDataFrame([("ar1",), ("naive",), ("gbt",)], "m string")
    pick = lambda text: sorted(r["m"] for r in types.where(select.model_type_in(text, F.col("m"), ["ar1", "naive"])).collect())
    assert pick("all") == ["ar1", "naive"] and pick(" NAIVE ,gbt") == ["naive"] and pick("none") == []


def test_catalog(spark):
    rows = series_rows({"h": 700, "c": 40})
    got = {r["site_id"]: r for r in catalog.site_catalog(spark.createDataFrame(rows, SERIES)).collect()}
    for site in ("h", "c"):
        own = sorted((t, loc) for s, loc, t, _ in rows if s == site)
        assert got[site]["location"] == own[0][1]
        assert got[site]["days"] == len({t.date() for t, _ in own}) and got[site]["data_points"] == len(own)


def test_quality_and_status(spark):
    df = spark.createDataFrame([("a", None), ("a", float("nan")), ("a", 1.0)] + [("b", 2.0)] * 22, "site_id string, flow double")
    quality = {r["site_id"]: (r["n_rows"], r["n_missing"]) for r in catalog.quality_counts(df).collect()}
    assert quality == {"a": (3, 2), "b": (22, 0)}
    status = catalog.site_status(df)
    assert {(r["site_id"], r["status"]) for r in status.collect()} == {("a", "too_short"), ("b", "ok")}
    assert {tuple(r) for r in catalog.status_counts(status).collect()} == {("ok", 1), ("too_short", 1)}


@pytest.mark.parametrize("by,part", [("hour", lambda t: t.hour), ("day", lambda t: t.day), ("weekday", lambda t: t.weekday())])
def test_profiles(spark, by, part):
    rows = series_rows({"h": 600, "c": 50})
    got = {(r["site_id"], r[by]): r["avg_flow"] for r in flow_profile(spark.createDataFrame(rows, SERIES), by).collect()}
    groups = {}
    for s, _, t, x in rows:
        groups.setdefault((s, part(t)), []).append(x)
    assert got == {k: pytest.approx(sum(v) / len(v)) for k, v in groups.items()}


def test_published_summary(published):
    got = {r["model_type"]: r for r in compare.model_summary(published).collect()}
    expected = {
        "gru": (74.01410912691284, 33.00629295763272, 176.54276141758686, 38.50716024544999, 22.211749332841812, 64.3190901013788, 0.7484977141240112, 0.45630181009800863, 0.9256850133363996),
        "lstm": (63.54705597648194, 30.15426363080319, 182.70722226637778, 38.78966633955154, 24.754199560307917, 66.49199286316791, 0.7427758767743068, 0.4111905590552676, 0.9311867142254258),
        "saes": (86.95218504486256, 34.89331801396581, 192.91740554567357, 41.7208860573054, 26.47457902508507, 67.51737547262695, 0.7127301683872668, 0.4108364273654378, 0.8660492311453338),
    }
    names = ("avg_mape", "min_mape", "max_mape", "avg_rmse", "min_rmse", "max_rmse", "avg_r2", "min_r2", "max_r2")
    assert {m: tuple(r[n] for n in names) for m, r in got.items()} == {m: pytest.approx(v, abs=1e-9) for m, v in expected.items()}
    ranked = [r["model_type"] for r in compare.rank_models(compare.model_summary(published)).collect()]
    assert ranked == ["lstm", "gru", "saes"]
    bars = {(r["model_type"], r["metric"]): r for r in compare.error_bars(compare.model_summary(published)).collect()}
    assert bars["gru", "mape"]["below"] == pytest.approx(74.01410912691284 - 33.00629295763272)
    short = compare.model_summary_short(published)
    assert short.columns == ["model_type", "avg_mape", "avg_rmse", "avg_r2", "min_mape", "max_mape"]


def test_published_top_sites(published):
    top = [r["site_id"] for r in compare.top_sites_by_metric(published, "mape", 10).collect()]
    assert top == "4262 3002 4043 2000 4263 2200 4270 4266 4057 3120".split()


def test_higher_is_better_for_r2(spark):
    rows = spark.createDataFrame([("a", "m", 0.1), ("b", "m", 0.9), ("c", "m", None)], "site_id string, model_type string, r2 double")
    assert [r["site_id"] for r in compare.top_sites_by_metric(rows, "r2", 2).collect()] == ["b", "a"]


def test_pivot(published):
    wide = {r["site_id"]: r for r in compare.site_model_pivot(published, "mape", ["gru", "lstm", "saes"]).collect()}
    assert len(wide) == 22 and wide["4262"]["gru"] == 33.00629295763272
    best = [min(("gru", "lstm", "saes"), key=lambda m: r[m]) for r in wide.values()]
    assert {m: best.count(m) for m in set(best)} == {"lstm": 17, "gru": 3, "saes": 2}
    with pytest.raises(Exception, match="duplicate"):
        compare.site_model_pivot(published.unionByName(published), "mape", ["gru"]).collect()


def test_comparison_table(spark):
    names = "explained_variance double, mape double, mae double, mse double, rmse double, r2 double"
    metrics = spark.createDataFrame([("s", "ar1", 0.5, 1234.567, 1.0, 2.0, 3.0, 0.25)], f"site_id string, model_type string, {names}")
    got = {r["metric"]: r["AR1"] for r in compare.comparison_table(metrics, ["ar1", "naive"]).collect()}
    assert got == {"Explained Variance": "0.5000", "MAPE (%)": "1234.57", "MAE": "1.0000", "MSE": "2.0000", "RMSE": "3.0000", "R²": "0.2500"}
    label = metrics.select(compare.metric_display_name(F.lit("rmse")), compare.metric_display_name(F.lit("new"))).first()
    assert tuple(label) == ("Root Mean Squared Error", "new")


HISTORY = "site_id string, model_type string, epoch int, val_loss double"


def run(spark, losses):
    return spark.createDataFrame([("s", "m", i, x) for i, x in enumerate(losses, 1)], HISTORY)


def test_best_epoch_is_the_earliest_lowest(spark):
    got = history.best_epoch(run(spark, [3.0, 1.0, 2.0, 1.0])).first()
    assert (got["best_epoch"], got["best_val_loss"]) == (2, 1.0)


def test_early_stop(spark):
    point = lambda losses, patience=10: tuple(history.early_stop(run(spark, losses), patience).first())[2:]
    assert point([0.05] + [0.1] * 10) == (11, 1, True)
    assert point([1.0 / i for i in range(1, 101)]) == (100, 100, False)
    assert point([5.0, 4.0, 4.0, 4.0, 1.0], 2) == (4, 2, True)
    assert point([5.0, 4.0, 4.0], 2) == (3, 2, False)


def test_published_history(spark):
    """A published run of 11 epochs: the first is the best, and training stopped after ten more."""
    runs = read_history_files(spark, os.path.join(os.path.dirname(__file__), "fixtures", "per_site"))
    best, stop = history.best_epoch(runs).first(), history.early_stop(runs).first()
    assert (best["site_id"], best["model_type"], best["best_epoch"]) == ("4262", "transformer", 1)
    assert best["best_val_loss"] == 0.05360656976699829
    assert (stop["stop_epoch"], stop["best_epoch"], stop["stopped"]) == (11, 1, True)

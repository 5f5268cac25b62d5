import datetime as dt

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import functions as F

from helpers import SERIES, brute_windows, series_rows
from lagweave.functions.metrics import mape_eps
from lagweave.operators import forecast
from lagweave.operators.points import first_test_points
from lagweave.operators.windows import lag_windows, validation_tail
from lagweave.plans import evaluate as evaluation
from lagweave.plans import train
from lagweave.sources import store

SIZES = {"h": 700, "c": 150, "d": 90}


@pytest.fixture(scope="module")
def rows():
    return series_rows(SIZES, seed=11)


@pytest.fixture(scope="module")
def windows(spark, rows):
    return lag_windows(spark.createDataFrame(rows, SERIES)).persist()


def least_squares(rows, site, length, order):
    own = [v for k, v in brute_windows(rows, length).items() if k[0] == site and v[1] == "train"]
    x = np.array([[1.0, *reversed(lags)][: order + 1] for _, _, lags, _ in own])
    return np.linalg.lstsq(x, np.array([y for *_, y in own]), rcond=None)[0]


@pytest.mark.parametrize("order", [1, 2, 12])
def test_per_key_fit_equals_least_squares(rows, windows, order):
    coefs = {r["site_id"]: r["coef"] for r in forecast.fit_model("ar_l", windows, length=order).collect()}
    assert coefs.keys() == SIZES.keys()
    for site, coef in coefs.items():
        assert coef == pytest.approx(least_squares(rows, site, 12, order), abs=1e-8)


def test_first_order_fit(rows, windows):
    for r in forecast.fit_model("ar1", windows).collect():
        assert r["coef"] == pytest.approx(least_squares(rows, r["site_id"], 12, 1), abs=1e-9)


def test_constant_key_predicts_its_constant(spark, rows):
    flat = [(s, loc, t, 5.0) for s, loc, t, _ in rows if s == "d"]
    windows = lag_windows(spark.createDataFrame(flat, SERIES), scale=False)
    for kind, length in (("ar1", 1), ("ar_l", 12)):
        scored = forecast.score_ar(windows, forecast.fit_model(kind, windows, length=length))
        assert [r["y_hat"] for r in scored.collect()] == pytest.approx([5.0] * (len(flat) - 12), abs=1e-6)


def test_fit_needs_whole_train_split(windows):
    part = windows.where((F.col("split") == "train") & (F.col("idx") > 3))
    with pytest.raises(Exception, match="whole train split"):
        forecast.fit_ar(part).collect()


def test_pooled_linear_equals_least_squares(rows, windows):
    model = forecast.fit_model("linear", windows)
    own = [v for v in brute_windows(rows, 12).values() if v[1] == "train"]
    x = np.array([[1.0, *reversed(lags)] for _, _, lags, _ in own])
    expected = np.linalg.lstsq(x, np.array([y for *_, y in own]), rcond=None)[0]
    assert train.pooled_coefficients(model)[0][1] == pytest.approx(expected, abs=1e-8)


def test_unknown_type_raises(windows):
    with pytest.raises(ValueError):
        forecast.fit_model("oracle", windows)


def test_scores_against_plain_python(rows, windows):
    coefs = forecast.fit_model("ar_l", windows, length=2)
    table = {r["site_id"]: r["coef"] for r in coefs.collect()}
    expected = brute_windows(rows, 12)
    scored = forecast.score_ar(windows, coefs).collect()
    assert len(scored) == len(expected)
    for r in scored:
        lags = expected[(r["site_id"], r["location"], r["ts"])][2]
        c = table[r["site_id"]]
        assert r["y_hat"] == pytest.approx(c[0] + c[1] * lags[-1] + c[2] * lags[-2])
    naive = forecast.score_naive(windows).collect()
    assert all(r["y_hat"] == r["lag_1"] for r in naive)


def test_previous_day(spark, rows):
    rows = [r for r in rows if r[0] == "h"]
    flows = {(loc, t): x for _, loc, t, x in rows}
    for r in forecast.with_previous_period(spark.createDataFrame(rows, SERIES)).collect():
        assert r["previous"] == flows.get((r["location"], r["ts"] - dt.timedelta(days=1)))


def test_seasonal_falls_back_to_last_value(spark, rows):
    windows = lag_windows(forecast.with_previous_period(spark.createDataFrame(rows, SERIES)))
    out = forecast.score_seasonal(windows).collect()
    missing = [r for r in out if r["previous"] is None]
    assert missing and len(missing) < len(out)
    assert all(r["y_hat"] == r["lag_1"] for r in missing)


def test_model_choice_is_per_site(spark):
    own = spark.createDataFrame([("a", "ar1", [1.0]), ("z", "ar1", [9.0])], "site_id string, model_type string, coef array<double>")
    shared = spark.createDataFrame([("ar1", [2.0]), ("ar_l", [3.0])], "model_type string, coef array<double>")
    sites = spark.createDataFrame([("a",), ("b",)], "site_id string")
    got = sorted(tuple(r) for r in forecast.choose_models(own, shared, sites).collect())
    assert got == [("a", "ar1", [1.0], "site"), ("b", "ar1", [2.0], "pooled"), ("b", "ar_l", [3.0], "pooled")]
    nothing = forecast.choose_models(own, shared.limit(0), sites).collect()
    assert [r["site_id"] for r in nothing] == ["a"]


def test_boosted_trees(windows):
    marked = validation_tail(windows.where("split = 'train'")).persist()
    model = forecast.fit_pooled_gbt(marked, validation="is_validation", rounds=3)
    fit, held = marked.where("not is_validation"), marked.where("is_validation")
    rounds = forecast.gbt_history(model, fit, held)
    assert [e for e, *_ in rounds] == list(range(1, len(rounds) + 1))
    assert rounds[-1][1] <= rounds[0][1] and len(rounds[0]) == 5
    last = forecast.score_pooled(held, model, "gbt").agg(mape_eps(F.col("y"), F.col("y_hat"))).first()[0]
    assert rounds[-1][4] == pytest.approx(last)
    scored = forecast.score_pooled(windows.where("split = 'test'"), model, "gbt")
    assert scored.where("y_hat is null").count() == 0
    report = evaluation.evaluate_pooled(scored).first()
    assert report["site_id"] == "combined" and report["mse"] > 0


def test_first_points_are_the_first_test_windows(rows, windows):
    got = first_test_points(windows, 10).collect()
    test = {k: v[0] for k, v in brute_windows(rows, 12).items() if v[1] == "test"}
    for site in SIZES:
        own = sorted(i for k, i in test.items() if k[0] == site)[:10]
        assert sorted(r["idx"] for r in got if r["site_id"] == site) == own
        assert sorted(r["point"] for r in got if r["site_id"] == site) == list(range(1, 11))


def test_evaluate_sites_skips_sites_without_model(spark, windows):
    coefs = forecast.fit_model("ar1", windows).where("site_id != 'c'")
    sites = spark.createDataFrame([("h", "High St")], "site_id string, location string")
    metrics, summary = evaluation.evaluate_sites(windows, coefs, sites)
    assert {(r["site_id"], r["location"]) for r in metrics.collect()} == {("h", "High St"), ("d", "Unknown")}
    assert summary.first()["model_type"] == "ar1"


def test_model_store(spark, windows, tmp_path):
    train.train_pooled(windows, str(tmp_path), ("linear",), all_sites=True)
    loaded = store.load_models(spark, str(tmp_path), {"linear": LinearRegressionModel, "gbt": LinearRegressionModel})
    assert list(loaded) == ["linear"]
    first = loaded["linear"].intercept
    train.train_pooled(windows.where("site_id = 'h'"), str(tmp_path), ("linear",))
    again = store.load_models(spark, str(tmp_path), {"linear": LinearRegressionModel})
    assert again["linear"].intercept != first
    coefs = train.train_per_site(spark, windows, str(tmp_path / "per_site"))
    assert coefs.groupBy("model_type").count().orderBy("model_type").collect() == [("ar1", 3), ("ar_l", 3), ("naive", 3), ("seasonal_naive", 3)]


def test_models_of_all_types_in_one_table(spark, rows, tmp_path):
    series = forecast.with_previous_period(spark.createDataFrame(rows, SERIES))
    windows = store_and_read(spark, lag_windows(series), tmp_path / "windows")
    coefs = train.train_per_site(spark, windows, str(tmp_path / "models"))
    assert {r["model_type"] for r in coefs.collect()} == {"naive", "seasonal_naive", "ar1", "ar_l"}
    scored = {(r["site_id"], r["location"], r["ts"], r["model_type"]): r for r in forecast.score_ar(windows, coefs).collect()}
    fitted = {site: {order: least_squares(rows, site, 12, order) for order in (1, 12)} for site in SIZES}
    day = dt.timedelta(days=1)
    values = {r[:3]: r[3] for r in rows}
    for (site, location, ts), (_, _, lags, _) in brute_windows(rows, 12).items():
        x = np.array([1.0, *reversed(lags)])
        got = {m: scored[site, location, ts, m] for m in ("naive", "seasonal_naive", "ar1", "ar_l")}
        assert got["naive"]["y_hat"] == pytest.approx(lags[-1])
        assert got["ar1"]["y_hat"] == pytest.approx(x[:2] @ fitted[site][1], abs=1e-8)
        assert got["ar_l"]["y_hat"] == pytest.approx(x @ fitted[site][12], abs=1e-8)
        before = values.get((site, location, ts - day))
        low, span = got["naive"]["x_min"], got["naive"]["x_max"] - got["naive"]["x_min"]
        assert got["seasonal_naive"]["y_hat"] == pytest.approx(lags[-1] if before is None else (before - low) / span)
    sites = spark.createDataFrame([(s, s) for s in SIZES], "site_id string, location string")
    metrics, summary = evaluation.evaluate_sites(windows, coefs, sites)
    assert metrics.count() == 4 * len(SIZES) and summary.count() == 4


def store_and_read(spark, df, path):
    df.drop("chunk").write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_scoring_refuses_what_it_cannot_score(spark, windows):
    long = spark.createDataFrame([("h", "ar_l", [0.0] * 14)], "site_id string, model_type string, coef array<double>")
    with pytest.raises(Exception, match="more than 12 lags"):
        forecast.score_ar(windows, long).collect()
    with pytest.raises(Exception, match="previous period"):
        forecast.score_ar(windows, forecast.fit_model("seasonal_naive", windows)).collect()


def test_sites_without_models_use_pooled_ones(spark, windows, tmp_path):
    own = forecast.fit_model("ar1", windows).where("site_id = 'h'")
    pooled = {"linear": forecast.fit_model("linear", windows), "gbt": forecast.fit_pooled_gbt(windows.where("split = 'train'"), rounds=2)}
    sites = spark.createDataFrame([(s, s.upper()) for s in SIZES], "site_id string, location string")
    metrics, summary = evaluation.evaluate_stored(windows, own, pooled, sites, str(tmp_path / "report"))
    found = {(r["site_id"], r["model_type"], r["location"]) for r in metrics.collect()}
    assert found == {("h", "ar1", "H"), *[(s, m, s.upper()) for s in ("c", "d") for m in ("linear", "gbt")]}
    assert {r["model_type"] for r in summary.collect()} == {"ar1", "linear", "gbt"}


def test_previous_period_takes_the_day_before_where_times_repeat(spark):
    start = dt.datetime(2006, 10, 2)
    rows = [("s", "a", start + dt.timedelta(days=d), float(v)) for d, v in ((0, 1), (0, 3), (1, 5), (1, 6), (3, 9))]
    got = forecast.with_previous_period(spark.createDataFrame(rows, SERIES)).orderBy("ts", "flow").collect()
    assert [r["previous"] for r in got] == [None, None, 3.0, 3.0, None]

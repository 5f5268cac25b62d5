import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import SERIES, series_rows
from lagweave.functions.solve import least_norm_solution
from lagweave.operators import boost, forecast
from lagweave.operators.windows import lag_windows

UNIT = 1 << 20


def brute_split(rows, bins):
    """(lag, threshold, left sum, left count, right sum, right count) of [(lags, residual)]: the first best border."""
    best = (-1.0, 1, math.inf, sum(s for _, s in rows), len(rows), 0, 0)
    for lag in range(1, len(rows[0][0]) + 1):
        for b in range(bins):
            left = [s for x, s in rows if min(max(math.floor(x[lag - 1] * bins), 0), bins - 1) <= b]
            right = [s for x, s in rows if min(max(math.floor(x[lag - 1] * bins), 0), bins - 1) > b]
            if left and right:
                gain = float(sum(left)) * float(sum(left)) / len(left) + float(sum(right)) * float(sum(right)) / len(right)
                if gain > best[0]:
                    best = (gain, lag, (b + 1) / bins, sum(left), len(left), sum(right), len(right))
    return best[1:]


def brute_boost(rows, rounds, bins=16, rate=0.5):
    """Ensemble of [(lags, y)] with trees of two levels."""
    target = [math.floor(y * UNIT + 0.5) for _, y in rows]
    predicted = [math.floor(sum(target) / len(target))] * len(rows)
    coef = [predicted[0] / UNIT]
    leaf = lambda s, n: math.floor(float(s) * rate / n) if n else 0
    for _ in range(rounds):
        residual = [t - p for t, p in zip(target, predicted)]
        top = brute_split([(x, s) for (x, _), s in zip(rows, residual)], bins)
        side = [x[top[0] - 1] < top[1] for x, _ in rows]
        low, leaves = [], []
        for which in (True, False):
            own = [(x, s) for (x, _), s, k in zip(rows, residual, side) if k is which]
            split = brute_split(own, bins) if own else (1, math.inf, 0, 0, 0, 0)
            low.append(split[:2])
            leaves += [leaf(split[2], split[3]), leaf(split[4], split[5])]
        coef += [top[0], top[1], *low[0], *low[1], *[v / UNIT for v in leaves]]
        for k, (x, _) in enumerate(rows):
            node = 0 if side[k] else 1
            predicted[k] += leaves[2 * node + (0 if x[low[node][0] - 1] < low[node][1] else 1)]
    return coef, [p / UNIT for p in predicted]


def frame(spark, keyed):
    rows = [(k, *x, y) for k, own in keyed.items() for x, y in own]
    return spark.createDataFrame(rows, "site_id string, lag_1 double, lag_2 double, lag_3 double, y double")


@pytest.fixture(scope="module")
def keyed():
    random.seed(3)
    draw = lambda n, f: [(x := [random.random() for _ in range(3)], f(x)) for _ in range(n)]
    return {
        "step": draw(60, lambda x: float(x[1] > 0.5) + 0.1 * x[0]),
        "noise": draw(50, lambda x: random.random() * 2 - 1),
        "constant": [([0.0, 0.0, 0.0], 0.25)] * 9,
        "one": [([0.3, 0.9, 0.1], 0.7)],
        "two values": [([float(k % 2), 0.5, 1.0], k % 2 + 0.0) for k in range(8)],
        "outside": draw(30, lambda x: x[2]) + [([-0.5, 1.7, 2.0], 3.0)],
    }


def test_trees_equal_plain_ones(spark, keyed):
    train = frame(spark, keyed).repartition(5)
    got = {r["site_id"]: r["coef"] for r in boost.fit_boost(train, length=3, rounds=3).collect()}
    assert got == {k: brute_boost(own, 3)[0] for k, own in keyed.items()}
    everything = [row for own in keyed.values() for row in own]
    (pooled,) = boost.fit_boost(train, keys=(), length=3, rounds=2).collect()
    assert pooled["coef"] == brute_boost(everything, 2)[0]


def test_predictions_come_from_the_coefficient_table(spark, keyed):
    train = frame(spark, keyed)
    models = boost.fit_boost(train, length=3, rounds=3).unionByName(
        spark.createDataFrame([("step", "ar1", [0.5, 0.25])], "site_id string, model_type string, coef array<double>")
    )
    scored = forecast.score_ar(train, models).collect()
    for key, own in keyed.items():
        want = sorted((round(y, 9), round(p, 9)) for (_, y), p in zip(own, brute_boost(own, 3)[1]))
        assert sorted((round(r["y"], 9), round(r["y_hat"], 9)) for r in scored if r["site_id"] == key and r["model_type"] == "boost") == want
    linear = [r for r in scored if r["model_type"] == "ar1"]
    assert len(linear) == 60 and all(abs(r["y_hat"] - 0.5 - 0.25 * r["lag_1"]) < 1e-12 for r in linear)


def test_rounds_lower_the_loss_and_feed_the_history(spark):
    windows = lag_windows(spark.createDataFrame(series_rows({"a": 900, "b": 700}, seed=2, top=9), SERIES))
    train = windows.where(F.col("split") == "train")
    rows = boost.boost_history(train, rounds=3).collect()
    assert {(r["site_id"], r["epoch"]) for r in rows} == {(s, e) for s in "ab" for e in (1, 2, 3)}
    for s in "ab":
        losses = [r["loss"] for r in sorted(rows, key=lambda r: r["epoch"]) if r["site_id"] == s]
        assert losses == sorted(losses, reverse=True)
    assert all(r["val_loss"] > 0 and r["mape"] > 0 for r in rows)


def test_nothing_to_fit(spark, keyed):
    assert boost.fit_boost(frame(spark, keyed).limit(0), length=3, rounds=1).collect() == []


def test_mixed_models_need_one_scan_of_the_windows(spark, tmp_path, keyed):
    path = str(tmp_path / "windows")
    frame(spark, keyed).write.parquet(path)
    rows = spark.read.parquet(path)
    models = spark.createDataFrame([("step", "ar1", [0.5, 0.25]), ("step", "boost", [0.1])], "site_id string, model_type string, coef array<double>")
    plan = forecast.score_chosen(rows, models)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Python" not in plan


@pytest.mark.parametrize("size", [1, 3, 6])
def test_least_norm_solutions(spark, size):
    rng = np.random.default_rng(size)
    rows, expected = [], []
    for k in range(24):
        a = rng.normal(size=(15, size))
        if k % 4 == 1:
            a[:, -1] = a[:, 0] * 3
        elif k % 4 == 2:
            a[:, : size // 2 + 1] = 0
        elif k % 4 == 3:
            a[:] = a[:, :1]
        y = rng.normal(size=15)
        expected.append(np.linalg.lstsq(a, y, rcond=1e-9)[0])
        rows.append((k, np.column_stack([a.T @ a, a.T @ y]).ravel().tolist()))
    frame = spark.createDataFrame(rows, "k int, m array<double>")
    got = frame.select("k", least_norm_solution(F.col("m"), size).alias("x")).orderBy("k").collect()
    for r, want in zip(got, expected):
        assert np.allclose(r["x"], want, atol=1e-8)


def test_no_python_in_the_least_squares_plan(spark):
    windows = lag_windows(spark.createDataFrame(series_rows({"a": 60}), SERIES))
    plan = forecast.fit_model("ar_l", windows)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Pandas", "Arrow", "Python"))

"""Pooled boosted trees against MLlib's, and the validation marks without places."""

import math
import random

import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from lagweave.operators import forecast, gbt
from lagweave.operators.windows import lag_names, validation_tail


def _rows(spark, n, length, few=False, seed=4):
    rng, out = random.Random(seed), []
    for k in range(n):
        lags = [float(rng.choice([0, 0, 0, 1, 2, 5])) if few else rng.choice([0.0, rng.random()]) for _ in range(length)]
        out.append((*lags, lags[-1] ** 2 - lags[0] + math.sin(9 * lags[1]) + rng.random() / 5, k % 7 == 0))
    return spark.createDataFrame(out, [*lag_names(length), "y", "held"]).repartition(3)


# Small nodes have splits of one gain by several lags, which MLlib tells apart by the last bits of its sums; hence low trees for few rows.
@pytest.mark.parametrize(("n", "length", "few", "depth", "held"), [(2000, 12, False, 2, None), (900, 13, False, 2, "held"), (12_000, 2, True, 4, "held"), (2, 2, True, 4, None)])
def test_trees_are_those_of_mllib(spark, n, length, few, depth, held):
    rows = _rows(spark, n, length, few).persist()
    estimator = GBTRegressor(featuresCol="features", labelCol="y", predictionCol="y_hat", maxIter=10, maxDepth=depth, seed=42)
    if held:
        estimator = estimator.setValidationIndicatorCol(held)
    featured = forecast.with_features(rows, length)
    theirs, own = estimator.fit(featured), forecast.fit_pooled_gbt(rows, length, held, depth=depth)
    assert own.getNumTrees == theirs.getNumTrees and own.treeWeights == theirs.treeWeights
    assert own.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray())
    a, b = (m.transform(featured).select("y_hat", *lag_names(length)).orderBy(*lag_names(length), "y_hat").collect() for m in (own, theirs))
    assert [r[0] for r in a] == pytest.approx([r[0] for r in b])
    assert own.evaluateEachIteration(featured, "squared") == pytest.approx(theirs.evaluateEachIteration(featured, "squared"))


def test_constant_rows_give_one_leaf(spark):
    rows = spark.range(5).select(*[F.lit(0.0).alias(c) for c in lag_names(2)], F.lit(3.0).alias("y"))
    model = forecast.fit_pooled_gbt(rows, 2)
    assert {r["y_hat"] for r in forecast.score_pooled(rows, model, "gbt", 2).collect()} == {3.0}


def test_early_stop_is_that_of_mllib(spark):
    rows = _rows(spark, 400, 3).withColumn("y", F.when(F.col("held"), 5 - F.col("y")).otherwise(F.col("y")))
    theirs = GBTRegressor(featuresCol="features", labelCol="y", maxIter=10, maxDepth=4, seed=42, validationIndicatorCol="held").fit(forecast.with_features(rows, 3))
    own = forecast.fit_pooled_gbt(rows, 3, "held")
    assert own.getNumTrees == theirs.getNumTrees < 10


def test_no_row_is_cached(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(gbt, "discard", lambda spark, path: seen.append((path, sorted(spark.read.parquet(path).dtypes))))
    before = set(spark._jsc.getPersistentRDDs())
    forecast.fit_pooled_gbt(_rows(spark, 50, 12), rounds=2)
    assert set(spark._jsc.getPersistentRDDs()) == before
    assert [t for _, t in seen] == [[("_b0", "bigint"), ("_held", "boolean"), ("_y", "double")]]


@pytest.mark.parametrize("share", [0.1, 0.34, 0.999])
def test_marks_without_places_are_the_same(spark, share):
    sizes = {"a": 1, "b": 9, "c": 400, "d": 3000, None: 5}
    rows = spark.createDataFrame([(s, k, k / 7) for s, n in sizes.items() for k in range(1, n + 1)], "site_id string, idx bigint, x double")
    own, whole = validation_tail(rows, share, places=False), validation_tail(rows, share)
    assert own.columns == [*rows.columns, "is_validation"]
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, whole.select(own.columns).collect()))
    assert "Window" not in own._jdf.queryExecution().optimizedPlan().toString()  # no row is sorted or moved by digest

"""Forecasters for the next interval: fit per key or pooled, score in bulk."""

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.metrics import mape_eps
from ..functions.scaling import minmax
from ..functions.solve import least_norm_solution
from .boost import MODEL as BOOST, ROUNDS as BOOST_ROUNDS, boost_prediction, fit_boost
from .gbt import fit_trees
from .lookup import lookup
from .windows import LENGTH, lag_names, lags_array

def fit_model(model_type: str, windows: DataFrame, keys: Sequence[str] = ("site_id",), length: int = LENGTH, **options):
    """Fit on the train split: a coefficient table for the types of `PER_KEY_MODELS`, an MLlib model for `POOLED_MODELS`."""
    train = windows.where(F.col("split") == "train")
    if model_type in PER_KEY_MODELS:
        return PER_KEY_MODELS[model_type](train, keys, length)
    if model_type in POOLED_MODELS:
        return POOLED_MODELS[model_type](train, length, **options)
    raise ValueError(f"unsupported model type: {model_type}")


def fit_fixed(train: DataFrame, keys: Sequence[str], model_type: str, coef: Sequence[float]) -> DataFrame:
    """(keys, model_type, coef) with the same coefficients for every key."""
    fixed = F.array(*[F.lit(float(c)) for c in coef]).cast("array<double>")
    return train.select(*keys).distinct().select(*keys, F.lit(model_type).alias("model_type"), fixed.alias("coef"))


def fit_ar1(train: DataFrame, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """(keys, model_type, coef): least squares of y on lag_1, coef = [intercept, slope]; slope 0 if lag_1 is constant."""
    x, y = F.col("lag_1"), F.col("y")
    slope = F.when(F.min(x) == F.max(x), F.lit(0.0)).otherwise(F.covar_pop(y, x) / F.var_pop(x))
    fitted = train.groupBy(*keys).agg(slope.alias("_slope"), F.avg(x).alias("_x"), F.avg(y).alias("_y"))
    coef = F.array(F.col("_y") - F.col("_slope") * F.col("_x"), F.col("_slope"))
    return fitted.select(*keys, F.lit("ar1").alias("model_type"), coef.alias("coef"))


def fit_ar(train: DataFrame, keys: Sequence[str] = ("site_id",), length: int = LENGTH) -> DataFrame:
    """(keys, model_type, coef): least squares of y on lag_1..lag_L, coef = [intercept, lag_1, .., lag_L].

    Takes whole train splits: windows 1 to `n_train` of each key. Over consecutive windows the product sum of lags j+1 and
    k+1 differs from that of lags j and k by the first and the last window only, so L+1 product sums and those two windows
    give the whole normal matrix. The aggregate combines map-side and has one row per key, whatever the key's length; the
    small solve runs on those rows, by elimination in array expressions. Keys whose lags depend on one another, such as constant ones, get
    the solution with the smallest norm.
    """
    lags = [F.col("y"), *[F.col(f"lag_{k}") for k in range(1, length + 1)]]
    at_first, at_last = F.col("idx") == 1, F.col("idx") == F.col("n_train")
    sums = train.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.max("n_train").alias("n_train"),
        F.sum("y").alias("total"),
        F.array(*[F.sum(F.col("y") * c) for c in lags]).alias("products"),
        F.array(*[F.max(F.when(at_first, c)) for c in lags]).alias("first"),
        F.array(*[F.max(F.when(at_last, c)) for c in lags]).alias("last"),
    )
    whole = F.when(F.col("n") == F.col("n_train"), F.col("n")).otherwise(
        F.raise_error(F.lit("fit_ar needs the whole train split of every key")).cast("bigint")
    )
    coef = least_norm_solution(_normal_equations(whole, length), length + 1)
    return sums.select(*keys, F.lit("ar_l").alias("model_type"), coef.alias("coef"))


def _normal_equations(n: Column, length: int) -> Column:
    """Rows of the normal matrix of (1, lag_1, .., lag_L), each with its right side last, from what `fit_ar` sums.

    Of the moments of (y, lag_1, .., lag_L), each diagonal grows from the product sum of its first element.
    """
    first, last = lambda i: F.element_at("first", i + 1), lambda i: F.element_at("last", i + 1)
    before = F.sequence(F.lit(0), F.lit(length - 1))

    def moment(j, k):  # j <= k
        grown = lambda s, i: s + first(i + 1) * first(i + 1 + (k - j)) - last(i) * last(i + (k - j))
        return F.aggregate(F.slice(before, F.lit(1), j), F.element_at("products", k - j + 1), grown)

    def total(j):
        return F.aggregate(F.slice(before, F.lit(1), j), F.col("total"), lambda s, i: s + first(i + 1) - last(i))

    def cell(r, c):
        right = F.when(r == 0, F.col("total")).otherwise(F.element_at("products", r + 1))
        edge = F.when(r == c, n.cast("double")).otherwise(total(F.greatest(r, c)))
        return F.when(c == length + 1, right).when(F.least(r, c) == 0, edge).otherwise(moment(F.least(r, c), F.greatest(r, c)))

    width = length + 2
    places = F.sequence(F.lit(0), F.lit((length + 1) * width - 1))
    return F.transform(places, lambda p: cell(F.floor(p / width).cast("int"), p % width))


def with_features(windows: DataFrame, length: int = LENGTH) -> DataFrame:
    return windows.withColumn("features", array_to_vector(lags_array(length)))


def fit_pooled_linear(train: DataFrame, length: int = LENGTH) -> LinearRegressionModel:
    """One linear model for all keys; the normal-equation solver passes over the data once."""
    estimator = LinearRegression(featuresCol="features", labelCol="y", predictionCol="y_hat", solver="normal")
    return estimator.fit(with_features(train, length).select("features", "y"))


def fit_pooled_gbt(
    train: DataFrame, length: int = LENGTH, validation: str | None = None, rounds: int = 10, depth: int = 4, seed: int = 42
) -> GBTRegressionModel:
    """One boosted tree model for all keys, as MLlib's `GBTRegressor` fits it; stops early on the rows marked by the `validation` column."""
    model = fit_trees(train, lag_names(length), "y", validation, rounds, depth, seed)
    model._set(maxIter=rounds, maxDepth=depth, seed=seed, featuresCol="features", labelCol="y", predictionCol="y_hat")
    model._transfer_params_to_java()
    return model


def ar_prediction(coef: Column, length: int) -> Column:
    """intercept + sum of lag_k * coef_k, spelled out so that it stays in generated code; missing coefficients are zero."""
    out = F.coalesce(F.get(coef, 0), F.lit(0.0))
    for k in range(1, length + 1):
        out = out + F.col(f"lag_{k}") * F.coalesce(F.get(coef, k), F.lit(0.0))
    return out


def score_ar(windows: DataFrame, coefs: DataFrame, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Adds `model_type` and `y_hat`; one output row per window and model of its key.

    Models of different types and lengths, boosted trees among them, may be in one table; one scan scores all. A model with more coefficients than
    the windows have lags is an error, as is `seasonal_naive` on windows without `previous` (see `with_previous_period`).
    """
    length = sum(c.startswith("lag_") for c in windows.columns)
    joined = lookup(windows, coefs, keys)
    if "previous" in windows.columns:
        seasonal = seasonal_prediction()
    else:
        seasonal = F.raise_error(F.lit("seasonal_naive needs the previous period")).cast("double")
    too_long = F.raise_error(F.lit(f"a model has more than {length} lags")).cast("double")
    y_hat = (
        F.when(F.col("model_type") == "seasonal_naive", seasonal)
        .when(F.col("model_type") == BOOST, boost_prediction(F.col("coef"), length, BOOST_ROUNDS))
        .when(F.size("coef") > length + 1, too_long)
        .otherwise(ar_prediction(F.col("coef"), length))
    )
    return joined.withColumn("y_hat", y_hat).drop("coef")


def score_naive(windows: DataFrame) -> DataFrame:
    """The last value again."""
    return windows.withColumns({"model_type": F.lit("naive"), "y_hat": F.col("lag_1")})


def with_previous_period(
    series: DataFrame, keys: Sequence[str] = ("site_id", "location"), value: str = "flow", ts: str = "ts"
) -> DataFrame:
    """Adds `previous`, the value of the same series and time of day one day earlier, NULL where there is none.

    A window over (keys, time of day) has one row a day, so no task gets a whole series.
    """
    slot = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    # The greatest value, should a time occur twice in the day before.
    day_before = Window.partitionBy(*keys, "_slot").orderBy("_day").rangeBetween(-1, -1)
    placed = series.withColumns({"_slot": slot, "_day": F.unix_date(F.to_date(ts))})
    return placed.withColumn("previous", F.max(value).over(day_before)).drop("_slot", "_day")


def seasonal_prediction() -> Column:
    """The `previous` value on the windows' scale, the last value where there is none."""
    return F.coalesce(minmax(F.col("previous"), F.col("x_min"), F.col("x_max")), F.col("lag_1"))


def score_seasonal(windows: DataFrame) -> DataFrame:
    """The `previous` value (see `with_previous_period`) on the windows' scale, the last value where there is none."""
    return windows.withColumns({"model_type": F.lit("seasonal_naive"), "y_hat": seasonal_prediction()})


def score_pooled(
    windows: DataFrame, model: LinearRegressionModel | GBTRegressionModel | PipelineModel, model_type: str, length: int = LENGTH
) -> DataFrame:
    scored = model.transform(with_features(windows, length)).drop("features")
    return scored.withColumn("model_type", F.lit(model_type))


def choose_models(per_site: DataFrame, pooled: DataFrame, sites: DataFrame) -> DataFrame:
    """(site_id, model_type, coef, scope): a site's own models if it has any, else every pooled model.

    All three tables have one row per site or model, none per observation. `coef` is NULL for pooled models that are not
    rows of coefficients (see `score_chosen`).
    """
    own = per_site.join(sites.select("site_id"), "site_id", "left_semi")
    rest = sites.select("site_id").join(per_site, "site_id", "left_anti")
    shared = pooled.select("model_type", "coef")
    bundle = shared.agg(F.collect_list(F.struct("model_type", "coef"))).scalar()
    fallback = rest.select("site_id", F.inline(bundle))
    return own.select("site_id", "model_type", "coef", F.lit("site").alias("scope")).unionByName(
        fallback.select("site_id", "model_type", "coef", F.lit("pooled").alias("scope"))
    )


def score_chosen(windows: DataFrame, chosen: DataFrame, models: dict | None = None) -> DataFrame:
    """Scores of the models that `choose_models` gave each site; `models` has the MLlib models by type."""
    scored = score_ar(windows, chosen.where(F.col("coef").isNotNull()).select("site_id", "model_type", "coef"))
    for model_type, model in (models or {}).items():
        users = chosen.where(F.col("coef").isNull() & (F.col("model_type") == model_type)).select("site_id")
        own = lookup(windows, users, ["site_id"], "left_semi")
        scored = scored.unionByName(score_pooled(own, model, model_type, model.numFeatures).select(scored.columns))
    return scored


def gbt_history(model: GBTRegressionModel, train: DataFrame, validation: DataFrame, length: int = LENGTH) -> list[tuple]:
    """(epoch, loss, mape, val_loss, val_mape) per boosting round, the columns of a stored history.

    The evaluation runs on Spark; a few numbers per round come back. The percentage error is that of `mape_eps`.
    """
    sides = []
    for rows in (train, validation):
        kept = with_features(rows, length).select("features", "y")
        sides += [model.evaluateEachIteration(kept, "squared"), _mape_of_rounds(model, kept)]
    return [(i, *values) for i, values in enumerate(zip(*sides), 1)]


def _mape_of_rounds(model: GBTRegressionModel, rows: DataFrame) -> list[float]:
    """The clamped percentage error of the first k trees of a model for every k, in one pass."""
    out, errors = F.lit(0.0), []
    for k, (tree, weight) in enumerate(zip(model.trees, model.treeWeights)):
        rows = tree.setPredictionCol(f"_tree{k}").transform(rows)
        out = out + F.col(f"_tree{k}") * F.lit(float(weight))
        errors.append(mape_eps(F.col("y"), out).alias(f"_round{k}"))
    return list(rows.agg(*errors).first())


#: What `fit_model` knows: a function of (train rows, keys, lags) per type with a row of coefficients per key ...
PER_KEY_MODELS = {
    "naive": lambda train, keys, length: fit_fixed(train, keys, "naive", [0.0, 1.0]),
    "seasonal_naive": lambda train, keys, length: fit_fixed(train, keys, "seasonal_naive", []),
    "ar1": lambda train, keys, length: fit_ar1(train, keys),
    "ar_l": lambda train, keys, length: fit_ar(train, keys, length),
    BOOST: lambda train, keys, length: fit_boost(train, keys, length),
}
LINEAR_MODELS = ("naive", "seasonal_naive", "ar1", "ar_l")
#: ... and of (train rows, lags, options) per MLlib type.
POOLED_MODELS = {"linear": fit_pooled_linear, "gbt": fit_pooled_gbt}

"""The registered queries: (spark, folder) -> DataFrame over the tables in the folder.

Doubles are rounded to six digits, so that the order of floating-point sums does not show.
"""

from collections.abc import Callable

from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.calendar import slot_columns, weekday_label
from ..functions.fixed_values import TWO_FILE_ATTRIBUTE
from ..functions.rounding import round6
from ..operators import catalog, compare, evaluate, forecast, history, points, reshape, scale, select, windows as win
from ..operators.profile import flow_profile
from ..sources import store
from ..sources.events import events_to_wide, read_table
from ..sources.shared import compiled, fresh_path, stored
from ..sources.csv_files import read_site_listing, read_two_files, read_wide_days
from . import evaluate as evaluation, preprocess, train, visualize

MODELS = ["ar1", "naive", "seasonal_naive"]

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    REGISTRY[function.__name__] = compiled(function)
    return function


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[round6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Inputs derived from the tables


def wide_days(spark, folder):
    return events_to_wide(read_table(spark, folder, "events"))


def series(spark, folder):
    return reshape.wide_to_long(wide_days(spark, folder))


def windows(spark, folder, **how):
    return win.packed_lag_windows(reshape.wide_to_packed(wide_days(spark, folder)), **how)


def windows_with_previous(spark, folder):
    """Windows with the value of the day before, for models that look at the last value only."""
    return win.packed_lag_windows(reshape.wide_to_packed(wide_days(spark, folder), previous=True), made=(1,))


def train_rows(spark, folder):
    return windows(spark, folder).where(F.col("split") == "train")


def test_rows(spark, folder):
    return windows(spark, folder).where(F.col("split") == "test")


def supplier_series(spark, folder):
    """Daily quantity per supplier and return flag."""
    lines = read_table(spark, folder, "lineitem")
    return lines.groupBy(
        F.col("l_suppkey").cast("string").alias("site_id"),
        F.col("l_returnflag").alias("location"),
        F.col("l_shipdate").alias("ts"),
    ).agg(F.sum("l_quantity").alias("flow"))


def supplier_windows(spark, folder):
    return win.lag_windows(supplier_series(spark, folder), chunk=F.date_trunc("MONTH", "ts"))


def line_series(spark, folder):
    """All order lines as one series, split by ship date into a train and a test source."""
    lines = read_table(spark, folder, "lineitem")
    train_part = F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")
    return lines.select(
        F.when(train_part, "train").otherwise("test").alias("source_file"),
        F.col("l_shipdate").alias("ts"),
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").alias("flow"),
    )


def run_history(spark, folder):
    """A training history out of the orders: one run per customer nation and priority, one epoch per month."""
    orders, customers = read_table(spark, folder, "orders"), read_table(spark, folder, "customer")
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    epoch = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")
    return joined.groupBy(
        F.col("c_nationkey").cast("string").alias("site_id"),
        F.col("o_orderpriority").alias("model_type"),
        epoch.alias("epoch"),
    ).agg(
        F.round(F.avg("o_totalprice"), 2).alias("loss"),
        F.round(F.avg("c_acctbal"), 2).alias("mape"),
        F.min("o_totalprice").alias("val_loss"),
        F.max("c_acctbal").alias("val_mape"),
    )


def site_metrics_table(spark, folder):
    return evaluate.regression_report(evaluation.predictions_of(windows_with_previous(spark, folder)))


# Reshape and clean


@query
def long_series(spark, folder):
    return series(spark, folder)


@query
def long_series_missing_slots(spark, folder):
    wide = wide_days(spark, folder)
    return reshape.wide_to_long(wide.drop(*slot_columns()[10:20]))


def dirty_orders(spark, folder):
    """Orders written the way dirty files are."""
    o = read_table(spark, folder, "orders")
    key, status, priority = F.col("o_custkey").cast("string"), F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    padded, plain = F.date_format("o_orderdate", "MM/dd/yyyy"), F.date_format("o_orderdate", "M/d/yyyy")
    amount = F.floor("o_totalprice").cast("string")
    return o.select(
        "o_orderkey",
        F.when(status == "F", F.concat(F.lit("00"), key)).when(status == "O", F.concat(key, F.lit(".0"))).otherwise(key).alias(
            "SCATS Number"
        ),
        F.when(priority == "5", "").otherwise(F.col("o_orderpriority")).alias("Location"),
        F.when(priority == "1", plain)
        .when(priority == "2", padded)
        .when(priority == "3", F.date_format("o_orderdate", "'13/'d/yyyy"))
        .when(priority == "4", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(status == "P", F.date_format("o_orderdate", "M/d/yy"))
        .otherwise(plain)
        .alias("Date"),
        F.when(status == "F", F.concat(F.lit(" "), amount, F.lit(" ")))
        .when(status == "O", F.concat(amount, F.lit("e1")))
        .when(priority == "1", F.concat(amount, F.lit("d")))
        .when(priority == "2", F.lit("inf"))
        .otherwise(F.lit("n/a"))
        .alias("V00"),
    )

@query
def clean_rows(spark, folder):
    """Orders written the way dirty files are, then cleaned."""
    return reshape.wide_to_long(reshape.clean_wide(dirty_orders(spark, folder)))


@query
def time_grid(spark, folder):
    bounds = read_table(spark, folder, "events").groupBy(F.col("event_type").alias("location")).agg(
        F.date_trunc("DAY", F.min("ts")).alias("start"), F.date_trunc("DAY", F.max("ts")).alias("stop")
    )
    return reshape.time_grid(bounds, "start", "stop")


# Catalogs and selection


@query
def site_catalog(spark, folder):
    return catalog.site_catalog(series(spark, folder))


@query
def distinct_sites(spark, folder):
    return catalog.distinct_sites(series(spark, folder)).orderBy("site_id")


@query
def rows_per_site(spark, folder):
    return catalog.rows_per_site(series(spark, folder))


@query
def top_sites(spark, folder):
    return select.top_sites(series(spark, folder), 5)


@query
def top_suppliers(spark, folder):
    return select.top_sites(supplier_series(spark, folder), 5)


@query
def first_sites(spark, folder):
    return select.first_sites(catalog.distinct_sites(series(spark, folder)), 5, ["site_id"])


@query
def site_filter(spark, folder):
    return series(spark, folder).where(F.col("site_id") == "1")


@query
def site_exists(spark, folder):
    rows = series(spark, folder)
    return select.site_exists(rows, "1").unionByName(select.site_exists(rows, "no such site"))


@query
def quality_counts(spark, folder):
    return catalog.quality_counts(reshape.wide_to_long(wide_days(spark, folder), fill=False))


@query
def site_status(spark, folder):
    orders = read_table(spark, folder, "orders")
    return catalog.site_status(orders.select(F.col("o_custkey").cast("string").alias("site_id")))


@query
def status_counts(spark, folder):
    return catalog.status_counts(site_status(spark, folder))


def _customers_of(spark, folder, region):
    c, n, r = (read_table(spark, folder, t) for t in ("customer", "nation", "region"))
    chosen = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return chosen.where(F.col("r_name") == region).select(
        F.col("c_custkey").cast("string").alias("site_id"), F.col("c_custkey").cast("int").alias("ord")
    )


def _customers_with_orders(spark, folder):
    return read_table(spark, folder, "orders").select(F.col("o_custkey").cast("string").alias("site_id")).distinct()


@query
def allowlist_semi(spark, folder):
    return select.allowed_sites(_customers_of(spark, folder, "ASIA"), _customers_with_orders(spark, folder))


@query
def allowlist_fallback(spark, folder):
    return select.allowed_sites(_customers_of(spark, folder, "ATLANTIS"), _customers_with_orders(spark, folder))


@query
def allowlist_rows(spark, folder):
    orders = read_table(spark, folder, "orders").withColumn("site_id", F.col("o_custkey").cast("string"))
    allowed = select.allowed_sites(_customers_of(spark, folder, "ASIA"), _customers_with_orders(spark, folder))
    return select.keep_sites(orders, allowed).select("o_orderkey", "site_id", "o_totalprice")


@query
def location_lookup(spark, folder):
    orders = read_table(spark, folder, "orders").withColumn("site_id", F.col("o_custkey").cast("string"))
    suppliers = read_table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("string").alias("site_id"), F.col("s_name").alias("location")
    )
    return select.with_location(orders, suppliers).select("o_orderkey", "site_id", "location")


@query
def site_listing(spark, folder):
    suppliers = read_table(spark, folder, "supplier")
    lines = read_table(spark, folder, "lineitem").select("l_suppkey").distinct()
    known = lines.join(suppliers, lines["l_suppkey"] == suppliers["s_suppkey"], "left")
    return select.listed_sites(select.rename_by_position(known.select("s_suppkey", "s_name", "s_nationkey")))


# Profiles


@query
def profile_hour(spark, folder):
    return rounded(flow_profile(series(spark, folder), "hour"))


@query
def profile_day(spark, folder):
    return rounded(flow_profile(series(spark, folder), "day"))


@query
def profile_weekday(spark, folder):
    profile = flow_profile(series(spark, folder), "weekday")
    return rounded(profile.withColumn("label", weekday_label(F.col("weekday"))))


@query
def profile_orders_weekday(spark, folder):
    orders = read_table(spark, folder, "orders")
    return rounded(flow_profile(orders, "weekday", "o_orderpriority", "o_orderdate", "o_totalprice"))


@query
def top_site_profiles(spark, folder):
    return rounded(visualize.top_site_profiles(series(spark, folder), "hour", 5))


@query
def top_site_weekdays(spark, folder):
    return rounded(visualize.top_site_profiles(series(spark, folder), "weekday", 5))


# Scaling


@query
def minmax_fit(spark, folder):
    return scale.minmax_fit(series(spark, folder), ["site_id"])


@query
def minmax_scale(spark, folder):
    rows = series(spark, folder)
    return rounded(scale.minmax_transform(rows, stored(scale.minmax_fit(rows, ["site_id"]), "scaler"), ["site_id"]))


@query
def minmax_inverse(spark, folder):
    rows = series(spark, folder)
    params = stored(scale.minmax_fit(rows, ["site_id"]), "scaler")
    scaled = scale.minmax_transform(rows, params, ["site_id"])
    return rounded(scale.minmax_inverse(scaled, params, ["site_id"]))


@query
def minmax_train_only(spark, folder):
    rows = supplier_series(spark, folder)
    is_train = F.col("ts") < F.lit("1999-01-01").cast("timestamp_ntz")
    params = stored(scale.minmax_fit(rows, ["site_id"], when=is_train), "scaler")
    return rounded(scale.minmax_transform(rows, params, ["site_id"]))


# Windows and splits


def _window_columns(df, *extra):
    return df.select("site_id", "location", "ts", "idx", "split", *win.lag_names(), "y", *extra)


@query
def lag_windows(spark, folder):
    return rounded(_window_columns(windows(spark, folder)))


@query
def lag_windows_by_location(spark, folder):
    return rounded(_window_columns(win.lag_windows(series(spark, folder), keys=("site_id", "location"), order=("ts",))))


@query
def lag_windows_suppliers(spark, folder):
    return rounded(_window_columns(supplier_windows(spark, folder)))


@query
def lag_windows_per_file(spark, folder):
    order = ("ts", "l_orderkey", "l_linenumber", "flow")
    chunk = F.struct(F.to_date("ts").alias("day"), F.floor(F.col("l_orderkey") / 10_000).alias("orders"))
    rows = win.lag_windows_per_file(line_series(spark, folder), chunk, order=order)
    return rounded(rows.select("split", "l_orderkey", "l_linenumber", "idx", *win.lag_names(), "y"))


@query
def lags_nested(spark, folder):
    """Windows as nested arrays, reported as sums over the flattened array."""
    rows = windows(spark, folder).select("site_id", "location", "ts", win.with_channel_axis(win.lags_array()).alias("lags"))
    flat = F.flatten("lags")
    total = F.aggregate(flat, F.lit(0.0), lambda a, x: a + x)
    return rounded(
        rows.select(
            "site_id",
            "location",
            "ts",
            F.size("lags").alias("steps"),
            total.alias("lag_sum"),
            F.element_at(flat, 1).alias("oldest"),
            F.element_at(flat, -1).alias("newest"),
        )
    )


@query
def feature_target(spark, folder):
    rows = windows(spark, folder).select("site_id", "location", "ts", F.array(*win.lag_names(), "y").alias("window"))
    cut = rows.select("site_id", "location", "ts", *win.features_and_target(F.col("window")))
    return rounded(
        cut.select("site_id", "location", "ts", F.size("lags").alias("n_lags"), F.element_at("lags", -1).alias("lag_1"), "y")
    )


@query
def split_assign(spark, folder):
    return windows(spark, folder).select("site_id", "location", "ts", "idx", "n_windows", "n_train", "split")


@query
def split_sizes(spark, folder):
    return catalog.split_sizes(windows(spark, folder))


@query
def split_sizes_suppliers(spark, folder):
    return catalog.split_sizes(supplier_windows(spark, folder))


@query
def pooled_windows(spark, folder):
    stack = win.pooled(windows(spark, folder), supplier_windows(spark, folder))
    return rounded(stack.select("split", "site_id", "location", "ts", "lag_12", "lag_1", "y"))


@query
def shuffled_train(spark, folder):
    return win.shuffled(train_rows(spark, folder)).select("site_id", "idx", "shuffle_key", "shuffle_pos")


@query
def shuffled_pooled(spark, folder):
    return win.shuffled(train_rows(spark, folder), keys=()).select("site_id", "idx", "shuffle_pos")


@query
def validation_tail(spark, folder):
    return win.validation_tail(train_rows(spark, folder)).select("site_id", "idx", "shuffle_pos", "is_validation")


# Fit and score


def _coefficients(coefs, length):
    return rounded(
        coefs.select(*[c for c in coefs.columns if c != "coef"], *[F.col("coef")[k].alias(f"c{k}") for k in range(length + 1)])
    )


@query
def fit_ar1(spark, folder):
    return _coefficients(forecast.fit_model("ar1", windows(spark, folder)), 1)


@query
def fit_ar2(spark, folder):
    return _coefficients(forecast.fit_model("ar_l", windows(spark, folder), length=2), 2)


@query
def fit_ar2_suppliers(spark, folder):
    return _coefficients(forecast.fit_model("ar_l", supplier_windows(spark, folder), length=2), 2)


@query
def fit_ar12(spark, folder):
    return _coefficients(forecast.fit_model("ar_l", windows(spark, folder)), 12)


@query
def ar12_residuals(spark, folder):
    """Least squares leaves residuals with mean 0 that are uncorrelated with every lag."""
    rows = stored(supplier_windows(spark, folder), "windows")
    coefs = stored(forecast.fit_model("ar_l", rows), "coefficients")
    return _residuals(forecast.score_ar(rows.where(F.col("split") == "train"), coefs))


def _residuals(fitted):
    error = F.col("y") - F.col("y_hat")
    return rounded(
        fitted.groupBy("site_id").agg(
            F.abs(F.avg(error)).alias("mean_error"),
            *[F.abs(F.avg(error * F.col(c))).alias(f"moment_{c}") for c in win.lag_names()],
        )
    )


@query
def fit_pooled_linear(spark, folder):
    """A linear model over the windows of all sites, on the two latest lags."""
    # Stored, as the fit reads its rows more than once.
    rows = stored(windows(spark, folder, made=(1, 2)).select("split", *win.lag_names(2), "y"), "windows")
    model = forecast.fit_model("linear", rows, length=2)
    (_, coef), = train.pooled_coefficients(model)
    one = read_table(spark, folder, "events").agg(F.count("*").alias("n_events"))
    return rounded(one.select("n_events", *[F.lit(c).alias(f"c{k}") for k, c in enumerate(coef)]))


@query
def fit_pooled_gbt(spark, folder):
    """Metrics of boosted trees over all sites, early stop on the validation tail."""
    rows = stored(windows(spark, folder).select("site_id", "idx", "split", *win.lag_names(), "y"), "windows")
    marked = win.validation_tail(rows.where(F.col("split") == "train"), places=False)
    model = forecast.fit_pooled_gbt(marked, validation="is_validation")
    scored = forecast.score_pooled(rows.where(F.col("split") == "test"), model, "gbt")
    return rounded(evaluation.evaluate_pooled(scored))


@query
def gbt_history(spark, folder):
    """Loss per boosting round on the train and the validation rows."""
    rows = stored(train_rows(spark, folder).select("site_id", "idx", *win.lag_names(), "y"), "windows")
    marked = win.validation_tail(rows, places=False)
    fit, held = marked.where(~F.col("is_validation")), marked.where("is_validation")
    rounds = forecast.gbt_history(forecast.fit_pooled_gbt(fit), fit, held)
    return rounded(spark.createDataFrame(rounds, "epoch int, loss double, mape double, val_loss double, val_mape double"))


def _score_columns(df):
    return rounded(df.select("site_id", "location", "ts", "model_type", "y", "y_hat"))


@query
def score_naive(spark, folder):
    return _score_columns(scale.unscale(forecast.score_naive(test_rows(spark, folder))))


@query
def score_seasonal(spark, folder):
    rows = windows_with_previous(spark, folder)
    return _score_columns(forecast.score_seasonal(rows.where(F.col("split") == "test")))


@query
def score_ar1(spark, folder):
    rows = windows(spark, folder)
    coefs = stored(forecast.fit_model("ar1", rows), "coefficients")
    return _score_columns(scale.unscale(forecast.score_ar(rows.where(F.col("split") == "test"), coefs)))


@query
def score_ar2(spark, folder):
    rows = windows(spark, folder)
    coefs = stored(forecast.fit_model("ar_l", rows, length=2), "coefficients")
    return _score_columns(forecast.score_ar(rows.where(F.col("split") == "test"), coefs))


@query
def join_truth(spark, folder):
    """Truth and predictions as two tables, aligned by key."""
    truth = series(spark, folder).withColumnRenamed("flow", "y")
    predictions = scale.unscale(forecast.score_naive(test_rows(spark, folder))).select(
        "site_id", "location", "ts", "model_type", "y_hat"
    )
    return _score_columns(evaluate.join_truth(truth, predictions))


@query
def model_fallback(spark, folder):
    """Suppliers of one region have their own models, the others use the pooled ones."""
    rows = supplier_windows(spark, folder)
    s, n, r = (read_table(spark, folder, t) for t in ("supplier", "nation", "region"))
    home = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    home = home.where(F.col("r_name") == "ASIA").select(F.col("s_suppkey").cast("string").alias("site_id"))
    fitted = forecast.fit_model("ar1", rows)
    own = fitted.join(home, "site_id", "left_semi")
    shared = forecast.fit_model("ar1", rows, keys=())
    chosen = forecast.choose_models(own, shared, catalog.distinct_sites(rows))
    return _coefficients(chosen, 1)


# Evaluation


@query
def site_metrics(spark, folder):
    return rounded(site_metrics_table(spark, folder))


@query
def site_metrics_located(spark, folder):
    """Evaluation of every supplier by its AR(2) model, with its name."""
    rows = supplier_windows(spark, folder)
    sites = read_table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("string").alias("site_id"), F.col("s_name").alias("location")
    )
    metrics, _ = evaluation.evaluate_sites(rows, stored(forecast.fit_model("ar_l", rows, length=2), "coefficients"), sites)
    return rounded(metrics)


@query
def pooled_metrics(spark, folder):
    return rounded(evaluation.evaluate_pooled(evaluation.predictions_of(windows_with_previous(spark, folder), unscaled=False)))


@query
def training_summary(spark, folder):
    scored = evaluation.predictions_of(windows_with_previous(spark, folder), unscaled=False)
    summary = evaluate.training_summary(scored, ["site_id", "model_type"])
    # The clamped percentage runs to millions, where double sums keep fewer decimals.
    return rounded(summary.withColumn("mape_eps", F.round("mape_eps", 2)))


@query
def model_summary(spark, folder):
    return rounded(compare.model_summary(site_metrics_table(spark, folder)))


@query
def model_summary_short(spark, folder):
    return rounded(compare.model_summary_short(site_metrics_table(spark, folder)))


@query
def model_error_bars(spark, folder):
    return rounded(compare.error_bars(compare.model_summary(site_metrics_table(spark, folder))))


@query
def metric_rows(spark, folder):
    rows = compare.metric_rows(site_metrics_table(spark, folder))
    return rounded(rows.withColumn("metric_name", compare.metric_display_name(F.col("metric"))))


@query
def site_model_pivot(spark, folder):
    return rounded(compare.site_model_pivot(site_metrics_table(spark, folder), "rmse", MODELS))


@query
def comparison_table(spark, folder):
    return compare.comparison_table(site_metrics_table(spark, folder), MODELS)


@query
def top_sites_by_mape(spark, folder):
    return rounded(compare.top_sites_by_metric(site_metrics_table(spark, folder), "mape", 10))


@query
def top_sites_by_r2(spark, folder):
    return rounded(compare.top_sites_by_metric(site_metrics_table(spark, folder), "r2", 10))


@query
def rank_models(spark, folder):
    return rounded(compare.rank_models(compare.model_summary(site_metrics_table(spark, folder)), "r2"))


@query
def select_models(spark, folder):
    metrics = site_metrics_table(spark, folder)
    return rounded(metrics.where(select.model_type_in(" Naive, ar1 ,unknown", F.col("model_type"), MODELS)))


@query
def first_day_points(spark, folder):
    scored = forecast.score_naive(points.first_test_points(windows(spark, folder)))
    return rounded(scale.unscale(scored).select("site_id", "location", "ts", "point", "model_type", "y", "y_hat"))


# Histories


@query
def best_epoch(spark, folder):
    return history.best_epoch(run_history(spark, folder))


@query
def early_stop(spark, folder):
    return history.early_stop(run_history(spark, folder), patience=10)


# Written and read back


@query
def roundtrip_windows(spark, folder):
    path = fresh_path(spark, "windows")
    store.write_windows(windows(spark, folder), path)
    return rounded(_window_columns(store.read_windows(spark, path)))


@query
def roundtrip_one_site(spark, folder):
    path = fresh_path(spark, "windows")
    store.write_windows(windows(spark, folder), path)
    return rounded(_window_columns(store.read_site(spark, path, "1")))


@query
def roundtrip_catalog(spark, folder):
    path = fresh_path(spark, "site_info")
    sites = catalog.site_catalog(series(spark, folder))
    sizes = select.with_location(catalog.split_sizes(windows(spark, folder)), sites)
    sizes = sizes.select("site_id", "location", "train_samples", "test_samples")
    store.materialise(sizes, path, fmt="csv")
    store.materialise(sizes.limit(0), path, fmt="csv")  # present already, so left alone
    return store.read_catalog(spark, path)


@query
def roundtrip_model_store(spark, folder):
    """Per-site and pooled models stored, loaded and scored; metrics per model over all suppliers."""
    rows = stored(supplier_windows(spark, folder), "windows")
    path = fresh_path(spark, "models")
    coefs = train.train_per_site(spark, rows, f"{path}/per_site", models=("ar1",))
    train.train_pooled(rows, path, ("linear",), length=2, all_sites=True)
    models = store.load_models(spark, path, {"linear": LinearRegressionModel})
    test = rows.where(F.col("split") == "test")
    own = evaluate.as_predictions(forecast.score_ar(test, coefs))
    shared = evaluate.as_predictions(forecast.score_pooled(test, models["linear"], "linear", length=2))
    return rounded(evaluation.evaluate_pooled(own.unionByName(shared)))


# Train and evaluate end to end


def _supplier_history(spark, folder):
    """Windows of the suppliers with the value of the day before."""
    rows = forecast.with_previous_period(supplier_series(spark, folder))
    return stored(win.lag_windows(rows, chunk=F.date_trunc("MONTH", "ts")), "windows")


def _supplier_names(spark, folder):
    s = read_table(spark, folder, "supplier")
    return s.select(F.col("s_suppkey").cast("string").alias("site_id"), F.col("s_name").alias("location"))


def _trained(spark, rows):
    """All per-key types in one table; two lags for `ar_l`, which SQL can solve."""
    return train.train_per_site(spark, rows, f"{fresh_path(spark, 'models')}/per_site", length=2)


@query
def evaluate_all_models(spark, folder):
    """Every per-key model of every supplier, fitted, stored, scored and reported together."""
    rows = _supplier_history(spark, folder)
    metrics, _ = evaluation.evaluate_sites(rows, _trained(spark, rows), _supplier_names(spark, folder))
    return rounded(metrics)


@query
def evaluate_one_site(spark, folder):
    """The same for one supplier, from the stored windows of that supplier."""
    path = fresh_path(spark, "windows")
    store.write_windows(_supplier_history(spark, folder), path)
    rows = store.read_site(spark, path, "1")
    metrics, _ = evaluation.evaluate_sites(rows, _trained(spark, rows), _supplier_names(spark, folder))
    return rounded(metrics)


def _chosen_report(spark, folder):
    """Suppliers of one region have models of their own, the others use a pooled linear model; written and read back."""
    rows = _supplier_history(spark, folder)
    s, n, r = (read_table(spark, folder, t) for t in ("supplier", "nation", "region"))
    home = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    home = home.where(F.col("r_name") == "ASIA").select(F.col("s_suppkey").cast("string").alias("site_id"))
    own = _trained(spark, rows.join(home, "site_id", "left_semi"))
    pooled = {"linear": forecast.fit_model("linear", rows, length=2)}
    sites = _supplier_names(spark, folder).join(catalog.distinct_sites(rows), "site_id", "left_semi")
    return evaluation.evaluate_stored(rows, own, pooled, sites, fresh_path(spark, "report"))


@query
def stored_metrics(spark, folder):
    return rounded(_chosen_report(spark, folder)[0])


@query
def stored_summary(spark, folder):
    return rounded(_chosen_report(spark, folder)[1])


@query
def pooled_linear12_residuals(spark, folder):
    """The pooled linear model on twelve lags, fitted on the stored pooled windows: its residuals vanish on every lag."""
    path = fresh_path(spark, "windows")
    store.write_windows(supplier_windows(spark, folder), path, per_site=False)
    rows = store.read_windows(spark, path)
    model = forecast.fit_model("linear", rows)
    fitted = forecast.score_pooled(rows.where(F.col("split") == "train"), model, "linear")
    return _residuals(fitted.withColumn("site_id", F.lit("combined")))


# Files


def _write_parts(rows, path, lead, parts):
    """Text files of (line, part), each beginning with the lead lines."""
    spark = rows.sparkSession
    begin = spark.createDataFrame([(k, p, line) for p in range(parts) for k, line in enumerate(lead)], "at int, part int, line string")
    lines = rows.select(F.lit(len(lead)).alias("at"), "part", "line").unionByName(begin)
    dealt = lines.repartition(parts, "part").sortWithinPartitions("part", "at")
    dealt.select(F.col("line").alias("value"), "part").write.partitionBy("part").text(path)
    return [f"{path}/part={p}" for p in range(parts)]


def _wide_csv(spark, folder):
    """The wide-day table as CSV files with a preamble and a header each, and rows without a site number."""
    path, wide = fresh_path(spark, "wide"), wide_days(spark, folder)
    broken = wide.where(F.col("location") == "click").withColumn("site_id", F.lit(None).cast("string"))
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in slot_columns()]
    lead = [F.coalesce("site_id", F.lit("")), F.col("location"), F.date_format("day", "M/d/yyyy")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = wide.unionByName(broken).select(F.concat_ws(",", *lead, *cells).alias("line"), F.pmod(F.xxhash64("site_id", "day"), F.lit(parts)).cast("int").alias("part"))
    header = ",".join(["SCATS Number", "Location", "Date", *slot_columns()])
    _write_parts(rows, path, ["Counts per interval" + "," * (len(slot_columns()) + 2), header], parts)
    return f"{path}/*"


@query
def csv_wide_days(spark, folder):
    """The wide CSV read back: rows without a site number go, and each file has lines that are no data."""
    return reshape.wide_to_long(reshape.clean_wide(read_wide_days(spark, _wide_csv(spark, folder))))


@query
def csv_site_listing(spark, folder):
    """A site listing with blank lines in its preamble and rows without a number."""
    s = read_table(spark, folder, "supplier")
    number = F.when(F.col("s_suppkey") % 7 == 0, "").otherwise(F.col("s_suppkey").cast("string"))
    rows = s.select(F.concat_ws(",", number, "s_name", F.col("s_nationkey").cast("string")).alias("line"), (F.col("s_suppkey") % 3).cast("int").alias("part"))
    lead = ["Listing", "", "made for a test", "", "", "note", "", "note", "", "Site,Description,Type"]
    path = fresh_path(spark, "listing")
    _write_parts(rows, path, lead, 3)
    return read_site_listing(spark, f"{path}/*").select("Site_Number", "Location_Description", "Site_Type", "Unknown4")


@query
def csv_two_files(spark, folder):
    """Order lines as folders of train and test files in time order, read back and windowed."""
    path, lines = fresh_path(spark, "two"), line_series(spark, folder)
    for source in ("train", "test"):
        own = lines.where(F.col("source_file") == source).orderBy("ts", "l_orderkey", "l_linenumber", "flow")
        own.select(F.col("flow").alias(TWO_FILE_ATTRIBUTE), F.col("ts").cast("string").alias("at")).write.csv(f"{path}/{source}", header=True)
    rows = read_two_files(spark, f"{path}/train", f"{path}/test")
    out = win.lag_windows_per_file(rows, F.col("file_block"), order=("file_block", "file_order"))
    return rounded(out.select("split", "idx", "lag_12", "lag_1", "y"))


@query
def preprocess_all_sites(spark, folder):
    """The whole preprocessing of the wide CSV without a site listing; scaled rows by the scaler read back."""
    tables = preprocess.preprocess(spark, _wide_csv(spark, folder), fresh_path(spark, "prepared"), region=False, per_site=False)
    return rounded(scale.minmax_transform(tables["series"], tables["scaler_params"], ["site_id"]))


@query
def roundtrip_pooled(spark, folder):
    path = fresh_path(spark, "windows")
    store.write_windows(windows(spark, folder), path, per_site=False)
    return rounded(_window_columns(store.read_windows(spark, path)))


@query
def stored_sites(spark, folder):
    """Sites with windows, from the folders of the window table and, by default, from the catalog."""
    path = fresh_path(spark, "prepared")
    store.write_windows(windows(spark, folder), f"{path}/windows")
    missing = store.stored_sites(spark, f"{path}/windows", f"{path}/site_info").select("site_id", F.lit("folders").alias("origin"))
    rows = store.read_windows(spark, f"{path}/windows")
    sizes = select.with_location(catalog.split_sizes(rows), stored(catalog.site_catalog(series(spark, folder)), "sites"))
    store.materialise(sizes.select("site_id", "location", "train_samples", "test_samples"), f"{path}/site_info", fmt="csv")
    listed = store.stored_sites(spark, f"{path}/windows", f"{path}/site_info").select("site_id", F.lit("catalog").alias("origin"))
    return missing.unionByName(listed)

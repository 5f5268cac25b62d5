"""The registered queries in SQL for DuckDB, for checking. Built from shared CTEs; rounding as in the Spark queries."""

_LAGS = list(range(12, 0, -1))

_CELLS = """
cells AS (
  SELECT CAST(user_id // 10 AS VARCHAR) AS site_id, event_type AS location, CAST(ts AS DATE) AS day,
         CAST(hour(ts) * 4 + minute(ts) // 15 AS INTEGER) AS slot, sum(floor(value)) AS flow
  FROM events GROUP BY ALL),
days AS (SELECT DISTINCT site_id, location, day FROM cells),
grid AS (
  SELECT d.site_id, d.location, CAST(d.day AS TIMESTAMP) + to_minutes(15 * s.slot) AS ts, s.slot, c.flow
  FROM days d CROSS JOIN (SELECT CAST(unnest(range(96)) AS INTEGER) AS slot) s
  LEFT JOIN cells c ON c.site_id = d.site_id AND c.location = d.location AND c.day = d.day AND c.slot = s.slot),
series AS (SELECT site_id, location, ts, coalesce(flow, 0.0) AS flow FROM grid)"""

_SUPPLIERS = """
supplier_series AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS site_id, l_returnflag AS location, l_shipdate AS ts, sum(l_quantity) AS flow
  FROM lineitem GROUP BY ALL)"""


def _windows(name: str, source: str, keys: str = "site_id", order: str = "ts, location") -> str:
    lags = ", ".join(f"lag(flow, {k}) OVER w AS r{k}" for k in _LAGS)
    scaled = ", ".join(f"(r{k} - x_min) / span AS lag_{k}" for k in _LAGS)
    return f"""
{name}_numbered AS (
  SELECT *, row_number() OVER w AS rn, count(*) OVER k AS n_rows, min(flow) OVER k AS x_min, max(flow) OVER k AS x_max, {lags}
  FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY {order}), k AS (PARTITION BY {keys})),
{name}_sized AS (
  SELECT *, rn - 12 AS idx, n_rows - 12 AS n_windows,
         CAST(greatest(1, least(n_rows - 13, floor((n_rows - 12) * CAST(0.7 AS DOUBLE)))) AS BIGINT) AS n_train,
         CASE WHEN x_max = x_min THEN 1.0 ELSE x_max - x_min END AS span
  FROM {name}_numbered WHERE n_rows >= 22 AND rn > 12),
{name} AS (
  SELECT site_id, location, ts, idx, n_windows, n_train, CASE WHEN idx <= n_train THEN 'train' ELSE 'test' END AS split,
         x_min, x_max, span, {scaled}, (flow - x_min) / span AS y, flow
  FROM {name}_sized)"""


_WINDOWS = _CELLS + "," + _windows("windowed", "series")
_SUPPLIER_WINDOWS = _SUPPLIERS + "," + _windows("supplier_windowed", "supplier_series")
_LAG_LIST = ", ".join(f"round(lag_{k}, 6) AS lag_{k}" for k in _LAGS)
_WINDOW_LIST = f"site_id, location, ts, idx, split, {_LAG_LIST}, round(y, 6) AS y"


def _ar1(name: str, source: str, keys: str = "site_id") -> str:
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""
{name}_slope AS (
  SELECT {lead}avg(lag_1) AS mx, avg(y) AS my,
         CASE WHEN min(lag_1) = max(lag_1) THEN 0.0 ELSE covar_pop(y, lag_1) / var_pop(lag_1) END AS c1
  FROM {source} WHERE split = 'train' {group}),
{name} AS (SELECT *, my - c1 * mx AS c0 FROM {name}_slope)"""


def _ar2(name: str, source: str, keys: str = "site_id") -> str:
    """Two lags by Cramer's rule on the centred moments."""
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    out = f"{keys}, " if keys else ""
    return f"""
{name}_moments AS (
  SELECT {lead}avg(y) AS my, avg(lag_1) AS m1, avg(lag_2) AS m2, var_pop(lag_1) AS s11, var_pop(lag_2) AS s22,
         covar_pop(lag_1, lag_2) AS s12, covar_pop(y, lag_1) AS s1y, covar_pop(y, lag_2) AS s2y
  FROM {source} WHERE split = 'train' {group}),
{name}_slopes AS (
  SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS c1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS c2
  FROM {name}_moments),
{name} AS (SELECT {out}my - c1 * m1 - c2 * m2 AS c0, c1, c2 FROM {name}_slopes)"""


def _ar12(source: str) -> str:
    """Twelve lags by Gauss-Jordan elimination of the normal equations, one column a step."""
    cells = ", ".join(["1.0::DOUBLE", *[f"lag_{k}" for k in range(1, 13)], "y"])
    return f"""entries AS (
      SELECT site_id, i, j, sum(v[i] * v[j]) AS s FROM (SELECT site_id, [{cells}] AS v FROM {source} WHERE split = 'train'),
             (SELECT unnest(range(1, 14)) AS i) a, (SELECT unnest(range(1, 15)) AS j) b GROUP BY ALL),
    matrix_rows AS (SELECT site_id, i, list(s ORDER BY j) AS cells FROM entries GROUP BY site_id, i),
    normal AS (SELECT site_id, list(cells ORDER BY i) AS m FROM matrix_rows GROUP BY site_id),
    steps AS (
      SELECT site_id, 1 AS k, m FROM normal
      UNION ALL SELECT site_id, k + 1, [[CASE WHEN r = k THEN m[k][c] / m[k][k] ELSE m[r][c] - m[r][k] * (m[k][c] / m[k][k]) END
                                         FOR c IN range(1, 15)] FOR r IN range(1, 14)] FROM steps WHERE k <= 13)"""


_PREDICTIONS = (
    _WINDOWS
    + ","
    + _ar1("ar1", "windowed")
    + """,
scored AS (
  SELECT w.*, w.lag_1 AS naive, coalesce(p.y, w.lag_1) AS seasonal_naive, a.c0 + a.c1 * w.lag_1 AS ar1
  FROM windowed w LEFT JOIN windowed p
       ON p.site_id = w.site_id AND p.location = w.location AND p.ts = w.ts - INTERVAL 1 DAY
  JOIN ar1 a ON a.site_id = w.site_id WHERE w.split = 'test'),
scaled_predictions AS (
  SELECT site_id, location, ts, x_min, span, 'naive' AS model_type, y, naive AS y_hat FROM scored
  UNION ALL SELECT site_id, location, ts, x_min, span, 'seasonal_naive', y, seasonal_naive FROM scored
  UNION ALL SELECT site_id, location, ts, x_min, span, 'ar1', y, ar1 FROM scored),
predictions AS (
  SELECT site_id, location, ts, model_type, y * span + x_min AS y, y_hat * span + x_min AS y_hat FROM scaled_predictions)"""
)


def _six(rounded: bool = True) -> str:
    parts = {
        "mape": "coalesce(100 * avg(CASE WHEN y > 0 THEN abs(y - y_hat) / y END), 0.0)",
        "rmse": "sqrt(avg((y - y_hat) * (y - y_hat)))",
        "r2": "CASE WHEN count(*) < 2 THEN CAST('NaN' AS DOUBLE) WHEN max(abs(y - y_hat)) = 0 THEN 1.0 "
        "WHEN min(y) = max(y) THEN 0.0 ELSE 1 - avg((y - y_hat) * (y - y_hat)) / var_pop(y) END",
        "mae": "avg(abs(y - y_hat))",
        "mse": "avg((y - y_hat) * (y - y_hat))",
        "explained_variance": "CASE WHEN min(y - y_hat) = max(y - y_hat) THEN 1.0 WHEN min(y) = max(y) THEN 0.0 "
        "ELSE 1 - var_pop(y - y_hat) / var_pop(y) END",
    }
    return ", ".join(f"round({e}, 6) AS {n}" if rounded else f"{e} AS {n}" for n, e in parts.items())


_METRICS = (
    _PREDICTIONS + f", metrics AS (SELECT site_id, model_type, {_six(False)} FROM predictions GROUP BY site_id, model_type)"
)
_SUMMARY_LIST = ", ".join(
    f"round({f}({m}), 6) AS {p}_{m}" for m in ("mape", "rmse", "r2") for p, f in (("avg", "avg"), ("min", "min"), ("max", "max"))
)
_TITLES = [
    ("explained_variance", "Explained Variance", "Explained Variance Score"),
    ("mape", "MAPE (%)", "Mean Absolute Percentage Error (%)"),
    ("mae", "MAE", "Mean Absolute Error"),
    ("mse", "MSE", "Mean Squared Error"),
    ("rmse", "RMSE", "Root Mean Squared Error"),
    ("r2", "R²", "R² Score"),
]
_METRIC_ROWS = " UNION ALL ".join(
    f"SELECT site_id, model_type, '{m}' AS metric, '{t}' AS title, '{n}' AS metric_name, {m} AS value FROM metrics"
    for m, t, n in _TITLES
)
_HISTORY = """
history AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS site_id, o_orderpriority AS model_type,
         (year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS epoch, min(o_totalprice) AS val_loss
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""
_WITH_ORDERS = "with_orders AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS site_id FROM orders)"

_SUPPLIER_SCORES = (
    _SUPPLIER_WINDOWS
    + ","
    + _ar1("ar1", "supplier_windowed")
    + ","
    + _ar2("ar2", "supplier_windowed")
    + ","
    + _ar2("pooled", "supplier_windowed", "")
    + """,
tested AS (
  SELECT w.*, coalesce((p.flow - w.x_min) / w.span, w.lag_1) AS before
  FROM supplier_windowed w LEFT JOIN supplier_series p
       ON p.site_id = w.site_id AND p.location = w.location AND p.ts = w.ts - INTERVAL 1 DAY
  WHERE split = 'test'),
own_scores AS (
  SELECT site_id, x_min, span, 'naive' AS model_type, y, lag_1 AS y_hat FROM tested
  UNION ALL SELECT site_id, x_min, span, 'seasonal_naive', y, before FROM tested
  UNION ALL SELECT site_id, x_min, span, 'ar1', y, c0 + c1 * lag_1 FROM tested JOIN ar1 USING (site_id)
  UNION ALL SELECT site_id, x_min, span, 'ar_l', y, c0 + c1 * lag_1 + c2 * lag_2 FROM tested JOIN ar2 USING (site_id)),
pooled_scores AS (
  SELECT site_id, x_min, span, 'linear' AS model_type, y, c0 + c1 * lag_1 + c2 * lag_2 AS y_hat FROM tested CROSS JOIN pooled),
home AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS site_id FROM supplier JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'),
chosen_scores AS (
  SELECT * FROM own_scores WHERE site_id IN (SELECT site_id FROM home)
  UNION ALL SELECT * FROM pooled_scores WHERE site_id NOT IN (SELECT site_id FROM home))"""
)


def _supplier_report(source: str, rounded: bool = True, where: str = "") -> str:
    return f"""report AS (
      SELECT site_id, model_type, {_six(rounded)} FROM (
        SELECT site_id, model_type, y * span + x_min AS y, y_hat * span + x_min AS y_hat FROM {source} {where})
      GROUP BY site_id, model_type)"""


_LOCATED = """SELECT report.*, coalesce(s_name, 'Unknown') AS location
        FROM report LEFT JOIN supplier ON CAST(s_suppkey AS VARCHAR) = site_id"""


def _allowed(region: str) -> str:
    return f"""{_WITH_ORDERS}, allow AS (
      SELECT CAST(c_custkey AS VARCHAR) AS site_id, CAST(c_custkey AS INTEGER) AS ord
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      WHERE r_name = '{region}'),
    allowed AS (
      SELECT site_id, ord FROM with_orders LEFT JOIN allow USING (site_id)
      WHERE ord IS NOT NULL OR (SELECT count(*) FROM allow SEMI JOIN with_orders USING (site_id)) = 0)"""


def _profile(by: str, part: str, extra: str = "") -> str:
    return f"""WITH {_CELLS} SELECT site_id, CAST({part} AS INTEGER) AS {by}, round(avg(flow), 6) AS avg_flow{extra}
    FROM series GROUP BY site_id, {part}"""


_TOP5 = "top5 AS (SELECT site_id FROM series GROUP BY site_id ORDER BY count(*) DESC, site_id LIMIT 5)"
_SHUFFLE = "md5(site_id || '|' || CAST(idx AS VARCHAR) || '|42')"
_SCORE_LIST = "site_id, location, ts, model_type, round(y, 6) AS y, round(y_hat, 6) AS y_hat"

_DIRTY = r"""dirty AS (
          SELECT CASE o_orderstatus WHEN 'F' THEN '00' || o_custkey WHEN 'O' THEN o_custkey || '.0'
                      ELSE CAST(o_custkey AS VARCHAR) END AS id,
                 CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE o_orderpriority END AS location,
                 CASE substr(o_orderpriority, 1, 1)
                   WHEN '1' THEN strftime(o_orderdate, '%-m/%-d/%Y') WHEN '2' THEN strftime(o_orderdate, '%m/%d/%Y')
                   WHEN '3' THEN strftime(o_orderdate, '13/%-d/%Y') WHEN '4' THEN strftime(o_orderdate, '%Y-%m-%d')
                   ELSE CASE o_orderstatus WHEN 'P' THEN strftime(o_orderdate, '%-m/%-d/%y')
                        ELSE strftime(o_orderdate, '%-m/%-d/%Y') END END AS day,
                 CASE WHEN o_orderstatus = 'F' THEN ' ' || CAST(floor(o_totalprice) AS BIGINT) || ' '
                      WHEN o_orderstatus = 'O' THEN CAST(floor(o_totalprice) AS BIGINT) || 'e1'
                      WHEN o_orderpriority LIKE '1%' THEN CAST(floor(o_totalprice) AS BIGINT) || 'd'
                      WHEN o_orderpriority LIKE '2%' THEN 'inf' ELSE 'n/a' END AS flow
          FROM orders),
        typed AS (
          SELECT regexp_replace(regexp_replace(id, '\.0+$', ''), '^0+(.)', '\1') AS site_id, location,
                 CASE WHEN regexp_matches(day, '^\d{1,2}/\d{1,2}/\d{4}$') THEN try_strptime(day, '%m/%d/%Y') END AS ts,
                 CASE WHEN regexp_matches(flow, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$')
                      THEN try_cast(trim(flow) AS DOUBLE) END AS flow,
                 id, day, flow AS cell
          FROM dirty)"""

SQL: dict[str, str] = {
    "long_series": f"WITH {_CELLS} SELECT * FROM series",
    "long_series_missing_slots": f"""WITH {_CELLS}
        SELECT site_id, location, ts, coalesce(flow, 0.0) AS flow FROM grid WHERE slot NOT BETWEEN 10 AND 19""",
    "clean_rows": f"""WITH {_DIRTY}
        SELECT site_id, location, ts, coalesce(flow, 0.0) AS flow FROM typed WHERE ts IS NOT NULL AND site_id IS NOT NULL""",
    "time_grid": """SELECT location, unnest(generate_series(lo, hi, INTERVAL 15 MINUTE)) AS ts FROM (
        SELECT event_type AS location, date_trunc('day', min(ts))::TIMESTAMP AS lo, date_trunc('day', max(ts))::TIMESTAMP AS hi
        FROM events GROUP BY event_type)""",
    "site_catalog": f"""WITH {_CELLS} SELECT site_id, arg_min(location, (ts, location)) AS location,
        count(DISTINCT CAST(ts AS DATE)) AS days, count(*) AS data_points FROM series GROUP BY site_id""",
    "distinct_sites": f"WITH {_CELLS} SELECT DISTINCT site_id FROM series",
    "rows_per_site": f"WITH {_CELLS} SELECT site_id, count(*) AS n_rows FROM series GROUP BY site_id",
    "top_sites": f"""WITH {_CELLS} SELECT site_id, count(*) AS n_rows FROM series GROUP BY site_id
        ORDER BY n_rows DESC, site_id LIMIT 5""",
    "top_suppliers": f"""WITH {_SUPPLIERS} SELECT site_id, count(*) AS n_rows FROM supplier_series GROUP BY site_id
        ORDER BY n_rows DESC, site_id LIMIT 5""",
    "first_sites": f"WITH {_CELLS} SELECT DISTINCT site_id FROM series ORDER BY site_id LIMIT 5",
    "site_filter": f"WITH {_CELLS} SELECT * FROM series WHERE site_id = '1'",
    "site_exists": f"""WITH {_CELLS} SELECT '1' AS site_id, count(*) > 0 AS "exists" FROM series WHERE site_id = '1'
        UNION ALL SELECT 'no such site', count(*) > 0 FROM series WHERE site_id = 'no such site'""",
    "quality_counts": f"""WITH {_CELLS} SELECT site_id, count(*) AS n_rows, count(*) FILTER (WHERE flow IS NULL) AS n_missing
        FROM grid GROUP BY site_id""",
    "site_status": """SELECT CAST(o_custkey AS VARCHAR) AS site_id, count(*) AS n_rows,
        CASE WHEN count(*) >= 22 THEN 'ok' ELSE 'too_short' END AS status FROM orders GROUP BY o_custkey""",
    "status_counts": """SELECT status, count(*) AS n_sites FROM (
        SELECT CASE WHEN count(*) >= 22 THEN 'ok' ELSE 'too_short' END AS status FROM orders GROUP BY o_custkey) GROUP BY status""",
    "allowlist_semi": f"WITH {_allowed('ASIA')} SELECT site_id, ord FROM allowed",
    "allowlist_fallback": f"WITH {_allowed('ATLANTIS')} SELECT site_id, ord FROM allowed",
    "allowlist_rows": f"""WITH {_allowed('ASIA')} SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS site_id, o_totalprice
        FROM orders WHERE CAST(o_custkey AS VARCHAR) IN (SELECT site_id FROM allowed)""",
    "location_lookup": """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS site_id, coalesce(s_name, 'Unknown') AS location
        FROM orders LEFT JOIN supplier ON o_custkey = s_suppkey""",
    "site_listing": """SELECT CAST(s_suppkey AS VARCHAR) AS "Site_Number", s_name AS "Location_Description",
        CAST(s_nationkey AS VARCHAR) AS "Site_Type", CAST(NULL AS VARCHAR) AS "Directory", CAST(NULL AS VARCHAR) AS "Map_Reference",
        CAST(NULL AS VARCHAR) AS "Unknown1", CAST(NULL AS VARCHAR) AS "Unknown2", CAST(NULL AS VARCHAR) AS "Unknown3",
        CAST(NULL AS VARCHAR) AS "Unknown4"
        FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)""",
    "profile_hour": _profile("hour", "hour(ts)"),
    "profile_day": _profile("day", "day(ts)"),
    "profile_weekday": _profile(
        "weekday", "isodow(ts) - 1", ", ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][isodow(ts)] AS label"
    ).replace("GROUP BY site_id, isodow(ts) - 1", "GROUP BY site_id, isodow(ts)"),
    "profile_orders_weekday": """SELECT o_orderpriority, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday,
        round(avg(o_totalprice), 6) AS avg_flow FROM orders GROUP BY o_orderpriority, isodow(o_orderdate)""",
    "top_site_profiles": f"""WITH {_CELLS}, {_TOP5} SELECT site_id, CAST(hour(ts) AS INTEGER) AS hour,
        round(avg(flow), 6) AS avg_flow FROM series SEMI JOIN top5 USING (site_id) GROUP BY site_id, hour(ts)""",
    "top_site_weekdays": f"""WITH {_CELLS}, {_TOP5} SELECT site_id, CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
        round(avg(flow), 6) AS avg_flow FROM series SEMI JOIN top5 USING (site_id) GROUP BY site_id, isodow(ts)""",
    "minmax_fit": f"WITH {_CELLS} SELECT site_id, min(flow) AS x_min, max(flow) AS x_max FROM series GROUP BY site_id",
    "minmax_scale": f"""WITH {_CELLS} SELECT site_id, location, ts, round((flow - min(flow) OVER k)
        / CASE WHEN max(flow) OVER k = min(flow) OVER k THEN 1.0 ELSE max(flow) OVER k - min(flow) OVER k END, 6) AS flow
        FROM series WINDOW k AS (PARTITION BY site_id)""",
    "minmax_inverse": f"WITH {_CELLS} SELECT site_id, location, ts, round(flow, 6) AS flow FROM series",
    "minmax_train_only": f"""WITH {_SUPPLIERS}, params AS (
          SELECT site_id, min(flow) FILTER (WHERE ts < TIMESTAMP '1999-01-01') AS lo,
                 max(flow) FILTER (WHERE ts < TIMESTAMP '1999-01-01') AS hi FROM supplier_series GROUP BY site_id)
        SELECT site_id, location, ts, round(CASE WHEN lo IS NULL THEN flow
               ELSE (flow - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END END, 6) AS flow
        FROM supplier_series JOIN params USING (site_id)""",
    "fit_ar12": "WITH RECURSIVE "
    + _WINDOWS
    + ", "
    + _ar12("windowed")
    + " SELECT site_id, 'ar_l' AS model_type, "
    + ", ".join(f"round(m[{k + 1}][14], 6) AS c{k}" for k in range(13))
    + " FROM steps WHERE k = 14",
    "lag_windows": f"WITH {_WINDOWS} SELECT {_WINDOW_LIST} FROM windowed",
    "lag_windows_by_location": f"""WITH {_CELLS}, {_windows("windowed", "series", "site_id, location", "ts")}
        SELECT {_WINDOW_LIST} FROM windowed""",
    "lag_windows_suppliers": f"WITH {_SUPPLIER_WINDOWS} SELECT {_WINDOW_LIST} FROM supplier_windowed",
    "lag_windows_per_file": f"""WITH lines AS (
          SELECT CASE WHEN l_shipdate < TIMESTAMP '1999-01-01' THEN 'train' ELSE 'test' END AS split,
                 l_shipdate AS ts, l_orderkey, l_linenumber, l_quantity AS flow FROM lineitem),
        fit AS (SELECT min(flow) AS lo, max(flow) - min(flow) AS span FROM lines WHERE split = 'train'),
        numbered AS (
          SELECT *, row_number() OVER w AS rn, {", ".join(f"lag(flow, {k}) OVER w AS r{k}" for k in _LAGS)} FROM lines
          WINDOW w AS (PARTITION BY split ORDER BY ts, l_orderkey, l_linenumber, flow))
        SELECT split, l_orderkey, l_linenumber, rn - 12 AS idx,
               {", ".join(f"round((r{k} - lo) / span, 6) AS lag_{k}" for k in _LAGS)}, round((flow - lo) / span, 6) AS y
        FROM numbered CROSS JOIN fit WHERE rn > 12""",
    "lags_nested": f"""WITH {_WINDOWS} SELECT site_id, location, ts, CAST(12 AS INTEGER) AS steps,
        round({" + ".join(f"lag_{k}" for k in _LAGS)}, 6) AS lag_sum, round(lag_12, 6) AS oldest, round(lag_1, 6) AS newest
        FROM windowed""",
    "feature_target": f"""WITH {_WINDOWS} SELECT site_id, location, ts, CAST(12 AS INTEGER) AS n_lags,
        round(lag_1, 6) AS lag_1, round(y, 6) AS y FROM windowed""",
    "split_assign": f"WITH {_WINDOWS} SELECT site_id, location, ts, idx, n_windows, n_train, split FROM windowed",
    "split_sizes": f"""WITH {_WINDOWS} SELECT site_id, count(*) FILTER (WHERE split = 'train') AS train_samples,
        count(*) FILTER (WHERE split = 'test') AS test_samples FROM windowed GROUP BY site_id""",
    "split_sizes_suppliers": f"""WITH {_SUPPLIER_WINDOWS} SELECT site_id,
        count(*) FILTER (WHERE split = 'train') AS train_samples, count(*) FILTER (WHERE split = 'test') AS test_samples
        FROM supplier_windowed GROUP BY site_id""",
    "pooled_windows": f"""WITH {_WINDOWS}, {_SUPPLIER_WINDOWS}, stack AS (
          SELECT split, site_id, location, ts, lag_12, lag_1, y FROM windowed
          UNION ALL SELECT split, site_id, location, ts, lag_12, lag_1, y FROM supplier_windowed)
        SELECT split, site_id, location, ts, round(lag_12, 6) AS lag_12, round(lag_1, 6) AS lag_1, round(y, 6) AS y FROM stack""",
    "shuffled_train": f"""WITH {_WINDOWS} SELECT site_id, idx, {_SHUFFLE} AS shuffle_key,
        row_number() OVER (PARTITION BY site_id ORDER BY {_SHUFFLE}, idx) AS shuffle_pos FROM windowed WHERE split = 'train'""",
    "shuffled_pooled": f"""WITH {_WINDOWS} SELECT site_id, idx, row_number() OVER (ORDER BY {_SHUFFLE}, idx) AS shuffle_pos
        FROM windowed WHERE split = 'train'""",
    "validation_tail": f"""WITH {_WINDOWS}, placed AS (
          SELECT site_id, idx, row_number() OVER (PARTITION BY site_id ORDER BY {_SHUFFLE}, idx) AS shuffle_pos,
                 count(*) OVER (PARTITION BY site_id) AS n FROM windowed WHERE split = 'train')
        SELECT site_id, idx, shuffle_pos, shuffle_pos > floor(n * (CAST(1 AS DOUBLE) - CAST(0.1 AS DOUBLE))) AS is_validation
        FROM placed""",
    "fit_ar1": f"""WITH {_WINDOWS}, {_ar1("ar1", "windowed")}
        SELECT site_id, 'ar1' AS model_type, round(c0, 6) AS c0, round(c1, 6) AS c1 FROM ar1""",
    "fit_ar2": f"""WITH {_WINDOWS}, {_ar2("ar2", "windowed")} SELECT site_id, 'ar_l' AS model_type,
        round(c0, 6) AS c0, round(c1, 6) AS c1, round(c2, 6) AS c2 FROM ar2""",
    "fit_ar2_suppliers": f"""WITH {_SUPPLIER_WINDOWS}, {_ar2("ar2", "supplier_windowed")} SELECT site_id,
        'ar_l' AS model_type, round(c0, 6) AS c0, round(c1, 6) AS c1, round(c2, 6) AS c2 FROM ar2""",
    "ar12_residuals": f"""WITH {_SUPPLIER_WINDOWS} SELECT DISTINCT site_id, CAST(0 AS DOUBLE) AS mean_error,
        {", ".join(f"CAST(0 AS DOUBLE) AS moment_lag_{k}" for k in _LAGS)} FROM supplier_windowed""",
    "fit_pooled_linear": f"""WITH {_WINDOWS}, {_ar2("ar2", "windowed", "")}
        SELECT (SELECT count(*) FROM events) AS n_events, round(c0, 6) AS c0, round(c1, 6) AS c1, round(c2, 6) AS c2 FROM ar2""",
    "score_naive": f"""WITH {_WINDOWS} SELECT site_id, location, ts, 'naive' AS model_type, round(flow, 6) AS y,
        round(lag_1 * span + x_min, 6) AS y_hat FROM windowed WHERE split = 'test'""",
    "score_seasonal": f"""WITH {_PREDICTIONS} SELECT {_SCORE_LIST} FROM scaled_predictions
        WHERE model_type = 'seasonal_naive'""",
    "score_ar1": f"WITH {_PREDICTIONS} SELECT {_SCORE_LIST} FROM predictions WHERE model_type = 'ar1'",
    "score_ar2": f"""WITH {_WINDOWS}, {_ar2("ar2", "windowed")} SELECT site_id, location, ts, 'ar_l' AS model_type,
        round(y, 6) AS y, round(c0 + c1 * lag_1 + c2 * lag_2, 6) AS y_hat
        FROM windowed JOIN ar2 USING (site_id) WHERE split = 'test'""",
    "join_truth": f"""WITH {_WINDOWS} SELECT site_id, location, ts, 'naive' AS model_type, round(flow, 6) AS y,
        round(lag_1 * span + x_min, 6) AS y_hat FROM windowed WHERE split = 'test'""",
    "model_fallback": f"""WITH {_SUPPLIER_WINDOWS}, {_ar1("own", "supplier_windowed")}, {_ar1("shared", "supplier_windowed", "")},
        home AS (
          SELECT CAST(s_suppkey AS VARCHAR) AS site_id FROM supplier JOIN nation ON s_nationkey = n_nationkey
          JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')
        SELECT site_id, 'ar1' AS model_type, 'site' AS scope, round(c0, 6) AS c0, round(c1, 6) AS c1
        FROM own SEMI JOIN home USING (site_id)
        UNION ALL
        SELECT o.site_id, 'ar1', 'pooled', round(s.c0, 6), round(s.c1, 6)
        FROM own o CROSS JOIN shared s WHERE o.site_id NOT IN (SELECT site_id FROM home)""",
    "site_metrics": f"WITH {_PREDICTIONS} SELECT site_id, model_type, {_six()} FROM predictions GROUP BY site_id, model_type",
    "site_metrics_located": f"""WITH {_SUPPLIER_WINDOWS}, {_ar2("ar2", "supplier_windowed")}, scored AS (
          SELECT site_id, y * span + x_min AS y, (c0 + c1 * lag_1 + c2 * lag_2) * span + x_min AS y_hat
          FROM supplier_windowed JOIN ar2 USING (site_id) WHERE split = 'test'),
        report AS (SELECT site_id, 'ar_l' AS model_type, {_six()} FROM scored GROUP BY site_id)
        SELECT report.*, coalesce(s_name, 'Unknown') AS location
        FROM report LEFT JOIN supplier ON CAST(s_suppkey AS VARCHAR) = site_id""",
    "pooled_metrics": f"""WITH {_PREDICTIONS} SELECT 'combined' AS site_id, 'Combined Dataset' AS location, model_type, {_six()}
        FROM scaled_predictions GROUP BY model_type""",
    "training_summary": f"""WITH {_PREDICTIONS} SELECT site_id, model_type, round(avg((y - y_hat) * (y - y_hat)), 6) AS loss,
        round(100 * avg(abs(y - y_hat) / greatest(abs(y), CAST(1e-7 AS DOUBLE))), 2) AS mape_eps
        FROM scaled_predictions GROUP BY site_id, model_type""",
    "model_summary": f"WITH {_METRICS} SELECT model_type, {_SUMMARY_LIST} FROM metrics GROUP BY model_type",
    "model_summary_short": f"""WITH {_METRICS} SELECT model_type, round(avg(mape), 6) AS avg_mape, round(avg(rmse), 6) AS avg_rmse,
        round(avg(r2), 6) AS avg_r2, round(min(mape), 6) AS min_mape, round(max(mape), 6) AS max_mape
        FROM metrics GROUP BY model_type""",
    "model_error_bars": f"WITH {_METRICS} "
    + " UNION ALL ".join(
        f"""SELECT model_type, '{m}' AS metric, round(avg({m}), 6) AS avg, round(avg({m}) - min({m}), 6) AS below,
        round(max({m}) - avg({m}), 6) AS above FROM metrics GROUP BY model_type"""
        for m in ("mape", "rmse", "r2")
    ),
    "metric_rows": f"""WITH {_METRICS}, long_rows AS ({_METRIC_ROWS})
        SELECT site_id, model_type, metric, round(value, 6) AS value, metric_name FROM long_rows""",
    "site_model_pivot": f"""WITH {_METRICS} SELECT site_id, round(max(rmse) FILTER (WHERE model_type = 'ar1'), 6) AS ar1,
        round(max(rmse) FILTER (WHERE model_type = 'naive'), 6) AS naive,
        round(max(rmse) FILTER (WHERE model_type = 'seasonal_naive'), 6) AS seasonal_naive FROM metrics GROUP BY site_id""",
    "comparison_table": f"""WITH {_METRICS}, long_rows AS ({_METRIC_ROWS}), cells_text AS (
          SELECT site_id, title, model_type,
                 CASE metric WHEN 'mape' THEN printf('%.2f', value) ELSE printf('%.4f', value) END AS cell FROM long_rows)
        SELECT site_id, title AS metric, max(cell) FILTER (WHERE model_type = 'ar1') AS "AR1",
               max(cell) FILTER (WHERE model_type = 'naive') AS "NAIVE",
               max(cell) FILTER (WHERE model_type = 'seasonal_naive') AS "SEASONAL_NAIVE"
        FROM cells_text GROUP BY site_id, title""",
    "top_sites_by_mape": f"""WITH {_METRICS} SELECT site_id, round(avg(mape), 6) AS avg_mape FROM metrics
        GROUP BY site_id ORDER BY avg(mape), site_id LIMIT 10""",
    "top_sites_by_r2": f"""WITH {_METRICS} SELECT site_id, round(avg(r2), 6) AS avg_r2 FROM metrics
        GROUP BY site_id ORDER BY avg(r2) DESC, site_id LIMIT 10""",
    "rank_models": f"""WITH {_METRICS} SELECT model_type, {_SUMMARY_LIST} FROM metrics GROUP BY model_type
        ORDER BY avg(r2) DESC""",
    "select_models": f"""WITH {_PREDICTIONS} SELECT site_id, model_type, {_six()} FROM predictions
        WHERE model_type IN ('naive', 'ar1') GROUP BY site_id, model_type""",
    "first_day_points": f"""WITH {_WINDOWS} SELECT site_id, location, ts, idx - n_train AS point, 'naive' AS model_type,
        round(flow, 6) AS y, round(lag_1 * span + x_min, 6) AS y_hat FROM windowed WHERE idx - n_train BETWEEN 1 AND 96""",
    "best_epoch": f"""WITH {_HISTORY} SELECT site_id, model_type, CAST(arg_min(epoch, (val_loss, epoch)) AS INTEGER) AS best_epoch,
        min(val_loss) AS best_val_loss FROM history GROUP BY site_id, model_type""",
    "early_stop": f"""WITH {_HISTORY}, lows AS (
          SELECT *, min(val_loss) OVER (PARTITION BY site_id, model_type ORDER BY epoch
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM history),
        bests AS (
          SELECT *, max(CASE WHEN low IS NULL OR val_loss < low THEN epoch END)
                    OVER (PARTITION BY site_id, model_type ORDER BY epoch) AS best FROM lows),
        stops AS (
          SELECT site_id, model_type, min(epoch) FILTER (WHERE epoch - best >= 10) AS stop_at, max(epoch) AS last_epoch
          FROM bests GROUP BY ALL)
        SELECT s.site_id, s.model_type, CAST(coalesce(stop_at, last_epoch) AS INTEGER) AS stop_epoch,
               CAST(b.best AS INTEGER) AS best_epoch, stop_at IS NOT NULL AS stopped
        FROM stops s JOIN bests b ON b.site_id = s.site_id AND b.model_type = s.model_type
             AND b.epoch = coalesce(stop_at, last_epoch)""",
    "roundtrip_windows": f"WITH {_WINDOWS} SELECT {_WINDOW_LIST} FROM windowed",
    "roundtrip_one_site": f"WITH {_WINDOWS} SELECT {_WINDOW_LIST} FROM windowed WHERE site_id = '1'",
    "roundtrip_catalog": f"""WITH {_WINDOWS}, sites AS (
          SELECT site_id, arg_min(location, (ts, location)) AS location FROM series GROUP BY site_id)
        SELECT site_id, s.location, count(*) FILTER (WHERE split = 'train') AS train_samples,
               count(*) FILTER (WHERE split = 'test') AS test_samples
        FROM windowed JOIN sites s USING (site_id) GROUP BY site_id, s.location""",
    "roundtrip_model_store": f"""WITH {_SUPPLIER_WINDOWS}, {_ar1("ar1", "supplier_windowed")},
        {_ar2("pooled", "supplier_windowed", "")}, scored AS (
          SELECT 'ar1' AS model_type, y, c0 + c1 * lag_1 AS y_hat FROM supplier_windowed JOIN ar1 USING (site_id)
          WHERE split = 'test'
          UNION ALL
          SELECT 'linear', y, c0 + c1 * lag_1 + c2 * lag_2 FROM supplier_windowed CROSS JOIN pooled WHERE split = 'test')
        SELECT 'combined' AS site_id, 'Combined Dataset' AS location, model_type, {_six()} FROM scored GROUP BY model_type""",
    "evaluate_all_models": f"WITH {_SUPPLIER_SCORES}, {_supplier_report('own_scores')} {_LOCATED}",
    "evaluate_one_site": f"""WITH {_SUPPLIER_SCORES}, {_supplier_report('own_scores', True, "WHERE site_id = '1'")} {_LOCATED}""",
    "stored_metrics": f"WITH {_SUPPLIER_SCORES}, {_supplier_report('chosen_scores')} {_LOCATED}",
    "stored_summary": f"""WITH {_SUPPLIER_SCORES}, {_supplier_report('chosen_scores', False)}
        SELECT model_type, {_SUMMARY_LIST} FROM report GROUP BY model_type""",
    "pooled_linear12_residuals": f"""WITH {_SUPPLIER_WINDOWS} SELECT DISTINCT 'combined' AS site_id, CAST(0 AS DOUBLE) AS mean_error,
        {", ".join(f"CAST(0 AS DOUBLE) AS moment_lag_{k}" for k in _LAGS)} FROM supplier_windowed""",
    "csv_wide_days": f"WITH {_CELLS} SELECT * FROM series",
    "csv_site_listing": """SELECT CAST(s_suppkey AS VARCHAR) AS "Site_Number", s_name AS "Location_Description",
        CAST(s_nationkey AS VARCHAR) AS "Site_Type", CAST(NULL AS VARCHAR) AS "Unknown4" FROM supplier WHERE s_suppkey % 7 <> 0""",
    "roundtrip_pooled": f"WITH {_WINDOWS} SELECT {_WINDOW_LIST} FROM windowed",
    "stored_sites": f"""WITH {_WINDOWS}, sites AS (SELECT DISTINCT site_id FROM windowed)
        SELECT site_id, origin FROM sites CROSS JOIN (VALUES ('folders'), ('catalog')) AS o(origin)""",
}
SQL["csv_two_files"] = f"SELECT split, idx, lag_12, lag_1, y FROM ({SQL['lag_windows_per_file']})"
SQL["preprocess_all_sites"] = SQL["minmax_scale"]

"""The queries of `boosting` in SQL for DuckDB: trees of two levels, round by round."""

from . import oracle as base
from .boosting import TREES

_LAGS = ", ".join(f"lag_{k}" for k in range(1, 13))


def _leaf(s: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN floor(CAST({s} AS DOUBLE) * 0.5 / {n}) ELSE 0 END"


def _level(name: str, rows: str) -> str:
    """The best split of every (site_id, node) of `rows` (site_id, node, x, s)."""
    return f"""
{name}_cells AS (
  SELECT site_id, node, lag, CAST(least(greatest(floor(x[lag] * 16.0), 0), 15) AS INTEGER) AS bin, count(*) AS n, CAST(sum(s) AS BIGINT) AS s
  FROM {rows}, (SELECT unnest(range(1, 13)) AS lag) GROUP BY ALL),
{name}_cuts AS (
  SELECT *, sum(n) OVER u AS nl, CAST(sum(s) OVER u AS BIGINT) AS sl, sum(n) OVER t AS nt, CAST(sum(s) OVER t AS BIGINT) AS st
  FROM {name}_cells WINDOW t AS (PARTITION BY site_id, node, lag),
       u AS (PARTITION BY site_id, node, lag ORDER BY bin ROWS UNBOUNDED PRECEDING)),
{name}_gains AS (
  SELECT *, nt - nl AS nr, st - sl AS sr,
         CASE WHEN nt > nl THEN CAST(sl AS DOUBLE) * CAST(sl AS DOUBLE) / nl + CAST(st - sl AS DOUBLE) * CAST(st - sl AS DOUBLE) / (nt - nl)
              ELSE -1.0 END AS gain FROM {name}_cuts),
{name} AS MATERIALIZED (
  SELECT site_id, node, lag, CASE WHEN gain >= 0 THEN (bin + 1) / 16.0::DOUBLE ELSE CAST('inf' AS DOUBLE) END AS threshold, nl, sl, nr, sr
  FROM {name}_gains QUALIFY row_number() OVER (PARTITION BY site_id, node ORDER BY gain DESC, lag, bin) = 1)"""


def boosted(source: str, name: str = "b", trees: int = TREES, keys: str = "site_id") -> str:
    """CTEs up to {name}_model (site_id, place, number) and {name}_scored_t (rows of `source` with `fit` and `p` after t trees).

    `source` has site_id, lag_1 .. lag_12, y and `fit`, which marks the rows to fit on; others are scored only.
    """
    n = name
    parts = [f"""
{n}_rows AS MATERIALIZED (
  SELECT *, {keys} AS own_key, [{_LAGS}] AS x, CAST(floor(y * 1048576.0 + 0.5) AS BIGINT) AS q FROM {source}),
{n}_base AS (SELECT own_key AS site_id, CAST(floor(CAST(sum(q) AS DOUBLE) / count(*)) AS BIGINT) AS p FROM {n}_rows WHERE fit GROUP BY own_key),
{n}_scored_0 AS MATERIALIZED (
  SELECT r.* EXCLUDE (site_id), r.site_id AS row_site, r.own_key AS site_id, p FROM {n}_rows r JOIN {n}_base b ON b.site_id = r.own_key)"""]
    model = [f"SELECT site_id, 0 AS place, p / 1048576.0::DOUBLE AS number FROM {n}_base"]
    for t in range(trees):
        parts.append(f"{n}_in{t} AS (SELECT site_id, 0 AS node, x, q - p AS s FROM {n}_scored_{t} WHERE fit)")
        parts.append(_level(f"{n}_top{t}", f"{n}_in{t}"))
        parts.append(f"""
{n}_mid{t} AS (
  SELECT r.site_id, CASE WHEN x[lag] < threshold THEN 1 ELSE 2 END AS node, x, q - p AS s
  FROM {n}_scored_{t} r JOIN {n}_top{t} USING (site_id) WHERE fit)""")
        parts.append(_level(f"{n}_low{t}", f"{n}_mid{t}"))
        parts.append(f"""
{n}_tree{t} AS MATERIALIZED (
  SELECT site_id, a.lag AS f0, a.threshold AS t0, coalesce(l.lag, 1) AS f1, coalesce(l.threshold, CAST('inf' AS DOUBLE)) AS t1,
         coalesce(h.lag, 1) AS f2, coalesce(h.threshold, CAST('inf' AS DOUBLE)) AS t2,
         CAST(coalesce({_leaf("l.sl", "l.nl")}, 0) AS BIGINT) AS v3, CAST(coalesce({_leaf("l.sr", "l.nr")}, 0) AS BIGINT) AS v4,
         CAST(coalesce({_leaf("h.sl", "h.nl")}, 0) AS BIGINT) AS v5, CAST(coalesce({_leaf("h.sr", "h.nr")}, 0) AS BIGINT) AS v6
  FROM {n}_top{t} a LEFT JOIN (SELECT * FROM {n}_low{t} WHERE node = 1) l USING (site_id)
  LEFT JOIN (SELECT * FROM {n}_low{t} WHERE node = 2) h USING (site_id))""")
        parts.append(f"""
{n}_scored_{t + 1} AS MATERIALIZED (
  SELECT r.* EXCLUDE (p), p + CASE WHEN x[f0] < t0 THEN CASE WHEN x[f1] < t1 THEN v3 ELSE v4 END
                                   ELSE CASE WHEN x[f2] < t2 THEN v5 ELSE v6 END END AS p
  FROM {n}_scored_{t} r JOIN {n}_tree{t} USING (site_id))""")
        cells = ["f0", "t0", "f1", "t1", "f2", "t2", *[f"v{k} / 1048576.0::DOUBLE" for k in range(3, 7)]]
        numbers = ", ".join(f"CAST({c} AS DOUBLE)" for c in cells)
        model.append(f"SELECT site_id, {1 + 10 * t} + unnest(range(10)) AS place, unnest([{numbers}]) AS number FROM {n}_tree{t}")
    parts.append(f"{n}_model AS ({' UNION ALL '.join(model)})")
    return ",".join(parts)


_TRAIN = "trained AS (SELECT *, TRUE AS fit FROM {source} WHERE split = 'train')"
_MARKED = f"""
counted AS (
  SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY {base._SHUFFLE}, idx) AS pos, count(*) OVER (PARTITION BY site_id) AS n_rows
  FROM supplier_windowed WHERE split = 'train'),
marked AS (SELECT *, pos <= floor(n_rows * CAST(0.9 AS DOUBLE)) AS fit FROM counted)"""
_ERROR = "(y - p / 1048576.0::DOUBLE)"
_HISTORY = f"WITH {base._SUPPLIER_WINDOWS}, {_MARKED}, {boosted('marked')}, rounds AS (" + " UNION ALL ".join(
    f"""SELECT site_id, {t} AS epoch, avg({_ERROR} * {_ERROR}) FILTER (fit) AS loss,
    100 * avg(abs({_ERROR}) / greatest(abs(y), 1e-7)) FILTER (fit) AS mape, avg({_ERROR} * {_ERROR}) FILTER (NOT fit) AS val_loss,
    100 * avg(abs({_ERROR}) / greatest(abs(y), 1e-7)) FILTER (NOT fit) AS val_mape FROM b_scored_{t} GROUP BY site_id"""
    for t in range(1, TREES + 1)
) + ")"

SQL: dict[str, str] = {
    "fit_histogram_boost": f"""WITH {base._SUPPLIER_WINDOWS}, {_TRAIN.format(source="supplier_windowed")}, {boosted("trained")}
        SELECT * FROM b_model""",
    "fit_histogram_boost_pooled": f"""WITH {base._WINDOWS}, {_TRAIN.format(source="windowed")}, {boosted("trained", keys="'all'")}
        SELECT CAST(place AS INTEGER) AS place, number FROM b_model""",
    "histogram_boost_history": f"""{_HISTORY} SELECT site_id, epoch, round(loss, 6) AS loss, round(mape, 6) AS mape,
        round(val_loss, 6) AS val_loss, round(val_mape, 6) AS val_mape FROM rounds""",
    "histogram_boost_stop": f"""{_HISTORY}, pairs AS (
          SELECT site_id, max(val_loss) FILTER (epoch = 1) AS a, max(val_loss) FILTER (epoch = 2) AS b FROM rounds GROUP BY site_id)
        SELECT site_id, 2 AS stop_epoch, CASE WHEN b < a THEN 2 ELSE 1 END AS best_epoch, NOT coalesce(b < a, FALSE) AS stopped,
               round(least(a, b), 6) AS best_val_loss FROM pairs""",
    "evaluate_mixed_models": f"""WITH {base._SUPPLIER_WINDOWS}, home AS (
          SELECT CAST(s_suppkey AS VARCHAR) AS site_id FROM supplier JOIN nation ON s_nationkey = n_nationkey
          JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'),
        near AS (SELECT *, split = 'train' AS fit FROM supplier_windowed WHERE site_id IN (SELECT site_id FROM home)),
        everywhere AS (SELECT *, split = 'train' AS fit FROM supplier_windowed),
        {base._ar1("ar1", "near")}, {base._ar2("ar2", "near")}, {base._ar1("shared", "everywhere", "")},
        {boosted("near", "own")}, {boosted("everywhere", "pool", keys="'all'")},
        predicted AS (
          SELECT site_id, 'ar1' AS model_type, y, c0 + c1 * lag_1 AS y_hat FROM near JOIN ar1 USING (site_id) WHERE split = 'test'
          UNION ALL SELECT site_id, 'ar_l', y, c0 + c1 * lag_1 + c2 * lag_2 FROM near JOIN ar2 USING (site_id) WHERE split = 'test'
          UNION ALL SELECT row_site, 'boost', y, p / 1048576.0::DOUBLE FROM own_scored_{TREES} WHERE split = 'test'
          UNION ALL SELECT site_id, 'ar1', y, c0 + c1 * lag_1 FROM everywhere CROSS JOIN shared
                    WHERE split = 'test' AND site_id NOT IN (SELECT site_id FROM home)
          UNION ALL SELECT row_site, 'boost', y, p / 1048576.0::DOUBLE FROM pool_scored_{TREES}
                    WHERE split = 'test' AND row_site NOT IN (SELECT site_id FROM home))
        SELECT site_id, model_type, {base._six()} FROM predicted GROUP BY site_id, model_type""",
    "score_histogram_boost": f"""WITH {base._WINDOWS}, everywhere AS (SELECT *, split = 'train' AS fit FROM windowed),
        {boosted("everywhere", "pool", keys="'all'")}, predicted AS (
          SELECT 'boost' AS model_type, y, p / 1048576.0::DOUBLE AS y_hat FROM pool_scored_{TREES} WHERE split = 'test')
        SELECT 'combined' AS site_id, 'Combined Dataset' AS location, model_type, {base._six()} FROM predicted GROUP BY model_type""",
}

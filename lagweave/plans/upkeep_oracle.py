"""The queries of `upkeep` in SQL for DuckDB."""

from . import oracle as base

_SIZES = """sizes AS (SELECT site_id, count(*) AS n FROM supplier_series GROUP BY site_id)"""


def _case(case: str, length: int = 12, times: int = 1) -> str:
    return f"""SELECT '{case}' AS "case", '{"stale" if case == "grown" else case}' AS found,
        CAST(sum({times} * n - {length}) AS BIGINT) AS n_rows, CAST(max({times} * n - {length}) AS BIGINT) AS last
        FROM sizes WHERE {times} * n >= {length + 10}"""


_REJECTS = r"""tagged AS (
      SELECT id AS raw_site, location, day AS raw_day,
             CASE WHEN site_id IS NULL THEN 'no_id' WHEN day IS NULL OR trim(day) = '' THEN 'no_date' WHEN ts IS NULL THEN 'bad_date' END AS reason,
             CASE WHEN cell <> 'n/a' AND flow IS NULL THEN 1 ELSE 0 END AS n_junk
      FROM typed)"""

SQL: dict[str, str] = {
    "history_files": """WITH runs AS (
          SELECT r_name AS site_id, substr(o_orderpriority, 1, 1) AS model_type, strftime(o_orderdate, '%Y-%m') AS month, min(o_totalprice) AS val_loss
          FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY site_id, model_type ORDER BY month) AS epoch FROM runs),
        best AS (SELECT site_id, model_type, CAST(arg_min(epoch, (val_loss, epoch)) AS INTEGER) AS best_epoch, min(val_loss) AS best_val_loss
                 FROM numbered GROUP BY site_id, model_type),
        lows AS (SELECT *, min(val_loss) OVER w AS low FROM numbered
                 WINDOW w AS (PARTITION BY site_id, model_type ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        marked AS (SELECT *, max(CASE WHEN low IS NULL OR val_loss < low THEN epoch END) OVER (PARTITION BY site_id, model_type ORDER BY epoch) AS lately FROM lows),
        stops AS (SELECT site_id, model_type, min(epoch) FILTER (epoch - lately >= 10) AS stop, max(epoch) AS last FROM marked GROUP BY site_id, model_type)
        SELECT site_id, model_type, best_epoch, best_val_loss, CAST(coalesce(stop, last) AS INTEGER) AS stop_epoch, stop IS NOT NULL AS stopped
        FROM best JOIN stops USING (site_id, model_type)""",
    "windows_after_append": base.SQL["lag_windows"],
    "catalog_after_append": base.SQL["site_catalog"],
    "materialise_resumes": f"WITH {base._SUPPLIERS}, {_SIZES} "
    + " UNION ALL ".join([*[_case(c) for c in ("absent", "broken", "stale", "damaged", "present")], _case("grown", times=2)]),
    "rejected_rows": f"""WITH {base._DIRTY}, {_REJECTS}
        SELECT raw_site, location, raw_day, coalesce(reason, 'junk_cells') AS reason, n_junk FROM tagged WHERE reason IS NOT NULL OR n_junk > 0""",
    "reject_counts": f"""WITH {base._DIRTY}, {_REJECTS}, reasons AS (SELECT unnest(['no_id', 'no_date', 'bad_date', 'junk_cells']) AS reason)
        SELECT r.reason, count(t.n_junk) AS n_rows, CAST(coalesce(sum(t.n_junk), 0) AS BIGINT) AS n_junk FROM reasons r
        LEFT JOIN tagged t ON r.reason = coalesce(t.reason, CASE WHEN n_junk > 0 THEN 'junk_cells' END) GROUP BY r.reason
        UNION ALL SELECT 'kept', count(*), 0 FROM tagged WHERE reason IS NULL""",
}

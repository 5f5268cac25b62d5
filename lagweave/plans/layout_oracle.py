"""The queries of `layout` in SQL for DuckDB."""

from . import oracle as base

_PRIME = (1 << 31) - 1


def _placed(source: str) -> str:
    """The rounds of the network as a recursion; a row leaves it after six rounds, or twelve and so on, when its cell is among the first n."""
    numbers = ", ".join(f"CAST('0x' || substr(d, {1 + 7 * k}, 7) AS BIGINT)" for k in range(8))
    return f"""
keyed AS (SELECT site_id, sha256(site_id || '|42') AS d, count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a
          FROM {source} WHERE split = 'train' GROUP BY site_id),
sized AS (SELECT *, (n + a - 1) // a AS b, [{numbers}] AS u FROM keyed),
walk AS (
  SELECT site_id, idx, n, a, b, u, 0 AS step, (idx - 1) // b AS l, (idx - 1) % b AS r FROM {source} JOIN sized USING (site_id) WHERE split = 'train'
  UNION ALL
  SELECT site_id, idx, n, a, b, u, step + 1, CASE WHEN step % 2 = 0 THEN (l + (h * h % {_PRIME}) * h % {_PRIME}) % a ELSE l END,
         CASE WHEN step % 2 = 1 THEN (r + (h * h % {_PRIME}) * h % {_PRIME}) % b ELSE r END
  FROM (SELECT *, ((CASE WHEN step % 2 = 0 THEN r ELSE l END) % {_PRIME} * (u[step % 6 + 1] + 1) + u[(step % 6 + 2) % 8 + 1]) % {_PRIME} AS h
        FROM walk WHERE step = 0 OR step % 6 <> 0 OR l * b + r >= n)),
placed AS (SELECT site_id, idx, n, l * b + r + 1 AS shuffle_pos FROM walk WHERE step > 0 AND step % 6 = 0 AND l * b + r < n)"""


SQL: dict[str, str] = {
    "permuted_train": f"WITH RECURSIVE {base._WINDOWS}, {_placed('windowed')} SELECT site_id, idx, shuffle_pos FROM placed",
    "permuted_validation_tail": f"""WITH RECURSIVE {base._SUPPLIER_WINDOWS}, {_placed("supplier_windowed")} SELECT site_id, idx, shuffle_pos,
        shuffle_pos > floor(n * (CAST(1 AS DOUBLE) - CAST(0.1 AS DOUBLE))) AS is_validation FROM placed""",
    "clustered_one_site": base.SQL["roundtrip_one_site"],
    "clustered_sites": f"""WITH {base._SUPPLIER_WINDOWS} SELECT site_id, count(*) AS n_windows, max(idx) AS last,
        (SELECT count(*) FROM supplier_windowed) AS n_indexed FROM supplier_windowed GROUP BY site_id""",
    "score_bucketed_ar1": f"""WITH {base._PREDICTIONS}, sites AS (SELECT site_id, arg_min(location, (ts, location)) AS first_location FROM series GROUP BY site_id)
        SELECT {base._SCORE_LIST}, first_location FROM predictions JOIN sites USING (site_id) WHERE model_type = 'ar1'""",
}

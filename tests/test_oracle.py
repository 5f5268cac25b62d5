"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, table

# A spread over the operators; tools/check_oracle.py runs all of them.
CHECKED = [
    "clean_rows",
    "site_catalog",
    "allowlist_semi",
    "location_lookup",
    "top_site_profiles",
    "minmax_train_only",
    "lag_windows_suppliers",
    "lag_windows_per_file",
    "split_sizes",
    "validation_tail",
    "fit_ar2_suppliers",
    "model_fallback",
    "comparison_table",
    "early_stop",
]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    found = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    df = entry.queries()[name](spark, small)
    assert sorted(df.columns) == sorted(columns)
    assert table([tuple(r) for r in df.collect()], df.columns) == table(found.fetchall(), columns)

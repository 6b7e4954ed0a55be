"""The entry, and core queries against their oracles in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = ["price_panel", "macro_ffill", "rolling_vol_21", "month_end_calendar", "summary_statistics", "event_windows", "bootstrap_indices", "pii_scan", "tex_escape"]


def canon(rows):
    return sorted((tuple(round(v, 6) + 0.0 if isinstance(v, float) else str(v) for v in r) for r in rows), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events", "documents", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]}) q")
    assert canon(df.select(*cols).collect()) == canon(rel.fetchall())

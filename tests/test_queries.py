"""A cross-section of the registered queries against DuckDB at the smallest scale.

``tools/check.py`` runs all of them."""
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

BASE = "/root/testdata/sf0.001"
NAMES = ["ingest_complete_grid", "ingest_overnight", "source_bar_files", "agg_opening_ranges", "win_snapshots", "win_cusum",
         "detect_grid", "detect_double_test", "detect_serial_switch", "entry_touch", "outcome_enriched", "outcome_trail_mfe",
         "select_non_overlapping", "stat_path", "stat_first_passage", "rule_edge_map", "search_walk_forward",
         "search_neighbors", "portfolio_exact", "stream_bars", "flow_opening_breakout", "join_asof_prev_keyed"]
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, con, name):
    df = entry.queries()[name](spark, BASE)
    res = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

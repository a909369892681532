"""A sample of the named queries against their SQL, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as driver
from logtable.plans import oracle
from logtable.plans import queries as named

FOLDER = Path("/root/testdata/sf0.001")
SAMPLE = (
    "list_events", "decode_price_fulfilled", "decode_admin_events", "uint256_decode", "int256_decode",
    "resolve_asset_asof", "insert_if_absent", "request_status", "deliveries", "median_price",
    "current_admin_state", "asset_violations", "streaming_ingest", "boundary_dedup",
    "list_deep_page", "cursor_page", "get_request", "fan_out", "streaming_fan_out", "watch_ownership", "streaming_resume",
)


def test_every_query_has_its_sql():
    assert set(named.registered()) == set(oracle.statements())
    assert set(driver.queries()) >= set(named.registered()) and set(driver.oracle_sql()) >= set(oracle.statements())


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    database = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        database.execute(f"create view {file.stem} as select * from '{file}'")
    found = driver.queries()[name](spark, str(FOLDER))
    columns = sorted(found.columns)
    wanted = database.execute(driver.oracle_sql()[name])
    names = [d[0] for d in wanted.description]
    assert sorted(names) == columns
    expected = [tuple(row[names.index(c)] for c in columns) for row in wanted.fetchall()]
    rows = [tuple(row) for row in found.select(*columns).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))

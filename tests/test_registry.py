import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
import __spark_entry__ as entry
from assayer import plans
import check

SF = "/root/testdata/sf0.001"
CHECKED = sorted(n for n in entry.oracle_sql() if n in plans.QUERIES)


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_flagship(spark):
    out = entry.entry(spark).collect()
    assert len(out) == 3 and sum(r.is_winner for r in out) == 1


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    ok, note = check.compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, note

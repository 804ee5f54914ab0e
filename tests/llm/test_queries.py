import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
import __spark_entry__ as entry
import check
from assayer.llm import queries

SF = "/root/testdata/sf0.001"


def test_all_thirteen_and_the_pipeline_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    ok, note = check.compare(spark, con, queries.QUERIES[name], queries.ORACLE[name], SF)
    assert ok, note

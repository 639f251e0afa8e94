"""A summary has no row for a selection without cells, as its SQL."""

import datetime

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("low,high,found", [(1000.0, 99000.0, ["all"]), (1000.0, 2000.0, ["all", "open", "open_border"]), (None, None, [])])
def test_empty_selections_equal_their_sql(spark, tmp_path, low, high, found):
    day = datetime.datetime(1995, 3, 1)
    # cells of 24 prices, a few at either end; one cell of too few
    rows = [(x * 5.0 + 1, low if i % 2 else high, day + datetime.timedelta(days=90 * y)) for x in range(3) for y in range(3) for i in range(24)] if found else []
    rows += [(41.0, 5000.0, day)]
    path = str(tmp_path / "lineitem.parquet")
    spark.createDataFrame(rows, "l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = sorted(con.execute(entry.oracle_sql()["agg04_residual_summary"]).fetchall())
    assert [r[0] for r in want] == found
    assert sorted(tuple(r) for r in entry.queries()["agg04_residual_summary"](spark, str(tmp_path)).collect()) == want

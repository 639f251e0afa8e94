"""Registered queries over whole tables, at sizes and rows where a filter or a fixed range would show."""

import os
from collections import Counter

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def plain(row):
    return tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in row)


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SMALL}/{name}')")
    return con


@pytest.mark.parametrize("name,of", [("geo01_rasterise", None), ("jn03_corners", "lineitem"), ("sca01_grouped_number", "orders"), ("sca40_41_prj18_small_rules", "customer"), ("jn07_point_in_ring", "customer"), ("sca23_sink_weight", "customer")])
def test_whole_tables_equal_their_sql(spark, duck, name, of):
    """And give a row for each of the table's, where the result isn't an aggregate."""
    out = entry.queries()[name](spark, SMALL)
    found = duck.execute(entry.oracle_sql()[name])
    at = [[c[0] for c in found.description].index(c) for c in out.columns]
    want = Counter(plain(r[i] for i in at) for r in found.fetchall())
    got = Counter(plain(r) for r in out.collect())
    assert got == want and sum(got.values()) == (duck.execute(f"SELECT count(*) FROM {of}").fetchone()[0] if of else sum(want.values()))


def test_catalogue_order_is_numbered_in_many_tasks(spark, duck, capsys):
    out = entry.queries()["srt01_catalogue_order"](spark, SMALL)
    out.explain()
    assert "SinglePartition" not in capsys.readouterr().out
    assert {(r.o_orderkey, r.place) for r in out.collect()} == set(duck.execute(entry.oracle_sql()["srt01_catalogue_order"]).fetchall())


def test_all_lines_are_rasterised(spark, tmp_path):
    """Second and third lines count: each of these triangles lies in one cell."""
    rows = [(37 * 23 * (i % 2 + 1), i, 1.0) for i in range(1, 4)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = entry.queries()["geo01_rasterise"](spark, str(tmp_path)).collect()
    assert [(r.ix, r.iy, r.n) for r in got] == [(0, 0, 3)]


def test_level_and_tree_rebuild_at_any_size(spark, tmp_path):
    """12,345 parts reach a level deeper than 9,999 do."""
    price = {i: 1.0 + i % 7 for i in range(1, 12_346)}
    spark.createDataFrame(list(price.items()), "p_partkey long, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    queries = entry.queries()
    level, tree = {}, {}
    inner = {i // 10 for i in price}
    for i in price:
        k, b = level.get(i // 10, (0, 0.0))
        level[i // 10] = k + 1, b + price[i]
        if i not in inner:
            up = i
            while up:
                up //= 10
                k, b = tree.get(up, (0, 0.0))
                tree[up] = k + 1, b + price[i]
    for name, want in (("geo14_level_rebuild", level), ("geo14_tree_rebuild", tree)):
        got = queries[name](spark, str(tmp_path)).collect()
        assert len(got) == len(want) and {r.node_id: (r.k, r.bytes) for r in got} == want

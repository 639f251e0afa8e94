"""Interpolated quantiles to DuckDB's last bit."""

import random

import duckdb
from pyspark.sql import functions as F

from orograph.functions import quantiles as Q
from orograph.operators import cells


def test_fused_has_the_bits_of_sql(spark, tmp_path):
    r = random.Random(3)
    rows = [(g, 0.5, round(r.random() * 1e5, 2) if r.random() < 0.9 else None) for g in range(120) for _ in range(r.randrange(1, 90))]
    spark.createDataFrame(rows, "g long, y double, v double").coalesce(1).write.parquet(str(tmp_path / "t"))
    df, of = spark.read.parquet(str(tmp_path / "t")), f"read_parquet('{tmp_path}/t/*.parquet')"
    want = duckdb.sql(f"SELECT g, quantile_cont(v, 0.05), quantile_cont(v, 0.75), quantile_cont(v, 0.95) FROM {of} GROUP BY g ORDER BY g").fetchall()
    got = df.groupBy("g").agg(*(Q.fused("v", q) for q in (0.05, 0.75, 0.95))).orderBy("g").collect()
    assert [tuple(x) for x in got] == want
    made = cells.grid_cells(df, F.col("g").cast("double"), "y", "v", 1.0, least=1).orderBy("ix").select("ix", "p5", "p95", "n", "cx", "cy").collect()
    sizes = {g: sum(x[0] == g for x in rows) for g in range(120)}
    assert [tuple(x) for x in made] == [(g, a, b, sizes[g], float(g), 0.5) for g, a, _, b in want]
    # Spark's own rounds once more
    plain = df.groupBy("g").agg(*(Q.linear("v", q) for q in (0.05, 0.75, 0.95))).orderBy("g").collect()
    assert [tuple(x) for x in plain] != want

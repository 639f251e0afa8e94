"""Percentiles of a whole table without a task that has all values."""

from pyspark.sql import functions as F

from orograph.functions import quantiles as Q
from orograph.operators import cells


def test_percentiles_are_those_of_the_aggregate(spark):
    rows = spark.range(997).select(F.when(F.col("id") % 50 == 3, float("nan")).when(F.col("id") % 50 != 4, F.col("id") * 7919 % 331 / 7 - 20).alias("v"))
    wanted = {f"q{int(q * 100)}": q for q in (0.0, 0.05, 0.2, 0.5, 0.95, 1.0)}
    for df in (rows, rows.limit(1), rows.where("v = 0"), rows.where("v > 1 and v < 1.5")):
        assert tuple(Q.percentiles(df, "v", wanted).first()) == tuple(df.agg(*(Q.linear("v", q) for q in wanted.values())).first())


def test_error_report_has_no_aggregate_of_all_values(spark, capsys):
    df = spark.range(500).selectExpr("id * 37D % 101 - 50 e", "id % 40D z")
    out = cells.error_report(df, "e", "z")
    out.explain()
    plan = capsys.readouterr().out
    assert "percentile(" not in plan and "median(" not in plan
    assert out.columns == ["median", "p95", "max", "ground_median", "ground_p95", "ground_max", "max_signed", "min_signed"]
    low = df.where(F.col("z") < df.agg(Q.linear("z", 0.2)).first()[0])
    of = lambda d: tuple(d.agg(Q.median(F.abs("e")), Q.linear(F.abs("e"), 0.95), F.max(F.abs("e"))).first())
    assert tuple(out.first()) == (*of(df), *of(low), 50.0, -50.0)
    assert tuple(cells.error_report(df.limit(0), "e", "z").first()) == (None,) * 8

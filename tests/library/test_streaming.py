"""The streaming rules against the batch folds, over files that arrive one after the other."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from orograph.operators import stateful
from orograph.streaming import rules

START = dt.datetime(2026, 1, 1)
SCHEMA = "key string, ts timestamp, seq long, radius_px double, failed boolean, step int"


def rows(n=120):
    r = random.Random(2)
    return [(f"k{i % 3}", START + dt.timedelta(milliseconds=400 * i), i, r.uniform(0, 20), r.random() < 0.4, r.choice((-1, 1))) for i in range(n)]


@pytest.fixture
def stream(spark, tmp_path):
    table = rows()
    for k in range(3):
        spark.createDataFrame(table[k * 40 : (k + 1) * 40], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))

    def run(df):
        q = df.writeStream.format("memory").queryName("out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.sql("SELECT * FROM out")

    return source, run, spark.createDataFrame(table, SCHEMA).withColumn("ms", F.unix_millis("ts").cast("double"))


def test_hysteresis_stream(stream):
    source, run, batch = stream
    got = {(r.key, r.seq, r.active) for r in run(rules.hysteresis(source)).collect()}
    state, want = {}, set()
    for r in stateful.hysteresis(batch).orderBy("seq").collect():
        if r.active != state.get(r.key, False):
            want.add((r.key, r.seq, r.active))
        state[r.key] = r.active
    assert got == want and want


def test_throttle_stream(stream):
    source, run, batch = stream
    assert {r.seq for r in run(rules.throttle(source, 1000)).collect()} == {r.seq for r in stateful.throttle(batch, 1000.0, order=("ms", "seq")).collect()}


def test_in_flight_stream(stream):
    source, run, batch = stream
    got = {(r.seq, r.loading) for r in run(rules.in_flight(source)).collect()}
    assert got == {(r.seq, r.loading) for r in stateful.in_flight(batch).collect()} and got


def shuffled(spark, folder, table, schema):
    """Three files whose rows overlap in time by less than the watermark of 20 s."""
    r = random.Random(4)
    table = sorted(table, key=lambda x: x[2] + r.uniform(0, 40))
    for k in range(3):
        spark.createDataFrame(table[k * 40 : (k + 1) * 40], schema).coalesce(1).write.parquet(str(folder / "mixed" / f"b{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder / "mixed"))
    return source.withWatermark("ts", "20 seconds")


def test_retries_stream(spark, stream, tmp_path):
    """Equal to the batch for all that the watermark has passed, with rows out of order across files."""
    _, run, batch = stream
    with rules.on_rocksdb(spark):
        got = [(r.key, r.due_ms, r.round) for r in run(rules.retries(shuffled(spark, tmp_path, rows(), SCHEMA), first_ms=500)).collect()]
    want = {(r.key, r.due_ms, r.round) for r in stateful.retries(batch.withColumn("ts", F.col("ms")), first_ms=500.0).collect()}
    passed = max(r.ms for r in batch.collect()) - 20_000
    assert sorted(got) == sorted(w for w in want if w[1] <= passed) and 0 < len(got) < len(want)


def test_loading_notices_stream(spark, stream, tmp_path):
    _, run, batch = stream
    table = [(key, ts, seq, seq % 7 < 4) for key, ts, seq, *_ in rows()]
    schema = "key string, ts timestamp, seq long, loading boolean"
    with rules.on_rocksdb(spark):
        got = [(r.key, r.at_ms, r.shown) for r in run(rules.loading_notices(shuffled(spark, tmp_path, table, schema), 700.0)).collect()]
    changes, was = [], {}
    for key, ts, _, loading in table:
        if loading != was.get(key, False):
            changes.append((key, (ts - START) / dt.timedelta(milliseconds=1), loading))
        was[key] = loading
    first, last = (batch.agg(f("ms")).first()[0] for f in (F.min, F.max))
    want = set()
    for r in stateful.loading_notices(spark.createDataFrame(changes, "key string, ts double, loading boolean"), 700.0).collect():
        want |= {(r.key, first + t, shown) for t, shown in ((r.notice_at, True), (r.until, False)) if t is not None}
    assert sorted(got) == sorted(w for w in want if w[1] <= last - 20_000) and {x[2] for x in got} == {True, False}


def test_request_timings_and_resume(spark, tmp_path):
    r = [(START + dt.timedelta(seconds=40 * i), "tile", 10 * i, 1.0, 2.0) for i in range(6)]
    spark.createDataFrame(r, "ts timestamp, event_type string, bytes long, first_ms double, total_ms double").coalesce(1).write.parquet(str(tmp_path / "e" / "a"))
    source = lambda: spark.readStream.schema("ts timestamp, event_type string, bytes long, first_ms double, total_ms double").option("recursiveFileLookup", True).parquet(str(tmp_path / "e"))
    q = rules.request_timings(source()).writeStream.format("memory").queryName("timings").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(x.n, x.bytes) for x in spark.sql("SELECT * FROM timings ORDER BY window").collect()] == [(2, 10), (1, 20), (2, 70), (1, 50)]
    out, check = str(tmp_path / "out"), str(tmp_path / "ck")
    rules.resumable(source(), lambda d: d.select("bytes"), out, check)
    rules.resumable(source(), lambda d: d.select("bytes"), out, check)
    assert spark.read.parquet(out).count() == 6
    spark.createDataFrame(r[:1], "ts timestamp, event_type string, bytes long, first_ms double, total_ms double").coalesce(1).write.parquet(str(tmp_path / "e" / "b"))
    rules.resumable(source(), lambda d: d.select("bytes"), out, check)
    assert spark.read.parquet(out).count() == 7

"""Rules that remember over the events table: a user is a key, ``value`` the radius on screen, order is (ts, event_id)."""

from pyspark.sql import functions as F

from orograph.operators import cells, requests, stateful
from orograph.plans.tables import query, table
from orograph.shared import scratch
from orograph.streaming import rules


def keyed_events(spark, sf_dir):
    ms = F.unix_micros(F.col("ts").cast("timestamp")) / 1000
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), ms.alias("ts"), F.col("value").alias("radius_px"), F.col("event_type"), (F.col("event_type") == "error").alias("failed"))


E = "e AS (SELECT user_id k, event_id seq, epoch_us(ts) / 1000.0::DOUBLE ts, value v, event_type t FROM events)"
ORDER = "PARTITION BY k ORDER BY ts, seq"


@query("WITH " + E + f", s AS (SELECT *, CASE WHEN v >= 12 THEN 1 WHEN v < 8 OR v IS NULL THEN 0 END st FROM e), g AS (SELECT *, count(st) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) grp FROM s) SELECT seq, coalesce(max(st) OVER (PARTITION BY k, grp), 0) = 1 active FROM g")
def str01_hysteresis(spark, sf_dir):
    return stateful.hysteresis(keyed_events(spark, sf_dir)).select("seq", "active")


@query("WITH RECURSIVE " + E + f", n AS (SELECT k, seq, ts, row_number() OVER ({ORDER}) i FROM e), f AS (SELECT k, i, seq, ts, ts last, true kept FROM n WHERE i = 1 UNION ALL SELECT n.k, n.i, n.seq, n.ts, CASE WHEN n.ts - f.last >= 60000 THEN n.ts ELSE f.last END, n.ts - f.last >= 60000 FROM f JOIN n ON n.k = f.k AND n.i = f.i + 1) SELECT seq FROM f WHERE kept")
def str03_throttle(spark, sf_dir):
    """At most one event a minute."""
    return stateful.throttle(keyed_events(spark, sf_dir), 60_000.0).select("seq")


@query("WITH " + E + f", s AS (SELECT *, CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END step FROM e), c AS (SELECT *, sum(step) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) r FROM s), o AS (SELECT *, r - least(0, min(r) OVER ({ORDER} ROWS UNBOUNDED PRECEDING)) op FROM c), l AS (SELECT *, op > 0 loading, coalesce(lag(op > 0) OVER ({ORDER}), false) was FROM o) SELECT seq, loading FROM l WHERE loading <> was")
def str05_in_flight(spark, sf_dir):
    steps = keyed_events(spark, sf_dir).withColumn("step", F.when(F.col("seq") % 2 == 0, 1).otherwise(-1))
    return stateful.in_flight(steps).select("seq", "loading")


@query("WITH RECURSIVE " + E + f", n AS (SELECT k, seq, v, row_number() OVER ({ORDER}) i FROM e), f AS (SELECT k, i, seq, coalesce(v, 0) * 0.4::DOUBLE m FROM n WHERE i = 1 UNION ALL SELECT n.k, n.i, n.seq, f.m * 0.6::DOUBLE + coalesce(n.v, 0) * 0.4::DOUBLE FROM f JOIN n ON n.k = f.k AND n.i = f.i + 1) SELECT seq, round(m, 6) ema FROM f")
def win05_moving_average(spark, sf_dir):
    rows = keyed_events(spark, sf_dir).withColumn("radius_px", F.coalesce("radius_px", F.lit(0.0)))
    return stateful.moving_average(rows, "radius_px", block=16).select("seq", F.round("ema", 6).alias("ema"))


@query("WITH RECURSIVE " + E + f", n AS (SELECT k, seq, v, ts, row_number() OVER ({ORDER}) i FROM e), f AS (SELECT k, i, seq, ts, coalesce(v, 0) * 0.4::DOUBLE m FROM n WHERE i = 1 UNION ALL SELECT n.k, n.i, n.seq, n.ts, f.m * 0.6::DOUBLE + coalesce(n.v, 0) / greatest(n.ts - f.ts, 1) * 0.4::DOUBLE FROM f JOIN n ON n.k = f.k AND n.i = f.i + 1) SELECT seq, round(m, 9) ema FROM f")
def win05_speed(spark, sf_dir):
    """Changes by the time they took."""
    rows = keyed_events(spark, sf_dir).withColumn("radius_px", F.coalesce("radius_px", F.lit(0.0)))
    return stateful.moving_average(rows, "radius_px", per="ts").select("seq", F.round("ema", 9).alias("ema"))


@query("WITH " + E + f" SELECT seq, max(v) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) peak FROM e")
def win09_running_peak(spark, sf_dir):
    return stateful.running_peak(keyed_events(spark, sf_dir), "radius_px").select("seq", "peak")


@query("WITH " + E + " SELECT seq FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY ts DESC, seq DESC) i FROM e) WHERE i <= 400")
def win10_last_events(spark, sf_dir):
    return stateful.last_events(keyed_events(spark, sf_dir), 400, key="event_type").select("seq")


@query("WITH " + E + f" SELECT seq, CAST(sum(seq % 1000) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) total, seq % 1000 delta FROM e")
def win11_byte_counter(spark, sf_dir):
    return stateful.byte_counter(keyed_events(spark, sf_dir).withColumn("bytes", F.col("seq") % 1000)).select("seq", "total", "delta")


@query("WITH " + E + ", r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY ts DESC, seq DESC) i FROM e), l AS (SELECT t, count(*) n, list_sort(list(v) FILTER (WHERE v IS NOT NULL)) a, count(v) c FROM r WHERE i <= 30 GROUP BY 1) SELECT t event_type, n, a[CAST(floor(0.5 * (c - 1)) AS BIGINT) + 1] first_p50, a[CAST(floor(0.5 * (c - 1)) AS BIGINT) + 1] * 2 total_p50, a[CAST(floor(0.9 * (c - 1)) AS BIGINT) + 1] * 2 total_p90 FROM l")
def agg29_latency(spark, sf_dir):
    rows = keyed_events(spark, sf_dir).withColumns({"first_ms": F.col("radius_px"), "total_ms": F.col("radius_px") * 2})
    return requests.latency_quantiles(rows, order=("ts", "seq"))


@query("WITH " + E + ", w AS (SELECT t g, seq, v, seq % 5 = 0 live, seq % 97 = 0 sel FROM e WHERE v IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY CASE WHEN sel THEN 'inf'::DOUBLE WHEN live THEN v * 1.25::DOUBLE ELSE v END DESC, lpad(CAST(seq AS VARCHAR), 12, '0')) place FROM w) SELECT g, seq, CAST(place AS INTEGER) place FROM o WHERE place <= 5")
def srt03_top_models(spark, sf_dir):
    rows = keyed_events(spark, sf_dir).where(F.col("radius_px").isNotNull())
    state = rows.select(F.col("event_type").alias("view"), "seq", "radius_px", F.lpad(F.col("seq").cast("string"), 12, "0").alias("slug"), (F.col("seq") % 5 == 0).alias("live"), (F.col("seq") % 97 == 0).alias("selected"), F.lit(True).alias("wanted"))
    return stateful.top_models(state, 5).select(F.col("view").alias("g"), "seq", "place")


RETRIES = "WITH RECURSIVE " + E + f""", n AS (SELECT k, ts, seq % 3 = 0 bad, row_number() OVER ({ORDER}) i FROM e),
 f AS (SELECT k, i, ts, CASE WHEN bad THEN 1 ELSE 0 END r, CASE WHEN bad THEN ts + 1000 ELSE '-inf'::DOUBLE END due, bad made, 1000.0::DOUBLE wait FROM n WHERE i = 1
 UNION ALL SELECT n.k, n.i, n.ts, CASE WHEN NOT bad AND n.ts >= f.due THEN 0 WHEN bad AND n.ts >= f.due AND f.r < 8 THEN f.r + 1 ELSE f.r END, CASE WHEN bad AND n.ts >= f.due AND f.r < 8 THEN n.ts + least(30000.0, 1000 * pow(2, f.r)) ELSE f.due END,
 bad AND n.ts >= f.due AND f.r < 8, least(30000.0, 1000 * pow(2, f.r))::DOUBLE FROM f JOIN n ON n.k = f.k AND n.i = f.i + 1)
 SELECT k "key", ts, wait wait_ms, due due_ms, CAST(r AS INTEGER) round FROM f WHERE made"""


@query(RETRIES)
def str02_retries(spark, sf_dir):
    """Retries of failing keys."""
    return stateful.retries(keyed_events(spark, sf_dir).withColumn("failed", F.col("seq") % 3 == 0))


def streamed(spark, sf_dir, flag, rule, schema: str):
    """What a streaming rule gives for the events, read as a stream of files and written as Parquet; the watermark is the latest time."""
    kinds = table(spark, sf_dir, "events").schema
    # a pattern, as a stream's path may not be a single file
    source = spark.readStream.schema(kinds).parquet(f"{sf_dir}/events.parquet*")
    rows = source.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), flag).withWatermark("ts", "0 seconds")
    folder = scratch(spark, "stream")
    with rules.on_rocksdb(spark):
        rules.resumable(rows, rule, f"{folder}/out", f"{folder}/state")
    return spark.read.schema(schema).parquet(f"{folder}/out")


@query(RETRIES.replace("""SELECT k "key", ts, wait wait_ms, due due_ms, CAST(r AS INTEGER) round FROM f WHERE made""", """SELECT k "key", due due_ms, CAST(r AS INTEGER) round FROM f WHERE made AND due <= (SELECT floor(max(ts)) FROM e)"""))
def str02_retries_stream(spark, sf_dir):
    """Retries that have come due by the end of the stream."""
    return streamed(spark, sf_dir, (F.col("event_id") % 3 == 0).alias("failed"), rules.retries, "key long, due_ms double, round int")


@query("WITH " + E + f""", s AS (SELECT *, seq % 3 = 0 loading FROM e), c AS (SELECT *, coalesce(lag(loading) OVER ({ORDER}), false) was FROM s), d AS (SELECT k, ts, loading FROM c WHERE loading <> was),
 n AS (SELECT *, lead(ts) OVER (PARTITION BY k ORDER BY ts) stop FROM d), w AS (SELECT floor(max(ts)) m FROM e)
 SELECT k "key", ts + 1200 at_ms, true shown FROM n, w WHERE loading AND (stop IS NULL OR stop - ts > 1200) AND ts + 1200 <= m
 UNION ALL SELECT k, stop, false FROM n, w WHERE loading AND stop - ts > 1200 AND stop <= m""")
def str04_notices_stream(spark, sf_dir):
    """Notices of loading that lasts, and their ends."""
    return streamed(spark, sf_dir, (F.col("event_id") % 3 == 0).alias("loading"), rules.loading_notices, "key long, at_ms double, shown boolean")


@query("WITH " + E + " SELECT k, count(*) n, min(v) lo, max(v) hi FROM e GROUP BY 1")
def agg01_box_by_key(spark, sf_dir):
    return cells.bounding_box(keyed_events(spark, sf_dir), "radius_px", by=("key",)).select(F.col("key").alias("k"), "n", F.col("min_radius_px").alias("lo"), F.col("max_radius_px").alias("hi"))

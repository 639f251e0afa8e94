"""Requests to the tile store as a table, answered by one projection and one window."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orograph.functions import quantiles as Q
from orograph.functions import web


def answer(requests: DataFrame, objects: DataFrame, allowed=(), preview: str | None = None) -> DataFrame:
    """Adds ``status, content_type, cache_control, range, cors`` to requests (method, path, origin, range_header, if_none_match); objects: key, size, stored_type, etag."""
    rows = requests.join(objects, F.substring("path", 2, 1 << 30) == F.col("key"), "left")
    status = web.status("method", "path", F.col("key").isNotNull(), "range_header", "size", "if_none_match", "etag")
    part = web.byte_range("range_header", "size")["text"]
    rows = rows.withColumn("status", status)
    ok = F.col("status").isin(200, 206, 304)
    cache = F.when(ok, web.cache_policy("path")).when((F.col("status") == 404) & web.bad_path("path"), web.SHORT_CACHE).when(F.col("status") == 404, web.MISSING_CACHE)
    return rows.withColumns({"content_type": F.when(ok, web.content_type("path", "stored_type")), "cache_control": cache, "range": F.when(F.col("status") == 206, part), "cors": F.when(web.is_allowed_origin("origin", allowed, preview), F.col("origin"))})


def edge_cache(answers: DataFrame, order="req_id") -> DataFrame:
    """Adds ``x_cache``: the first whole answer to a versioned path is a MISS and is kept, later ones are HITs whatever their query; the rest
    is not kept. HEAD asks but does not store."""
    kept = web.is_versioned("path") & F.col("range_header").isNull() & F.col("status").isin(200, 304)
    stores = kept & (F.col("method") == "GET") & (F.col("status") == 200)
    # the first store of each path decides, so a busy path is reduced before it moves and no task sorts its requests
    first = answers.where(stores).groupBy(F.col("path").alias("__path")).agg(F.min(order).alias("__first"))
    rows = answers.join(first, F.col("path") == F.col("__path"), "left")
    hit = kept & F.coalesce(F.col(order) > F.col("__first"), F.lit(False))
    return rows.withColumn("x_cache", F.when(hit, "HIT").when((F.col("method") == "GET") & F.col("status").isin(200, 206), "MISS")).drop("__path", "__first")


def get_object(objects: DataFrame) -> DataFrame:
    """Adds ``body`` to rows with content (binary), range_header, etag, if_none_match: the part that is asked for; null if the tag is known."""
    size = F.octet_length("content").cast("long")
    r = web.byte_range("range_header", size)
    part = F.when(r.isNotNull(), F.substring(F.col("content"), (r["start"] + 1).cast("int"), r["length"].cast("int"))).otherwise(F.col("content"))
    return objects.withColumn("body", F.when(F.col("if_none_match").eqNullSafe(F.col("etag")) & F.col("etag").isNotNull(), None).otherwise(part))


def latency_quantiles(events: DataFrame, by="event_type", order=("ts", "event_id"), first="first_ms", total="total_ms", last: int = 30) -> DataFrame:
    """Of the last requests of each kind: count, the median to the first byte, median and p90 in total (floor ranks)."""
    w = Window.partitionBy(by).orderBy(*(F.col(c).desc() for c in order))
    recent = events.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= last)
    return recent.groupBy(by).agg(F.count(F.lit(1)).alias("n"), Q.floor_rank(first, 0.5).alias("first_p50"), Q.floor_rank(total, 0.5).alias("total_p50"), Q.floor_rank(total, 0.9).alias("total_p90"))


def resumed(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a log of finished work does not have yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")

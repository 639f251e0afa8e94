"""Exact dedup as a stateful stream.

Every document sends one small event ``(digest, doc_id, locator)``. A Structured Streaming aggregation keyed by the digest
keeps, in the RocksDB state store and with neither watermark nor expiry, how many rows had the text, the largest id and the
locator of that row. Spark merges events of a key before the shuffle, so a text that is a third of all rows reaches its
state as one row from each task. On hits (a digest with two rows or more) the full bytes are compared with the
keeper's, which the locator and the identifier find; where they differ, the digest's rows are grouped by their bytes instead.

Defined results: a null text is the empty text, and empty texts are copies of each other. Of equal texts the largest id
stays; where that id itself is repeated, every row with the id is reported and ``drop_copies`` keeps one of them. A null id
sorts below all others. Extra columns are carried by ``drop_copies`` whatever their names. An empty table gives no rows.
"""

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .shared import each, materialise, own_names, scratch_dir, small_batches, with_verdicts

STORE = "spark.sql.streaming.stateStore"
#: Native memory of all state partitions on an executor together, however many there are; a partition's files are closed and go from the executor when
#: its task has committed to the checkpoint.
STATE_CONF = {
    f"{STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STORE}.rocksdb.boundedMemoryUsage": "true", f"{STORE}.rocksdb.maxMemoryUsageMB": "128", f"{STORE}.rocksdb.writeBufferSizeMB": "4",
    f"{STORE}.unloadOnCommit": "true",
}


@F.arrow_udf(BinaryType())
def normal_bytes(text: pa.Array) -> pa.Array:
    """UTF-8 bytes with A-Z lower-cased (bytes.lower changes no others); null counts as empty."""
    return pa.array([(x or b"").lower() for x in each(text.cast(pa.binary()))], pa.binary())


@F.arrow_udf(BinaryType())
def normal_digest(text: pa.Array) -> pa.Array:
    """SHA-256 of the normal bytes."""
    return pa.array([hashlib.sha256((x or b"").lower()).digest() for x in each(text.cast(pa.binary()))], pa.binary())


class DedupState:
    """The keyed state of a dedup stream. ``feed`` holds the events, ``checkpoint`` the stream's progress and state,
    ``updates`` what each micro-batch changed; all live in the shared folder, so a later run with the same folder goes on from there."""

    def __init__(self, spark, folder: str | None = None, max_bytes_per_trigger: int = 64 << 30):
        self.spark, self.folder, self.limit = spark, folder or scratch_dir(spark, "dedup"), max_bytes_per_trigger

    def ingest(self, schema) -> None:
        """Runs every event file below ``feed`` that was not seen yet through the stream."""
        spark = self.spark
        before = {k: spark.conf.get(k, None) for k in STATE_CONF}
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        try:
            seen = (
                spark.readStream.schema(schema).option("maxBytesPerTrigger", self.limit).parquet(f"{self.folder}/feed/*")
                .groupBy("digest")
                .agg(F.max(F.struct("doc_id", "locator")).alias("best"), F.count(F.lit(1)).alias("n"))
            )
            query = (
                seen.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/checkpoint")
                .trigger(availableNow=True)
                .foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{self.folder}/updates/batch={k}"))
                .start()
            )
            query.awaitTermination()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    def table(self, schema) -> DataFrame:
        """One row for each digest: ``digest, keep_id, keep_locator, group_size`` as the last micro-batch left it."""
        kind = f"digest binary, best struct<doc_id:{schema['doc_id'].dataType.simpleString()},locator:{schema['locator'].dataType.simpleString()}>, n bigint, batch bigint"
        rows = self.spark.read.schema(kind).parquet(f"{self.folder}/updates")
        return rows.groupBy("digest").agg(F.max("best").alias("best"), F.max("n").alias("group_size")).select(
            "digest", F.col("best.doc_id").alias("keep_id"), F.col("best.locator").alias("keep_locator"), "group_size")


def dedup_decisions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", locator=None, folder: str | None = None, contents: DataFrame | None = None, digest=normal_digest) -> DataFrame:
    """``doc_id, locator, keep_id, keep_locator, group_size, kept, text_sha256`` for every row of docs.

    locator: a column that tells where a row's content lies (a file's path, say), by default the id.
    folder: that of an earlier run to go on from; its texts then count as rows that came before, and ``contents`` (doc_id, locator, text) is
    where the bytes of keepers from there are read; a hit whose keeper isn't found stands by its digest."""
    spark = docs.sparkSession
    place = (F.col(doc_id) if locator is None else locator).alias("locator")
    events = docs.select(digest(text).alias("digest"), F.col(doc_id).alias("doc_id"), place)
    state = DedupState(spark, folder)
    feed = f"{state.folder}/feed/{uuid.uuid4().hex}"
    with small_batches(spark):
        events.write.parquet(feed)
    schema = spark.read.parquet(feed).schema
    state.ingest(schema)
    table = materialise(state.table(schema), "state")
    decided = with_verdicts(spark.read.schema(schema).parquet(feed), table, "digest", "group_size").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    texts = docs.select(F.col(doc_id).alias("doc_id"), place, F.col(text).alias("t"))
    odd = materialise(differing(texts, decided, contents, digest).select("digest").distinct(), "clashes")
    if not odd.isEmpty():
        decided = decided.join(odd, "digest", "left_anti").unionByName(by_bytes(texts, odd, digest))
    return decided.select("doc_id", "locator", "keep_id", "keep_locator", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def differing(texts: DataFrame, decided: DataFrame, contents: DataFrame | None = None, digest=normal_digest) -> DataFrame:
    """``digest, doc_id`` of hits whose full normalised bytes are not those of their keeper. Only the texts of groups get to the comparison. A
    group's copies are dealt over as many keys as its share of all rows asks for (1024 at most), and its keeper goes to each of them."""
    hits = decided.where("group_size > 1").select(F.col("doc_id").alias("hit"), F.col("locator").alias("at"), F.col("digest").alias("of"), "kept", "group_size").distinct()
    found = lambda rows: rows.join(hits.hint("shuffle_hash"), rows["doc_id"].eqNullSafe(hits["hit"]) & rows["locator"].eqNullSafe(hits["at"])).where(digest("t") == F.col("of"))
    own = found(texts).select("of", "hit", "kept", "group_size", normal_bytes("t").alias("t"))
    total = decided.count() or 1
    spread = F.greatest(F.lit(1), F.ceil(F.col("group_size") * 1024 / total)).cast("int")
    keepers = own.where("kept").select("of", "t", "group_size")
    if contents is not None:
        earlier = decided.where("group_size > 1").select(F.col("keep_id").alias("k"), F.col("keep_locator").alias("l"), F.col("digest").alias("of"), "group_size").distinct()
        known = contents.select("doc_id", "locator", F.col("text").alias("t"))
        known = known.join(earlier, known["doc_id"].eqNullSafe(earlier["k"]) & known["locator"].eqNullSafe(earlier["l"])).where(digest("t") == F.col("of"))
        keepers = keepers.unionByName(known.select("of", normal_bytes("t").alias("t"), "group_size"))
    keepers = keepers.dropDuplicates(["of"]).select("of", F.col("t").alias("keeper_text"), F.explode(F.sequence(F.lit(0), spread - 1)).alias("part"))
    copies = own.where("not kept").withColumn("part", F.pmod(F.xxhash64("hit"), spread).cast("int"))
    return copies.join(keepers, ["of", "part"]).where("t != keeper_text").select(F.col("of").alias("digest"), F.col("hit").alias("doc_id"))


def by_bytes(texts: DataFrame, odd: DataFrame, digest=normal_digest) -> DataFrame:
    """Decisions for the rows of digests that stand for several texts, by the texts themselves."""
    rows = texts.withColumn("digest", digest("t")).join(odd, "digest", "left_semi").select("digest", "doc_id", "locator", normal_bytes("t").alias("bytes"))
    best = rows.groupBy("digest", "bytes").agg(F.max(F.struct("doc_id", "locator")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(best, ["digest", "bytes"]).select(
        "digest", "doc_id", "locator", F.col("best.doc_id").alias("keep_id"), F.col("best.locator").alias("keep_locator"), "group_size", F.col("doc_id").eqNullSafe(F.col("best.doc_id")).alias("kept"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; of a repeated row one stays."""
    sha, name, of, n = own_names(docs.columns, "sha_of", "kept_id", "kept_sha", "rows_of")
    made = docs.withColumn(sha, F.lower(F.hex(normal_digest(text))))
    kept = dedup_decisions(docs, doc_id, text).where("kept").groupBy(F.col("doc_id").alias(name), F.col("text_sha256").alias(of)).agg(F.count(F.lit(1)).alias(n))
    kept = materialise(kept, "keepers")
    rest = made.join(kept, made[doc_id].eqNullSafe(kept[name]) & (made[sha] == kept[of]))
    if not kept.where(F.col(n) > 1).isEmpty():
        rest = rest.dropDuplicates([name, of])
    return rest.select(*(docs[c] for c in docs.columns))

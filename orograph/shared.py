"""What iterating and numbering operators share: checkpoints, and scans of an order that is cut into ranges."""

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

#: Columns of a frame that ``ranged`` has made.
RANGE, TIE = "__range", "__tie"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Where that is unset, a local master gets a temp folder; a cluster gets
    an error, as no other folder is known to be shared."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="orograph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20):
    """Contents of files are long: jobs within pass at most so many rows and about so many bytes at a time to and from Python. The session's own limits are back
    afterwards."""
    limits = {f"spark.sql.execution.arrow.{k}": v for k, v in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size))}
    before = {k: spark.conf.get(k) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def up_to(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def small(df: DataFrame) -> DataFrame:
    """A table of a proven bound by way of the driver, so that a plan that uses it doesn't make it again."""
    return F.broadcast(df.sparkSession.createDataFrame(df.toArrow(), df.schema))


def _columns(order) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


class Ranges:
    """A frame in order (within groups ``by``), cut into as many ranges as Spark has shuffle partitions, for any number of scans.

    Each row has the number of its range, and a hash of all its columns that tells rows apart which are equal by order; so only rows that are
    equal in all columns have to be in one range. A group is in several ranges only where ranges meet: what must be known of other
    ranges is a table of two rows for each range at most, which is broadcast, and no row moves for it. Give it the columns that are needed, as
    all are written once."""

    def __init__(self, df: DataFrame, order, by=()):
        self.order, self.by = _columns(order), list(by)
        ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        hashed = [f.name for f in df.schema.fields if not isinstance(f.dataType, MapType)]
        rows = df.withColumn(TIE, F.xxhash64(*(F.col(f"`{c}`") for c in hashed)))
        self.rows = settled(rows.repartitionByRange(ranges, *self.by, *self.order, TIE).withColumn(RANGE, F.spark_partition_id()))
        #: The rows of groups that are in several ranges.
        self.shared = self.rows
        if self.by:
            group, met = F.struct(*self.by), Window.orderBy(RANGE)
            edges = self.rows.groupBy(RANGE).agg(F.min(group).alias("lo"), F.max(group).alias("hi"))
            first, last = (F.when(F.col(c).eqNullSafe(f(o).over(met)), F.col(c)) for c, f, o in (("lo", F.lag, "hi"), ("hi", F.lead, "lo")))
            edges = edges.select(F.col(RANGE).alias("__of"), F.array(first, last).alias("g")).select("__of", F.explode("g").alias("g")).where("g is not null").distinct()
            edges = small(edges.select("__of", *(F.col(f"g.`{c}`").alias(f"__of_{c}") for c in self.by)))
            self.shared = self.rows.join(edges, self._same(self.rows, edges), "left_semi")

    def _same(self, rows: DataFrame, table: DataFrame) -> Column:
        same = rows[RANGE] == table["__of"]
        for c in self.by:
            same = same & rows[c].eqNullSafe(table[f"__of_{c}"])
        return same

    def within(self) -> WindowSpec:
        """A range's rows of a group in order."""
        return Window.partitionBy(RANGE, *self.by).orderBy(*self.order, TIE)

    def add(self, **columns: Column) -> "Ranges":
        """With columns that a row has by itself, or by windows over ``within``."""
        self.rows, self.shared = self.rows.withColumns(columns), self.shared.withColumns(columns)
        return self

    def drop(self, *names: str) -> "Ranges":
        self.rows, self.shared = self.rows.drop(*names), self.shared.drop(*names)
        return self

    def carried(self, ends: dict[str, Column], carry: Callable[[WindowSpec], dict[str, Column]]) -> "Ranges":
        """With what is known before a row's range. ends: aggregates that tell what a whole range of a group does. carry(w): columns by windows over the
        group's ranges up to the one before; null in its first."""
        known = self.shared.groupBy(RANGE, *self.by).agg(*(c.alias(n) for n, c in ends.items()))
        before = carry(Window.partitionBy(*self.by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1))
        known = small(known.select(F.col(RANGE).alias("__of"), *(F.col(c).alias(f"__of_{c}") for c in self.by), *(c.alias(n) for n, c in before.items())))
        names = ["__of", *(f"__of_{c}" for c in self.by)]
        self.rows, self.shared = (x.join(known, self._same(x, known), "left").drop(*names) for x in (self.rows, self.shared))
        return self

    def total(self, value: Column, name: str) -> "Ranges":
        """With the sum of values up to each row; nulls don't count."""
        self.add(__scan_v=value).add(__scan_sum=F.sum("__scan_v").over(up_to(self.within())))
        self.carried({"__scan_end": F.sum("__scan_v")}, lambda w: {"__scan_before": F.sum("__scan_end").over(w)})
        none = F.lit(0).cast(self.rows.schema["__scan_sum"].dataType)
        return self.add(**{name: F.coalesce("__scan_before", none) + F.coalesce("__scan_sum", none)}).drop("__scan_v", "__scan_sum", "__scan_before")

    def latest(self, value: Column, name: str, before: bool = False) -> "Ranges":
        """With the last value up to each row that isn't null; before: up to the row before it."""
        w = self.within()
        self.add(__scan_v=value).add(__scan_last=F.last("__scan_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1 if before else 0)), __scan_k=F.row_number().over(w))
        self.carried({"__scan_end": F.max(F.when(F.col("__scan_v").isNotNull(), F.struct("__scan_k", "__scan_v")))["__scan_v"]}, lambda w: {"__scan_before": F.last("__scan_end", ignorenulls=True).over(w)})
        return self.add(**{name: F.coalesce("__scan_last", "__scan_before")}).drop("__scan_v", "__scan_last", "__scan_k", "__scan_before")

    def peak(self, value: Column, name: str) -> "Ranges":
        """With the greatest value up to each row; nulls don't count."""
        self.add(__scan_v=value).add(__scan_best=F.max("__scan_v").over(up_to(self.within())))
        self.carried({"__scan_end": F.max("__scan_v")}, lambda w: {"__scan_before": F.max("__scan_end").over(w)})
        return self.add(**{name: F.greatest("__scan_best", "__scan_before")}).drop("__scan_v", "__scan_best", "__scan_before")

    def frame(self) -> DataFrame:
        return self.rows.drop(RANGE, TIE)


def numbered(df: DataFrame, order, name: str = "number", by=()) -> DataFrame:
    """Adds each row's place in the order of the whole table, or of its group ``by``, from 0."""
    return running(df, order, F.lit(1), name, by).withColumn(name, F.col(name) - 1)


def running(df: DataFrame, order, weight, name: str = "running", by=()) -> DataFrame:
    """Adds the sum of weights up to each row in the order of the whole table, or of its group ``by``; rows that are equal by order come in any order.

    Ranges of the order are added up each by itself, then moved by the sums of the ranges before: no task sorts more than a range,
    however large a group is."""
    return Ranges(df, order, by).total(weight, name).frame()

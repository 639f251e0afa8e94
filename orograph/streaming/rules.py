"""The stateful rules as Structured Streaming operators: keyed state in the state store, timers where a rule waits.

Every operator takes a streaming DataFrame with ``key, ts (timestamp), seq`` and returns one; within a micro-batch a key's events are handled
in the order of (ts, seq). State is a few numbers a key. Events must not be later than the watermark the caller sets. ``retries`` and ``loading_notices``
wait for the watermark, so order across micro-batches doesn't matter to them; the others take batches as they come."""

import contextlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _ordered(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(["ts", "seq"])


def hysteresis(events: DataFrame, on: float = 12.0, off: float = 8.0, value: str = "radius_px") -> DataFrame:
    """Changes of activity: ``key, ts, seq, active``, only when it changes."""
    kind = events.schema["key"].dataType.simpleString()

    def run(key, parts, state: GroupState):
        active = state.get[0] if state.exists else False
        out = []
        for r in _ordered(parts).itertuples():
            size = getattr(r, value)
            if not getattr(r, "visible", True):
                now = False
            elif getattr(r, "selected", False):
                now = True
            elif not getattr(r, "in_view", True) or size is None or size != size:
                now = False
            else:
                now = size >= (off if active else on)
            if now != active:
                out.append((key[0], r.ts, r.seq, now))
            active = now
        state.update((active,))
        yield pd.DataFrame(out, columns=["key", "ts", "seq", "active"])

    return events.groupBy("key").applyInPandasWithState(run, f"key {kind}, ts timestamp, seq long, active boolean", "active boolean", "append", GroupStateTimeout.NoTimeout)


def throttle(events: DataFrame, least_ms: int = 400) -> DataFrame:
    """The first event, and those at least ``least_ms`` behind the last kept one."""
    kind = events.schema["key"].dataType.simpleString()

    def run(key, parts, state: GroupState):
        last = state.get[0] if state.exists else None
        out = []
        for r in _ordered(parts).itertuples():
            t = int(r.ts.timestamp() * 1000)
            if last is None or t - last >= least_ms:
                out.append((key[0], r.ts, r.seq))
                last = t
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "ts", "seq"])

    return events.groupBy("key").applyInPandasWithState(run, f"key {kind}, ts timestamp, seq long", "last_ms long", "append", GroupStateTimeout.NoTimeout)


class _InOrder(StatefulProcessor):
    """A rule over a key's events in the order of time, however they come: list state holds them until the watermark has passed them, a timer then hands
    them to ``step`` by (ms, seq). ``passed`` adds what time alone brings, ``alarm`` is when it next does. Memory is one tuple a key; what a key has
    between two watermarks is in a worker's memory when it is due."""

    waits: str
    remembers: str
    first: tuple
    gives: list[str]

    def step(self, memory: tuple, row: tuple, out: list) -> tuple:
        raise NotImplementedError

    def passed(self, memory: tuple, now: float, out: list) -> tuple:
        return memory

    def alarm(self, memory: tuple) -> float | None:
        return None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waits)
        self.memory = handle.getValueState("memory", self.remembers)

    def handleInputRows(self, key, rows, timerValues):
        least = math.inf
        for pdf in rows:
            new = list(zip(*(pdf[c].tolist() for c in ("ms", "nr", "flag")), strict=True))
            self.waiting.appendList(new)
            least = min(least, *(r[0] for r in new), math.inf)
        if least < math.inf:
            self.handle.registerTimer(math.ceil(least))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, out = timerValues.getCurrentWatermarkInMs(), []
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in rows if r[0] <= now]
        memory = tuple(self.memory.get()) if self.memory.exists() else self.first
        for row in due:
            memory = self.step(memory, tuple(row), out)
        memory = self.passed(memory, now, out)
        self.memory.update(memory)
        if due:
            self.waiting.clear()
            if len(due) < len(rows):
                self.waiting.put([tuple(r) for r in rows[len(due) :]])
        ahead = [t for t in (rows[len(due)][0] if len(due) < len(rows) else None, self.alarm(memory)) if t is not None]
        if ahead:
            self.handle.registerTimer(max(math.ceil(min(ahead)), now + 1))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["key", *self.gives])

    def close(self) -> None:
        pass


class _Retries(_InOrder):
    waits, remembers, first, gives = "ms double, seq long, failed boolean", "round int, due double, sent boolean", (0, -math.inf, True), ["due_ms", "round"]

    def __init__(self, most: int, first_ms: float, most_ms: float):
        self.most, self.first_ms, self.most_ms = most, first_ms, most_ms

    def step(self, memory, row, out):
        round_, due, sent = self.passed(memory, row[0], out)
        if sent and not row[2]:
            round_ = 0
        elif sent and round_ < self.most:
            due, round_, sent = row[0] + min(self.most_ms, self.first_ms * 2.0**round_), round_ + 1, False
        return round_, due, sent

    def passed(self, memory, now, out):
        round_, due, sent = memory
        if not sent and due <= now:
            out.append((due, round_))
            sent = True
        return round_, due, sent

    def alarm(self, memory):
        return None if memory[2] else memory[1]


class _Notices(_InOrder):
    waits, remembers, first, gives = "ms double, seq long, loading boolean", "since double, shown boolean", (None, False), ["at_ms", "shown"]

    def __init__(self, wait_ms: float):
        self.wait_ms = wait_ms

    def step(self, memory, row, out):
        since, shown = memory
        # what ends at the very moment at which the notice would come is not shown
        if since is not None and not shown and row[0] > since + self.wait_ms:
            out.append((since + self.wait_ms, True))
            shown = True
        if row[2]:
            return (row[0] if since is None else since), shown
        if shown:
            out.append((row[0], False))
        return None, False

    def passed(self, memory, now, out):
        since, shown = memory
        if since is not None and not shown and since + self.wait_ms <= now:
            out.append((since + self.wait_ms, True))
            shown = True
        return since, shown

    def alarm(self, memory):
        return None if memory[0] is None or memory[1] else memory[0] + self.wait_ms


def _in_order(events: DataFrame, flag: str, rule: _InOrder, schema: str) -> DataFrame:
    kind = events.schema["key"].dataType.simpleString()
    rows = events.select("key", "ts", (F.unix_micros("ts") / 1000).alias("ms"), F.col("seq").cast("long").alias("nr"), F.coalesce(flag, F.lit(False)).alias("flag"))
    return rows.groupBy("key").transformWithStateInPandas(rule, f"key {kind}, {schema}", "Append", "EventTime")


def retries(events: DataFrame, most: int = 8, first_ms: float = 1000.0, most_ms: float = 30000.0) -> DataFrame:
    """Retries due: ``key, due_ms, round``, sent when their time has come by the watermark. Needs a watermark on ts and the RocksDB state store (``on_rocksdb``);
    events may come in any order within the watermark. The rule is ``stateful.retries``."""
    return _in_order(events, "failed", _Retries(most, first_ms, most_ms), "due_ms double, round int")


def loading_notices(changes: DataFrame, wait_ms: float = 1200.0) -> DataFrame:
    """Notices of loading that lasts: ``key, at_ms, shown``; true ``wait_ms`` after loading began if it goes on, by the watermark, and false when it ends. Events
    have ``loading``; needs what ``retries`` needs."""
    return _in_order(changes, "loading", _Notices(wait_ms), "at_ms double, shown boolean")


@contextlib.contextmanager
def on_rocksdb(spark: SparkSession):
    """Streams started within keep their state in RocksDB; the session's own setting comes back."""
    name, own = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, own)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def in_flight(events: DataFrame) -> DataFrame:
    """Changes of whether a key is loading, from steps of +1 and -1: ``key, ts, seq, loading``."""
    kind = events.schema["key"].dataType.simpleString()

    def run(key, parts, state: GroupState):
        n = state.get[0] if state.exists else 0
        out = []
        for r in _ordered(parts).itertuples():
            new = max(0, n + int(r.step))
            if (new > 0) != (n > 0):
                out.append((key[0], r.ts, r.seq, new > 0))
            n = new
        state.update((n,))
        yield pd.DataFrame(out, columns=["key", "ts", "seq", "loading"])

    return events.groupBy("key").applyInPandasWithState(run, f"key {kind}, ts timestamp, seq long, loading boolean", "n long", "append", GroupStateTimeout.NoTimeout)


def request_timings(events: DataFrame, window: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Count, bytes and mean times of requests by window and kind, with a watermark."""
    rows = events.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.avg("first_ms").alias("first_ms"), F.avg("total_ms").alias("total_ms"))


def resumable(source: DataFrame, work, sink: str, checkpoint: str):
    """Runs ``work`` (DataFrame to DataFrame) over what a file source has that no earlier run with the same checkpoint has finished, and
    appends the results as Parquet. Returns the ended query."""
    query = work(source).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query

"""Rules that remember, over a key's events in order (columns ``key, ts, seq``): batch scans. ``streaming.rules`` has the same rules for streams.

What a row gets depends on all rows of its key before it. Each rule is written as something that a whole range of rows does (a sum, the
last decision, the greatest value since a reset, an affine step), so ranges are scanned each by itself and what is known before a range is put
in front (``orograph.shared.Ranges``): a key that holds a third of all rows is many tasks. Where each step needs the last one's outcome and no such form
exists (``throttle``, ``retries``), a fold walks through one session of a key, cut where the rule provably starts anew."""

import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from orograph.shared import RANGE, TIE, Ranges, up_to

ON_PX, OFF_PX, LIVE_BONUS = 12.0, 8.0, 1.25
#: Events of a key that are folded at a time.
BLOCK = 4096


def with_sessions(events: DataFrame, gap: float, key="key", order=("ts", "seq"), also: Column | None = None) -> DataFrame:
    """Adds ``session``: a number that goes up at an event ``gap`` or more behind the one before (and for which ``also`` holds)."""
    rows = Ranges(events, order, [key]).latest(F.col(order[0]), "__prev", before=True)
    new = F.col(order[0]) - F.col("__prev") >= gap
    new = new if also is None else new & also
    return rows.total(F.coalesce(new.cast("long"), F.lit(0)), "session").drop("__prev").frame()


def hysteresis(events: DataFrame, on: float = ON_PX, off: float = OFF_PX, key="key", value="radius_px", order=("ts", "seq")) -> DataFrame:
    """Adds ``active``: on at ``on`` or more, off below ``off``, as before between; selected always on, hidden or out of view off.

    What an event does is decided by itself except in between, where the last decision holds: so it is the last decision so far."""
    value = F.col(value)
    has = {c: F.col(c) if c in events.columns else F.lit(d) for c, d in (("visible", True), ("selected", False), ("in_view", True))}
    sets = F.when(~has["visible"], False).when(has["selected"], True).when(~has["in_view"], False).when(value >= on, True).when((value < off) | value.isNull() | F.isnan(value), False)
    return Ranges(events, order, [key]).latest(sets, "active").frame().withColumn("active", F.coalesce("active", F.lit(False)))


def top_models(state: DataFrame, k: int, group="view", radius="radius_px") -> DataFrame:
    """The k of a view that may live: wanted ones by size on screen, the selected one first, those alive counting a quarter more; ties by slug."""
    weight = F.when(F.col("selected"), float("inf")).otherwise(F.col(radius) * F.when(F.col("live"), LIVE_BONUS).otherwise(1.0))
    w = Window.partitionBy(group).orderBy(weight.desc(), "slug")
    return state.where("wanted").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def throttle(events: DataFrame, least: float, key="key", order=("ts", "seq")) -> DataFrame:
    """Keeps an event if the last kept one is ``least`` or more before it. An event that is so far behind the one before is kept whatever was kept, so
    it starts a session."""
    def start():
        last = None

        def step(row):
            nonlocal last
            if last is None or row[1] - last >= least:
                last = row[1]
                yield row

        return step

    kinds = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in (key, *order))
    cut = with_sessions(events.select(key, *order), least, key, order)
    kept = _in_sessions(cut, key, order, (key, *order), start, kinds).withColumnsRenamed({c: f"__{c}" for c in (key, *order)})
    same = F.lit(True)
    for c in (key, *order):
        same = same & events[c].eqNullSafe(kept[f"__{c}"])
    return events.join(kept, same, "left_semi")


def _in_sessions(cut: DataFrame, key, order, columns, start, schema: str) -> DataFrame:
    """What a fold gives for the rows of each session in order: ``start()`` makes the fold of one session, a function from a row's columns to rows. Sessions
    are dealt over the tasks, each task walks through its sorted rows batch by batch and holds one session's state."""
    typed = to_arrow_schema(_parse_datatype_string(schema))
    at = len(columns)

    def run(batches):
        now = step = None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[at:] != now:
                    now, step = row[at:], start()
                out += step(row[:at])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * len(typed), typed, strict=True)], schema=typed)

    rows = cut.repartition(key, "session").sortWithinPartitions(key, "session", *order)
    return rows.select(*columns, F.col(key).alias("__key"), "session").mapInArrow(run, schema)


def moving_average(events: DataFrame, value: str, weight: float = 0.4, key="key", order=("ts", "seq"), name: str = "ema", per: str | None = None, block: int = BLOCK) -> DataFrame:
    """Adds ``v = (1 - weight) v + weight x`` from 0 on; per: a column whose growth since the event before (1 at least) divides x, as a change divides by its time.

    A block of so many events turns a start v into ``left * v + end``, where end is its fold from 0 and left what remains of v. So a block's start is a sum over the
    blocks before it, of which only so many count until left has gone below what a double holds: a bounded window."""
    rows = Ranges(events, order, [key]).total(F.lit(1).cast("long"), "__n")
    x = F.col(value).cast("double")
    if per is not None:
        rows.latest(F.col(per).cast("double"), "__per", before=True)
        x = x / F.greatest(F.coalesce(F.col(per) - F.col("__per"), F.lit(1.0)), F.lit(1.0))
    rows = rows.frame().withColumns({"__x": x, "__b": F.floor((F.col("__n") - 1) / block)}).withColumnRenamed("__n", "__k").drop("__per")
    blocks = rows.groupBy(key, "__b").agg(F.array_sort(F.collect_list(F.struct(F.col("__k").alias("k"), F.col("__x").alias("x")))).alias("items"))
    fold = F.aggregate("items", F.lit(0.0), lambda v, i: v * (1 - weight) + i["x"] * weight)
    left = (1 - weight) ** block
    count = 1 if left < 1e-320 else 1_000_000 if left >= 1 else math.ceil(math.log(1e-320) / math.log(left))
    # all blocks but a key's last are full
    ends = blocks.select(F.col(key).alias("__key"), (F.col("__b") + 1).alias("__next"), fold.alias("end"))
    before = F.collect_list("end").over(Window.partitionBy("__key").orderBy("__next").rowsBetween(1 - count, 0))
    starts = ends.select("__key", "__next", F.aggregate(before, F.lit(0.0), lambda v, e: v * left + e).alias("start"))
    met = blocks.join(starts, blocks[key].eqNullSafe(starts["__key"]) & (blocks["__b"] == starts["__next"]), "left")

    @F.pandas_udf("array<double>")
    def folded(values: pd.Series, start: pd.Series) -> pd.Series:
        def one(xs, v):
            out = []
            for x in xs:
                v = v * (1 - weight) + x * weight
                out.append(v)
            return out

        return pd.Series([one(xs, v) for xs, v in zip(values, start, strict=True)])

    found = met.select(blocks[key].alias("__key"), F.transform("items", lambda i: i["k"]).alias("k"), folded(F.transform("items", lambda i: i["x"]), F.coalesce("start", F.lit(0.0))).alias("v"))
    found = found.select("__key", F.explode(F.arrays_zip("k", "v")).alias("z")).select("__key", F.col("z.k").alias("__of"), F.col("z.v").alias(name))
    return rows.join(found, rows[key].eqNullSafe(found["__key"]) & (rows["__k"] == found["__of"])).drop("__k", "__b", "__x", "__key", "__of")


def decay(v: Column | float, frame_ms: float = 16.0, time_ms: float = 180.0, least: float = 0.02, most: int = 10_000) -> Column:
    """Column of the speeds of a motion that runs out: array of v * exp(-k dt / tau) while they are ``least`` or more, ``most`` at most."""
    v = v if isinstance(v, Column) else F.lit(float(v))
    # the last frame at which the speed is enough, and one more for rounding
    frames = F.floor(F.log(F.abs(v) / least) * (time_ms / frame_ms)) + 1
    k = F.when(F.abs(v) >= least, F.sequence(F.lit(1), F.least(F.greatest(frames, F.lit(1)), F.lit(most)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(k, lambda i: v * F.exp(-i * frame_ms / time_ms)), lambda x: F.abs(x) >= least)


def running_peak(events: DataFrame, value: str, key="key", order=("ts", "seq"), reset: str | None = None, name: str = "peak") -> DataFrame:
    """Adds the greatest value so far, since the last event that reads and resets it.

    A range with resets starts anew behind its last one, whatever came before: its end is how many resets it has and the peak since the last."""
    rows = Ranges(events, order, [key])
    if reset is None:
        return rows.peak(F.col(value), name).frame()
    rows.add(__v=F.col(value), __r=F.coalesce(F.col(reset).cast("long"), F.lit(0)))
    # how many resets a range has had before a row
    rows.add(__part=F.coalesce(F.sum("__r").over(rows.within().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows.add(__best=F.max("__v").over(up_to(Window.partitionBy(RANGE, key, "__part").orderBy(*order, TIE))))
    # the greatest part has what follows the range's last reset
    after = F.struct((F.col("__part") + F.col("__r")).alias("part"), F.when(F.col("__r") == 0, F.col("__v")).alias("v"))
    ends = {"__resets": F.sum("__r"), "__end": F.max(after)["v"]}

    def carry(w):
        # the ranges since the last that has resets, that one included
        all_ = F.collect_list(F.struct("__resets", "__end")).over(w)
        step = lambda s, e: F.when(e["__resets"] > 0, e["__end"]).otherwise(F.greatest(s, e["__end"]))
        return {"__before": F.aggregate(all_, F.lit(None).cast(events.schema[value].dataType), step)}

    best = F.when(F.col("__part") == 0, F.greatest("__best", "__before")).otherwise(F.col("__best"))
    return rows.carried(ends, carry).add(**{name: best}).drop("__v", "__r", "__part", "__best", "__before").frame()


def last_events(events: DataFrame, n: int = 3000, key="key", order=("ts", "seq")) -> DataFrame:
    """Each key's n last events. Tasks keep n of a key before any row moves (a rank with a limit)."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    return events.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def byte_counter(events: DataFrame, key="key", order=("ts", "seq"), size="bytes") -> DataFrame:
    """Adds ``total`` so far and ``delta`` since the event before."""
    rows = Ranges(events, order, [key]).total(F.coalesce(size, F.lit(0)), "total").frame()
    return rows.withColumn("delta", F.coalesce(F.col(size).cast(rows.schema["total"].dataType), F.lit(0)))


def in_flight(events: DataFrame, key="key", order=("ts", "seq"), step="step") -> DataFrame:
    """Changes of whether a key is loading: rows where the count of open requests (steps of +1 and -1, never below 0) goes from or to 0.

    The count floored at 0 is the running sum less its lowest value so far, if that is below 0. A range's end is its sum and its lowest prefix."""
    rows = Ranges(events, order, [key])
    rows.add(__s=F.sum(step).over(up_to(rows.within()))).add(__low=F.min("__s").over(up_to(rows.within())))

    def carry(w):
        both = F.aggregate(
            F.collect_list(F.struct("__sum", "__least")).over(w), F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("low")),
            lambda a, e: F.struct((a["s"] + e["__sum"]).alias("s"), F.least(a["low"], a["s"] + e["__least"]).alias("low")))
        return {"__before": both}

    rows.carried({"__sum": F.sum(step).cast("long"), "__least": F.min("__s").cast("long")}, carry)
    s0, low0 = F.coalesce(F.col("__before.s"), F.lit(0)), F.coalesce(F.col("__before.low"), F.lit(0))
    rows.add(open=s0 + F.col("__s") - F.least(F.lit(0), low0, s0 + F.col("__low"))).drop("__s", "__low", "__before").add(loading=F.col("open") > 0)
    found = rows.latest(F.col("loading"), "__was", before=True).frame()
    return found.where(F.col("loading") != F.coalesce("__was", F.lit(False))).drop("__was")


def retry_schedule(rounds: int = 8, first_s: float = 1.0, most_s: float = 30.0) -> list[float]:
    return [min(most_s, first_s * 2**k) for k in range(rounds)]


def retries(events: DataFrame, most: int = 8, key="key", order=("ts", "seq"), failed="failed", first_ms: float = 1000.0, most_ms: float = 30000.0) -> DataFrame:
    """``key, ts, wait_ms, due_ms, round``: a retry for a failure if none is pending and fewer than ``most`` were made in a row; waits double. An event
    that isn't a failure, when all before it have been retried, starts the count anew."""
    def start():
        round_, due = 0, float("-inf")

        def step(row):
            nonlocal round_, due
            k, t, bad = row
            if not bad:
                if t >= due:
                    round_ = 0
            elif t >= due and round_ < most:
                wait = min(most_ms, first_ms * 2**round_)
                round_, due = round_ + 1, t + wait
                yield k, float(t), wait, due, round_

        return step

    # an event that isn't a failure, as far behind the one before as the longest wait, finds nothing pending: the count starts anew there
    cut = with_sessions(events.select(key, *order, failed), most_ms, key, order, also=~F.col(failed))
    return _in_sessions(cut, key, order, (key, order[0], failed), start, f"{key} {events.schema[key].dataType.simpleString()}, ts double, wait_ms double, due_ms double, round int")


def loading_notices(changes: DataFrame, wait_ms: float = 1200.0, key="key", ts="ts") -> DataFrame:
    """Of changes (loading true or false in turn): the times at which loading has lasted ``wait_ms``; null end means still loading."""
    # from the last change to the first, what comes next is what was last
    order = [F.col(ts).desc()]
    rows = Ranges(changes.select(key, ts, "loading"), order, [key]).latest(F.col(ts), "__end", before=True).frame().where("loading")
    return rows.where(F.col("__end").isNull() | (F.col("__end") - F.col(ts) > wait_ms)).select(key, (F.col(ts) + wait_ms).alias("notice_at"), F.col("__end").alias("until"))


def last_failures(events: DataFrame, n: int = 5, failed="failed", order=("ts", "seq")) -> DataFrame:
    """The last n failures, latest first."""
    return events.where(F.col(failed)).orderBy(*(F.col(c).desc() for c in order)).limit(n)

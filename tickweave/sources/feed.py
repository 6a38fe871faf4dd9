"""The live feed as a data source of its own: which ticks are due, with offsets.

The source hands out due slots, one per tick, sampling interval and group of bindings;
Spark joins them to the bindings of that interval and group and draws the readings. An
offset is a tick, so a restarted stream goes on where it stopped, and a range of ticks
gives the same readings whichever way it was cut into batches.
"""

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tickweave.functions.scalars import interval_ticks
from tickweave.operators.generate import GRID_BLOCK, drawn_readings, with_stem
from tickweave.schemas import LONG, struct

SLOT_ROWS = 1 << 16         # slots in one Arrow batch
MAX_INTERVALS = 1000        # intervals with slots of their own
_SLOTS = struct(every=LONG, slot_group=LONG, tick=LONG)
_RUNS = struct(every=LONG, slot_group=LONG, tick=LONG, last=LONG)


class _Groups(InputPartition):
    """A range of groups of bindings, over a range of ticks; both ends are exclusive."""

    def __init__(self, groups: tuple[int, int], ticks: tuple[int, int]):
        self.groups, self.ticks = groups, ticks


class _Due:
    """What batch and stream reader share."""

    def __init__(self, options: dict):
        get = lambda name, default: int(options.get(name, default))
        self.first, self.groups = get("first", 0), get("groups", 1)
        self.tasks = max(1, min(self.groups, get("tasks", self.groups)))
        self.end = get("end", -1) if "end" in options else None
        self.origin_ms, self.ms_per_tick = 1000 * get("origin_s", 0), get("ms_per_tick", 60_000)
        self.run = get("run", 1)
        self.intervals = sorted({int(x) for x in options.get("intervals", "1").split(",")})
        if self.intervals[0] < 1:
            raise ValueError("an interval has one tick at least")
        if self.run < 1:
            raise ValueError("a run has one slot at least")
        self.names = (_RUNS if "run" in options else _SLOTS).names

    def over(self, start: int, stop: int) -> list[_Groups]:
        if start >= stop:
            return []
        cuts = [self.groups * i // self.tasks for i in range(self.tasks + 1)]
        return [_Groups((a, b), (start, stop)) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition: _Groups) -> Iterator[pa.RecordBatch]:
        start, stop = partition.ticks
        for every in self.intervals:
            due = self.first + -(-(start - self.first) // every) * every      # the first one not before start
            final, step = stop - 1 - (stop - 1 - due) % every, every * self.run
            while due < stop:
                ticks = np.arange(due, min(stop, due + step * SLOT_ROWS), step, dtype=np.int64)
                ends = np.minimum(ticks + (step - every), final)
                for group in range(*partition.groups):
                    row = [pa.array(np.full(len(ticks), x, np.int64)) for x in (every, group)] + [pa.array(ticks), pa.array(ends)]
                    yield pa.RecordBatch.from_arrays(row[:len(self.names)], self.names)
                due += step * SLOT_ROWS


class _BatchReader(_Due, DataSourceReader):
    def partitions(self) -> list[_Groups]:
        if self.end is None:
            raise ValueError("reading a feed as a table needs its last tick, 'end'")
        return self.over(self.first, self.end + 1) or [_Groups((0, 0), (0, 0))]


class _StreamReader(_Due, DataSourceStreamReader):
    """Offsets are the next tick. Without ``end`` the clock says what is due."""

    def initialOffset(self) -> dict:
        return {"tick": self.first}

    def latestOffset(self) -> dict:
        now = (time.time_ns() // 1_000_000 - self.origin_ms) // self.ms_per_tick
        return {"tick": max(self.first, (now if self.end is None else self.end) + 1)}

    def partitions(self, start: dict, end: dict) -> list[_Groups]:
        return self.over(start["tick"], end["tick"])


class DueSlots(DataSource):
    """``every``, ``slot_group`` and ``tick`` of all slots that are due.

    Options: ``first`` (the tick from which intervals count), ``end`` (inclusive; a stream
    without it follows the clock), ``intervals`` (comma-separated ticks), ``groups``,
    ``tasks``, ``origin_s``, ``ms_per_tick``. With ``run``, a row is a run of up to that
    many due slots from ``tick`` to ``last``, ``every`` ticks apart.
    """

    @classmethod
    def name(cls) -> str:
        return "due_slots"

    def schema(self) -> T.StructType:
        return _RUNS if "run" in self.options else _SLOTS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _BatchReader(self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def feed(spark: SparkSession, bound: DataFrame, seed: int, first: int = 0, end: int | None = None, ms_per_tick: int = 60_000,
         origin_s: int = 0, groups: int | None = None, stream: bool = False, max_intervals: int = MAX_INTERVALS) -> DataFrame:
    """Readings of the bound profiles that are due from ``first`` to ``end``, as a table or as a stream.

    Equal to ``generate_readings`` over the same ticks, with ``event_ts`` added. PERIODIC
    bindings (no ``mode`` counts as such) are due every interval, all others on every tick.
    The ``max_intervals`` most frequent intervals have slots of their own, so that only due
    ones meet a binding; bindings with any other interval look through the slots of every
    tick. A stream joins ``bound`` anew in each micro-batch: write it to a table before.
    """
    groups = groups or int(spark.conf.get("spark.sql.shuffle.partitions"))
    column = lambda name, otherwise: F.col(name) if name in bound.columns else F.lit(otherwise)
    periodic = F.coalesce(column("mode", "PERIODIC"), F.lit("PERIODIC")) == "PERIODIC"
    every = F.when(periodic, F.coalesce(interval_ticks(column("interval_ms", None).cast("double"), ms_per_tick), F.lit(1))).otherwise(1)
    timed = bound.withColumn("_every", every.cast("bigint"))
    frequent = timed.groupBy("_every").count().orderBy(F.desc("count"), "_every").limit(max_intervals + 1).collect()
    own = [r["_every"] for r in frequent[:max_intervals]]
    others = len(frequent) > max_intervals
    slotted = with_stem(timed, seed).withColumn("every", F.when(F.col("_every").isin(own), F.col("_every")).otherwise(1).cast("bigint")).withColumn(
        "slot_group", F.pmod(F.xxhash64("device_id", "measure_name"), F.lit(groups)))

    spark.dataSource.register(DueSlots)
    options = {"first": first, "groups": groups, "run": GRID_BLOCK, "origin_s": origin_s, "ms_per_tick": ms_per_tick,
               "intervals": ",".join(map(str, {*own, *([1] if others else [])} or {1}))}
    if end is not None:
        options["end"] = end
    slots = (spark.readStream if stream else spark.read).format("due_slots").options(**options).load()
    # bindings meet runs of slots, which are few; only then, dealt to a fixed number of tasks
    # that AQE must not merge for being small, they grow by up to GRID_BLOCK
    runs = slots.join(slotted, ["every", "slot_group"]).repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "device_id", "measure_name", "tick")
    grid = runs.withColumn("tick", F.explode(F.sequence("tick", "last", "every"))).drop("last")
    if others:
        grid = grid.where(F.pmod(F.col("tick") - first, F.col("_every")) == 0)
    at = F.timestamp_millis(F.lit(1000 * origin_s) + F.col("tick") * ms_per_tick)
    return drawn_readings(grid.drop("every", "slot_group", "_every"), seed).withColumn("event_ts", at)

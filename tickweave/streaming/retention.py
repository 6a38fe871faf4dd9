"""Age-based retention of a stream's readings, with regular purges."""

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickweave.schemas import LONG, struct

# Ticks a reading is kept, and ticks between purges. Fixed values.
MAX_AGE, EVERY = 5_000, 1_000

_GROUP = struct(_group=LONG, purged_at=LONG)


class _Store(StatefulProcessor):
    """The readings that leave together: stored until their purge is due, then handed out and cleared."""

    def __init__(self, columns: T.StructType, origin_s: int, ms_per_tick: int):
        self.columns, self.origin_ms, self.ms_per_tick = columns, origin_s * 1000, ms_per_tick

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getListState("stored", self.columns)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*_GROUP.names, *self.columns.names], dtype=object)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            values = pdf[self.columns.names].astype(object)
            self.stored.appendList(list(values.where(values.notna(), None).itertuples(index=False, name=None)))
        self.handle.registerTimer(self.origin_ms + int(key[1]) * self.ms_per_tick)
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = [(*key, *r) for r in self.stored.get()]
        self.stored.clear()
        yield self._frame(rows)

    def close(self) -> None:
        pass


def purge_tick(tick, max_age: int = MAX_AGE, every: int = EVERY):
    """The first purge at which a reading is older than ``max_age``."""
    return ((F.floor((tick + max_age) / F.lit(every)) + 1) * every).cast("bigint")


def purged(df: DataFrame, origin_s: int, ms_per_tick: int, max_age: int = MAX_AGE, every: int = EVERY,
           columns: Sequence[str] = ("device_id", "measure_name", "tick", "event_id", "value"),
           spread: int = 64) -> DataFrame:
    """Readings as they leave the store, with the tick of the purge.

    For a stream with a watermark on ``event_ts``. A purge at every ``every``-th tick takes
    out what is older than ``max_age``; it happens when the watermark passes it. Spark's own
    time to live counts processing time, which replays differently, so timers on event
    time do this. A reading's stay depends on its own tick alone, so readings are dealt by a
    hash of their id, not by key: a hot key is spread like all others, and ``spread`` should
    be a few times the number of cores. State holds at most what arrives in
    ``max_age + every`` ticks and the watermark's delay.
    """
    at = purge_tick(F.col("tick"), max_age, every)
    slim = df.select(
        F.pmod(F.xxhash64("event_id", "tick"), F.lit(spread)).alias("_group"), at.alias("purged_at"), "event_ts", *columns)
    stored = T.StructType([T.StructField(c, df.schema[c].dataType) for c in columns])
    return slim.groupBy(*_GROUP.names).transformWithStateInPandas(
        statefulProcessor=_Store(stored, origin_s, ms_per_tick), outputStructType=T.StructType(_GROUP.fields + stored.fields),
        outputMode="append", timeMode="EventTime").drop("_group")

"""Dead-band, threshold crossing, declared arrival modes and row windows with keyed state.

Readings of a key are held back until the watermark passes them, then handled in
(tick, event_id) order. This makes the result equal to the batch operators
whatever the order of arrival; readings later than the watermark are dropped by it.
The held-back list is bounded by the rate of a key times the watermark's delay.
"""

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessorHandle

from tickweave.functions.scalars import interval_ticks
from tickweave.operators.transmit import INITIAL_VALUE, LOST, SENT, SUPPRESSED, periodic, survives
from tickweave.schemas import BOOL, DOUBLE, LONG, STR, TIER_NAMES, struct
from tickweave.streaming.buckets import InBuckets, OfKey, by_bucket

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_HELD = struct(event_ms=LONG, tick=LONG, event_id=LONG, value=DOUBLE, survive=BOOL)
_ONE_VALUE = struct(value=DOUBLE)
_VALUES = struct(values=T.ArrayType(DOUBLE))
_SENT_FIELDS = struct(tick=LONG, event_id=LONG, value=DOUBLE)
_MEAN_FIELDS = struct(tick=LONG, event_id=LONG, mean_value=DOUBLE)
_PROFILE_FIELDS = struct(mode=STR, threshold=DOUBLE)
_LABELLED_FIELDS = struct(tick=LONG, event_id=LONG, value=DOUBLE, mode=STR, status=STR)
_STATUS = (SUPPRESSED, LOST, SENT)
_LOOK = 64      # readings that are looked at together first
_MOVE_FIELDS = struct(tick=LONG, event_id=LONG, from_value=DOUBLE, to_value=DOUBLE)


def configure(spark) -> None:
    """Keyed state needs the RocksDB store; it also keeps large state off the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class _InOrder(InBuckets):
    """Fold each key's readings in order, once the watermark has passed them."""

    def __init__(self, key_names: Sequence[str]):
        self.key_names = list(key_names)

    def due(self, ready: pa.Table, wait: pa.Table) -> Iterator[pd.DataFrame]:
        columns = [ready[c].to_pylist() for c in (*self.key_names, *_HELD.names)]
        n, out = len(self.key_names), []
        for key, rows in groupby(zip(*columns), key=lambda r: r[:n]):
            self.key = key
            out += [(*key, *r) for r in self.fold([r[n:] for r in rows])]
        # object columns: pandas' own string columns may not convert to one Arrow array
        yield pd.DataFrame(out, columns=self.columns(), dtype=object)

    def of_key(self, handle: StatefulProcessorHandle, name: str, value: T.StructType, many: bool = False) -> OfKey:
        """A state of each key, for ``fold``."""
        return OfKey(handle.getMapState(name, self.key_type, value), lambda: self.key, many)

    def fold(self, rows: list) -> list[tuple]:
        raise NotImplementedError

    def columns(self) -> list[str]:
        return [*self.key_names, "tick", "event_id", "value"]


class _Gate(_InOrder):
    """Deliver a reading if it passes against the last delivered value."""

    def __init__(self, key_names, mode: str, threshold: float):
        super().__init__(key_names)
        self.mode, self.threshold = mode, threshold

    def setup(self, handle) -> None:
        self.last = self.of_key(handle, "last", _ONE_VALUE)

    def fold(self, rows):
        stored = self.last.get()
        last, out = (stored[0] if stored else None), []
        for _, tick, event_id, value, survive in rows:
            if value is None or not survive:
                continue
            if self.mode == "ON_CHANGE":
                passes = last is None or abs(value - last) >= self.threshold
            else:
                side = (0.0 if last is None else last) >= self.threshold
                passes = (value >= self.threshold) != side
            if passes:
                last = value
                out.append((tick, event_id, value))
        if out:
            self.last.update((last,))
        return out


class _Rows(_InOrder):
    """Mean over the n most recent readings, for every reading; a null value takes its place among them."""

    def __init__(self, key_names, n: int):
        super().__init__(key_names)
        self.n = n

    def setup(self, handle) -> None:
        self.recent = self.of_key(handle, "recent", _VALUES, many=True)

    def columns(self):
        return [*self.key_names, "tick", "event_id", "mean_value"]

    def fold(self, rows):
        recent = [r[0] for r in self.recent.get()]
        out = []
        for _, tick, event_id, value, survive in rows:
            if not survive:
                continue
            recent = [*recent, value][-self.n:]
            given = [v for v in recent if v is not None]
            out.append((tick, event_id, sum(given) / len(given) if given else None))
        if out:
            self.recent.put([(v,) for v in recent])
        return out


class _Moves(_InOrder):
    """Tier changes: the value column carries the tier's number."""

    def setup(self, handle) -> None:
        self.last = self.of_key(handle, "last", _ONE_VALUE)

    def columns(self):
        return [*self.key_names, "tick", "event_id", "from_value", "to_value"]

    def fold(self, rows):
        stored = self.last.get()
        last, out = (stored[0] if stored else 0.0), []
        for _, tick, event_id, value, _ in rows:
            if value != last:
                out.append((tick, event_id, last, value))
            last = value
        if rows:
            self.last.update((last,))
        return out


def thinned(value: np.ndarray, ok: np.ndarray, mode: str, threshold: float, last: float | None) -> tuple[np.ndarray, float | None]:
    """Codes (2 sent, 1 lost, 0 suppressed) of a key's readings in order, and the value that the next one is compared with.

    A missing value (NaN) is never delivered. ON_CHANGE jumps from one reading that differs
    enough to the next; between them nothing is looked at one by one. ON_THRESHOLD compares
    with the last surviving reading, which is on the same side as the last delivered one.
    """
    code = np.zeros(len(value), np.int8)
    given = ~np.isnan(value)
    if mode == "ON_THRESHOLD":
        side, usable = value >= threshold, ok & given
        before = np.concatenate(([-1], np.maximum.accumulate(np.where(usable, np.arange(len(value)), -1))))
        start = (INITIAL_VALUE if last is None else last) >= threshold
        sides = np.where(before[:-1] >= 0, side[before[:-1]], start)
        code[given & (side != sides)] = 1
        code[(code == 1) & ok] = 2
        return code, float(value[before[-1]]) if before[-1] >= 0 else last
    i, size = 0, _LOOK
    while i < len(value):
        part = value[i:i + size]
        hit = given[i:i + size] if last is None else np.abs(part - last) >= threshold
        k = int(hit.argmax())
        if not hit[k]:
            i, size = i + len(part), 2 * size
            continue
        code[i + k] = 1 + int(ok[i + k])
        last = float(part[k]) if ok[i + k] else last
        i, size = i + k + 1, _LOOK
    return code, last


class _Declared(_InOrder):
    """Label a key's readings by its profile, that of its latest reading so far."""

    def setup(self, handle) -> None:
        self.last = self.of_key(handle, "last", _ONE_VALUE)

    def due(self, ready, wait):
        names, n = [*self.key_names, *_PROFILE_FIELDS.names], len(self.key_names)
        self.profiles = {r[:n]: r[n:] for part in (ready, wait.sort_by("event_ms"))
                         for r in zip(*[part[c].to_pylist() for c in names])}
        yield from super().due(ready, wait)

    def columns(self):
        return [*self.key_names, "tick", "event_id", "value", "mode", "status"]

    def fold(self, rows):
        mode, threshold = self.profiles[self.key]
        stored = self.last.get()
        value = np.array([np.nan if r[3] is None else r[3] for r in rows], float)
        ok = np.array([bool(r[4]) for r in rows], bool)
        code, last = thinned(value, ok, mode, threshold, stored[0] if stored else None)
        if last is not None:
            self.last.update((last,))
        return [(r[1], r[2], r[3], mode, _STATUS[c]) for r, c in zip(rows, code.tolist())]


def transmit(df: DataFrame, ms_per_tick: int, seed: int, start: int = 0,
             keys: Sequence[str] = ("device_id", "measure_name")) -> DataFrame:
    """Label every reading sent, lost or suppressed by the arrival mode that its profile declares.

    As ``operators.transmit.transmit``, on a stream with a watermark on ``event_ts``: rows
    carry ``mode``, ``interval_ms``, ``threshold`` and ``failure``, as a join with the static
    table of profiles leaves them. Periodic readings, usually the bulk, need no state and go
    out at once; those that are not due are left out. Readings of the other modes wait for
    the watermark. A key's latest profile holds for all its readings that become due.
    """
    ok = survives(F.col("failure"), seed, (*keys, "tick", "event_id"))
    mode = F.coalesce("mode", F.lit("PERIODIC"))
    names = [*keys, "tick", "event_id", "value", "mode", "status"]
    due = periodic(df.filter(~mode.isin("ON_CHANGE", "ON_THRESHOLD")),
                   F.coalesce(interval_ticks(F.col("interval_ms"), ms_per_tick), F.lit(1)), start)
    due = due.withColumn("mode", mode).withColumn("status", F.when(ok, SENT).otherwise(LOST)).select(*names)
    stateful = df.filter(mode.isin("ON_CHANGE", "ON_THRESHOLD"))
    slim = stateful.select(
        *keys, "tick", "event_id", F.col("value").cast("double").alias("value"), "event_ts", F.unix_millis("event_ts").alias("event_ms"),
        F.coalesce(ok, F.lit(True)).alias("survive"), "mode", F.coalesce("threshold", F.lit(0.0)).cast("double").alias("threshold"))
    labelled = by_bucket(slim, keys, _Declared(keys), _LABELLED_FIELDS)
    return due.unionByName(labelled.select(*names))


def _run(df: DataFrame, processor: _InOrder, fields: T.StructType, survive) -> DataFrame:
    keys = processor.key_names
    slim = df.select(
        *keys, "tick", "event_id", "value", "event_ts",
        F.unix_millis("event_ts").alias("event_ms"),
        (F.lit(True) if survive is None else survive).alias("survive"),
    )
    return by_bucket(slim, keys, processor, fields)


def deadband(df: DataFrame, threshold: float, keys: Sequence[str] = ("device_id", "measure_name"),
             survive=None) -> DataFrame:
    """ON_CHANGE on a stream with a watermark on ``event_ts``."""
    return _run(df, _Gate(keys, "ON_CHANGE", threshold), _SENT_FIELDS, survive)


def crossing(df: DataFrame, threshold: float, keys: Sequence[str] = ("device_id", "measure_name"),
             survive=None) -> DataFrame:
    """ON_THRESHOLD on a stream with a watermark on ``event_ts``."""
    return _run(df, _Gate(keys, "ON_THRESHOLD", threshold), _SENT_FIELDS, survive)


def rolling_rows_mean(df: DataFrame, n: int, keys: Sequence[str] = ("device_id", "measure_name")) -> DataFrame:
    """Mean over the n most recent readings on a stream."""
    return _run(df, _Rows(keys, n), _MEAN_FIELDS, None)


def transitions(df: DataFrame, keys: Sequence[str] = ("device_id", "measure_name")) -> DataFrame:
    """Tier changes on a stream; before its first reading a device is NORMAL."""
    names = F.array(*[F.lit(t) for t in TIER_NAMES])
    code = (F.array_position(names, F.coalesce("tier", F.lit(TIER_NAMES[0]))) - 1).cast("double")
    moved = _run(df.withColumn("value", code), _Moves(keys),
                 _MOVE_FIELDS, None)
    name = lambda c: F.get(names, F.col(c).cast("int"))
    return moved.select(*keys, "tick", "event_id", name("from_value").alias("from_tier"),
                        name("to_value").alias("to_tier"))

"""Keyed state by buckets of keys.

Calls to the state store and frames for Arrow cost milliseconds each, so a group per key
makes a stream of many keys slow. Here keys are dealt to buckets by a hash and a bucket is
the group: its waiting readings are one list of chunks, handled together once the
watermark has passed them, and only the small state of each key is an entry of its own.
"""

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickweave.schemas import struct

# Part of what a checkpoint means, so a fixed number: several for each core of a large cluster.
BUCKETS = 1024

_CHUNK = struct(rows=T.BinaryType())


def by_bucket(df: DataFrame, keys: Sequence[str], processor: "InBuckets", fields: T.StructType) -> DataFrame:
    """Run ``processor`` over rows with ``event_ms``, ``tick`` and ``event_id``; its rows are the keys and ``fields``."""
    processor.key_type = T.StructType([df.schema[k] for k in keys])
    processor.stored = T.StructType([f for f in df.schema.fields if f.name not in ("event_ts", "_copy")])
    schema = T.StructType(processor.key_type.fields + fields.fields)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket")
    return df.select(bucket, "*").groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="EventTime")


class InBuckets(StatefulProcessor):
    """Hold readings back until the watermark passes them, then handle a bucket's in (keys, tick, event_id) order."""

    key_type: T.StructType
    stored: T.StructType

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _CHUNK)
        self.setup(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        oldest = []
        for frame in rows:
            if len(frame):
                self.held.appendValue((self._packed(self._table(frame)),))
                oldest.append(int(frame["event_ms"].min()))
        if oldest:
            # one timer for the oldest reading; it sets the next one when it fires
            self.handle.registerTimer(min(oldest) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        chunks = [pa.ipc.open_stream(bytes(c[0])).read_all() for c in self.held.get()]
        if not chunks:
            return
        held = pa.concat_tables(chunks)
        due = pc.less(held["event_ms"], timerValues.getCurrentWatermarkInMs())
        ready, wait = held.filter(due), held.filter(pc.invert(due))
        if not len(ready):      # handled by an earlier timer of this batch, which set the next one
            return
        if len(wait):
            self.held.put([(self._packed(wait),)])
            self.handle.registerTimer(pc.min(wait["event_ms"]).as_py() + 1)
        else:
            self.held.clear()
        order = [*self.key_type.names, "tick", "event_id"]
        yield from self.due(ready.sort_by([(c, "ascending") for c in order]), wait)

    def close(self) -> None:
        pass

    def _table(self, frame: pd.DataFrame) -> pa.Table:
        return pa.Table.from_pandas(frame[self.stored.names], to_arrow_schema(self.stored), preserve_index=False)

    @staticmethod
    def _packed(table: pa.Table) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return sink.getvalue().to_pybytes()

    def setup(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def due(self, ready: pa.Table, wait: pa.Table) -> Iterator[pd.DataFrame]:
        """The output of the readings that have become due; ``wait`` are those that stay."""
        raise NotImplementedError


class OfKey:
    """One key's entry in a bucket's map state, by the interface of a value or a list state of its own."""

    def __init__(self, entries, key: Callable[[], tuple], many: bool = False):
        self.entries, self.key, self.many = entries, key, many

    def get(self):
        found = self.entries.getValue(self.key())
        if self.many:
            return [] if found is None else [(v,) for v in found[0]]
        return None if found is None else tuple(found)

    def update(self, value: tuple) -> None:
        self.entries.updateValue(self.key(), value)

    def put(self, rows: list[tuple]) -> None:
        self.entries.updateValue(self.key(), ([r[0] for r in rows],))

"""Declared rules on a stream: any ``RuleSet``, chained to any depth, in one streaming query.

The levels of a rule set become stateful operators one behind the other. Readings carry
``event_ts`` with a watermark. A derived event's ``event_ts`` is the time at which it fires,
which is never before the end of what it was made of, so the watermark that Spark hands on
from one operator to the next holds for it too, and readings and derived events may be read
by one rule together.

Tumbling rules of one window are one streaming aggregation. Sliding, last-N and landmark
rules keep the rows of the open window (or running totals) of a key in its state and are
evaluated once the watermark has passed a reading, so late readings find their place. All
readings that become due at a time are evaluated together: the window of a reading is a
suffix of one block of rows, as long as the window, and a prefix of the next one, and both
come from running aggregates, so the cost of a reading doesn't depend on the window's length.

Each head's events go out once; where a later level reads a head, that level has its own
copy of the operators below it, so name the ``heads`` whose events are wanted. The copies are
numbered, as Spark would otherwise let them share a shuffle and lose sight of the watermark behind it.
"""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessorHandle

from tickweave.operators.aggregates import DEFAULT_VALUE, Agg
from tickweave.plans.rules import (
    Body, Rule, RuleSet, fired, source_rows, tumbling_branches, windowless,
)
from tickweave.schemas import DOUBLE, LONG
from tickweave.streaming.buckets import InBuckets, by_bucket

_COMBINE = {"sum": np.add, "count": np.add, "min": np.minimum, "max": np.maximum, "last": np.maximum}
_NOTHING = {"sum": 0.0, "count": 0.0, "min": np.inf, "max": -np.inf, "last": -1.0}
_STATES = {"avg": ("sum", "count"), "sum": ("sum", "count"), "count": ("count",), "min": ("min",), "max": ("max",), "last": ("last",)}


@dataclass(frozen=True)
class Clock:
    """What time a tick is."""

    origin_s: int = 0           # of tick 0, in seconds since the epoch
    tick_seconds: int = 60

    def time(self, tick: Column) -> Column:
        return F.timestamp_seconds(F.lit(self.origin_s) + tick * self.tick_seconds)

    def tick(self, time: Column) -> Column:
        return F.floor((F.unix_seconds(time) - self.origin_s) / self.tick_seconds).cast("bigint")


# windows of readings in order, as arrays

def running(values: np.ndarray, block: np.ndarray, combine: np.ufunc) -> np.ndarray:
    """Running aggregates within runs of equal ``block``, by doubling."""
    out, step = values.copy(), 1
    longest = int(np.diff(np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))).max(initial=0))
    while step < longest:
        same = block[step:] == block[:-step]
        out[step:] = np.where(same, combine(out[step:], out[:-step]), out[step:])
        step *= 2
    return out


def _state(kind: str, values: np.ndarray) -> np.ndarray:
    """The state of each single reading; a missing value adds nothing."""
    given = ~np.isnan(values)
    own = {"count": given.astype(float), "last": np.arange(len(values), dtype=float)}.get(kind, values)
    return np.where(given, own, _NOTHING[kind])


def window_states(kind: str, values: np.ndarray, block: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The state of the rows ``first`` to ``last`` for each reading; these lie in one block or in two neighbouring ones."""
    own, combine = _state(kind, values), _COMBINE[kind]
    prefix = running(own, block, combine)[last]
    suffix = running(own[::-1], block[::-1], combine)[::-1][first]
    return np.where(block[first] == block[last], prefix, combine(suffix, prefix))


def finished(agg: Agg, states: dict[str, np.ndarray], values: np.ndarray) -> np.ndarray:
    """An aggregate's values from the states of its input; DEFAULT_VALUE over no values."""
    s = states
    with np.errstate(invalid="ignore", divide="ignore"):
        out = {
            "avg": lambda: np.where(s["count"] > 0, s["sum"] / s["count"], DEFAULT_VALUE),
            "sum": lambda: s["sum"], "count": lambda: s["count"],
            "min": lambda: np.where(np.isfinite(s["min"]), s["min"], DEFAULT_VALUE),
            "max": lambda: np.where(np.isfinite(s["max"]), s["max"], DEFAULT_VALUE),
            "last": lambda: np.where(s["last"] >= 0, values[s["last"].astype(np.int64)], DEFAULT_VALUE),
        }[agg.func]()
    return out


class _RowWindows(InBuckets):
    """The aggregates of a sliding, last-N or landmark rule at every reading, in (tick, event_id) order.

    All keys of a bucket are worked on together: a block of rows never goes over a key's end.
    """

    def __init__(self, rule: Rule, body: Body, start: int):
        self.keys, self.window, self.size, self.start = list(rule.keys), rule.window, rule.size, start
        self.aggs = [*body.private, *body.means]
        self.inputs = list(dict.fromkeys(a.input for a in self.aggs))

    def setup(self, handle: StatefulProcessorHandle) -> None:
        # rows that a key's later windows still see, or, for a landmark, its totals so far
        if self.window == "landmark":
            fields = [T.StructField(f"{kind}_{i}", DOUBLE) for i in range(len(self.inputs)) for kind in _COMBINE]
        else:
            fields = [T.StructField("tick", T.ArrayType(LONG))] + [
                T.StructField(f"value_{i}", T.ArrayType(DOUBLE)) for i in range(len(self.inputs))]
        self.past = handle.getMapState("past", self.key_type, T.StructType(fields))

    def due(self, ready: pa.Table, wait: pa.Table) -> Iterator[pd.DataFrame]:
        """The due readings with their aggregates; then the state is what later readings need."""
        rows = list(zip(*[ready[k].to_pylist() for k in self.keys]))
        starts = [i for i, r in enumerate(rows) if i == 0 or r != rows[i - 1]]
        owners = [rows[i] for i in starts]
        owner = np.repeat(np.arange(len(starts)), np.diff([*starts, len(rows)]))
        tick = ready["tick"].to_numpy()
        values = {c: pc.fill_null(ready[c], np.nan).to_numpy() for c in self.inputs}
        if self.window == "landmark":
            results, fires = self._landmark(owners, owner, tick, values), slice(None)
        else:
            results = self._windows(owners, owner, tick, values)
            fires = tick - self.start >= self.size if self.window == "sliding" else slice(None)
        out = {k: pd.Series(ready[k].to_pylist(), dtype=object)[fires] for k in self.keys}
        out |= {c: ready[c].to_numpy()[fires] for c in ("tick", "event_id")}
        yield pd.DataFrame(out | {a.out: r[fires] for a, r in zip(self.aggs, results)})

    def _windows(self, owners: list[tuple], owner: np.ndarray, tick: np.ndarray, values: dict) -> list[np.ndarray]:
        past = [self.past.getValue(key) for key in owners]
        seen = [len(p[0]) if p else 0 for p in past]
        earlier = [p for p in past if p]
        # a key's past rows come right before its due ones
        owner = np.concatenate((np.repeat(np.arange(len(owners)), seen), owner))
        order = np.argsort(owner, kind="stable")
        owner, fresh = owner[order], order >= sum(seen)
        tick = np.concatenate([*[np.array(p[0], np.int64) for p in earlier], tick])[order]
        values = {c: np.concatenate([*[np.array(p[i + 1], float) for p in earlier], values[c]])[order]
                  for i, c in enumerate(self.inputs)}
        begin = np.searchsorted(owner, np.arange(len(owners) + 1))
        place = np.flatnonzero(fresh)
        if self.window == "rows":
            number = np.arange(len(owner)) - begin[owner]
            block, last = number // self.size, place
            first = np.maximum(place - self.size + 1, begin[owner[place]])
            keep = np.arange(len(owner)) >= begin[owner + 1] - (self.size - 1)
        else:
            block = tick // self.size - int(tick.min()) // self.size
            at = owner * (int(tick.max() - tick.min()) + self.size + 1) + tick      # windows of two keys lie apart
            last = np.searchsorted(at, at[place], "right") - 1          # peers of a tick see each other
            first = np.searchsorted(at, at[place] - self.size, "right")
            keep = tick > tick[begin[owner + 1] - 1] + 1 - self.size
        block = owner * (int(block.max()) + 1) + block
        for i, key in enumerate(owners):
            part = slice(begin[i], begin[i + 1])
            kept = keep[part]
            if kept.any():
                self.past.updateValue(key, tuple(x[part][kept].tolist() for x in (tick, *[values[c] for c in self.inputs])))
            elif past[i]:
                self.past.removeKey(key)
        return [finished(a, {k: window_states(k, values[a.input], block, first, last) for k in _STATES[a.func]},
                         values[a.input]) for a in self.aggs]

    def _landmark(self, owners: list[tuple], owner: np.ndarray, tick: np.ndarray, values: dict) -> list[np.ndarray]:
        at = owner * (int(tick.max() - tick.min()) + 1) + tick
        last = np.searchsorted(at, at, "right") - 1
        ends = np.searchsorted(owner, np.arange(len(owners)), "right") - 1
        nothing = [np.nan if kind == "last" else _NOTHING[kind] for _ in self.inputs for kind in _COMBINE]
        before = np.array([self.past.getValue(key) or nothing for key in owners], float)
        after, each = [], {}
        for i, column in enumerate(self.inputs):
            each[column] = {}
            for j, kind in enumerate(_COMBINE):
                old = before[:, i * len(_COMBINE) + j][owner]
                state = running(_state(kind, values[column]), owner, _COMBINE[kind])
                if kind == "last":      # here the value itself, as its row does not stay
                    state = np.where(state >= 0, values[column][state.astype(np.int64)], old)
                else:
                    state = _COMBINE[kind](state, old)
                each[column][kind] = state[last]
                after.append(state[ends])
        for key, totals in zip(owners, np.array(after).T.tolist()):
            self.past.updateValue(key, tuple(totals))

        def value(a: Agg):
            s = each[a.input]
            return np.where(np.isnan(s["last"]), DEFAULT_VALUE, s["last"]) if a.func == "last" else finished(a, s, s["sum"])

        return [value(a) for a in self.aggs]


def row_windows(rows: DataFrame, rule: Rule, body: Body, start: int = 0, copy: int = 0) -> DataFrame:
    """keys, tick, event_id and the aggregates of a sliding, last-N or landmark rule, once the watermark has passed a reading.

    In a query that holds the same operator twice, each needs a ``copy`` number of its own.
    """
    run = _RowWindows(rule, body, start)
    slim = rows.select(*rule.keys, "tick", "event_id", *[F.col(c).cast("double").alias(c) for c in run.inputs], "event_ts",
                       F.unix_millis("event_ts").alias("event_ms"), F.lit(copy).alias("_copy"))
    fields = T.StructType([T.StructField("tick", LONG), T.StructField("event_id", LONG)]
                          + [T.StructField(a.out, DOUBLE) for a in run.aggs])
    return by_bucket(slim, rule.keys, run, fields)


def check_order(rules: Sequence[Rule]) -> None:
    """A head that another rule reads must not fire before it is known: at its window's end, or at its reading."""
    read = {s.event_type for r in rules for s in r.sources}
    for r in rules:
        least = {"tumbling": r.size, "sliding": r.size - 1, "landmark": None}.get(r.window, 0)
        if r.head in read and r.fire_offset is not None and (least is None or r.fire_offset < least):
            raise ValueError(f"on a stream, {r.head!r} is read by a rule, but fires before its window has closed")


def stream_rules(rule_set: RuleSet, readings: DataFrame, clock: Clock = Clock(), heads: Sequence[str] | None = None) -> DataFrame:
    """The derived events of all rules (or of ``heads``), with ``event_ts``; write them in append mode.

    Equal to ``rule_set.run`` over the same readings, up to the watermark: a window's rules
    fire once the watermark has passed its end, a reading's once it has passed the reading.
    """
    mark = readings.schema["event_ts"].metadata
    if not mark:
        raise ValueError("readings need a watermark on event_ts")
    check_order(rule_set.rules)
    copies = count()

    def timed(derived: DataFrame) -> DataFrame:
        own = [c for c in derived.columns if c != "event_ts"]
        # the column is an event time as that of the readings, with the same watermark
        return derived.select(*own, clock.time(F.col("tick")).alias("event_ts", metadata=mark))

    def tumbling(events: DataFrame, rules: list[Rule]) -> DataFrame:
        wanted, states, fired_heads = tumbling_branches(events, rules, digits=None)
        seconds = rules[0].size * clock.tick_seconds
        offset = (clock.origin_s + rule_set.start * clock.tick_seconds) % seconds
        bounds = F.window("event_ts", f"{seconds} seconds", f"{seconds} seconds", f"{offset} seconds")
        copy = next(copies)
        windows = events.filter(wanted).groupBy(*rules[0].keys, bounds.alias("window")).agg(
            *states, F.max(F.lit(copy)).alias("_copy")).where(F.col("_copy") == copy)
        windows = windows.withColumn("window_start", clock.tick(F.col("window.start"))).withColumn(
            "window_end", F.col("window_start") + rules[0].size)
        return timed(windows.select(*rules[0].keys, fired_heads))

    def by_row(events: DataFrame, rule: Rule) -> DataFrame:
        parts = []
        for source in rule.sources:
            rows, body = source_rows(events, source), rule.body(source)
            out = windowless(rows, body) if rule.window == "none" else row_windows(
                rows, rule, body, rule_set.start, next(copies))
            parts.append(timed(fired(out, rule, body, rule_set.start, None)))
        return reduce(DataFrame.unionByName, parts)

    return rule_set.evaluated(readings, tumbling, by_row, heads, shared=False)

"""The dead-band fold over sorted Arrow batches, and its composition over segments.

Rows arrive sorted by (key, segment, tick); ``_start`` marks the first row of each
run. A reading's successor is the first later one that differs from it by the limit.
All successors of a batch are found together (``first_hits``), and which readings
are delivered follows from doubling these jumps, so nothing goes reading by reading.

What a segment does to the last delivered value is a piecewise constant function of
it, with as many pieces as the segment has new extremes within twice the limit. Only
``2 * GROUPS`` pieces of it leave the task, each with the range of its results
(``segment_table``). Chaining them gives exact values or ranges; segments that a range
goes through are looked at again for that range alone, until all values are exact.
"""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tickweave.operators.segments import SEGMENT, Segments, join_segment_facts
from tickweave.schemas import BOOL, DOUBLE, struct

GROUPS = 128        # pieces of a segment's table on either side


def first_hits(value: np.ndarray, at: np.ndarray, last: np.ndarray, limit: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each query, the first position in [at, end) whose value differs from ``last`` by ``limit``, else ``end``.

    All queries climb a pyramid of block extremes until a block has such a value, and
    come down in it, so the number of array steps is logarithmic.
    """
    out = end.copy()
    if not len(value):
        return out
    lows, highs = [value], [value]
    while len(lows[-1]) > 1:
        even = len(lows[-1]) + 1 & ~1
        low = np.append(lows[-1], lows[-1][-1:])[:even].reshape(-1, 2)
        high = np.append(highs[-1], highs[-1][-1:])[:even].reshape(-1, 2)
        lows.append(low.min(axis=1))
        highs.append(high.max(axis=1))

    def hits(k: int, block: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (highs[k][block] - last[q] >= limit[q]) | (last[q] - lows[k][block] >= limit[q])

    found = []
    q = np.flatnonzero(at < end)
    block = at[q]
    for k in range(len(lows)):
        here = []
        for odd_only in (False, True):
            turn = (block & 1 == 1) if odd_only else np.ones(len(q), bool)
            hit = np.zeros(len(q), bool)
            hit[turn] = hits(k, block[turn], q[turn])
            here.append((q[hit], block[hit]))
            block = block + (turn & ~hit)
            left = ~hit & (block << k < end[q])
            q, block = q[left], block[left]
        found.append(here)
        block = block >> 1
    q, block = np.empty(0, np.int64), np.empty(0, np.int64)
    for k in reversed(range(len(lows))):
        q = np.concatenate([q, *[f[0] for f in found[k]]])
        block = np.concatenate([block, *[f[1] for f in found[k]]])
        if k:
            block = 2 * block
            block += ~hits(k - 1, block, q)
    out[q] = np.minimum(block, end[q])
    return out


def _visited(starts: np.ndarray, jump: np.ndarray) -> np.ndarray:
    """Which positions the chains from ``starts`` visit; ``len(jump)`` is the end of a chain."""
    n = len(jump)
    jumps = [np.append(jump, n)]
    while (twice := jumps[-1][jumps[-1]]).min() < n:
        jumps.append(twice)
    seen = np.zeros(n + 1, bool)
    seen[starts] = True
    for step in reversed(jumps):
        seen[step[np.flatnonzero(seen)]] = True
    return seen[:n]


def _arrays(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    """Columns as numpy; a null number becomes NaN."""
    return [batch.column(c).to_numpy(zero_copy_only=False).astype(bool if c in ("_ok", "_start") else float)
            for c in names]


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append 2 (delivered), 1 (candidate, but lost) or 0 (suppressed) to each row.

    A missing value (null or NaN) is never delivered.
    """
    carry = np.nan      # last delivered value of the run that goes on from the batch before
    for batch in batches:
        n = batch.num_rows
        value, limit, ok, start, incoming = _arrays(batch, "value", "_limit", "_ok", "_start", "_incoming")
        if not n:
            code = np.zeros(0, np.int32)
        else:
            first = np.union1d([0], np.flatnonzero(start))
            end = np.append(first[1:], n)
            last = np.where(start[first], incoming[first], carry)
            run = np.searchsorted(first, np.arange(n), "right") - 1
            used = np.flatnonzero(ok & ~np.isnan(value))
            m, given = len(used), value[used]
            begin, stop = np.searchsorted(used, first), np.searchsorted(used, end)
            own_stop = stop[run[used]]
            jump = first_hits(given, np.arange(1, m + 1), given, limit[used], own_stop)
            jump[jump == own_stop] = m
            at = np.where(np.isnan(last), begin, first_hits(given, begin, last, limit[first], stop))
            sent = np.zeros(n, bool)
            sent[used[_visited(at[at < stop], jump)]] = True
            latest = np.maximum.accumulate(np.where(sent, np.arange(n), -1))
            before = np.append(-1, latest[:-1])
            stands = np.where(before >= first[run], value[before], last[run])
            candidate = ~np.isnan(value) & (np.isnan(stands) | (np.abs(value - stands) >= limit))
            code = np.where(sent, 2, candidate).astype(np.int32)
            carry = value[latest[-1]] if latest[-1] >= first[-1] else last[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], [*batch.schema.names, "_code"])


def delivery_codes(sorted_rows: DataFrame) -> DataFrame:
    schema = T.StructType([*sorted_rows.schema.fields, T.StructField("_code", T.IntegerType())])
    return sorted_rows.mapInArrow(_codes, schema)


_SIDE = ("edge", "first", "last", "least", "most")      # of each group of new extremes
_LISTS = [f"{side}_{name}" for side in ("up", "down") for name in _SIDE]


def _grouped(at: np.ndarray, value: np.ndarray, result: np.ndarray, groups: int) -> list[np.ndarray]:
    """At most ``groups`` groups of neighbouring extremes: the farthest value, positions, range of results."""
    n = len(at)
    group = np.arange(n)
    if n > groups:
        group = np.append(0, np.cumsum(result[1:] != result[:-1]))
        if group[-1] >= groups:
            group = group * groups // (group[-1] + 1)
    cut = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.empty(0, np.int64)
    tail = np.append(cut[1:], n) - 1 if n else cut
    ranges = [f.reduceat(result, cut) if n else result for f in (np.minimum, np.maximum)]
    return [value[tail], at[cut].astype(float), at[tail].astype(float), *ranges]


def segment_table(value: np.ndarray, limit: float, low: float = -np.inf, high: float = np.inf,
                  groups: int = GROUPS) -> dict:
    """What readings do to a last delivered value between ``low`` and ``high``.

    A value is compared with each reading until the first that differs enough. That
    one is a new highest or lowest reading; from there on the course no longer depends
    on the value before. Values that come in are thus told apart by the new extremes
    that end them, and these are listed in order of time, in groups. If ``low`` equals
    ``high``, one extreme of each side is left and the result is exact.
    """
    n = len(value)
    if not n:
        return {"from_nothing": None, "limit": limit} | {c: np.empty(0) for c in _LISTS}
    jump = first_hits(value, np.arange(1, n + 1), value, np.full(n, limit), np.full(n, n))
    final = np.where(jump < n, jump, np.arange(n))
    while not np.array_equal(further := final[final], final):
        final = further
    result = value[final]
    top, bottom = np.maximum.accumulate(value), np.minimum.accumulate(value)
    # once the readings span more than twice the limit, one of them differs enough from any value
    wide = np.flatnonzero(top - bottom > 2.000001 * limit)
    m = wide[0] + 1 if len(wide) else n
    ups = np.append(0, 1 + np.flatnonzero(value[1:m] > top[:m - 1]))
    downs = np.append(0, 1 + np.flatnonzero(value[1:m] < bottom[:m - 1]))
    ups = ups[_first(value[ups] - low, limit):_first(value[ups] - high, limit) + 1]
    downs = downs[_first(high - value[downs], limit):_first(low - value[downs], limit) + 1]
    sides = [_grouped(at, value[at], result[at], groups) for at in (ups, downs)]
    return {"from_nothing": result[0], "limit": limit} | dict(zip(_LISTS, [*sides[0], *sides[1]]))


def _first(distance: np.ndarray, limit: float) -> int:
    """Where growing distances first reach the limit."""
    return int(np.searchsorted(distance, limit, "left"))


def after(table: dict, low: float, high: float) -> tuple[float, float]:
    """Range of the last delivered value after a segment, for one between ``low`` and ``high`` before it."""
    limit, up, down = table["limit"], table["up_edge"], table["down_edge"]
    u = _first(up - low, limit), _first(up - high, limit)
    d = _first(high - down, limit), _first(low - down, limit)
    rows = []
    for side, (a, b), other, (_, other_b), edge in (("up", u, "down", d, up), ("down", d, "up", u, down)):
        # if every value is ended on the other side by some reading, later groups of this side end none
        bound = table[f"{other}_last"][other_b] if other_b < len(table[f"{other}_edge"]) else np.inf
        rows += [(table[f"{side}_least"][g], table[f"{side}_most"][g])
                 for g in range(a, min(b + 1, len(edge))) if table[f"{side}_first"][g] <= bound]
    if u[1] == len(up) and d[1] == len(down):
        rows.append((low, high))        # none of the readings differs enough from some of the values
    return min(r[0] for r in rows), max(r[1] for r in rows)


def transfer_rows(sorted_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (key, segment): its table for incoming values between ``_low`` and ``_high``."""
    ids = [*keys, SEGMENT]
    fields = [T.StructField("from_nothing", DOUBLE), T.StructField("limit", DOUBLE),
              *[T.StructField(c, T.ArrayType(DOUBLE)) for c in _LISTS]]
    out_schema = T.StructType([sorted_rows.schema[c] for c in ids] + fields)

    def condense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, parts, bounds = None, [], None

        def finish() -> pa.RecordBatch:
            table = segment_table(np.concatenate(parts), *bounds)
            values = [pa.array([table[f.name]], pa.list_(pa.float64()) if f.name in _LISTS else pa.float64())
                      for f in fields]
            return pa.RecordBatch.from_arrays([*owner, *values], ids + [f.name for f in fields])

        for batch in batches:
            value, limit, ok, start, low, high = _arrays(batch, "value", "_limit", "_ok", "_start", "_low", "_high")
            usable = ok & ~np.isnan(value)
            first = np.union1d([0], np.flatnonzero(start)) if len(value) else []
            for a, b in zip(first, np.append(first[1:], len(value))):
                a, b = int(a), int(b)
                if start[a]:
                    if owner is not None:
                        yield finish()
                    owner, parts = [batch.column(c).slice(a, 1) for c in ids], []
                    bounds = float(limit[a]), float(low[a]), float(high[a])
                parts.append(value[a:b][usable[a:b]])
        if owner is not None:
            yield finish()

    slim = sorted_rows.select(*ids, "value", "_limit", "_ok", "_start", "_low", "_high")
    return slim.mapInArrow(condense, out_schema)


_FACTS = struct(nothing=BOOL, low=DOUBLE, high=DOUBLE, out_nothing=BOOL, out_low=DOUBLE, out_high=DOUBLE)


def _chained(tables: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What comes into each segment and what leaves it, by chaining the tables of each key."""
    ids = [*keys, SEGMENT]
    schema = T.StructType([tables.schema[c] for c in ids] + _FACTS.fields)

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(SEGMENT)
        facts, state = [], None
        for r in rows.to_dict("records"):
            incoming = state
            if r["settled"]:
                state = None if r["out_nothing"] else (r["out_low"], r["out_low"])
            elif state is None:
                state = None if pd.isna(r["from_nothing"]) else (r["from_nothing"],) * 2
            else:
                state = after(r, *state)
            facts.append((incoming is None, *(incoming or (0.0, 0.0)), state is None, *(state or (0.0, 0.0))))
        # object columns: pandas' own string columns may not convert to one Arrow array
        out = rows[ids].astype(object).reset_index(drop=True)
        return pd.concat([out, pd.DataFrame(facts, columns=_FACTS.names)], axis=1)

    return tables.groupBy(*keys).applyInPandas(chain, schema)


def incoming_states(hot: DataFrame, segments: Segments, in_runs: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Last delivered value before each segment of the hot keys.

    Each round settles at least the first segment that is open in each key, mostly
    all of them. The driver sees one row per segment, as it does for the cut points.
    """
    spark, keys = hot.sparkSession, segments.keys
    ids = [*keys, SEGMENT]
    rows = hot.withColumns({"_low": F.lit(-np.inf), "_high": F.lit(np.inf)})
    known = None
    while True:
        tables = transfer_rows(in_runs(rows), keys).withColumn("settled", F.lit(False))
        if known is not None:
            tables = tables.unionByName(known, allowMissingColumns=True)
        else:
            tables = tables.withColumns({"out_nothing": F.lit(False), "out_low": F.lit(0.0)})
        found = _chained(tables, keys)
        facts = found.collect()
        if all(r["low"] == r["high"] for r in facts):
            return spark.createDataFrame(
                [(*[r[c] for c in ids], None if r["nothing"] else r["low"]) for r in facts],
                T.StructType([found.schema[c] for c in ids] + [T.StructField("_incoming", DOUBLE)]))
        facts = spark.createDataFrame(facts, found.schema)
        settled = F.col("out_low") == F.col("out_high")
        known = facts.filter(settled).select(*ids, F.lit(True).alias("settled"), "out_nothing", "out_low")
        open_ = facts.filter(~settled).select(*ids, F.col("low").alias("_low"), F.col("high").alias("_high"))
        rows = join_segment_facts(hot, open_, segments).filter(F.col("_low").isNotNull())

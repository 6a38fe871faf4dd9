"""Scalar expressions shared by several operators."""

import operator

from pyspark.sql import Column, functions as F

# Milliseconds per duration unit. Fixed values; an unknown unit counts as seconds.
UNIT_MS = {"MS": 1, "SEC": 1000, "MIN": 60_000, "HOURS": 3_600_000, "DAYS": 86_400_000}
UNKNOWN_UNIT_MS = 1000

COMPARISONS = {
    "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge,
    "=": operator.eq, "==": operator.eq, "!=": operator.ne,
}


def compare(left: Column, op: str, right: Column | float) -> Column:
    """One of the six comparison predicates, by its symbol."""
    if op not in COMPARISONS:
        raise ValueError(f"unknown comparison {op!r}")
    return COMPARISONS[op](left, right)


def duration_ms(amount: Column, unit: Column) -> Column:
    """Duration literal to milliseconds."""
    table = F.create_map(*[F.lit(x) for pair in UNIT_MS.items() for x in pair])
    factor = F.coalesce(F.try_element_at(table, F.upper(unit)), F.lit(UNKNOWN_UNIT_MS))
    return amount * factor


def interval_ticks(interval_ms: Column, ms_per_tick: int) -> Column:
    """Sampling interval in whole ticks, never less than one."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(interval_ms / F.lit(ms_per_tick)).cast("bigint"))


def tick_of(ts: Column, origin_epoch_s: int = 0, seconds_per_tick: int = 60) -> Column:
    """Tick number of a timestamp, counted from ``origin_epoch_s``."""
    epoch = F.unix_seconds(ts.cast("timestamp"))
    return (F.floor(epoch / seconds_per_tick) - origin_epoch_s // seconds_per_tick).cast("bigint")


def profile_key(device_class: Column, measure: Column, zone_id: Column) -> Column:
    return F.format_string("%s_%s_zone%d", device_class, measure, zone_id)


def clamp(value: Column, low: Column, high: Column) -> Column:
    """Clamp to a range; a null bound is open (least and greatest skip nulls)."""
    return F.when(value.isNotNull(), F.greatest(low, F.least(high, value)))


def exact_sums(v: Column) -> tuple[Column, Column]:
    """Two aggregates whose total is the sum of ``v``, in whatever order and parts it is added.

    The first adds the values cut to multiples of 2**-20, which is exact as long as it stays
    below 2**33; the second adds the rest, whose own rounding lies far below the last place
    of the total. Plain sums differ in the last bit from order to order. Both merge by adding.
    """
    grid, cut = F.lit(float(1 << 20)), F.abs(v) < float(1 << 32)
    coarse = F.when(cut, F.rint(v * grid) / grid).otherwise(v)
    return F.sum(coarse), F.sum(F.when(cut, v - coarse).otherwise(0.0))


def exact_mean(v: Column) -> Column:
    """The mean of an aggregate's values, the same in any order of addition; null over no values."""
    coarse, fine = exact_sums(v)
    return F.try_divide(coarse + fine, F.count(v))

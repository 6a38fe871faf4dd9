"""Thinning a stream of readings by arrival mode and random loss."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickweave.functions.scalars import interval_ticks
from tickweave.functions.uniform import uniform
from tickweave.operators.deadband import delivery_codes, incoming_states
from tickweave.operators.ordered import with_previous
from tickweave.operators.segments import (
    HOT, SEGMENT, Segments, join_segment_facts, plan_segments,
)

MODES = ("PERIODIC", "ON_CHANGE", "ON_THRESHOLD")      # fixed values
SENT, LOST, SUPPRESSED = "sent", "lost", "suppressed"
INITIAL_VALUE = 0.0     # what a threshold sensor compares with before its first delivery

KEYS = ("device_id", "measure_name")
ORDER = ("tick", "event_id")


def periodic(df: DataFrame, interval: Column | int, start: Column | int = 0,
             tick: str = "tick") -> DataFrame:
    """Keep every ``interval``-th tick, counted from ``start``."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.filter(F.pmod(F.col(tick) - lit(start), lit(interval)) == 0)


def survives(probability: Column | float, seed: int, keys: Sequence[str | Column],
             draw: str = "loss") -> Column:
    """Whether a reading is not lost."""
    p = probability if isinstance(probability, Column) else F.lit(float(probability))
    return uniform(seed, keys, draw) >= F.coalesce(p, F.lit(0.0))


def lossy(df: DataFrame, probability: Column | float, seed: int,
          keys: Sequence[str | Column] | None = None) -> DataFrame:
    """Drop each reading independently with the given probability.

    ``keys`` tell readings apart; by default device, measure, tick and, if the table has it, event_id.
    """
    if keys is None:
        keys = [k for k in (*KEYS, *ORDER) if k != "event_id" or k in df.columns]
    return df.filter(survives(probability, seed, keys))


def crossing_status(
    df: DataFrame,
    threshold: Column | float,
    survive: Column | None = None,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    segments: Segments | None = None,
) -> DataFrame:
    """ON_THRESHOLD: label each reading sent, lost or suppressed.

    A reading is a candidate if it lies on the other side of the threshold than the
    last delivered one. Readings that are not delivered lie on the same side as the
    last delivered one, unless lost, so the last surviving reading stands for it.
    """
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    df = df.withColumn("_ok", F.lit(True) if survive is None else survive)
    df = df.withColumn("_side", F.col("value") >= limit)
    usable = F.col("_ok") & F.col("_side").isNotNull()
    df = with_previous(
        df, F.col("_side"), "_last_side", keys, order, where=usable,
        default=F.lit(INITIAL_VALUE) >= limit, segments=segments,
    )
    candidate = F.coalesce(F.col("_side") != F.col("_last_side"), F.lit(False))
    status = F.when(~candidate, SUPPRESSED).when(F.col("_ok"), SENT).otherwise(LOST)
    return df.withColumn("status", status).drop("_ok", "_side", "_last_side")


def crossing(df: DataFrame, threshold: Column | float, **kw) -> DataFrame:
    """ON_THRESHOLD: keep readings that cross the threshold."""
    return crossing_status(df, threshold, **kw).filter(F.col("status") == SENT).drop("status")


def deadband_status(
    df: DataFrame,
    threshold: Column | float,
    survive: Column | None = None,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    segments: Segments | None = None,
) -> DataFrame:
    """ON_CHANGE: label each reading sent, lost or suppressed.

    The comparison is with the last *delivered* value, so this is a fold over the
    sorted rows of a key. Rows stream through it with one number of state. A hot
    key is folded in segments at the same time: a first pass condenses each segment
    to a table of bounded size "value delivered before it -> value delivered at its end",
    the tables of a key are chained, in several rounds if need be, and the last pass
    starts each segment with its true value.
    ``threshold`` must be the same for all readings of a key.
    """
    seg = segments if segments is not None else plan_segments(df, keys, order)
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    df = seg.assign(df) if seg.any_hot else df
    df = df.withColumn("_limit", limit.cast("double")).withColumn(
        "_ok", F.lit(True) if survive is None else F.coalesce(survive, F.lit(True))
    )
    if seg.any_hot:
        hot = df.filter(F.col(HOT))
        facts = incoming_states(hot, seg, lambda rows: _run_starts(rows, seg))
        df = join_segment_facts(df, facts, seg)
    else:
        df = df.withColumn("_incoming", F.lit(None).cast("double"))
    out = delivery_codes(_run_starts(df, seg))
    status = F.when(F.col("_code") == 2, SENT).when(F.col("_code") == 1, LOST).otherwise(SUPPRESSED)
    return out.withColumn("status", status).drop(
        "_limit", "_ok", "_incoming", "_start", "_code", SEGMENT, HOT
    )


def _run_starts(df: DataFrame, seg: Segments) -> DataFrame:
    """Sort the rows of each (key, segment) together and mark the first of each."""
    return df.withColumn("_start", F.row_number().over(seg.window()) == 1)


def deadband(df: DataFrame, threshold: Column | float, **kw) -> DataFrame:
    """ON_CHANGE: keep readings that differ from the last delivered one by the threshold."""
    return deadband_status(df, threshold, **kw).filter(F.col("status") == SENT).drop("status")


def drop_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Readings per status."""
    return df.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("n"))


def transmit(
    df: DataFrame,
    ms_per_tick: int,
    seed: int,
    start: int = 0,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    segments: Segments | None = None,
    modes: Sequence[str] = MODES,
) -> DataFrame:
    """Apply the arrival mode of each reading's profile and label the readings.

    Expects the profile columns ``mode``, ``interval_ms``, ``threshold`` and
    ``failure`` on each row, as ``bind_profiles`` leaves them. The modes are split
    by a filter, so periodic readings, usually the bulk, are not shuffled. Readings
    without a mode are periodic; ``modes`` may leave out modes that no profile has.
    """
    ok = survives(F.col("failure"), seed, (*keys, *order))
    mode = F.coalesce("mode", F.lit("PERIODIC"))
    due = periodic(df.filter(~mode.isin("ON_CHANGE", "ON_THRESHOLD")),
                   F.coalesce(interval_ticks(F.col("interval_ms"), ms_per_tick), F.lit(1)), start)
    out = due.withColumn("status", F.when(ok, SENT).otherwise(LOST))
    limit = F.coalesce("threshold", F.lit(0.0))
    for name, label in (("ON_CHANGE", deadband_status), ("ON_THRESHOLD", crossing_status)):
        if name in modes:
            out = out.unionByName(label(df.filter(mode == name), limit, ok, keys, order, segments))
    return out


def with_stale_flag(df: DataFrame, max_delay: str, event_ts: str = "event_ts",
                    ingest_ts: str = "ingest_ts") -> DataFrame:
    """Mark readings that arrived more than ``max_delay`` after they were made."""
    late = F.col(ingest_ts) > F.col(event_ts) + F.expr(f"INTERVAL {max_delay}")
    return df.withColumn("stale", late)

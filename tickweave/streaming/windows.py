"""Windowed rules on a stream.

Readings carry ``event_ts`` (TIMESTAMP) and a watermark. Windows close when the
watermark passes their end, so a closed window equals the batch window of the
same bounds as long as no reading is later than the watermark's delay.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickweave.operators.aggregates import Agg, DEFAULT_VALUE, result, states_for
from tickweave.plans.rules import Having, Rule, _means_hold, mean_aggs, row_rule, source_rows


def with_event_time(df: DataFrame, delay: str, origin_s: int = 0,
                    seconds_per_tick: int = 60, tick: str = "tick") -> DataFrame:
    """Add ``event_ts`` from the tick, with a watermark of ``delay``.

    ``origin_s`` is the time of tick 0 in seconds since the epoch. Every row moves the
    watermark: filters of later steps are kept from slipping below it by one that is
    always true, which the optimizer cannot know.
    """
    ts = F.timestamp_seconds(F.lit(origin_s) + F.col(tick) * seconds_per_tick)
    return df.withColumn("event_ts", ts).withWatermark("event_ts", delay).where(F.spark_partition_id() >= 0)


def windowed(
    df: DataFrame,
    duration: str,
    aggs: Sequence[Agg],
    keys: Sequence[str] = ("device_id",),
    slide: str | None = None,
    offset: str | None = None,
    having: Sequence[Having] = (),
    tie: str = "event_id",
) -> DataFrame:
    """Tumbling (no ``slide``) or sliding windows in event time.

    Keeps Spark's window column, so that a later windowed rule can use ``F.window_time``.
    """
    order = "tick" if "tick" in df.columns else "event_ts"
    all_aggs = [*aggs, *mean_aggs(having)]
    states = states_for(all_aggs, order, tie)
    exprs = [s.from_rows.alias(s.name) for s in states] or [F.count(F.lit(1)).alias("_rows")]
    bounds = F.window("event_ts", duration, slide or duration, offset or "0 seconds")
    out = df.groupBy(*keys, bounds.alias("window")).agg(*exprs)
    if having:
        out = out.filter(_means_hold(lambda a: result(a, empty=None), having))
    return out.select(*keys, "window", *[result(a) for a in aggs])


def tumbling_rule(df: DataFrame, rule: Rule, tick_seconds: int = 60, origin_s: int = 0) -> DataFrame:
    """A tumbling rule; chain the result into another one with ``as_source``.

    Windows are counted from ``origin_s``, where Spark would count from the epoch.
    """
    offset = f"{origin_s % (rule.size * tick_seconds)} seconds"
    parts = []
    for source in rule.sources:
        body = rule.body(source)
        out = windowed(source_rows(df, source), f"{rule.size * tick_seconds} seconds", body.aggs,
                       rule.keys, offset=offset, having=body.having)
        fire_offset = rule.size if rule.fire_offset is None else rule.fire_offset
        value = F.col(rule.aggs[0].out) if rule.aggs else F.lit(DEFAULT_VALUE)
        parts.append(out.select(
            *rule.keys, "window",
            F.lit(rule.head).alias("event_type"),
            *([] if "measure_name" in rule.keys else [F.lit(rule.head).alias("measure_name")]),
            value.alias("value"), F.lit(rule.head).alias("triggered_by"),
            F.lit(rule.label).cast("string").alias("rule_label"),
            (F.col("window.start") + F.expr(f"INTERVAL {fire_offset * tick_seconds} SECONDS")).alias("fire_time"),
        ))
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return merged


def as_source(derived: DataFrame) -> DataFrame:
    """Derived events as input of a chained rule.

    The event time of a chained window must be the window's own time; the stamped
    fire time is payload.
    """
    names = [c for c in derived.columns if c not in ("value", "window")]
    return derived.withColumn("event_ts", F.window_time("window")).withColumn(
        "event_id", F.xxhash64(*names)
    ).drop("window")


def landmark_running(df: DataFrame, aggs: Sequence[Agg], keys: Sequence[str] = ("device_id",)) -> DataFrame:
    """Everything since the start; write it in update or complete mode."""
    order = "tick" if "tick" in df.columns else "event_ts"
    states = states_for(aggs, order)
    out = df.groupBy(*keys).agg(*[s.from_rows.alias(s.name) for s in states])
    return out.select(*keys, *[result(a) for a in aggs])


def immediate(df: DataFrame, rule: Rule) -> DataFrame:
    """A windowless rule: each matching reading fires at once, ``fire_offset`` ticks later."""
    return row_rule(df, rule)


def cooccur_same_window(df: DataFrame, duration: str, first: Column, second: Column,
                        keys: Sequence[str] = ("device_id",)) -> DataFrame:
    """Windows of a key in which both conditions were seen."""
    return df.groupBy(*keys, F.window("event_ts", duration).alias("window")).agg(
        F.count_if(first).alias("n_first"), F.count_if(second).alias("n_second")
    ).filter((F.col("n_first") > 0) & (F.col("n_second") > 0))


def cooccur_within(left: DataFrame, right: DataFrame, within: str,
                   keys: Sequence[str] = ("device_id",)) -> DataFrame:
    """Left readings with a right reading of the same key within +-``within``.

    A semi-join: a reading is reported once however many partners it has. Both sides need
    a watermark on ``event_ts``.
    """
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("event_ts").alias("_r_ts"))
    span = F.expr(f"INTERVAL {within}")
    on = F.col("_r_ts").between(F.col("event_ts") - span, F.col("event_ts") + span)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    return left.join(other, on, "left_semi")


def fresh_only(df: DataFrame, max_delay: str) -> DataFrame:
    """Drop readings that were already later than ``max_delay`` when they were ingested."""
    return df.filter(F.col("ingest_ts") <= F.col("event_ts") + F.expr(f"INTERVAL {max_delay}"))

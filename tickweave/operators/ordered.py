"""Operators that look along a key's time line: previous value, row number, last N.

All of them take ``segments`` (see ``segments.py``). When it says that no key is
hot they are one plain window; otherwise they work per segment and carry the
boundary values over, so no task ever orders a whole hot key.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickweave.operators.segments import (
    HOT, SEGMENT, Segments, carry_over, join_segment_facts, plan_segments,
)


def _resolve(df: DataFrame, keys, order, segments: Segments | None, **kw) -> Segments:
    return segments if segments is not None else plan_segments(df, keys, order, **kw)


def with_previous(
    df: DataFrame,
    value: Column,
    out: str,
    keys: Sequence[str] = ("device_id",),
    order: Sequence[str] = ("tick", "event_id"),
    where: Column | None = None,
    default: Column | None = None,
    segments: Segments | None = None,
) -> DataFrame:
    """Add ``value`` of the nearest earlier row of the key for which ``where`` holds.

    Without ``where`` this is a lag. A null ``value`` on that row stays null;
    ``default`` is used only when there is no earlier row.
    """
    seg = _resolve(df, keys, order, segments)
    df = labelled = seg.assign(df) if seg.any_hot else df
    boxed = F.struct(value.alias("v"))
    seen = boxed if where is None else F.when(where, boxed)
    if where is None:
        prev = F.lag(boxed).over(seg.window())
    else:
        prev = F.last(seen, ignorenulls=True).over(
            seg.window().rowsBetween(Window.unboundedPreceding, -1)
        )
    df = df.withColumn("_prev", prev)
    if seg.any_hot:
        last = F.max_by(seen, F.when(seen.isNotNull(), F.struct(*order)))
        summary = labelled.filter(F.col(HOT)).groupBy(*seg.keys, SEGMENT).agg(last.alias("_last"))
        df = join_segment_facts(df, carry_over(summary, seg, F.col("_last"), "_carry"), seg)
        df = df.withColumn("_prev", F.coalesce("_prev", "_carry")).drop("_carry", SEGMENT, HOT)
    found = F.col("_prev")["v"]
    if default is not None:
        found = F.when(F.col("_prev").isNull(), default).otherwise(found)
    return df.withColumn(out, found).drop("_prev")


def with_row_number(
    df: DataFrame,
    out: str,
    keys: Sequence[str],
    order: Sequence[str],
    segments: Segments | None = None,
) -> DataFrame:
    """Running number of the row within its key, from 1."""
    seg = _resolve(df, keys, order, segments)
    df = labelled = seg.assign(df) if seg.any_hot else df
    df = df.withColumn(out, F.row_number().over(seg.window()).cast("bigint"))
    if seg.any_hot:
        sizes = labelled.filter(F.col(HOT)).groupBy(*seg.keys, SEGMENT).count()
        before = Window.partitionBy(*seg.keys).orderBy(SEGMENT).rowsBetween(
            Window.unboundedPreceding, -1
        )
        facts = sizes.select(*seg.keys, SEGMENT, F.sum("count").over(before).alias("_before"))
        df = join_segment_facts(df, facts, seg)
        df = df.withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0))).drop(
            "_before", SEGMENT, HOT
        )
    return df


def keep_last_n(
    df: DataFrame,
    n: int,
    keys: Sequence[str] = ("event_type", "device_id"),
    order: Sequence[str] = ("tick", "event_id"),
    segments: Segments | None = None,
) -> DataFrame:
    """The ``n`` most recent rows of each key.

    Segments hold at least ``n`` rows each, so a hot key needs only its last one.
    """
    seg = _resolve(df, keys, order, segments, min_segment_rows=n)
    if seg.any_hot:
        is_last = F.col(SEGMENT) == F.size("_cuts_of")
        labelled = seg.assign(df)
        counts = seg.cuts.select(
            *[F.col(f"_k_{k}").alias(f"_q_{k}") for k in seg.keys], F.col("_cuts").alias("_cuts_of")
        )
        same = [F.col(k).eqNullSafe(F.col(f"_q_{k}")) for k in seg.keys]
        df = (
            labelled.join(F.broadcast(counts), same, "left")
            .filter(F.col("_cuts_of").isNull() | is_last)
            .drop("_cuts_of", HOT, SEGMENT, *[f"_q_{k}" for k in seg.keys])
        )
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n).drop("_rn")


def keep_recent(df: DataFrame, max_age: int, current: Column, tick: str = "tick") -> DataFrame:
    """Age-based retention: drop rows older than ``max_age`` ticks."""
    return df.filter(current - F.col(tick) <= max_age)


def rolling_rows(
    df: DataFrame,
    n: int,
    aggs: dict[str, Column],
    keys: Sequence[str] = ("device_id",),
    order: Sequence[str] = ("tick", "event_id"),
    segments: Segments | None = None,
) -> DataFrame:
    """Aggregates over the ``n`` most recent rows, evaluated on every row.

    In a hot key every segment first gets the last n-1 rows of the one before it;
    segments hold at least n-1 rows, so this is all it can need.
    """
    seg = _resolve(df, keys, order, segments, min_segment_rows=max(1, n - 1))
    if seg.any_hot:
        df = seg.assign(df).withColumn("_halo", F.lit(False))
        if n > 1:
            tail_w = Window.partitionBy(*seg.keys, SEGMENT).orderBy(*[F.col(c).desc() for c in order])
            tails = (
                df.filter(F.col(HOT)).withColumn("_rn", F.row_number().over(tail_w))
                .filter(F.col("_rn") <= n - 1).drop("_rn")
                .withColumn(SEGMENT, F.col(SEGMENT) + 1).withColumn("_halo", F.lit(True))
            )
            df = df.unionByName(tails)
    frame = seg.window().rowsBetween(-(n - 1), 0)
    out = df.select("*", *[c.over(frame).alias(name) for name, c in aggs.items()])
    if seg.any_hot:
        out = out.filter(~F.col("_halo")).drop("_halo", SEGMENT, HOT)
    return out

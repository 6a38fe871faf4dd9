"""Splitting hot keys into ordered segments.

Operators that look back in time (previous value, last N rows, dead-band) need
all rows of a key in order. If one device holds a third of all rows, ordering
it in one task is the bottleneck of the whole job. ``plan_segments`` finds such
keys with one map-side-combined count, cuts their time line into pieces of
about equal row count, and ``Segments.assign`` labels every row with its piece.
Each operator then works on (key, piece) and carries a small summary from one
piece to the next. Keys that are not hot are one piece and cost nothing extra.

The cut points are found from a hash sample of the hot keys' rows; the sample
only decides where to cut, every row is still processed. What is broadcast is
the list of cut points: at most ``2 * max_hot`` of them, whatever the data size.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tickweave.functions.search import rank_in_sorted

SEGMENT = "_segment"
HOT = "_hot"
MIN_HOT_ROWS = 2_000_000     # what one task is allowed to order
_SAMPLES_PER_SEGMENT = 32


@dataclass(frozen=True)
class Segments:
    """Cut points of the hot keys of one table; ``cuts`` is None if no key is hot."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    cuts: DataFrame | None = None     # keys prefixed with _k_, _cuts ARRAY<STRUCT<order>>
    max_cuts: int = 0

    @property
    def any_hot(self) -> bool:
        return self.cuts is not None

    def assign(self, df: DataFrame) -> DataFrame:
        """Add the segment number and whether the key is hot."""
        if self.cuts is None:
            return df.withColumn(SEGMENT, F.lit(0)).withColumn(HOT, F.lit(False))
        same_key = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in self.keys]
        position = F.struct(*[F.col(c).alias(c) for c in self.order])
        rank = rank_in_sorted(F.col("_cuts"), position, self.max_cuts)
        joined = df.join(F.broadcast(self.cuts), same_key, "left")
        return (
            joined.withColumn(HOT, F.col("_cuts").isNotNull())
            .withColumn(SEGMENT, F.when(F.col("_cuts").isNotNull(), rank).otherwise(0))
            .drop("_cuts", *[f"_k_{k}" for k in self.keys])
        )

    def hot_rows(self, df: DataFrame) -> DataFrame:
        """Only the rows of hot keys, labelled."""
        return self.assign(df).filter(F.col(HOT))

    def window(self) -> "Window":
        """Ordered window over one segment of one key."""
        part = list(self.keys) + ([SEGMENT] if self.any_hot else [])
        return Window.partitionBy(*part).orderBy(*self.order)


def plan_segments(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = ("tick", "event_id"),
    min_rows: int = MIN_HOT_ROWS,
    max_hot: int = 10_000,
    min_segment_rows: int = 1,
) -> Segments:
    """Find hot keys and where to cut them.

    A key is hot if it has more than ``min_rows`` rows and is among the ``max_hot``
    largest; any other key then holds under 1/``max_hot`` of the table.
    ``min_segment_rows`` guarantees a least (exactly counted) size of each segment.
    ``order`` must be unique within a key for the cuts to balance ties.
    """
    keys, order = tuple(keys), tuple(order)
    spark = df.sparkSession
    narrow = df.select(*keys, *order)
    hot = (
        narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > min_rows)
        .orderBy(F.col("_n").desc(), *keys)
        .limit(max_hot)
        .collect()
    )
    if not hot:
        return Segments(keys, order)

    target = max(min_rows, -(-sum(r["_n"] for r in hot) // max_hot))
    every = max(1, target // _SAMPLES_PER_SEGMENT)
    key_schema = T.StructType([T.StructField(f"_k_{k}", narrow.schema[k].dataType) for k in keys])
    hot_keys = spark.createDataFrame([tuple(r[k] for k in keys) for r in hot], key_schema)
    same_key = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    sampled = (
        narrow.filter(F.pmod(F.xxhash64(*order), F.lit(every)) == 0)
        .join(F.broadcast(hot_keys), same_key)
        .select(*keys, *order)
    )
    per_cut = max(1, target // every)
    w = Window.partitionBy(*keys).orderBy(*order)
    cut_rows = (
        sampled.withColumn("_r", F.row_number().over(w))
        .filter((F.col("_r") > 1) & (F.col("_r") % per_cut == 0))
        .select(*keys, *order)
        .dropDuplicates()
        .collect()
    )
    cuts: dict[tuple, list[tuple]] = {}
    for r in cut_rows:
        cuts.setdefault(tuple(r[k] for k in keys), []).append(tuple(r[c] for c in order))
    segments = _segments(spark, narrow.schema, keys, order, cuts)
    if min_segment_rows > 1 and segments.any_hot:
        sizes = segments.hot_rows(narrow).groupBy(*keys, SEGMENT).count().collect()
        count = {(tuple(r[k] for k in keys), r[SEGMENT]): r["count"] for r in sizes}
        merged = {k: _merge_small(sorted(c), k, count, min_segment_rows) for k, c in cuts.items()}
        segments = _segments(spark, narrow.schema, keys, order, merged)
    return segments


def _merge_small(cuts: list[tuple], key: tuple, count: dict, least: int) -> list[tuple]:
    """Drop cuts until every segment of the key has at least ``least`` rows."""
    kept: list[tuple] = []
    rows = count.get((key, 0), 0)
    for i, cut in enumerate(cuts, start=1):
        if rows >= least:
            kept.append(cut)
            rows = 0
        rows += count.get((key, i), 0)
    if rows < least and kept:
        kept.pop()      # the last segment is too small: join it to the one before
    return kept


def _segments(spark, schema: T.StructType, keys, order, cuts: dict[tuple, list[tuple]]) -> Segments:
    cuts = {k: sorted(c) for k, c in cuts.items() if c}
    if not cuts:
        return Segments(keys, order)
    position = T.StructType([T.StructField(c, schema[c].dataType) for c in order])
    table = T.StructType(
        [T.StructField(f"_k_{k}", schema[k].dataType) for k in keys]
        + [T.StructField("_cuts", T.ArrayType(position))]
    )
    rows = [(*k, c) for k, c in cuts.items()]
    return Segments(keys, order, spark.createDataFrame(rows, table), max(len(c) for c in cuts.values()))


def carry_over(summary: DataFrame, segments: Segments, value: Column, out: str) -> DataFrame:
    """``value`` of the nearest earlier segment of the same key that has one.

    ``summary`` has one row per (hot key, segment), so at most 3 * max_hot rows.
    """
    w = (
        Window.partitionBy(*segments.keys).orderBy(SEGMENT)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return summary.select(*segments.keys, SEGMENT, F.last(value, ignorenulls=True).over(w).alias(out))


def join_segment_facts(df: DataFrame, facts: DataFrame, segments: Segments) -> DataFrame:
    """Left join of per-(hot key, segment) facts, which are few enough to broadcast."""
    renamed = facts.select(
        *[F.col(c).alias(f"_f_{c}") for c in (*segments.keys, SEGMENT)],
        *[c for c in facts.columns if c not in (*segments.keys, SEGMENT)],
    )
    same = [F.col(c).eqNullSafe(F.col(f"_f_{c}")) for c in (*segments.keys, SEGMENT)]
    return df.join(F.broadcast(renamed), same, "left").drop(
        *[f"_f_{c}" for c in (*segments.keys, SEGMENT)]
    )

"""The feed's data source against the tick grid."""

import pytest
from pyspark.sql import functions as F

from tickweave.operators.generate import generate_readings, prepare_profiles
from tickweave.sources.feed import DueSlots, feed

MS, SEED = 60_000, 3
COLUMNS = ("device_id", "measure_name", "tick", "event_id", "tier", "value")


@pytest.fixture(scope="module")
def bound(spark, tmp_path_factory):
    """Forty bindings of all modes with ten intervals, some without any; written once."""
    normal = F.struct(F.lit("NORMAL").alias("family"), F.create_map(F.lit("mean"), F.lit(5.0), F.lit("std_dev"), F.lit(1.0)).alias("params"),
                      F.lit(0.8).alias("probability"))
    rare = F.struct(F.lit("POISSON").alias("family"), F.create_map(F.lit("mean"), F.lit(4.0)).alias("params"), F.lit(0.1).alias("probability"))
    n = F.col("id")
    rows = spark.range(40).select(
        n.cast("string").alias("device_id"), F.lit("m").alias("measure_name"), normal.alias("normal"), rare.alias("above"), rare.alias("below"),
        F.lit(0.0).alias("range_min"), F.lit(10.0).alias("range_max"),
        F.when(n % 5 == 0, "ON_CHANGE").when(n % 5 < 4, "PERIODIC").alias("mode"),
        F.when(n % 7 > 0, (n % 10) * 60_000.0).alias("interval_ms"))
    path = str(tmp_path_factory.mktemp("bound"))
    prepare_profiles(rows).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def rows_of(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


@pytest.mark.parametrize("first,end,most", [(0, 130, 1000), (7, 200, 1000), (0, 130, 2), (5, 5, 1000), (9, 3, 1000)])
def test_a_range_equals_the_grid(spark, bound, first, end, most):
    """Also with more intervals than may have slots of their own, and over no ticks."""
    got = feed(spark, bound, SEED, first, end, MS, max_intervals=most)
    want = generate_readings(bound, first, end, MS, SEED) if first <= end else bound.limit(0).select(
        *[F.lit(None).alias(c) for c in COLUMNS])
    assert rows_of(got) == rows_of(want)


def test_only_due_slots_are_read(spark):
    spark.dataSource.register(DueSlots)
    slots = spark.read.format("due_slots").options(first=3, end=63, intervals="20,7", groups=6, tasks=4).load()
    assert slots.rdd.getNumPartitions() == 4
    got = sorted(map(tuple, slots.collect()))
    assert got == sorted((e, g, t) for e in (7, 20) for g in range(6) for t in range(3, 64, e))


def test_a_range_needs_an_end(spark, bound):
    with pytest.raises(Exception, match="end"):
        feed(spark, bound, SEED).collect()


def test_a_stream_goes_on_after_a_restart(spark, bound, tmp_path):
    for end in (40, 40, 131):
        q = (feed(spark, bound, SEED, 2, end, MS, stream=True).writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
        q.awaitTermination()
        assert q.exception() is None
    out = spark.read.parquet(str(tmp_path / "out"))
    assert rows_of(out) == rows_of(generate_readings(bound, 2, 131, MS, SEED))
    assert out.where(F.unix_seconds("event_ts") != F.col("tick") * 60).count() == 0


def test_readings_are_spread_evenly(spark, bound):
    """Groups of bindings meet in few tasks; the readings that come of them must not stay there."""
    many = bound.where("device_id = '1'").drop("device_id", "measure_name", "mode").crossJoin(spark.range(4000).select(
        F.col("id").cast("string").alias("device_id"), F.lit("m").alias("measure_name"), F.lit("ON_CHANGE").alias("mode")))
    sizes = [r["count"] for r in feed(spark, many, SEED, 0, 9, MS, groups=8).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and sum(sizes) == 40_000 and max(sizes) < 1.3 * 5_000


def test_runs_of_slots_hold_the_same_ticks(spark):
    spark.dataSource.register(DueSlots)
    runs = spark.read.format("due_slots").options(first=3, end=63, intervals="20,7", groups=2, run=2).load()
    got = sorted((r.every, r.slot_group, t) for r in runs.collect() for t in range(r.tick, r.last + 1, r.every))
    assert got == sorted((e, g, t) for e in (7, 20) for g in range(2) for t in range(3, 64, e)) and runs.count() == 2 * (5 + 2)

"""A live synthetic feed: Spark's rate source joined to bound profiles."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickweave.functions.scalars import interval_ticks
from tickweave.operators.generate import drawn_readings, with_stem


def stream_synthetic(spark: SparkSession, bound: DataFrame, seed: int, ticks_per_second: int = 1,
                     ms_per_tick: int = 60_000) -> DataFrame:
    """Readings of every bound measure, one tick per rate row.

    ``bound`` comes from ``bind_profiles(bindings, prepare_profiles(profiles))``. Each tick
    is expanded to all bindings that are due; loss is left to the transmission step.
    """
    ticks = (
        spark.readStream.format("rate").option("rowsPerSecond", ticks_per_second).load()
        .select(F.col("value").alias("tick"), F.col("timestamp").alias("event_ts"))
    )
    return readings_at(ticks, bound, seed, ms_per_tick=ms_per_tick)


def readings_at(ticks: DataFrame, bound: DataFrame, seed: int, shards: int | None = None,
                ms_per_tick: int = 60_000) -> DataFrame:
    """Readings of the bindings that are due at the given ticks.

    PERIODIC bindings (no ``mode`` counts as such) are due every ``interval_ms``, all
    others on every tick. Bindings and ticks meet by equality on a shard number, so that a
    tick is worked on by up to ``shards`` tasks, as many as the session's shuffle
    partitions unless given.
    """
    shards = shards or int(bound.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sharded = with_stem(bound, seed).withColumn("_shard", F.pmod(F.xxhash64("device_id", "measure_name"), F.lit(shards)))
    spread = ticks.withColumn("_shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))))
    grid = spread.join(sharded, "_shard").drop("_shard")
    if "interval_ms" in bound.columns:
        every = F.coalesce(interval_ticks(F.col("interval_ms"), ms_per_tick), F.lit(1))
        mode = F.coalesce("mode", F.lit("PERIODIC")) if "mode" in bound.columns else F.lit("PERIODIC")
        grid = grid.where(mode.isin("ON_CHANGE", "ON_THRESHOLD") | (F.pmod("tick", every) == 0))
    return drawn_readings(grid, seed)

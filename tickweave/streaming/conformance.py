"""Conformance of a stream: summaries kept per key and merged batch by batch.

A stream's readings are summarised in stretches of a fixed length, which close when the
watermark passes their end. So a batch's stretches all lie behind those of the batches
before, and each batch is merged into one stored row per key. The history is never read
again, and a hot key's stretches are worked on by different tasks.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from tickweave.operators.conformance import GROUP
from tickweave.operators.incremental import appended, finished, merged, stretch_columns
from tickweave.operators.segments import MIN_HOT_ROWS, plan_segments

DEVICE_GROUP = ("device_id", *GROUP)


def stretches(df: DataFrame, length: int, origin_s: int = 0, seconds_per_tick: int = 60,
              keys: Sequence[str] = DEVICE_GROUP, value: str = "value") -> DataFrame:
    """A summary per key and stretch of ``length`` ticks, numbered by its first tick.

    ``df`` has a watermark on ``event_ts``, and ``range_min`` and ``range_max`` from a join
    with the bindings. State holds the tiers of open stretches, so their length bounds it.
    """
    seconds = length * seconds_per_tick
    window = F.window("event_ts", f"{seconds} seconds", startTime=f"{origin_s % seconds} seconds")
    out = df.groupBy(*keys, window.alias("window")).agg(*stretch_columns(F.col("range_min"), F.col("range_max"), value))
    first = ((F.unix_seconds("window.start") - origin_s) / seconds_per_tick).cast("bigint")
    return finished(out).withColumn("stretch", first).drop("window")


def keep_summaries(closed: DataFrame, folder: str, keys: Sequence[str] = DEVICE_GROUP,
                   min_rows: int = MIN_HOT_ROWS) -> DataStreamWriter:
    """Merge each micro-batch of closed stretches into the store; start the writer, then see ``kept_summaries``.

    ``folder`` must be shared by the cluster. A repeated micro-batch overwrites what it
    wrote before and starts from the same version, so each reading counts once.
    """
    keys = tuple(keys)

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # written first: the state behind a batch must be gone through once only
        batch.write.mode("overwrite").parquet(f"{folder}/closed/{batch_id}")
        rows = spark.read.schema(batch.schema).parquet(f"{folder}/closed/{batch_id}")
        now = merged(rows, keys, segments=plan_segments(rows, keys, ("stretch",), min_rows))
        if batch_id > 0:
            now = appended(spark.read.schema(now.schema).parquet(f"{folder}/store/{batch_id - 1}"), now, keys)
        now.write.mode("overwrite").parquet(f"{folder}/store/{batch_id}")
        for old in (f"{folder}/closed/{batch_id - 2}", f"{folder}/store/{batch_id - 2}"):
            fs, path = _at(spark, old)
            fs.delete(path, True)

    return closed.writeStream.foreachBatch(process).option("checkpointLocation", f"{folder}/progress")


def kept_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """The store's newest complete version: one row per key."""
    fs, store = _at(spark, f"{folder}/store")
    done = [s.getPath() for s in fs.listStatus(store) if fs.exists(_at(spark, f"{s.getPath().toString()}/_SUCCESS")[1])]
    return spark.read.parquet(max(done, key=lambda p: int(p.getName())).toString())


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at

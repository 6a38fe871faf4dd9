"""Dead-band and crossing on a stream whose hot keys are too large for one task.

Keyed state puts a key on one task. Here each micro-batch is thinned by the batch
operators, which split hot keys, and the last delivered value of every key is kept
in a table between batches. Readings must arrive in tick order from batch to batch;
within a batch any order will do. Use ``transmission.py`` for late readings.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from tickweave.operators.segments import MIN_HOT_ROWS, plan_segments
from tickweave.operators.transmit import ORDER, SENT, crossing_status, deadband_status

_LABELS = {"ON_CHANGE": deadband_status, "ON_THRESHOLD": crossing_status}
_BEFORE_ALL = -(2 ** 63)
_COLUMNS = ("tick", "event_id", "value")


def thin_in_batches(
    stream: DataFrame,
    mode: str,
    threshold: float,
    folder: str,
    keys: Sequence[str] = ("device_id", "measure_name"),
    min_rows: int = MIN_HOT_ROWS,
) -> DataStreamWriter:
    """Thin each micro-batch; start the returned writer, then see ``delivered``.

    ``folder`` must be shared by the cluster. A repeated micro-batch overwrites what it
    wrote before and starts from the same state, so each reading counts once.
    """
    keys = tuple(keys)

    def process(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*keys, *_COLUMNS, F.lit(False).alias("carried"))
        if batch_id > 0:
            # the last delivered value of a key takes part as its first reading
            state = batch.sparkSession.read.schema(rows.schema).parquet(f"{folder}/state/{batch_id - 1}")
            rows = rows.unionByName(state)
        segments = plan_segments(rows, keys, ORDER, min_rows)
        labelled = _LABELS[mode](rows, threshold, keys=keys, segments=segments)
        kept = labelled.filter((F.col("status") == SENT) | F.col("carried")).drop("status")
        kept.write.mode("overwrite").parquet(f"{folder}/kept/batch={batch_id}")
        written = batch.sparkSession.read.schema(rows.schema).parquet(f"{folder}/kept/batch={batch_id}")
        last = written.groupBy(*keys).agg(F.max_by("value", F.struct(*ORDER)).alias("value"))
        last.select(
            *keys, F.lit(_BEFORE_ALL).alias("tick"), F.lit(_BEFORE_ALL).alias("event_id"), "value",
            F.lit(True).alias("carried"),
        ).write.mode("overwrite").parquet(f"{folder}/state/{batch_id}")

    return stream.writeStream.foreachBatch(process).option("checkpointLocation", f"{folder}/progress")


def delivered(spark: SparkSession, folder: str) -> DataFrame:
    """What has been delivered so far."""
    return spark.read.parquet(f"{folder}/kept").filter(~F.col("carried")).drop("carried", "batch")

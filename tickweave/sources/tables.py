"""Existing event tables as readings."""

from pyspark.sql import DataFrame, functions as F

from tickweave.functions.scalars import tick_of


def events_as_readings(events: DataFrame, origin_epoch_s: int = 0, seconds_per_tick: int = 60) -> DataFrame:
    """A table (event_id, ts, user_id, event_type, value) in the shape of readings.

    The user is the device and the event type the measure.
    """
    return events.select(
        "event_id",
        F.lit("sensor_reading").alias("event_type"),
        tick_of(F.col("ts"), origin_epoch_s, seconds_per_tick).alias("tick"),
        F.col("user_id").cast("string").alias("device_id"),
        F.col("event_type").alias("measure_name"),
        "value",
    )

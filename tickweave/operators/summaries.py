"""Summaries of resource tables and of run-history tables."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Limits of the scaling exponent. Fixed values.
NEAR_LINEAR_BELOW = 1.15
MILD_BELOW = 1.5


def counts_with_share(df: DataFrame, by: str) -> DataFrame:
    """Rows per group and their share of all rows in whole percent (integer division).

    Groups are counted first; the total is the sum of those few counts.
    """
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.withColumn("_total", total).select(
        by, "n", F.expr("(100 * n) div _total").alias("percent")
    )


def throughput(runs: DataFrame, events: str = "n_events", wall: str = "wall_seconds",
               ticks: str = "n_ticks") -> DataFrame:
    """Events per second and milliseconds per thousand ticks."""
    return runs.withColumn("events_per_second", F.try_divide(F.col(events), F.col(wall))).withColumn(
        "ms_per_1k_ticks", F.try_divide(F.col(wall) * 1000.0, F.col(ticks) / 1000.0)
    )


def scale_vs_first(runs: DataFrame, workload: Sequence[str] = ("workload",), order: Sequence[str] = ("run",),
                   wall: str = "wall_seconds") -> DataFrame:
    """Wall time relative to the first run of the workload.

    The first run is an aggregate joined back, not a window: a workload may hold most runs.
    """
    base = runs.groupBy(*workload).agg(F.min_by(wall, F.struct(*order)).alias("_base"))
    scale = F.when(F.col("_base") > 0, F.col(wall) / F.col("_base")).otherwise(1.0)
    return runs.join(base, list(workload)).withColumn("scale_vs_first", scale).drop("_base")


def scaling_class(exponent: Column) -> Column:
    return (
        F.when(exponent < NEAR_LINEAR_BELOW, "near-linear")
        .when(exponent < MILD_BELOW, "mild superlinear")
        .otherwise("superlinear")
    )


def scaling_exponent(runs: DataFrame, workload: Sequence[str] = ("workload",), size: str = "n_devices",
                     wall: str = "wall_seconds") -> DataFrame:
    """Slope of log wall time over log size per workload, and what it means."""
    usable = runs.filter((F.col(size) > 0) & (F.col(wall) > 0))
    return usable.groupBy(*workload).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.regr_slope(F.log(wall), F.log(size)).alias("exponent"),
    ).filter(F.col("n_runs") >= 2).withColumn("scaling", scaling_class(F.col("exponent")))

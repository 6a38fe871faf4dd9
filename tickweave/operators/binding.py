"""Binding devices to zones, measures and profiles.

No side is broadcast by hand: plots and profiles may grow, so the choice is left to
Spark, which broadcasts a side it has measured to be small and otherwise does a
sort-merge join whose skewed partitions AQE splits.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tickweave.functions.scalars import profile_key
from tickweave.operators.specs import last_declared


def bind_devices(devices: DataFrame, plots: DataFrame, measures: DataFrame) -> DataFrame:
    """One row per device and measure of its class, with the zone of its plot.

    Devices on unknown plots and classes without measures have no row. A plot or a class's
    measure listed twice counts once, as listed last if the table has a ``decl_order``.
    """
    order = ["decl_order"] if "decl_order" in plots.columns else ["zone_id"]
    zone_of = last_declared(plots.select("plot_id", "zone_id", *{*order} - {"zone_id"}), ["plot_id"], order)
    order = ["decl_order"] if "decl_order" in measures.columns else ["position"]
    class_measures = last_declared(
        measures.select("device_class", "measure_name", "position", *{*order} - {"position"}),
        ["device_class", "measure_name"], order).select("device_class", "measure_name", "position")
    return (
        devices.join(zone_of.select("plot_id", "zone_id"), "plot_id")
        .join(class_measures, "device_class")
        .withColumn("profile", profile_key(F.col("device_class"), F.col("measure_name"), F.col("zone_id")))
    )


def bind_profiles(bindings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Attach the profile; bindings without one are dropped."""
    extra = [c for c in profiles.columns if c not in bindings.columns or c == "profile"]
    return bindings.join(profiles.select(*extra), "profile")


def select_for_zone(df: DataFrame, zone_params: DataFrame,
                    keys: Sequence[str] = ("measure_name", "zone_id")) -> DataFrame:
    """Zone-keyed parameters for each row, by equality on measure and zone."""
    return df.join(zone_params, list(keys))


def synthetic_bindings(classes: Sequence[str], distributions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Devices, plots and zones when no resources are given.

    One device for every class and every declared (measure, zone). The class list is
    part of the declaration, so it is expanded on each row and nothing is joined.
    """
    zones_of = distributions.select("measure_name", F.col("zone_id").cast("bigint")).distinct()
    devices = zones_of.withColumn(
        "device_class", F.explode(F.array(*[F.lit(c) for c in classes]))
    ).select(
        F.format_string(
            "%s_%s_z%d", F.substring("device_class", 1, 6), F.substring("measure_name", 1, 4), "zone_id"
        ).alias("device_id"),
        "device_class",
        (F.col("zone_id") * 10).alias("plot_id"),
        "measure_name",
        "zone_id",
    )
    plots = zones_of.select((F.col("zone_id") * 10).alias("plot_id"), "zone_id").distinct()
    zones = zones_of.select("zone_id").distinct()
    return devices, plots, zones

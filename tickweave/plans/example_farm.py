"""Declarations of a small example farm: four sensor classes in two zones.

The numbers are fixed values; results on this example are compared with published ones.
"""

from pyspark.sql import DataFrame, SparkSession

from tickweave import schemas
from tickweave.operators.aggregates import Agg
from tickweave.plans.rules import Having, Rule, Source

EVENT_TYPES = ("sensor_reading", "metric_avg", "alert", "report")

# class, measure, position, unit, range_min, range_max, resolution
MEASURES = (
    ("SoilMoistureSensor", "Moisture", 0, "percent_VWC", 0.0, 100.0, 0.1),
    ("AirTemperatureSensor", "AirTemp", 0, "celsius", -20.0, 60.0, 0.1),
    ("HumiditySensor", "Humidity", 0, "percent_RH", 0.0, 100.0, 0.5),
    ("NPKSensor", "Nitrogen", 0, "mg_per_kg", 0.0, 999.0, 1.0),
    ("NPKSensor", "Phosphorus", 1, "mg_per_kg", 0.0, 999.0, 1.0),
    ("NPKSensor", "Potassium", 2, "mg_per_kg", 0.0, 999.0, 1.0),
)

# measure, mode, interval_ms, threshold, failure_prob
ARRIVALS = (
    ("Moisture", "ON_CHANGE", None, 2.0, 0.10),
    ("AirTemp", "PERIODIC", 300_000.0, None, 0.05),
    ("Humidity", "PERIODIC", 300_000.0, None, 0.05),
    ("Nitrogen", "PERIODIC", 86_400_000.0, None, 0.12),
    ("Phosphorus", "PERIODIC", 86_400_000.0, None, 0.12),
    ("Potassium", "PERIODIC", 86_400_000.0, None, 0.12),
)

# measure, zone, then mean, std_dev and probability of NORMAL, ABOVE and BELOW
TIERS = (
    ("Moisture", 1, (65.0, 8.0, 0.90), (88.0, 4.0, 0.03), (18.0, 5.0, 0.07)),
    ("Moisture", 2, (32.0, 10.0, 0.80), (62.0, 5.0, 0.05), (8.0, 3.0, 0.15)),
    ("AirTemp", 1, (22.0, 4.0, 0.85), (40.0, 3.0, 0.08), (1.0, 1.5, 0.07)),
    ("AirTemp", 2, (24.0, 3.0, 0.92), (38.0, 2.0, 0.05), (2.0, 1.0, 0.03)),
    ("Humidity", 1, (55.0, 12.0, 0.82), (88.0, 5.0, 0.12), (12.0, 4.0, 0.06)),
    ("Humidity", 2, (72.0, 6.0, 0.93), (92.0, 3.0, 0.04), (42.0, 5.0, 0.03)),
    ("Nitrogen", 1, (180.0, 30.0, 0.85), (340.0, 30.0, 0.05), (55.0, 15.0, 0.10)),
    ("Nitrogen", 2, (220.0, 20.0, 0.90), (370.0, 20.0, 0.04), (60.0, 12.0, 0.06)),
    ("Phosphorus", 1, (80.0, 18.0, 0.85), (165.0, 15.0, 0.05), (25.0, 8.0, 0.10)),
    ("Phosphorus", 2, (100.0, 14.0, 0.90), (195.0, 12.0, 0.04), (28.0, 7.0, 0.06)),
    ("Potassium", 1, (160.0, 28.0, 0.85), (300.0, 25.0, 0.05), (40.0, 12.0, 0.10)),
    ("Potassium", 2, (200.0, 18.0, 0.90), (338.0, 18.0, 0.04), (42.0, 10.0, 0.06)),
)

_MEAN = (Agg("value", "avg"),)
# The rules read the readings by measure.
RULES = (
    Rule("metric_avg", "sliding", 6, (Source("sensor_reading", "Moisture"),), (Agg("avg_value", "avg"),),
         label="Moisture", fire_offset=7),
    Rule("metric_avg", "sliding", 6, (Source("sensor_reading", "AirTemp"),), (Agg("avg_value", "avg"),),
         label="AirTemp", fire_offset=7),
    Rule("alert", "tumbling", 30, (Source("sensor_reading", "Moisture"),), _MEAN, (Having("<", 25),),
         label="DROUGHT_STRESS", fire_offset=31),
    Rule("alert", "tumbling", 60, (Source("sensor_reading", "AirTemp"),), _MEAN, (Having(">", 38),),
         label="HEATWAVE", fire_offset=61),
    Rule("alert", "tumbling", 60, (Source("sensor_reading", "AirTemp"),), _MEAN, (Having("<", 3),),
         label="FROST_RISK", fire_offset=61),
    Rule("report", "tumbling", 60, (Source("alert", "DROUGHT_STRESS"),), (), (Having("<", 25),),
         label="IRRIGATION_NEEDED", fire_offset=61),
)


def measures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*m, i) for i, m in enumerate(MEASURES)], schemas.MEASURES)


def arrivals(spark: SparkSession) -> DataFrame:
    rows = [("farm", *a, i) for i, a in enumerate(ARRIVALS)]
    return spark.createDataFrame(rows, schemas.ARRIVALS)


def tiers(spark: SparkSession, force: dict[str, str] | None = None) -> DataFrame:
    """Declared tiers; ``force`` maps a measure to the one tier that gets all probability."""
    force, rows = force or {}, []
    for measure, zone, *specs in TIERS:
        for tier, (mean, std, p) in zip(schemas.TIER_NAMES, specs):
            if measure in force:
                p = 1.0 if force[measure] == tier else 0.0
            rows.append((measure, zone, tier, "NORMAL", {"mean": mean, "std_dev": std}, p, 1))
    return spark.createDataFrame(rows, schemas.TIERS)

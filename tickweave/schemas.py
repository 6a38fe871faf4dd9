"""Explicit schemas of the tables the operators read and write.

Nothing is inferred from files: every source passes one of these to Spark.
"""

from pyspark.sql import types as T

STR, LONG, INT, DOUBLE, BOOL, TS = (
    T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
)
PARAMS = T.MapType(STR, DOUBLE)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


READINGS = struct(
    event_id=LONG, event_type=STR, event_time=LONG, event_ts=TS, ingest_ts=TS, device_id=STR,
    measure_name=STR, value=DOUBLE, value2=DOUBLE, value3=DOUBLE, tier=STR, depth_cm=INT,
    triggered_by=STR,
)

TRIGGERED = struct(
    event_type=STR, event_time=LONG, device_id=STR, measure_name=STR, value=DOUBLE,
    triggered_by=STR, rule_label=STR, window_start=LONG, window_end=LONG,
)

ZONES = struct(zone_id=LONG, zone_name=STR, zone_type=STR, area_ha=DOUBLE)

PLOTS = struct(
    plot_id=LONG, zone_id=LONG, plot_name=STR, area_ha=DOUBLE, plot_type=STR, soil_type=STR,
    crop_type=STR,
)

DEVICES = struct(device_id=STR, device_class=STR, plot_id=LONG, depth_cm=INT)

RESOURCES = struct(
    devices=T.ArrayType(DEVICES), plots=T.ArrayType(PLOTS), zones=T.ArrayType(ZONES)
)

MEASURES = struct(
    device_class=STR, measure_name=STR, position=INT, unit=STR, range_min=DOUBLE, range_max=DOUBLE,
    resolution=DOUBLE, decl_order=INT,
)

ARRIVALS = struct(
    stream=STR, measure_name=STR, mode=STR, interval_ms=DOUBLE, threshold=DOUBLE,
    failure_prob=DOUBLE, decl_order=INT,
)

TIERS = struct(
    measure_name=STR, zone_id=LONG, tier=STR, family=STR, params=PARAMS, probability=DOUBLE,
    decl_order=INT,
)

# The JSON form of a profile and of a binding, as they are exchanged between tools.
_TIER_JSON = struct(distribution=struct(type=STR, params=PARAMS), probability=DOUBLE)
PROFILE_JSON = struct(
    event_type=STR, measure_name=STR, unit=STR, valid_range=struct(min=DOUBLE, max=DOUBLE),
    resolution=DOUBLE, zone_id=LONG, normal=_TIER_JSON, above=_TIER_JSON, below=_TIER_JSON,
    sampling=struct(mode=STR, interval_ms=DOUBLE, threshold=DOUBLE, failure=DOUBLE),
)
BINDING_JSON = struct(device_id=STR, device_class=STR, profile=STR, zone_id=LONG, depth_cm=INT)
PROFILE_FILE = struct(
    profiles=T.MapType(STR, PROFILE_JSON), bindings=T.ArrayType(BINDING_JSON)
)

# Names of the three tiers, in the order they are drawn and reported. Fixed values.
TIER_NAMES = ("NORMAL", "ABOVE", "BELOW")

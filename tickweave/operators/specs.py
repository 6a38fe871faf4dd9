"""Spec tables: profile assembly, classification, last-wins declarations."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickweave.functions.scalars import profile_key
from tickweave.schemas import TIER_NAMES

# Device-class fragments and the event-type fragment they stand for. Fixed values;
# the first line that matches a class decides.
CLASS_CATEGORIES = (
    ("soil", ("moisture", "temperature", "npk", "ph", "salinity", "insect", "soil")),
    ("environment", ("air", "humidity", "co2", "solar", "wind", "rain")),
    ("vital", ("oximeter", "ecg", "nibp", "thermo", "respiratory", "icp")),
    ("location", ("rfid",)),
)
DEFAULT_EVENT_TYPE = "sensor_reading"

# Measures of multi-value sensors in the order of their value columns. Fixed values.
MEASURE_ORDER = {
    "NPKSensor": ("Nitrogen", "Phosphorus", "Potassium"),
    "NIBPCuff": ("Systolic", "Diastolic"),
    "WindSensor": ("WindSpeed", "WindDirection"),
}
VALUE_COLUMNS = ("value", "value2", "value3")


def value_columns(n: int) -> tuple[str, ...]:
    """Names of ``n`` value columns; the record shape has the first three."""
    return ("value", *[f"value{i}" for i in range(2, n + 1)])


def last_declared(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("decl_order",)) -> DataFrame:
    """One row per key: the one declared last. An aggregate, so hot keys combine early."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("_last")).select(
        *[F.col(k) if k in keys else F.col(f"_last.{k}") for k in df.columns]
    )


def classify_event_type(
    device_class: Column,
    event_types: Sequence[str],
    categories: Sequence[tuple[str, Sequence[str]]] = CLASS_CATEGORIES,
) -> Column:
    """Event type a device class produces, by name fragments; else the first event type."""
    fallback = F.lit(event_types[0] if event_types else DEFAULT_EVENT_TYPE)
    name, out = F.lower(device_class), None
    for marker, fragments in categories:
        target = next((F.lit(e) for e in event_types if marker in e.lower()), fallback)
        hit = F.lit(False)
        for fragment in fragments:
            hit = hit | F.contains(name, F.lit(fragment))
        out = F.when(hit, target) if out is None else out.when(hit, target)
    return fallback if out is None else out.otherwise(fallback)


def effective_tiers(tiers: DataFrame) -> DataFrame:
    """Tiers of the last distribution declared for each measure.

    ``decl_order`` numbers the distributions, not the tiers: a later declaration
    replaces all zones of an earlier one. Within one declaration the first tier of a
    name counts (``tier_order``, if the table has it).
    """
    last = tiers.groupBy("measure_name").agg(F.max("decl_order").alias("_last"))
    kept = tiers.join(last, "measure_name").filter(F.col("decl_order") == F.col("_last")).drop("_last")
    if "tier_order" not in tiers.columns:
        return kept
    keys = ("measure_name", "zone_id", "tier")
    return last_declared(kept.withColumn("_neg", -F.col("tier_order")), keys, ("_neg",)).drop("_neg")


def effective_arrivals(arrivals: DataFrame) -> DataFrame:
    """The last arrival declared for each measure, across streams."""
    return last_declared(arrivals, ["measure_name"])


def assemble_profiles(
    measures: DataFrame,
    tiers: DataFrame,
    arrivals: DataFrame,
    event_types: Sequence[str] = (DEFAULT_EVENT_TYPE,),
) -> DataFrame:
    """One profile per (class, measure, zone).

    Measures without a distribution have none; measures without an arrival keep a
    null mode. The tiers become columns by a pivoting aggregate.
    """
    spec = F.struct("family", "params", "probability")
    by_zone = effective_tiers(tiers).groupBy("measure_name", "zone_id").agg(
        *[F.max_by(F.when(F.col("tier") == t, spec), F.when(F.col("tier") == t, 1)).alias(t.lower())
          for t in TIER_NAMES]
    )
    sampling = effective_arrivals(arrivals).select(
        "measure_name", "mode", "interval_ms", "threshold", F.col("failure_prob").alias("failure")
    )
    return (
        measures.join(by_zone, "measure_name")
        .join(sampling, "measure_name", "left")
        .select(
            profile_key(F.col("device_class"), F.col("measure_name"), F.col("zone_id")).alias("profile"),
            "device_class", "measure_name", "zone_id",
            classify_event_type(F.col("device_class"), event_types).alias("event_type"),
            "position", "unit", "range_min", "range_max", "resolution",
            *[t.lower() for t in TIER_NAMES],
            "mode", "interval_ms", "threshold", "failure",
        )
    )


def profile_tiers(profiles: DataFrame, keep: Sequence[str] = ("device_class", "measure_name", "zone_id")) -> DataFrame:
    """The tiers of assembled profiles as rows again."""
    tiers = F.array(*[
        F.struct(F.lit(t).alias("tier"), F.col(f"{t.lower()}.family").alias("family"),
                 F.col(f"{t.lower()}.params").alias("params"),
                 F.col(f"{t.lower()}.probability").alias("probability"))
        for t in TIER_NAMES
    ])
    return profiles.select(*keep, F.inline(tiers)).filter(F.col("family").isNotNull())


def measure_value(position: Column) -> Column:
    """The value column a measure is stored in: value, value2, value3 by its position from 0."""
    out = None
    for i, name in enumerate(VALUE_COLUMNS):
        out = F.when(position == i, F.col(name)) if out is None else out.when(position == i, F.col(name))
    return out.otherwise(F.col(VALUE_COLUMNS[0]))


def measure_position(device_class: Column, measure: Column,
                     order: dict[str, Sequence[str]] = MEASURE_ORDER) -> Column:
    """Position of a measure within its class; 0 for single-measure classes."""
    out = F.lit(0)
    for cls, names in order.items():
        for i, name in enumerate(names):
            out = F.when((device_class == cls) & (measure == name), i).otherwise(out)
    return out


def pack_measures(df: DataFrame, keys: Sequence[str] = ("device_id", "tick"),
                  position: str = "position", columns: Sequence[str] = VALUE_COLUMNS) -> DataFrame:
    """Long to wide: the measures of one device and tick in one of ``columns`` each.

    The reading with the largest event_id counts. A position without a column is an error,
    so no measure is lost; ``value_columns`` names columns for wider classes.
    """
    place = F.col(position)
    known = F.coalesce((place >= 0) & (place < len(columns)), F.lit(False))
    place = F.when(known, place).otherwise(F.raise_error(F.lit(f"a measure's position is not in 0..{len(columns) - 1}")))
    return df.withColumn(position, place).groupBy(*keys).agg(*[
        F.max_by("value", F.when(F.col(position) == i, F.col("event_id"))).alias(name)
        for i, name in enumerate(columns)
    ])


def unpack_measures(df: DataFrame, ids: Sequence[str] = ("device_id", "tick"),
                    columns: Sequence[str] = VALUE_COLUMNS) -> DataFrame:
    """Wide to long: one row per filled value column, with its position."""
    values = F.array(*[
        F.struct(F.lit(i).alias("position"), F.col(c).alias("reading"))
        for i, c in enumerate(columns)
    ])
    out = df.select(*ids, F.inline(values)).filter(F.col("reading").isNotNull())
    return out.withColumnRenamed("reading", "value")

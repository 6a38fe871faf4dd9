"""Synthetic readings and resource tables as column expressions.

Everything is a function of row keys (see ``functions/uniform.py``), so a lost
partition is regenerated identically and the result does not depend on how the
work was split.
"""

from collections.abc import Sequence
from dataclasses import replace
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickweave.functions.samplers import Draw, discrete_cdf, sample_value, with_cdf_rank
from tickweave.functions.scalars import clamp, interval_ticks
from tickweave.functions.uniform import digest, digest_from, fraction, stem, uniform
from tickweave.operators.ordered import with_row_number
from tickweave.operators.segments import Segments
from tickweave.schemas import TIER_NAMES

KEYS = ("device_id", "measure_name", "tick")
STEM = "_stem"
GRID_BLOCK = 4096      # ticks expanded by one task row

# Shares of device classes, and the values resource tables cycle through. Fixed values.
SENSOR_MIX = (
    ("SoilMoistureSensor", 0.50),
    ("AirTemperatureSensor", 0.20),
    ("HumiditySensor", 0.15),
    ("NPKSensor", 0.15),
)
ZONE_TYPES = ("IRRIGATED", "NON_IRRIGATED", "INDOOR")
PLOT_TYPES = ("OPEN_FIELD", "GREENHOUSE", "ORCHARD")
CROP_TYPES = ("wheat", "barley", "tomato", "maize", "soybean", "lettuce")
SOIL_TYPES = ("CLAY", "LOAM", "SANDY", "SILT")
DEPTHS_CM = (10, 20, 30, 40)
FIRST_PLOT_ID = 101
DEVICES_PER_PLOT = 6


def tick_grid(bindings: DataFrame, start: int, end: int, ms_per_tick: int,
              block: int = GRID_BLOCK) -> DataFrame:
    """One row per binding and due tick; ``end`` is inclusive.

    PERIODIC bindings are due every interval, all others on every tick. The grid is
    expanded in two steps, first to blocks of ticks, which are spread over the
    cluster, then to ticks, so a few bindings over a long time do not end up in
    a few tasks. If no binding has more ticks than a block, all ticks of a key (device and
    measure) are in one task, as a window over them needs it.
    """
    step = F.when(
        F.coalesce("mode", F.lit("PERIODIC")) == "PERIODIC",
        F.coalesce(interval_ticks(F.col("interval_ms"), ms_per_tick), F.lit(1)),
    ).otherwise(1).cast("bigint")
    n_due = F.floor((F.lit(end) - F.lit(start)) / F.col("_step")).cast("bigint") + 1
    blocks = (
        bindings.withColumn("_step", step)
        .withColumn("_n", n_due)
        .filter(F.col("_n") > 0)
        .withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / block))))
    )
    # a fixed number: the rows are few here but grow by up to ``block`` right after, so AQE
    # must not merge these partitions for being small
    dealt_by = ["device_id", "measure_name"] + ["_b"] * (end - start >= block)
    blocks = blocks.repartition(_parallelism(bindings.sparkSession), *dealt_by)
    first = F.col("_b") * block
    last = F.least(first + block, F.col("_n")) - 1
    return (
        blocks.withColumn("_i", F.explode(F.sequence(first, last)))
        .withColumn("tick", F.lit(start).cast("bigint") + F.col("_i") * F.col("_step"))
        .drop("_step", "_n", "_b", "_i")
    )


def _parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chosen_tier(u: Column, p_normal: Column, p_above: Column) -> Column:
    """NORMAL below p(NORMAL), ABOVE in the next p(ABOVE), else BELOW.

    A missing NORMAL probability counts as 1, a missing ABOVE probability as 0.
    """
    pn = F.coalesce(p_normal, F.lit(1.0))
    return F.when(u < pn, TIER_NAMES[0]).when(
        u < pn + F.coalesce(p_above, F.lit(0.0)), TIER_NAMES[1]
    ).otherwise(TIER_NAMES[2])


def prepare_profiles(profiles: DataFrame) -> DataFrame:
    """Add the discrete CDFs of each tier, once per profile."""
    for t in TIER_NAMES:
        name = t.lower()
        profiles = profiles.withColumn(
            f"{name}_cdf", discrete_cdf(F.col(f"{name}.family"), F.col(f"{name}.params"))
        )
    return profiles


def _digest(grid: DataFrame, seed: int, keys: Sequence[str], draw: str) -> Column:
    """The digest of a reading, from its binding's stem if the grid has it."""
    return digest_from(F.col(STEM), F.col("tick"), draw) if STEM in grid.columns else digest(seed, keys, draw)


def with_stem(bound: DataFrame, seed: int) -> DataFrame:
    """Work out once for a binding what the digests of all its readings begin with."""
    return bound.withColumn(STEM, stem(seed, [k for k in KEYS if k != "tick"]))


def with_tier(grid: DataFrame, seed: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Draw the tier of each reading; an undeclared tier is labelled NORMAL."""
    u = fraction(_digest(grid, seed, keys, "tier"))
    grid = grid.withColumn("_drawn", chosen_tier(u, F.col("normal.probability"), F.col("above.probability")))
    declared = F.lit(False)
    for t in TIER_NAMES:
        declared = declared | ((F.col("_drawn") == t) & F.col(t.lower()).isNotNull())
    return grid.withColumn("_declared", declared).withColumn(
        "tier", F.when(F.col("_declared"), F.col("_drawn")).otherwise(TIER_NAMES[0])
    )


def with_value(grid: DataFrame, seed: int, keys: Sequence[str] = KEYS,
               families: dict | None = None) -> DataFrame:
    """Sample the drawn tier's distribution and clamp it to the declared range.

    The value of an undeclared tier is 0.0. Expects ``with_tier`` and ``prepare_profiles``.
    """
    pick = lambda suffix: F.when(F.col("_drawn") == TIER_NAMES[0], F.col(f"normal{suffix}")).when(
        F.col("_drawn") == TIER_NAMES[1], F.col(f"above{suffix}")
    ).otherwise(F.col(f"below{suffix}"))
    grid = grid.withColumns(
        {"_spec": pick(""), "_cdf": pick("_cdf"), "_bits": _digest(grid, seed, keys, "value")}
    )
    grid, draw = with_draw(grid, F.col("_spec.params"), F.col("_bits"), F.col("_cdf"))
    # a column of its own: clamping names the value twice, and it would be drawn twice
    grid = grid.withColumn("_value", F.when(F.col("_declared"), sample_value(F.col("_spec.family"), draw, families)))
    drawn = clamp(F.col("_value"), F.col("range_min"), F.col("range_max"))
    return grid.withColumn(
        "value", F.when(F.col("_declared"), drawn).otherwise(F.lit(0.0))
    ).drop("_spec", "_cdf", "_bits", "_u2", "_rank", "_drawn", "_declared", "_value")


def value_draw(params: Column, bits: Column, cdf: Column | None = None) -> Draw:
    """The two uniforms of a value, from one digest."""
    none = F.lit(None).cast("struct<first:bigint,cdf:array<double>>")
    return Draw(params, fraction(bits, 0, open_interval=True), fraction(bits, 1), none if cdf is None else cdf)


def with_draw(grid: DataFrame, params: Column, bits: Column, cdf: Column) -> tuple[DataFrame, Draw]:
    """``value_draw`` for many rows: the second uniform and its rank in the CDF are columns, ``_u2`` and ``_rank``."""
    grid = with_cdf_rank(grid.withColumn("_u2", fraction(bits, 1)), "_rank", cdf, F.col("_u2"))
    return grid, replace(value_draw(params, bits, cdf), u2=F.col("_u2"), rank=F.col("_rank"))


def generate_readings(bound: DataFrame, start: int, end: int, ms_per_tick: int, seed: int) -> DataFrame:
    """Readings of bound profiles before transmission, values unrounded.

    ``bound`` comes from ``bind_profiles(bindings, prepare_profiles(profiles))``.
    ``event_id`` is a hash of the key, unique per (device, measure, tick) for all
    practical purposes and only used to order ties.
    """
    return drawn_readings(tick_grid(with_stem(bound, seed), start, end, ms_per_tick), seed)


def drawn_readings(grid: DataFrame, seed: int) -> DataFrame:
    """Tier, value and ``event_id`` of each row of a grid of bound profiles and ticks."""
    out = with_value(with_tier(grid, seed), seed)
    return out.withColumn("event_id", F.xxhash64(*KEYS)).drop(
        STEM, *[t.lower() for t in TIER_NAMES], *[f"{t.lower()}_cdf" for t in TIER_NAMES]
    )


def emitted(readings: DataFrame, digits: int = 4) -> DataFrame:
    """Readings as they leave the system: rounded, in the declared record shape."""
    keep = ["event_type", F.col("tick").alias("event_time"), "device_id", "measure_name",
            F.round("value", digits).alias("value"), "tier"]
    return readings.select(*keep)


def _cycle(values: Sequence[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(index, F.lit(len(values))).cast("int"))


def _draw_from(values: Sequence, seed: int, keys: Sequence[str], draw: str) -> Column:
    u = uniform(seed, keys, draw)
    return F.get(F.array(*[F.lit(v) for v in values]), F.floor(u * len(values)).cast("int"))


def _area(low: float, high: float, seed: int, keys: Sequence[str]) -> Column:
    return F.round(low + (high - low) * uniform(seed, keys, "area"), 1)


def make_zones(spark: SparkSession, n_zones: int, seed: int) -> DataFrame:
    zone = spark.range(1, n_zones + 1).withColumnRenamed("id", "zone_id")
    return zone.select(
        "zone_id",
        F.format_string("Zone_%d", "zone_id").alias("zone_name"),
        _cycle(ZONE_TYPES, F.col("zone_id") - 1).alias("zone_type"),
        _area(5.0, 50.0, seed, ["zone_id"]).alias("area_ha"),
    )


def plots_per_zone(n_devices: int, n_zones: int) -> int:
    return max(1, max(n_zones, n_devices // DEVICES_PER_PLOT) // n_zones)


def make_plots(spark: SparkSession, n_zones: int, per_zone: int, seed: int) -> DataFrame:
    """Zone after zone, ``per_zone`` plots each."""
    plot = spark.range(n_zones * per_zone).select(
        (F.col("id") + FIRST_PLOT_ID).alias("plot_id"),
        (F.floor(F.col("id") / per_zone) + 1).cast("bigint").alias("zone_id"),
    )
    key = ["plot_id"]
    return plot.select(
        "plot_id", "zone_id",
        F.format_string("Plot_%d", "plot_id").alias("plot_name"),
        _area(1.0, 10.0, seed, key).alias("area_ha"),
        _draw_from(PLOT_TYPES, seed, key, "plot_type").alias("plot_type"),
        _draw_from(SOIL_TYPES, seed, key, "soil_type").alias("soil_type"),
        _draw_from(CROP_TYPES, seed, key, "crop_type").alias("crop_type"),
    )


def class_counts(n_devices: int, mix: Sequence[tuple[str, float]] = SENSOR_MIX) -> list[tuple[str, int]]:
    return [(name, max(1, round(n_devices * ratio))) for name, ratio in mix]


def shuffle_stride(total: int) -> int:
    """A multiplier without a common factor with ``total``: i -> i*stride mod total shuffles."""
    stride = max(1, int(total * 0.6180339887))
    while gcd(stride, total) != 1:
        stride += 1
    return stride


def allocate_classes(df: DataFrame, index: str, n_devices: int,
                     mix: Sequence[tuple[str, float]] = SENSOR_MIX) -> DataFrame:
    """Device class of each index 0..n_devices-1, in the ratios of the mix.

    The class list is shuffled by a modular multiplication, a permutation every
    row can compute by itself.
    """
    counts = class_counts(n_devices, mix)
    total = sum(c for _, c in counts)
    slot = F.pmod(F.col(index) * shuffle_stride(total), F.lit(total))
    upper, out = 0, None
    for name, count in counts:
        upper += count
        out = F.when(slot < upper, name) if out is None else out.when(slot < upper, name)
    return df.withColumn("device_class", out)


def name_devices(df: DataFrame, index: str, n_plots: int, seed: int,
                 segments: Segments | None = None) -> DataFrame:
    """Plot, name and depth of devices that have an index and a class.

    Names count per class. One class may hold most devices, so the count runs in
    segments of the index (see ``segments.py``).
    """
    numbered = with_row_number(df, "_seq", ["device_class"], [index], segments)
    soil = F.contains("device_class", F.lit("Soil"))
    return numbered.select(
        F.format_string("%s_%04d", F.upper(F.substring("device_class", 1, 3)), "_seq").alias("device_id"),
        "device_class",
        (F.pmod(F.col(index), F.lit(n_plots)) + FIRST_PLOT_ID).alias("plot_id"),
        F.when(soil, _draw_from(DEPTHS_CM, seed, [index], "depth")).alias("depth_cm"),
    )


def make_devices(spark: SparkSession, n_devices: int, n_plots: int, seed: int) -> DataFrame:
    return name_devices(allocate_classes(spark.range(n_devices), "id", n_devices), "id", n_plots, seed)

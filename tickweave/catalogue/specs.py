"""Binding and specification queries.

Customers stand for devices, nations for plots, regions for zones. The spec tables
are derived from the event table: measured statistics become declarations.
"""

from pyspark.sql import functions as F

from tickweave.catalogue.base import query, r4, readings, sql_r4, table, with_readings
from tickweave.operators.binding import bind_devices, bind_profiles, select_for_zone, synthetic_bindings
from tickweave.operators.specs import (
    assemble_profiles, classify_event_type, effective_arrivals, effective_tiers,
)

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
MEASURES = ("click", "error", "purchase", "signup", "view")
_CATEGORIES = (("soil", ("ring", "widget")), ("environment", ("bolt", "gear")), ("vital", ("gizmo",)))
_EVENT_TYPES = ("sensor_reading", "reading_soil", "environment_reading", "alert")


def devices(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("device_id"), F.col("c_mktsegment").alias("device_class"),
        F.col("c_nationkey").cast("bigint").alias("plot_id"))


def plots(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("plot_id"), F.col("n_regionkey").cast("bigint").alias("zone_id"))


def measures(spark, sf_dir):
    """Event types seen per customer segment, with their range."""
    names = F.array(*[F.lit(m) for m in MEASURES])
    seen = table(spark, sf_dir, "events").join(
        table(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey"))
    return seen.groupBy(F.col("c_mktsegment").alias("device_class"), F.col("event_type").alias("measure_name")).agg(
        F.min("value").alias("range_min"), F.max("value").alias("range_max")
    ).withColumn(
        "position", (F.array_position(names, F.col("measure_name")) - 1).cast("int")
    ).withColumn("unit", F.lit("units")).withColumn("resolution", F.lit(0.01))


def tiers(spark, sf_dir):
    """Measured tier statistics as declarations; an older one of some measures is superseded."""
    r = readings(spark, sf_dir).withColumn("zone_id", F.col("device_id").cast("bigint") % 5)
    grouped = r.groupBy("measure_name", "zone_id", "tier").agg(
        F.count(F.lit(1)).alias("n"), r4(F.avg("value")).alias("mean"),
        r4(F.coalesce(F.stddev_samp("value"), F.lit(1.0))).alias("std_dev"))
    total = grouped.groupBy("measure_name", "zone_id").agg(F.sum("n").alias("total"))
    now = grouped.join(total, ["measure_name", "zone_id"]).select(
        "measure_name", "zone_id", "tier", F.lit("NORMAL").alias("family"),
        F.create_map(F.lit("mean"), F.col("mean"), F.lit("std_dev"), F.col("std_dev")).alias("params"),
        (F.col("n") / F.col("total")).alias("probability"), F.lit(2).alias("decl_order"))
    old = grouped.filter("measure_name < 'f'").select(
        "measure_name", "zone_id", "tier", F.lit("UNIFORM").alias("family"),
        F.create_map(F.lit("low"), F.lit(0.0), F.lit("high"), F.col("mean") + 1).alias("params"),
        F.lit(0.5).alias("probability"), F.lit(1).alias("decl_order"))
    return now.unionByName(old)


def arrivals(spark, sf_dir):
    """One arrival per zone (as stream) and event type; the last stream counts."""
    r = readings(spark, sf_dir)
    n = F.length("measure_name")
    return r.groupBy("zone_id", "measure_name").agg(F.avg("value").alias("m")).select(
        F.format_string("stream_%d", "zone_id").alias("stream"), "measure_name",
        F.when(n % 3 == 0, "ON_THRESHOLD").when(n % 3 == 1, "ON_CHANGE").otherwise("PERIODIC").alias("mode"),
        (60000.0 * F.col("zone_id") * n).alias("interval_ms"), r4("m").alias("threshold"),
        (F.col("zone_id") / 10.0).alias("failure_prob"), F.col("zone_id").cast("int").alias("decl_order"))


MEASURES_SQL = """measures AS (
  SELECT c_mktsegment AS device_class, event_type AS measure_name, min(value) AS range_min, max(value) AS range_max
  FROM events JOIN customer ON user_id = c_custkey GROUP BY ALL)"""
TIERS_SQL = f"""grouped AS (
  SELECT measure_name, CAST(device_id AS BIGINT) % 5 AS zone_id, tier, count(*) AS n,
         {sql_r4('avg(value)')} AS mean, {sql_r4('coalesce(stddev_samp(value), 1.0)')} AS std_dev
  FROM readings GROUP BY ALL),
tiers AS (SELECT measure_name, zone_id, tier, mean, std_dev,
         CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY measure_name, zone_id) AS probability FROM grouped)"""
ARRIVALS_SQL = f"""arrivals AS (
  SELECT measure_name, CASE length(measure_name) % 3 WHEN 0 THEN 'ON_THRESHOLD' WHEN 1 THEN 'ON_CHANGE'
         ELSE 'PERIODIC' END AS mode, CAST(60000.0 * zone_id * length(measure_name) AS DOUBLE) AS interval_ms,
         {sql_r4('avg(value)')} AS threshold, zone_id / 10.0::DOUBLE AS failure_prob, zone_id AS decl_order
  FROM readings GROUP BY zone_id, measure_name
  QUALIFY row_number() OVER (PARTITION BY measure_name ORDER BY zone_id DESC) = 1)"""
BINDINGS_SQL = """bindings AS (
  SELECT CAST(c_custkey AS VARCHAR) AS device_id, c_mktsegment AS device_class, measure_name,
         CAST(n_regionkey AS BIGINT) AS zone_id,
         c_mktsegment || '_' || measure_name || '_zone' || n_regionkey AS profile
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN measures ON device_class = c_mktsegment)"""
PROFILES_SQL = """profiles AS (
  SELECT device_class || '_' || measure_name || '_zone' || zone_id AS profile, device_class, measure_name, zone_id,
         range_min, range_max,
         max(mean) FILTER (WHERE tier = 'NORMAL') AS normal_mean, max(probability) FILTER (WHERE tier = 'NORMAL') AS normal_p,
         max(mean) FILTER (WHERE tier = 'ABOVE') AS above_mean, max(probability) FILTER (WHERE tier = 'ABOVE') AS above_p,
         max(std_dev) FILTER (WHERE tier = 'BELOW') AS below_std, max(probability) FILTER (WHERE tier = 'BELOW') AS below_p,
         any_value(mode) AS mode, any_value(interval_ms) AS interval_ms, any_value(threshold) AS threshold,
         any_value(failure_prob) AS failure
  FROM measures JOIN tiers USING (measure_name) LEFT JOIN arrivals USING (measure_name)
  GROUP BY device_class, measure_name, zone_id, range_min, range_max)"""


def profiles(spark, sf_dir):
    return assemble_profiles(measures(spark, sf_dir), tiers(spark, sf_dir), arrivals(spark, sf_dir))


@query(with_readings("SELECT * FROM bindings", MEASURES_SQL, BINDINGS_SQL))
def binding_join(spark, sf_dir):
    out = bind_devices(devices(spark, sf_dir), plots(spark, sf_dir), measures(spark, sf_dir))
    return out.select("device_id", "device_class", "measure_name", "zone_id", "profile")


def _flat(p):
    return p.select(
        "profile", "device_class", "measure_name", "zone_id", "range_min", "range_max",
        F.try_element_at("normal.params", F.lit("mean")).alias("normal_mean"), r4("normal.probability").alias("normal_p"),
        F.try_element_at("above.params", F.lit("mean")).alias("above_mean"), r4("above.probability").alias("above_p"),
        F.try_element_at("below.params", F.lit("std_dev")).alias("below_std"), r4("below.probability").alias("below_p"),
        "mode", "interval_ms", "threshold", "failure")


@query(with_readings(f"""
  SELECT profile, device_class, measure_name, zone_id, range_min, range_max, normal_mean, {sql_r4('normal_p')} AS normal_p,
         above_mean, {sql_r4('above_p')} AS above_p, below_std, {sql_r4('below_p')} AS below_p,
         mode, interval_ms, threshold, failure FROM profiles""",
                     MEASURES_SQL, TIERS_SQL, ARRIVALS_SQL, PROFILES_SQL))
def profile_assembly(spark, sf_dir):
    return _flat(profiles(spark, sf_dir))


@query(with_readings("""
  SELECT device_id, profile, b.zone_id, p.mode, p.failure FROM bindings b JOIN profiles p USING (profile)""", MEASURES_SQL, TIERS_SQL, ARRIVALS_SQL, BINDINGS_SQL, PROFILES_SQL))
def profile_binding(spark, sf_dir):
    bindings = bind_devices(devices(spark, sf_dir), plots(spark, sf_dir), measures(spark, sf_dir))
    return bind_profiles(bindings, profiles(spark, sf_dir)).select("device_id", "profile", "zone_id", "mode", "failure")


@query(with_readings(f"""
  SELECT event_id, device_id, r.measure_name, r.zone_id, {sql_r4('value - mean')} AS off
  FROM readings r JOIN tiers t ON r.measure_name = t.measure_name AND r.zone_id = t.zone_id AND t.tier = 'NORMAL'""",
                     TIERS_SQL))
def zone_parameters(spark, sf_dir):
    declared = effective_tiers(tiers(spark, sf_dir)).filter("tier = 'NORMAL'").select(
        "measure_name", "zone_id", F.try_element_at("params", F.lit("mean")).alias("mean"))
    out = select_for_zone(readings(spark, sf_dir), declared)
    return out.select("event_id", "device_id", "measure_name", "zone_id", r4(F.col("value") - F.col("mean")).alias("off"))


@query(with_readings("SELECT measure_name, mode, interval_ms, threshold, failure_prob FROM arrivals", ARRIVALS_SQL))
def last_arrival_wins(spark, sf_dir):
    return effective_arrivals(arrivals(spark, sf_dir)).select(
        "measure_name", "mode", "interval_ms", "threshold", "failure_prob")


@query(with_readings("SELECT measure_name, zone_id, tier, 'NORMAL' AS family, mean FROM tiers", TIERS_SQL))
def last_distribution_wins(spark, sf_dir):
    return effective_tiers(tiers(spark, sf_dir)).select(
        "measure_name", "zone_id", "tier", "family", F.try_element_at("params", F.lit("mean")).alias("mean"))


_SYNTHETIC_SQL = """dists AS (SELECT DISTINCT measure_name, zone_id FROM readings),
  classes AS (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) AS device_class)"""


@query(with_readings("""
  SELECT substr(device_class, 1, 6) || '_' || substr(measure_name, 1, 4) || '_z' || zone_id AS device_id,
         device_class, zone_id * 10 AS plot_id FROM dists, classes""", _SYNTHETIC_SQL))
def synthetic_devices(spark, sf_dir):
    out, _, _ = synthetic_bindings(SEGMENTS, readings(spark, sf_dir))
    return out.select("device_id", "device_class", "plot_id")


@query(with_readings("SELECT DISTINCT zone_id * 10 AS plot_id, zone_id FROM dists", _SYNTHETIC_SQL))
def synthetic_plots(spark, sf_dir):
    return synthetic_bindings(SEGMENTS, readings(spark, sf_dir))[1]


@query("""
  SELECT p_partkey, CASE WHEN c LIKE '%ring%' OR c LIKE '%widget%' THEN 'reading_soil'
                         WHEN c LIKE '%bolt%' OR c LIKE '%gear%' THEN 'environment_reading'
                         ELSE 'sensor_reading' END AS event_type
  FROM (SELECT p_partkey, lower(p_name || ' ' || p_type) AS c FROM part)""")
def classify_parts(spark, sf_dir):
    cls = F.concat_ws(" ", "p_name", "p_type")
    return table(spark, sf_dir, "part").select(
        "p_partkey", classify_event_type(cls, _EVENT_TYPES, _CATEGORIES).alias("event_type"))


@query("""
  SELECT p_partkey, CASE WHEN c LIKE '%moisture%' OR c LIKE '%temperature%' OR c LIKE '%npk%' OR c LIKE '%ph%'
      OR c LIKE '%salinity%' OR c LIKE '%insect%' OR c LIKE '%soil%' THEN 'reading_soil'
      WHEN c LIKE '%air%' OR c LIKE '%humidity%' OR c LIKE '%co2%' OR c LIKE '%solar%' OR c LIKE '%wind%'
      OR c LIKE '%rain%' THEN 'environment_reading' ELSE 'sensor_reading' END AS event_type
  FROM (SELECT p_partkey, lower(p_name || ['Moisture', 'Air', 'NPK', 'ECG', 'RFID', 'Rain'][p_size % 6 + 1]) AS c FROM part)""")
def classify_sensors(spark, sf_dir):
    kind = F.get(F.array(*[F.lit(k) for k in ("Moisture", "Air", "NPK", "ECG", "RFID", "Rain")]), F.col("p_size") % 6)
    return table(spark, sf_dir, "part").select(
        "p_partkey", classify_event_type(F.concat("p_name", kind), _EVENT_TYPES).alias("event_type"))

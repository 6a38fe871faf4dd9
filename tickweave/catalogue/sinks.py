"""Round trips through the sources and sinks."""

from pyspark.sql import functions as F

from tickweave.catalogue import conformance as conf, specs
from tickweave.catalogue.base import query, r4, readings, with_readings
from tickweave.catalogue.storage import shared_folder
from tickweave.sources import (
    read_readings, read_resources, write_events, write_profiles, write_report, write_resource_documents, write_resources,
)
from tickweave.sources.files import report_rows
from tickweave.schemas import DEVICES, PLOTS, ZONES

_EVENTS_SQL = with_readings("""
  SELECT event_type, tick AS event_time, device_id, measure_name, value, tier FROM readings""")


def _events(spark, sf_dir):
    return readings(spark, sf_dir).select(
        "event_id", "event_type", F.col("tick").alias("event_time"), "device_id", "measure_name", "value",
        F.lit(None).cast("double").alias("value2"), "tier")


def _back(df):
    return df.select("event_type", "event_time", "device_id", "measure_name", "value", "tier")


_RESOURCES_SQL = """
  SELECT 'device' AS kind, CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS device_class,
         CAST(c_nationkey AS BIGINT) AS plot_id, CAST(NULL AS BIGINT) AS zone_id FROM customer
  UNION ALL SELECT 'plot', NULL, NULL, CAST(n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT) FROM nation
  UNION ALL SELECT DISTINCT 'zone', NULL, NULL, NULL, CAST(n_regionkey AS BIGINT) FROM nation"""


def _resources(devices, plots, zones):
    """The three resource tables as one."""
    nothing = F.lit(None)
    return devices.select(
        F.lit("device").alias("kind"), F.col("device_id").alias("id"), "device_class", "plot_id",
        nothing.cast("bigint").alias("zone_id")
    ).unionByName(plots.select(F.lit("plot").alias("kind"), "plot_id", "zone_id"), allowMissingColumns=True
    ).unionByName(zones.select(F.lit("zone").alias("kind"), "zone_id"), allowMissingColumns=True)


@query(_EVENTS_SQL)
def events_json_round_trip(spark, sf_dir):
    path = shared_folder(spark, "events-json")
    write_events(_events(spark, sf_dir), path)
    return _back(read_readings(spark, path))


@query(_EVENTS_SQL)
def events_parquet_round_trip(spark, sf_dir):
    path = shared_folder(spark, "events-parquet")
    write_events(_events(spark, sf_dir), path, "parquet")
    return _back(read_readings(spark, path, "parquet"))


@query(with_readings("""
  SELECT profile, device_class, measure_name, zone_id, range_min, range_max, mode, interval_ms, threshold, failure
  FROM profiles""", specs.MEASURES_SQL, specs.TIERS_SQL, specs.ARRIVALS_SQL, specs.PROFILES_SQL))
def profiles_round_trip(spark, sf_dir):
    path = shared_folder(spark, "profiles")
    profiles = specs.profiles(spark, sf_dir)
    write_profiles(profiles, path)
    return spark.read.schema(profiles.schema).json(path).select(
        "profile", "device_class", "measure_name", "zone_id", "range_min", "range_max", "mode",
        "interval_ms", "threshold", "failure")


@query(_RESOURCES_SQL)
def resources_round_trip(spark, sf_dir):
    path = shared_folder(spark, "resources")
    zones = specs.plots(spark, sf_dir).select("zone_id").distinct()
    write_resources(specs.devices(spark, sf_dir), specs.plots(spark, sf_dir), zones, path)
    return _resources(*(spark.read.schema(shape).json(f"{path}/{name}")
                        for name, shape in (("devices", DEVICES), ("plots", PLOTS), ("zones", ZONES))))


@query(_RESOURCES_SQL)
def resource_documents_round_trip(spark, sf_dir):
    path = shared_folder(spark, "resource-documents")
    zones = specs.plots(spark, sf_dir).select("zone_id").distinct()
    write_resource_documents(specs.devices(spark, sf_dir), specs.plots(spark, sf_dir), zones, path, per_document=500)
    return _resources(*read_resources(spark, path))


@query(with_readings("""
  SELECT device_id, measure_name, zone_id, n_events, observed_mean AS mean_observed, n_transitions,
         CAST(n_tiers AS INTEGER) AS n_tiers, overall_pass
  FROM judged JOIN (SELECT device_class, measure_name, zone_id, count(*) AS n_tiers FROM declared GROUP BY ALL)
       USING (device_class, measure_name, zone_id)""", *conf.judged_sql(conf.FIRST)))
def report_round_trip(spark, sf_dir):
    path = shared_folder(spark, "report")
    results = conf.results(spark, sf_dir)
    results = results.withColumn("observed_mean", r4("observed_mean"))      # as in the SQL; the report rounds it once more
    write_report(results, path)
    return spark.read.schema(report_rows(results).schema).json(path).select(
        "device_id", "measure_name", "zone_id", "n_events",
        F.col("mean.observed").alias("mean_observed"), F.col("transitions.count").alias("n_transitions"),
        F.size("tiers").alias("n_tiers"), "overall_pass")

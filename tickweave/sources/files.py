"""Files: resources, readings, profiles, events and reports."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from tickweave import schemas
from tickweave.schemas import TIER_NAMES


def read_resources(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Devices, plots and zones from JSON objects with three arrays, one to a file."""
    doc = spark.read.schema(schemas.RESOURCES).option("multiLine", True).json(path)
    return tuple(doc.select(F.inline(name)) for name in ("devices", "plots", "zones"))


def write_resources(devices: DataFrame, plots: DataFrame, zones: DataFrame, path: str,
                    mode: str = "error") -> None:
    """One directory per table: large fleets do not fit one JSON object."""
    for name, df in (("devices", devices), ("plots", plots), ("zones", zones)):
        df.write.mode(mode).json(f"{path}/{name}")


def write_resource_documents(devices: DataFrame, plots: DataFrame, zones: DataFrame, path: str,
                             per_document: int = 10_000, mode: str = "error") -> None:
    """Documents that ``read_resources`` reads, each with about ``per_document`` rows of one table.

    Rows are dealt by a hash of all their columns, so no document grows with the fleet,
    and a document that is written again is the same.
    """
    documents = []
    for name, df in (("devices", devices), ("plots", plots), ("zones", zones)):
        n = max(1, -(-df.count() // per_document))
        number = F.format_string(f"{name}-%d", F.pmod(F.xxhash64(*df.columns), F.lit(n)))
        rows = df.groupBy(number.alias("document")).agg(F.collect_list(F.struct(*df.columns)).alias(name))
        documents.append(rows.select("document", F.to_json(F.struct(name)).alias("value")))
    reduce(DataFrame.unionByName, documents).write.mode(mode).partitionBy("document").text(path)


def read_readings(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Readings and derived events from JSON Lines or Parquet; blank lines are skipped."""
    return spark.read.schema(schemas.READINGS).format(fmt).load(path)


def stream_readings(spark: SparkSession, path: str, fmt: str = "json",
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """The same files as a stream."""
    reader = spark.readStream.schema(schemas.READINGS).format(fmt)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def read_profiles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Profiles and bindings from a compiled profile file."""
    doc = spark.read.schema(schemas.PROFILE_FILE).option("multiLine", True).json(path)
    named = doc.select(F.explode("profiles").alias("profile", "p"))
    tier = lambda t: F.when(
        F.col(f"p.{t}").isNotNull(),
        F.struct(
            F.col(f"p.{t}.distribution.type").alias("family"),
            F.col(f"p.{t}.distribution.params").alias("params"),
            F.col(f"p.{t}.probability").alias("probability"),
        ),
    ).alias(t)
    profiles = named.select(
        "profile",
        # a key is <class>_<measure>_zone<n>; what remains without the tail is the class
        F.expr("left(profile, length(profile) - length(concat('_', p.measure_name, '_zone', p.zone_id)))")
        .alias("device_class"),
        "p.measure_name", "p.zone_id", "p.event_type", "p.unit",
        F.col("p.valid_range.min").alias("range_min"), F.col("p.valid_range.max").alias("range_max"),
        "p.resolution", *[tier(t.lower()) for t in TIER_NAMES],
        "p.sampling.mode", "p.sampling.interval_ms", "p.sampling.threshold", "p.sampling.failure",
    )
    bindings = doc.select(F.posexplode("bindings").alias("binding_idx", "b")).select(
        F.col("binding_idx").cast("bigint"), "b.*"
    )
    return profiles, bindings


def write_profiles(df: DataFrame, path: str, fmt: str = "json", mode: str = "error") -> None:
    """Profiles or bindings as a table."""
    df.write.mode(mode).format(fmt).save(path)


def write_events(df: DataFrame, path: str, fmt: str = "json", mode: str = "error") -> None:
    """Events as JSON Lines without null fields, or as Parquet partitioned by event type."""
    if fmt == "json":
        df.write.mode(mode).option("ignoreNullFields", True).json(path)
    elif fmt == "parquet":
        df.write.mode(mode).partitionBy("event_type").parquet(path)
    else:
        raise ValueError(f"unknown event format {fmt!r}")


def write_events_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "json") -> DataStreamWriter:
    """The same as a streaming sink; start it with ``.start()``."""
    writer = df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
    return writer.partitionBy("event_type") if fmt == "parquet" else writer


def report_rows(results: DataFrame) -> DataFrame:
    """Conformance results in the nested shape of the report file."""
    tier = lambda t: F.struct(
        t["tier"].alias("tier"), F.round(t["observed_prob"], 4).alias("observed_prob"),
        F.round(t["declared_prob"], 4).alias("declared_prob"), t["pass"].alias("pass"),
        F.round(t["deviation_pp"], 2).alias("deviation_pp"),
    )
    both = lambda name: F.struct(
        F.round(f"observed_{name}", 4).alias("observed"),
        F.round(f"declared_{name}", 4).alias("declared"), F.col(f"{name}_ok").alias("pass"),
    ).alias(name)
    return results.select(
        *[c for c in ("device_id", "device_class", "measure_name", "zone_id") if c in results.columns],
        "n_events", both("mean"), both("std"), F.transform("tiers", tier).alias("tiers"),
        F.struct(
            F.col("n_transitions").alias("count"), F.round("transition_rate", 2).alias("observed_rate"),
            F.round("expected_transition_rate", 2).alias("expected_rate"),
            F.col("transition_ok").alias("pass"),
        ).alias("transitions"),
        F.struct(F.col("n_out_of_range"), F.col("range_ok").alias("pass")).alias("range"),
        "overall_pass",
    )


def write_report(results: DataFrame, path: str, mode: str = "error") -> None:
    report_rows(results).write.mode(mode).json(path)

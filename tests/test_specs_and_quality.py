"""Spec assembly, binding, checks and files on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from tickweave import schemas
from tickweave.functions.scalars import duration_ms, interval_ticks, tick_of
from tickweave.operators import quality as q
from tickweave.operators.binding import bind_devices, bind_profiles, synthetic_bindings
from tickweave.operators.specs import assemble_profiles, classify_event_type, effective_arrivals, pack_measures, unpack_measures, value_columns
from tickweave.operators.summaries import scale_vs_first, scaling_exponent, throughput
from tickweave.operators.transmit import with_stale_flag
from tickweave.plans import example_farm as farm
from tickweave.sources import read_profiles, read_readings, read_resources, write_events


def test_units(spark):
    df = spark.createDataFrame([(2.0, "MS"), (2.0, "sec"), (2.0, "MIN"), (2.0, "HOURS"), (2.0, "DAYS"), (2.0, "DAY")], "n double, u string")
    ms = [r.ms for r in df.select(duration_ms(F.col("n"), F.col("u")).alias("ms")).collect()]
    assert ms == [2, 2000, 120000, 7200000, 172800000, 2000]
    t = spark.createDataFrame([(10.0,), (60000.0,), (179999.0,)], "ms double").select(interval_ticks(F.col("ms"), 60000).alias("t"))
    assert [r.t for r in t.collect()] == [1, 1, 2]
    ts = spark.sql("SELECT timestamp'1970-01-01 00:02:59' AS ts").select(tick_of(F.col("ts")).alias("t"))
    assert ts.first().t == 2


@pytest.mark.parametrize("cls,want", [
    ("SoilMoistureSensor", "r_soil"), ("AirTemperatureSensor", "r_soil"), ("HumiditySensor", "r_environment"),
    ("ECGSensor", "first"), ("Unknown", "first")])
def test_classification(spark, cls, want):
    types = ["first", "r_soil", "r_environment"]      # no vital type is declared
    assert spark.range(1).select(classify_event_type(F.lit(cls), types).alias("t")).first().t == want
    assert spark.range(1).select(classify_event_type(F.lit(cls), []).alias("t")).first().t == "sensor_reading"


def test_binding(spark):
    devices = spark.createDataFrame([("s", "SoilMoistureSensor", 11, 30), ("n", "NPKSensor", 12, None), ("lost", "NPKSensor", 99, None), ("odd", "Other", 11, None)], schemas.DEVICES)
    plots = spark.createDataFrame([(11, 1), (12, 7)], "plot_id long, zone_id long")
    out = bind_devices(devices, plots, farm.measures(spark))
    assert sorted((r.device_id, r.profile, r.depth_cm) for r in out.collect()) == [
        ("n", "NPKSensor_Nitrogen_zone7", None), ("n", "NPKSensor_Phosphorus_zone7", None), ("n", "NPKSensor_Potassium_zone7", None),
        ("s", "SoilMoistureSensor_Moisture_zone1", 30)]
    profiles = assemble_profiles(farm.measures(spark), farm.tiers(spark), farm.arrivals(spark), farm.EVENT_TYPES)
    assert profiles.count() == 12
    assert [r.device_id for r in bind_profiles(out, profiles).collect()] == ["s"]
    soil = profiles.filter("profile = 'SoilMoistureSensor_Moisture_zone2'").first()
    assert (soil.mode, soil.threshold, soil.failure, soil.above.params["mean"], soil.event_type) == ("ON_CHANGE", 2.0, 0.1, 62.0, "sensor_reading")


def test_last_declaration_wins(spark):
    a = spark.createDataFrame([("s1", "m", "PERIODIC", 1000.0, None, 0.1, 0), ("s2", "m", "ON_CHANGE", None, 2.0, 0.2, 1)], schemas.ARRIVALS)
    assert [(r.mode, r.interval_ms, r.threshold) for r in effective_arrivals(a).collect()] == [("ON_CHANGE", None, 2.0)]


def test_synthetic_bindings(spark):
    d, p, z = synthetic_bindings(["Sensor1", "Sensor2"], spark.createDataFrame([("Moisture", 1), ("Moisture", 2), ("Air", 1)], "measure_name string, zone_id int"))
    assert d.count() == 6 and {r.device_id for r in d.filter("device_class = 'Sensor1'").collect()} == {"Sensor_Mois_z1", "Sensor_Mois_z2", "Sensor_Air_z1"}
    assert sorted(map(tuple, p.collect())) == [(10, 1), (20, 2)] and z.count() == 2


def test_pack_and_unpack(spark):
    df = spark.createDataFrame([("d", 1, 0, 5.0, 1), ("d", 1, 2, 7.0, 2), ("d", 1, 2, 8.0, 3)], "device_id string, tick long, position int, value double, event_id long")
    wide = pack_measures(df)
    assert tuple(wide.first()) == ("d", 1, 5.0, None, 8.0)
    assert sorted(map(tuple, unpack_measures(wide).collect())) == [("d", 1, 0, 5.0), ("d", 1, 2, 8.0)]
    five = value_columns(5)
    wider = df.unionByName(df.where("position = 0").withColumn("position", F.lit(4)))
    assert tuple(pack_measures(wider, columns=five).first()) == ("d", 1, 5.0, None, 8.0, None, 5.0)
    assert unpack_measures(pack_measures(wider, columns=five), columns=five).count() == 3
    with pytest.raises(Exception, match="position"):
        pack_measures(wider).collect()
    assert "SortAggregate" not in wide._jdf.queryExecution().toString()


def test_functional_dependency_sees_nulls(spark):
    df = spark.createDataFrame([(1, "a", None), (1, None, "a"), (2, "b", None), (2, "b", None)], "k int, x string, y string")
    assert [r.subject for r in q.functional_dependency(df, ["k"], ["x", "y"]).collect()] == ["1"]


def found(df):
    return sorted((r.check, r.subject) for r in df.collect())


def test_example_spec_is_clean(spark):
    assert q.spec_violations(farm.measures(spark), farm.tiers(spark), farm.arrivals(spark)).count() == 0


def test_spec_checks(spark):
    t = spark.createDataFrame([
        ("m", 1, "NORMAL", "NORMAL", {"mean": 1.0, "std_dev": 0.0}, 0.5, 1), ("m", 1, "NORMAL", "UNIFORM", {"low": 2.0, "high": 2.0}, 0.5009, 1),
        ("m", 2, "ABOVE", "BINOMIAL", {"n": 3.0, "p": 1.5}, 0.9, 1), ("x", 1, "NORMAL", "POISSON", {}, 1.0, 2), ("x", 1, "NORMAL", "ODD", {}, 1.0, 1)], schemas.TIERS)
    assert found(q.probabilities_sum_to_one(t)) == [("probability_sum", "m zone=2"), ("probability_sum", "x zone=1")]
    assert found(q.one_normal_tier(t)) == [("one_normal_tier", s) for s in ("m zone=1", "m zone=2", "x zone=1")]
    assert [r.message for r in q.missing_parameters(t).collect()] == ["POISSON: mean"]
    assert sorted(r.message for r in q.parameter_sanity(t).collect()) == ["low must be < high", "p must be in [0,1]", "std_dev must be > 0"]
    assert found(q.repeated_distributions(t)) == [("repeated_distribution", "x")]
    a = spark.createDataFrame([("s", "m", "PERIODIC", None, None, 1.5, 0), ("s", "y", "ON_CHANGE", None, None, 0.0, 1), ("s", "m", "PERIODIC", 1.0, None, 1.0, 2)], schemas.ARRIVALS)
    assert sorted(r.message for r in q.arrival_sanity(a).collect()) == ["ON_CHANGE requires a threshold", "PERIODIC requires an interval", "failure must be in [0,1]"]
    m = spark.createDataFrame([("c", "m", False)], "device_class string, measure_name string, zone_enum boolean")
    assert found(q.unknown_measures(a, m, "arrival", q.WARN)) == [("arrival", "y")]
    assert found(q.zone_without_discriminator(t, m)) == [("zone_without_discriminator", "c.m")]
    only_warn = q.roll_up(q.repeated_distributions(t)).first()
    assert (only_warn.n_errors, only_warn.n_warnings, only_warn.passed) == (0, 1, True)
    assert not q.roll_up(q.arrival_sanity(a)).first().passed


def test_data_checks(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (1, "b", 50.05), (2, None, -1.0), (None, "a", 1.0)], "id int, name string, v double")
    assert found(q.duplicates(df, ["id"])) == [("duplicate", "1")]
    assert found(q.primary_key(df, ["id"])) == [("primary_key", ""), ("primary_key", "1")]
    assert found(q.functional_dependency(df, ["id"], ["name"])) == [("functional_dependency", "1")]
    assert found(q.functional_dependency(df, ["name"], ["id"])) == [("functional_dependency", "a")]
    assert found(q.orphans(df, spark.createDataFrame([(2,)], "pid int"), ["id"], ["pid"])) == [("orphan", "1")]
    assert found(q.out_of_range(df, "v", F.lit(0.0), F.lit(None).cast("double"), F.col("id"))) == [("range", "2")]
    assert found(q.off_resolution(df, "v", F.lit(0.1), F.col("id"))) == [("resolution", "1")]
    cols = spark.createDataFrame([("t", "a")], "table_name string, column_name string")
    refs = spark.createDataFrame([("x", "1", "t", "a"), ("x", "2", "t", "b"), ("x", "3", "u", "a"), ("x", "4", "DEVICE_CLASS", "q")],
                                 "table_name string, column_name string, ref_table string, ref_column string")
    assert found(q.schema_references(cols, refs)) == [("unknown_column", "x.2"), ("unknown_table", "x.3")]
    uses = spark.createDataFrame([("s", ["a", "b"])], "name string, event_types array<string>")
    assert [r.message for r in q.unknown_event_types(uses, spark.createDataFrame([("a",)], "event_type string"), "c", q.ERROR).collect()] == ["b"]


def test_published_scaling(spark):
    rows = [("sweep", i, n, w) for i, (n, w) in enumerate([(14, 0.14), (64, 0.88), (130, 1.55), (326, 4.04), (650, 7.54), (1300, 16.72)])]
    runs = spark.createDataFrame(rows, "workload string, run int, n_devices int, wall_seconds double")
    r = scaling_exponent(runs).first()
    assert round(r.exponent, 2) == 1.03 and r.scaling == "near-linear"
    assert round(max(x.scale_vs_first for x in scale_vs_first(runs).collect()), 1) == 119.4
    t = throughput(runs.withColumn("n_events", F.col("n_devices") * 10).withColumn("n_ticks", F.lit(1440))).filter("run = 0").first()
    assert round(t.events_per_second) == 1000 and round(t.ms_per_1k_ticks, 2) == 97.22


def test_stale_flag(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS event_ts, timestamp'2024-01-01 00:05:00' AS ingest_ts "
                   "UNION ALL SELECT timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 00:05:01'")
    assert sorted(r.stale for r in with_stale_flag(df, "5 MINUTES").collect()) == [False, True]


def test_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({
        "devices": [{"device_id": "SM_001", "device_class": "SoilMoistureSensor", "plot_id": 11, "depth_cm": 30}, {"device_id": "N", "device_class": "NPKSensor", "plot_id": 11}],
        "plots": [{"plot_id": 11, "zone_id": 3}], "zones": [{"zone_id": 3, "zone_name": "North", "zone_type": "IRRIGATED"}]}, indent=2))
    devices, plots, zones = read_resources(spark, str(tmp_path / "r.json"))
    assert [r.depth_cm for r in devices.orderBy("device_id").collect()] == [None, 30] and plots.count() == zones.count() == 1
    (tmp_path / "e.jsonl").write_text('{"event_type":"sensor_reading","event_time":3,"device_id":"d","value":1.5}\n\n{"event_type":"alert","event_time":4,"device_id":"d","triggered_by":"alert"}\n')
    events = read_readings(spark, str(tmp_path / "e.jsonl"))
    assert sorted((r.event_time, r.triggered_by) for r in events.collect()) == [(3, None), (4, "alert")]
    write_events(events.coalesce(1), str(tmp_path / "out"))
    lines = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()]
    assert sorted(map(len, lines)) == [4, 4]      # null fields are left out
    write_events(events, str(tmp_path / "pq"), "parquet")
    assert {p.name for p in (tmp_path / "pq").glob("event_type=*")} == {"event_type=sensor_reading", "event_type=alert"}
    tier = {"distribution": {"type": "normal", "params": {"mean": 1.0, "std_dev": 2.0}}, "probability": 1.0}
    (tmp_path / "p.json").write_text(json.dumps({
        "profiles": {"A_b_Moisture_zone3": {"event_type": "sensor_reading", "measure_name": "Moisture", "unit": "u", "valid_range": {"min": 0, "max": 9},
                                             "resolution": 0.1, "zone_id": 3, "normal": tier, "sampling": {"mode": "PERIODIC", "interval_ms": 1000, "threshold": None, "failure": 0.1}}},
        "bindings": [{"device_id": "d", "device_class": "A_b", "profile": "A_b_Moisture_zone3", "zone_id": 3}]}))
    profiles, bindings = read_profiles(spark, str(tmp_path / "p.json"))
    p = profiles.first()
    assert (p.device_class, p.normal.params["std_dev"], p.above, p.failure) == ("A_b", 2.0, None, 0.1)
    assert bindings.first().binding_idx == 0

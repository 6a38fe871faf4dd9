"""Generation: families, tiers, grid, independence of partitioning, and the whole example."""

import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from tickweave.catalogue import QUERIES
from tickweave.functions import samplers
from tickweave.functions.samplers import discrete_cdf, sample_value, with_cdf
from tickweave.functions.scalars import clamp
from tickweave.functions.search import rank_in_sorted, with_rank
from tickweave.functions.uniform import digest, uniform
from tickweave.operators.conformance import summary
from tickweave.operators.generate import (
    allocate_classes, chosen_tier, class_counts, generate_readings, make_devices, make_plots, make_zones, plots_per_zone, prepare_profiles,
    shuffle_stride, tick_grid, value_draw, with_draw, with_tier, with_value,
)
from tickweave.plans import example_farm as farm
from tickweave.plans.end_to_end import Deployment, tick_range


def draws(spark, family, params, n=20_000):
    spec = with_cdf(spark.createDataFrame([(family, {k: float(v) for k, v in params.items()})],
                                          "family string, params map<string,double>"))
    df = spec.crossJoin(spark.range(n)).withColumn("bits", digest(7, ["id"], "v"))
    value = sample_value(F.col("family"), value_draw(F.col("params"), F.col("bits"), F.col("cdf")))
    return [r.v for r in df.select(value.alias("v")).collect()]


@pytest.mark.parametrize("family,params,mean,std", [
    ("NORMAL", {"mean": 5, "std_dev": 2}, 5, 2),
    ("uniform", {"low": 2, "high": 8}, 5, 6 / math.sqrt(12)),
    ("EXPONENTIAL", {"mean": 4}, 4, 4),
    ("POISSON", {"mean": 8}, 8, math.sqrt(8)),
    ("POISSON", {"mean": 100}, 99.5, 10),
    ("BINOMIAL", {"n": 20, "p": 0.3}, 6, math.sqrt(4.2)),
    ("BINOMIAL", {"n": 1_000_000, "p": 0.5}, 500_000, 500),
])
def test_moments(spark, family, params, mean, std):
    v = draws(spark, family, params)
    assert abs(statistics.mean(v) - mean) < 0.03 * std + 0.005 * mean * (mean < 1000)
    assert abs(statistics.stdev(v) / std - 1) < 0.05


@pytest.mark.parametrize("family,params,want", [
    ("POISSON", {"mean": 0}, {0.0}), ("POISSON", {"mean": -2}, {0.0}),
    ("BINOMIAL", {"n": 5, "p": 0}, {0.0}), ("BINOMIAL", {"n": 5, "p": 1}, {5.0}), ("BINOMIAL", {"n": 0, "p": 0.5}, {0.0}),
    ("CAUCHY", {"mean": 1}, {0.0}),
])
def test_edges(spark, family, params, want):
    assert set(draws(spark, family, params, 200)) == want


def test_a_distribution_too_wide_to_search_raises():
    with pytest.raises(ValueError):
        samplers._binomial_cdf(1 << 40, 0.5)


def test_cdf_matches_the_exact_one(spark):
    row = spark.createDataFrame([("binomial", {"n": 10.0, "p": 0.3})], "family string, params map<string,double>").select(
        discrete_cdf(F.col("family"), F.col("params")).alias("c")).first().c
    want, total = [], 0.0
    for k in range(11):
        total += math.comb(10, k) * 0.3 ** k * 0.7 ** (10 - k)
        want.append(total)
    assert row["first"] == 0 and all(abs(a - b) < 1e-12 for a, b in zip(row["cdf"], want))


@pytest.mark.parametrize("max_size", [1, 5, 300])
def test_rank_by_steps(spark, max_size):
    """The search in columns finds what the search in a lambda finds, and what counting finds."""
    rng = random.Random(max_size)
    data = [(sorted(rng.choice([0.0, 0.25, rng.random()]) for _ in range(rng.randrange(max_size + 1))), rng.choice([0.25, rng.random()]))
            for _ in range(200)] + [(None, 0.5), ([0.5] * max_size, 0.5), ([0.5] * max_size, None)]
    df = spark.createDataFrame(data, "a array<double>, x double")
    out = with_rank(df, "n", F.col("a"), F.col("x"), max_size)
    assert out.columns == ["a", "x", "n"]
    out = out.withColumn("m", rank_in_sorted(F.col("a"), F.col("x"), max_size)).collect()
    for r in out:
        want = sum(c <= r.x for c in r.a) if r.a is not None and r.x is not None else 0
        assert r.n == r.m == want


@pytest.mark.parametrize("family,params", [("POISSON", {"mean": 8}), ("POISSON", {"mean": 100}), ("BINOMIAL", {"n": 1_000_000, "p": 0.5})])
def test_draws_in_columns(spark, family, params):
    spec = with_cdf(spark.createDataFrame([(family, {k: float(v) for k, v in params.items()})],
                                          "family string, params map<string,double>"))
    df = spec.crossJoin(spark.range(20_000)).withColumn("bits", digest(7, ["id"], "v"))
    df, draw = with_draw(df, F.col("params"), F.col("bits"), F.col("cdf"))
    assert [r.v for r in df.select(sample_value(F.col("family"), draw).alias("v")).collect()] == draws(spark, family, params)


@pytest.mark.parametrize("name", ["gen_poisson", "gen_binomial", "gen_profile_readings"])
def test_readings_are_drawn_in_compiled_code(spark, name):
    """A lambda would have each reading's projection interpreted."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    per_reading = plan[:plan.index("Generate explode")]
    assert "md5" in per_reading and "lambda" not in per_reading


def test_user_family(spark):
    df = spark.createDataFrame([({"a": 3.0},)], "params map<string,double>").withColumn("bits", digest(1, [F.lit("x")], "v"))
    value = sample_value(F.lit("TRIPLE"), value_draw(F.col("params"), F.col("bits")), {"triple": lambda d: d.param("a") * 3})
    assert df.select(value.alias("v")).first().v == 9.0


def test_tier_choice_bounds(spark):
    df = spark.createDataFrame([(0.0,), (0.6999,), (0.7,), (0.7999,), (0.8,), (0.99,)], "u double")
    got = [r.t for r in df.select(chosen_tier(F.col("u"), F.lit(0.7), F.lit(0.1)).alias("t")).collect()]
    assert got == ["NORMAL", "NORMAL", "ABOVE", "ABOVE", "BELOW", "BELOW"]
    null = F.lit(None).cast("double")
    assert {r.t for r in df.select(chosen_tier(F.col("u"), null, null).alias("t")).collect()} == {"NORMAL"}


def test_missing_tier_gives_zero_labelled_normal(spark):
    spec = "struct<family:string,params:map<string,double>,probability:double>"
    cdf = "struct<first:bigint,cdf:array<double>>"
    df = spark.range(200).select(
        F.col("id").cast("string").alias("device_id"), F.lit("m").alias("measure_name"), F.col("id").alias("tick"),
        F.struct(F.lit("UNIFORM").alias("family"), F.create_map(F.lit("low"), F.lit(5.0), F.lit("high"), F.lit(6.0)).alias("params"),
                 F.lit(0.5).alias("probability")).alias("normal"),
        F.lit(None).cast(spec).alias("above"), F.lit(None).cast(spec).alias("below"),
        *[F.lit(None).cast(cdf).alias(f"{t}_cdf") for t in ("normal", "above", "below")],
        F.lit(1.0).alias("range_min"), F.lit(9.0).alias("range_max"))
    out = with_value(with_tier(df, 3), 3).collect()
    assert {r.tier for r in out} == {"NORMAL"}
    zero = [r for r in out if r.value == 0.0]      # not clamped to the range
    assert 60 < len(zero) < 140 and all(5 <= r.value <= 6 for r in out if r.value != 0.0)


def test_clamp_open_bounds(spark):
    df = spark.createDataFrame([(5.0, 0.0, 3.0), (5.0, None, None), (-1.0, 0.0, None), (None, 0.0, 1.0)], "v double, lo double, hi double")
    assert [r.x for r in df.select(clamp(F.col("v"), F.col("lo"), F.col("hi")).alias("x")).collect()] == [3.0, 5.0, 0.0, None]


def test_grid(spark):
    df = spark.createDataFrame([("p", "m", "PERIODIC", 300_000.0), ("c", "m", "ON_CHANGE", None), ("f", "m", "PERIODIC", 10.0), ("n", "m", None, None)],
                               "device_id string, measure_name string, mode string, interval_ms double")
    out = {}
    for r in tick_grid(df, 3, 14, 60_000, block=4).collect():
        out.setdefault(r.device_id, []).append(r.tick)
    assert sorted(out["p"]) == [3, 8, 13]
    assert all(sorted(out[d]) == list(range(3, 15)) for d in "cfn")


def test_uniform_does_not_depend_on_partitioning(spark):
    df = spark.range(1000).withColumn("u", uniform(42, ["id"], "x"))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, spark.range(1000).repartition(13).withColumn("u", uniform(42, ["id"], "x")).collect()))
    assert all(0 <= r.u < 1 for r in df.collect())


def test_resources(spark):
    assert plots_per_zone(100, 3) == 5 and plots_per_zone(4, 3) == 1
    zones = make_zones(spark, 4, 1).orderBy("zone_id").collect()
    assert [z.zone_type for z in zones] == ["IRRIGATED", "NON_IRRIGATED", "INDOOR", "IRRIGATED"]
    plots = make_plots(spark, 3, 2, 1).orderBy("plot_id").collect()
    assert [(p.plot_id, p.zone_id) for p in plots] == [(101, 1), (102, 1), (103, 2), (104, 2), (105, 3), (106, 3)]
    assert all(1.0 <= p.area_ha <= 10.0 for p in plots)
    n = 200
    devices = make_devices(spark, n, 6, 1).collect()
    by_class = {}
    for d in devices:
        by_class.setdefault(d.device_class, []).append(d)
        assert 101 <= d.plot_id <= 106
        assert (d.depth_cm in (10, 20, 30, 40)) if "Soil" in d.device_class else d.depth_cm is None
    assert {c: len(v) for c, v in by_class.items()} == dict(class_counts(n))
    assert sorted(d.device_id for d in by_class["SoilMoistureSensor"]) == [f"SOI_{i:04d}" for i in range(1, 101)]


def test_class_permutation(spark):
    for n in (1, 2, 7, 100):
        total = sum(c for _, c in class_counts(n))
        assert math.gcd(shuffle_stride(total), total) == 1
        assert allocate_classes(spark.range(n), "id", n).filter("device_class IS NULL").count() == 0


def test_tick_range():
    assert tick_range(0, 90, "days", "minutes") == (0, 129_600, 60_000)
    assert tick_range(30, 120, "minutes", "hours") == (0, 2, 3_600_000)


@pytest.fixture(scope="module")
def deployment(spark):
    return Deployment(farm.measures(spark), farm.tiers(spark), farm.arrivals(spark),
                      make_devices(spark, 12, 6, 42), make_plots(spark, 2, 3, 42), farm.EVENT_TYPES, farm.RULES)


def test_example_farm_conforms(deployment):
    """Every class, measure and zone that has enough readings meets its declaration."""
    sent = deployment.delivered(0, 30 * 1440, 60_000, seed=42)
    got = {(r.measure_name, r.zone_id): r for r in summary(deployment.conformance(sent, devices="pooled")).collect()}
    for key in (("AirTemp", 1), ("AirTemp", 2), ("Humidity", 1), ("Humidity", 2)):
        if key in got:
            assert got[key].n_fail == 0
    assert len([k for k in got if k[0] in ("AirTemp", "Humidity")]) >= 2


def test_forced_tier_fires_in_every_window(spark):
    devices = spark.createDataFrame([("A1", "AirTemperatureSensor", 101, None)], "device_id string, device_class string, plot_id long, depth_cm int")
    plots = make_plots(spark, 1, 1, 1)
    run = lambda tier: Deployment(
        farm.measures(spark), farm.tiers(spark, {"AirTemp": tier}), farm.arrivals(spark), devices, plots, farm.EVENT_TYPES, farm.RULES[2:5])
    hot = run("ABOVE")
    heat = hot.derived(hot.delivered(0, 600, 60_000, 1)).filter("rule_label = 'HEATWAVE'").collect()
    assert sorted(r.window_start for r in heat) == list(range(0, 600, 60)) and all(r.tick == r.window_start + 61 for r in heat)
    mild = run("NORMAL")
    assert mild.derived(mild.delivered(0, 600, 60_000, 1)).count() == 0


def test_events_are_reproducible(deployment, spark):
    one = deployment.events(deployment.delivered(0, 300, 60_000, 5)).drop("aggregates")
    assert one.filter("event_type = 'metric_avg'").count() > 0
    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = sorted(map(repr, one.collect()))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        again = deployment.events(deployment.delivered(0, 300, 60_000, 5)).drop("aggregates")
        assert sorted(map(repr, again.collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_clamped_value_is_drawn_once(spark):
    from tickweave.operators.generate import with_tier, with_value
    tier = F.struct(F.lit("NORMAL").alias("family"), F.create_map(F.lit("mean"), F.col("id") * 1.0, F.lit("std_dev"), F.lit(1.0)).alias("params"),
                    F.lit(1.0).alias("probability"))
    grid = spark.range(10).select(F.col("id").cast("string").alias("device_id"), F.lit("m").alias("measure_name"), F.col("id").alias("tick"),
                                  tier.alias("normal"), tier.alias("above"), tier.alias("below"), F.lit(0.0).alias("range_min"),
                                  F.lit(9.0).alias("range_max"))
    for t in ("normal", "above", "below"):
        grid = grid.withColumn(f"{t}_cdf", F.lit(None).cast("struct<first:bigint,cdf:array<double>>"))
    plan = with_value(with_tier(grid, 1), 1, families={"normal": lambda d: d.param("mean") + d.z})
    assert plan._jdf.queryExecution().optimizedPlan().toString().upper().count("COS(") == 1


def _bound(spark, n=30):
    """Bindings whose tiers are normal, Poisson and binomial; two without a device, two alike."""
    tier = lambda family, share, **params: F.struct(
        F.lit(family).alias("family"), F.create_map(*[F.lit(x) for kv in params.items() for x in kv]).alias("params"), F.lit(share).alias("probability"))
    device = F.when(F.col("id") > 1, F.greatest("id", F.lit(3)).cast("string"))
    return prepare_profiles(spark.range(n).select(
        device.alias("device_id"), F.concat(F.lit("m"), F.col("id") > 9).alias("measure_name"), tier("NORMAL", 0.6, mean=5.0, std_dev=2.0).alias("normal"),
        tier("POISSON", 0.2, mean=4.0).alias("above"), tier("BINOMIAL", 0.2, n=20.0, p=0.4).alias("below"), F.lit(0.0).alias("range_min"),
        F.lit(9.0).alias("range_max"), F.lit("ON_CHANGE").alias("mode"), F.lit(None).cast("double").alias("interval_ms"),
        F.lit(1.0).alias("threshold"), F.lit(0.1).alias("failure")))


def test_drawing_fits_methods_that_are_compiled(spark):
    """The JVM interprets methods of over 8,000 bytes, which made a reading cost six times as much."""
    from tickweave.operators.segments import Segments
    from tickweave.operators.transmit import KEYS as BY, ORDER, transmit
    readings = generate_readings(_bound(spark), 0, 96, 60_000, 42)
    grown = tick_grid(_bound(spark), 0, 96, 60_000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (readings, with_value(with_tier(grown, 42), 42), transmit(readings, 60_000, 42, 0, segments=Segments(BY, ORDER))):
            text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
            sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text)]
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_stems_draw_what_keys_draw(spark):
    """Also for a missing device; and over several blocks of ticks."""
    grid = tick_grid(_bound(spark), 0, 50, 60_000, block=7)
    want = with_value(with_tier(grid, 5), 5).select("device_id", "tick", "tier", "value")
    got = generate_readings(_bound(spark), 0, 50, 60_000, 5).select("device_id", "tick", "tier", "value")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(got) == rows(want) and got.where("tier <> 'NORMAL'").count() > 300


def test_a_window_over_keys_finds_them_together(spark):
    """Over a short span the readings of a key are made in one task, and no shuffle of readings follows."""
    from pyspark.sql import Window
    by = Window.partitionBy("device_id", "measure_name").orderBy("tick")
    plan = lambda end: generate_readings(_bound(spark), 0, end, 60_000, 5).withColumn(
        "n", F.row_number().over(by))._jdf.queryExecution().executedPlan().toString()
    assert plan(96).count("Exchange hashpartitioning") == 1 and plan(5000).count("Exchange hashpartitioning") == 2

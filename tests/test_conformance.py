"""Mixture statistics and verdicts on hand-worked numbers."""

import math

import pytest
from pyspark.sql import functions as F

from tickweave.operators.conformance import (
    conformance, mixture_stats, representatives, tier_rates, tier_tallies, transition_log,
)
from tickweave.operators.segments import plan_segments
from tickweave.operators.specs import VALUE_COLUMNS, measure_position, measure_value

GROUP = ("c", "m", 1)
TIER_FIELDS = "device_class string, measure_name string, zone_id long, tier string, family string, params map<string,double>, probability double"


def tiers(spark, *specs):
    return spark.createDataFrame([(*GROUP, t, f, p, q) for t, f, p, q in specs], TIER_FIELDS)


def test_published_mixture(spark):
    df = tiers(spark, ("NORMAL", "NORMAL", {"mean": 22.0, "std_dev": 4.0}, 0.85),
               ("ABOVE", "NORMAL", {"mean": 40.0, "std_dev": 3.0}, 0.08), ("BELOW", "NORMAL", {"mean": 1.0, "std_dev": 1.5}, 0.07))
    r = mixture_stats(df).first()
    assert round(r.declared_mean, 2) == 21.97 and round(r.declared_std, 2) == 8.44
    assert math.isclose(r.expected_transition_rate, 100 * (1 - 0.85 ** 2 - 0.08 ** 2 - 0.07 ** 2))


@pytest.mark.parametrize("family,params,declared,exact", [
    ("UNIFORM", {"low": 2.0, "high": 8.0}, (0, 1), (5, 6 / math.sqrt(12))),
    ("EXPONENTIAL", {"mean": 4.0}, (4, 1), (4, 4)),
    ("POISSON", {"mean": 9.0}, (9, 1), (9, 3)),
    ("BINOMIAL", {"n": 10.0, "p": 0.5}, (0, 1), (5, math.sqrt(2.5))),
    ("NORMAL", {"mean": 3.0, "std": 2.0}, (3, 2), (3, 2)),
])
def test_moments(spark, family, params, declared, exact):
    df = tiers(spark, ("NORMAL", family, params, 1.0))
    for moments, want in (("declared", declared), ("exact", exact)):
        r = mixture_stats(df, moments=moments).first()
        assert math.isclose(r.declared_mean, want[0]) and math.isclose(r.declared_std, want[1])


def readings(spark, values, tier="NORMAL", device="d1"):
    rows = [(i, i, device, "m", float(v), t) for i, (v, t) in enumerate(zip(values, tier if isinstance(tier, list) else [tier] * len(values)))]
    return spark.createDataFrame(rows, "event_id long, tick long, device_id string, measure_name string, value double, tier string")


def bindings(spark, *devices):
    rows = [(d, "c", "m", 1, 0.0, 20.0, i) for i, d in enumerate(devices)]
    return spark.createDataFrame(rows, "device_id string, device_class string, measure_name string, zone_id long, range_min double, range_max double, binding_idx long")


def test_verdicts(spark):
    declared = tiers(spark, ("NORMAL", "NORMAL", {"mean": 10.0, "std_dev": 2.0}, 0.6), ("ABOVE", "NORMAL", {"mean": 10.0, "std_dev": 2.0}, 0.4))
    df = readings(spark, [8, 8, 12, 12, 25], ["NORMAL", "ABOVE", "NORMAL", "ABOVE", "NORMAL"])
    r = conformance(df, bindings(spark, "d1"), declared).first()
    assert (r.n_events, r.observed_mean, r.mean_ok) == (5, 13.0, False)
    assert math.isclose(r.observed_std, math.sqrt((25 + 25 + 1 + 1 + 144) / 4)) and not r.std_ok
    assert [(t.tier, t.observed_prob, t["pass"]) for t in r.tiers] == [("NORMAL", 0.6, True), ("ABOVE", 0.4, True)]
    assert (r.n_transitions, r.transition_rate) == (4, 80.0) and not r.transition_ok
    assert (r.n_out_of_range, r.range_ok, r.overall_pass) == (1, False, False)
    good = conformance(readings(spark, [8, 8, 12, 12, 10], ["NORMAL", "ABOVE", "NORMAL", "ABOVE", "NORMAL"]), bindings(spark, "d1"), declared).first()
    assert good.overall_pass and good.mean_ok and good.std_ok and good.range_ok


def test_gate_and_zero_mean(spark):
    zero = tiers(spark, ("NORMAL", "NORMAL", {"mean": 0.0, "std_dev": 1.0}, 1.0))
    assert conformance(readings(spark, [1, 1, 1, 1]), bindings(spark, "d1"), zero).count() == 0
    assert conformance(readings(spark, [1] * 5), bindings(spark, "d1"), zero).first().mean_ok
    assert not conformance(readings(spark, [1.01] * 5), bindings(spark, "d1"), zero).first().mean_ok


def test_representative_is_chosen_before_the_gate(spark):
    declared = tiers(spark, ("NORMAL", "NORMAL", {"mean": 1.0, "std_dev": 1.0}, 1.0))
    df = readings(spark, [1] * 3, device="d1").unionByName(readings(spark, [1] * 9, device="d2"))
    b = bindings(spark, "d1", "d2")
    assert representatives(b).first().device_id == "d1"
    assert conformance(df, b, declared).count() == 0
    assert [r.device_id for r in conformance(df, b, declared, devices="all").collect()] == ["d2"]
    assert conformance(df, b, declared, devices="pooled").first().n_events == 12


def test_transition_log(spark):
    df = readings(spark, [1] * 6, ["NORMAL", "ABOVE", "ABOVE", None, "BELOW", "NORMAL"])
    want = [(1, "NORMAL", "ABOVE"), (3, "ABOVE", "NORMAL"), (4, "NORMAL", "BELOW"), (5, "BELOW", "NORMAL")]
    assert sorted((r.tick, r.from_tier, r.to_tier) for r in transition_log(df).collect()) == want
    starts_high = transition_log(readings(spark, [1], ["ABOVE"])).collect()
    assert [(r.tick, r.from_tier, r.to_tier) for r in starts_high] == [(0, "NORMAL", "ABOVE")]
    split = plan_segments(df, ("device_id", "measure_name"), min_rows=2)
    assert split.any_hot
    assert sorted((r.tick, r.from_tier, r.to_tier) for r in transition_log(df, segments=split).collect()) == want
    t = tier_tallies(df).first()
    assert (t.NORMAL, t.ABOVE, t.BELOW) == (3, 2, 1)


def test_tier_rates_list_declared_tiers_only(spark):
    declared = spark.createDataFrame([("m", "NORMAL", 0.5), ("m", "BELOW", 0.1)], "measure_name string, tier string, probability double")
    out = {r.tier: r for r in tier_rates(readings(spark, [1, 1], ["NORMAL", "ABOVE"]), declared, ["measure_name"]).collect()}
    assert set(out) == {"NORMAL", "BELOW"} and out["NORMAL"]["pass"] and not out["BELOW"]["pass"]
    assert math.isclose(out["BELOW"].deviation_pp, 10.0)


def test_value_by_position(spark):
    df = spark.createDataFrame([("NPKSensor", "Phosphorus", 1.0, 2.0, 3.0), ("NPKSensor", "Potassium", 1.0, 2.0, 3.0), ("X", "Y", 1.0, 2.0, 3.0)],
                               "cls string, measure string, value double, value2 double, value3 double")
    out = df.select(measure_value(measure_position(F.col("cls"), F.col("measure"))).alias("v")).collect()
    assert [r.v for r in out] == [2.0, 3.0, 1.0] and len(VALUE_COLUMNS) == 3

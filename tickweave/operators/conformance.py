"""Observed statistics of readings against the declared tier mixture."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickweave.functions.scalars import exact_mean
from tickweave.operators.ordered import with_previous
from tickweave.operators.segments import Segments
from tickweave.schemas import TIER_NAMES

# Tolerances and gates. Fixed values.
MEAN_TOLERANCE = 0.15
MEAN_TOLERANCE_AT_ZERO = 1.0
STD_TOLERANCE = 0.20
TIER_TOLERANCE = 0.05
TRANSITION_TOLERANCE = 5.0
MIN_EVENTS = 5

GROUP = ("device_class", "measure_name", "zone_id")
KEYS = ("device_id", "measure_name")


def persistent_readings(events: DataFrame, event_type: str = "sensor_reading") -> DataFrame:
    """Readings only: of the reading type and not derived by a rule."""
    return events.filter((F.col("event_type") == event_type) & F.col("triggered_by").isNull())


def tier_moments(tiers: DataFrame, moments: str = "declared") -> DataFrame:
    """Mean and standard deviation of each tier.

    ``declared`` reads the parameters and falls back to mean 0 and deviation 1 for
    every family; ``exact`` uses the moments of the family.
    """
    p = lambda name: F.try_element_at("params", F.lit(name))
    mean = F.coalesce(p("mean"), F.lit(0.0))
    std = F.coalesce(p("std_dev"), p("std"), F.lit(1.0))
    if moments == "exact":
        family = F.upper("family")
        mean = (F.when(family == "UNIFORM", (p("low") + p("high")) / 2)
                .when(family == "BINOMIAL", p("n") * p("p")).otherwise(mean))
        std = (F.when(family == "UNIFORM", (p("high") - p("low")) / F.sqrt(F.lit(12.0)))
               .when(family == "EXPONENTIAL", p("mean"))
               .when(family == "POISSON", F.sqrt(p("mean")))
               .when(family == "BINOMIAL", F.sqrt(p("n") * p("p") * (1 - p("p")))).otherwise(std))
    elif moments != "declared":
        raise ValueError(f"moments must be 'declared' or 'exact', not {moments!r}")
    return tiers.withColumn("mean", mean).withColumn("std", std).withColumn(
        "prob", F.coalesce("probability", F.lit(0.0))
    )


def mixture_stats(tiers: DataFrame, keys: Sequence[str] = GROUP, moments: str = "declared") -> DataFrame:
    """Mean, standard deviation and expected transition rate of each declared mixture.

    The three tiers become columns, as in a profile; a tier listed twice counts once. The
    deviation is taken around the mean in a second step: the one-pass form would need
    probabilities that sum to exactly one.
    """
    each = F.struct("prob", "mean", "std")
    order = -F.col("tier_order") if "tier_order" in tiers.columns else F.lit(0)
    wide = tier_moments(tiers, moments).groupBy(*keys).agg(*[
        F.max(F.when(F.col("tier") == t, F.struct(order.alias("o"), each.alias("t")))).getField("t").alias(t)
        for t in TIER_NAMES
    ])
    total = lambda f: sum((F.coalesce(f(F.col(t)), F.lit(0.0)) for t in TIER_NAMES), F.lit(0.0))
    off = lambda t: t["mean"] - F.col("declared_mean")
    declared = F.map_from_entries(F.filter(
        F.array(*[F.struct(F.lit(t).alias("tier"), F.col(f"{t}.prob").alias("prob")) for t in TIER_NAMES]),
        lambda e: e["prob"].isNotNull(),
    ))
    return (
        wide.withColumn("declared_mean", total(lambda t: t["prob"] * t["mean"]))
        .withColumn("_var", total(lambda t: t["prob"] * (t["std"] * t["std"] + off(t) * off(t))))
        .select(
            *keys, "declared_mean", F.sqrt("_var").alias("declared_std"),
            (100.0 * (1.0 - total(lambda t: t["prob"] * t["prob"]))).alias("expected_transition_rate"),
            declared.alias("_declared"),
        )
    )


def representatives(bindings: DataFrame, keys: Sequence[str] = GROUP,
                    order: Sequence[str] = ("binding_idx",)) -> DataFrame:
    """The first bound device of each class, measure and zone."""
    return bindings.groupBy(*keys).agg(F.min_by("device_id", F.struct(*order)).alias("device_id"))


def with_transitions(readings: DataFrame, keys: Sequence[str] = KEYS,
                     order: Sequence[str] = ("tick", "event_id"),
                     segments: Segments | None = None) -> DataFrame:
    """Add the tier of the previous reading; null on a key's first."""
    return with_previous(
        readings.withColumn("tier", F.coalesce("tier", F.lit(TIER_NAMES[0]))),
        F.col("tier"), "prev_tier", keys, order, segments=segments,
    )


def transition_log(readings: DataFrame, keys: Sequence[str] = KEYS,
                   order: Sequence[str] = ("tick", "event_id"),
                   segments: Segments | None = None) -> DataFrame:
    """One row per tier change; before its first reading a device is NORMAL."""
    moved = with_transitions(readings, keys, order, segments)
    before = F.coalesce("prev_tier", F.lit(TIER_NAMES[0]))
    return moved.filter(F.col("tier") != before).select(
        *keys, *order, before.alias("from_tier"), F.col("tier").alias("to_tier")
    )


def tier_tallies(readings: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Readings per tier of each key, one column per tier."""
    tier = F.coalesce("tier", F.lit(TIER_NAMES[0]))
    return readings.groupBy(*keys).agg(
        *[F.count_if(tier == t).alias(t) for t in TIER_NAMES]
    )


def observed_stats(
    readings: DataFrame,
    keys: Sequence[str],
    range_min: Column,
    range_max: Column,
    value: Column | str = "value",
    order: Sequence[str] = ("tick", "event_id"),
    segments: Segments | None = None,
) -> DataFrame:
    """Counts, mean, deviation, tier tallies, transitions and range violations per key.

    The look-back for transitions and the aggregate use the same key, so unsplit keys
    are shuffled once.
    """
    v = F.col(value) if isinstance(value, str) else value
    moved = with_transitions(readings, keys, order, segments)
    outside = F.coalesce(v < range_min, F.lit(False)) | F.coalesce(v > range_max, F.lit(False))
    return moved.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count(v).alias("n_values"),
        exact_mean(v).alias("observed_mean"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("observed_std"),
        *[F.count_if(F.col("tier") == t).alias(f"n_{t.lower()}") for t in TIER_NAMES],
        F.count_if(F.col("tier") != F.col("prev_tier")).alias("n_transitions"),
        F.count_if(outside).alias("n_out_of_range"),
    )


def conformance(
    readings: DataFrame,
    bindings: DataFrame,
    tiers: DataFrame,
    devices: str = "representative",
    moments: str = "declared",
    value: Column | str = "value",
    segments: Segments | None = None,
) -> DataFrame:
    """Observed against declared statistics per device, class, measure and zone.

    ``bindings``: device_id, device_class, measure_name, zone_id, range_min, range_max and
    ``binding_idx``; ``tiers``: class, measure, zone and the tier columns.
    ``devices="representative"`` judges the first bound device of each combination,
    ``"all"`` every device, ``"pooled"`` all devices of a combination together.
    """
    if devices == "representative":
        chosen = bindings.join(representatives(bindings), [*GROUP, "device_id"], "left_semi")
        keys = ["device_id", *GROUP]
    elif devices == "all":
        chosen, keys = bindings, ["device_id", *GROUP]
    elif devices == "pooled":
        chosen, keys = bindings, list(GROUP)
    else:
        raise ValueError(f"unknown choice of devices {devices!r}")
    slim = chosen.select("device_id", *GROUP, "range_min", "range_max")
    joined = readings.join(slim, list(KEYS))
    if devices == "pooled":
        moved = with_transitions(joined, ["device_id", *GROUP], segments=segments)
        # transitions are per device, the rest per combination
        stats = _pooled(moved, keys, value)
    else:
        stats = observed_stats(joined, keys, F.col("range_min"), F.col("range_max"), value, segments=segments)
    gated = stats.filter((F.col("n_events") >= MIN_EVENTS) & (F.col("n_values") >= MIN_EVENTS))
    return judge(gated.join(mixture_stats(tiers, GROUP, moments), list(GROUP)))


def _pooled(moved: DataFrame, keys: Sequence[str], value: Column | str) -> DataFrame:
    v = F.col(value) if isinstance(value, str) else value
    outside = F.coalesce(v < F.col("range_min"), F.lit(False)) | F.coalesce(v > F.col("range_max"), F.lit(False))
    return moved.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"), F.count(v).alias("n_values"),
        exact_mean(v).alias("observed_mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("observed_std"),
        *[F.count_if(F.col("tier") == t).alias(f"n_{t.lower()}") for t in TIER_NAMES],
        F.count_if(F.col("tier") != F.col("prev_tier")).alias("n_transitions"),
        F.count_if(outside).alias("n_out_of_range"),
    )


def tier_results(counts: Column, declared: Column, n: Column) -> Column:
    """Array of tier results, one per declared tier: counts and declared are maps by tier."""
    def one(tier: Column) -> Column:
        observed = F.coalesce(F.try_element_at(counts, tier), F.lit(0)) / n
        wanted = F.try_element_at(declared, tier)
        off = F.abs(observed - wanted)
        return F.struct(
            tier.alias("tier"), observed.alias("observed_prob"), wanted.alias("declared_prob"),
            (off * 100.0).alias("deviation_pp"), (off <= TIER_TOLERANCE).alias("pass"),
        )

    known = F.filter(F.array(*[F.lit(t) for t in TIER_NAMES]), lambda t: F.map_contains_key(declared, t))
    return F.transform(known, one)


def judge(stats: DataFrame) -> DataFrame:
    """Verdicts from observed and declared statistics in one row."""
    mu, sigma = F.col("declared_mean"), F.col("declared_std")
    mean_room = F.when(mu == 0, MEAN_TOLERANCE_AT_ZERO).otherwise(F.abs(mu) * MEAN_TOLERANCE)
    counts = F.create_map(*[x for t in TIER_NAMES for x in (F.lit(t), F.col(f"n_{t.lower()}"))])
    rate = 100.0 * F.col("n_transitions") / F.greatest(F.col("n_events"), F.lit(1))
    out = (
        stats.withColumn("mean_ok", F.abs(F.col("observed_mean") - mu) <= mean_room)
        .withColumn("std_ok", F.abs(F.col("observed_std") - sigma) <= sigma * STD_TOLERANCE)
        .withColumn("tiers", tier_results(counts, F.col("_declared"), F.col("n_events")))
        .withColumn("transition_rate", rate)
        .withColumn("transition_ok",
                    F.abs(F.col("transition_rate") - F.col("expected_transition_rate")) < TRANSITION_TOLERANCE)
        .withColumn("range_ok", F.col("n_out_of_range") == 0)
        .withColumn("overall_pass", F.col("mean_ok") & F.col("std_ok") & F.col("range_ok")
                    & F.forall("tiers", lambda t: t["pass"]))
    )
    first = [c for c in ("device_id", *GROUP) if c in stats.columns]
    return out.select(
        *first, "n_events", "observed_mean", "declared_mean", "mean_ok",
        "observed_std", "declared_std", "std_ok", "tiers",
        "n_transitions", "transition_rate", "expected_transition_rate", "transition_ok",
        "n_out_of_range", "range_ok", "overall_pass",
    )


def tier_rates(readings: DataFrame, tiers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observed against declared tier probabilities, one row per declared tier of keys with data."""
    tier = F.coalesce("tier", F.lit(TIER_NAMES[0]))
    counts = readings.groupBy(*keys, tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("n_events"))
    observed = F.coalesce("n", F.lit(0)) / F.col("n_events")
    off = F.abs(observed - F.col("probability"))
    return (
        tiers.select(*keys, "tier", "probability").join(totals, list(keys))
        .join(counts, [*keys, "tier"], "left")
        .select(
            *keys, "tier", "n_events", observed.alias("observed_prob"),
            F.col("probability").alias("declared_prob"),
            (off * 100.0).alias("deviation_pp"), (off <= TIER_TOLERANCE).alias("pass"),
        )
    )


def summary(results: DataFrame) -> DataFrame:
    """Results per measure and zone with pass and fail counts, sorted."""
    return results.groupBy("measure_name", "zone_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("overall_pass").alias("n_pass"),
        F.count_if(~F.col("overall_pass")).alias("n_fail"),
    ).withColumn("pass_percent", F.expr("(100 * n_pass) div n")).orderBy("measure_name", "zone_id")


def totals(results: DataFrame) -> DataFrame:
    """Overall pass and fail counts; the percentage is an integer division."""
    return results.agg(
        F.count_if("overall_pass").alias("n_pass"), F.count_if(~F.col("overall_pass")).alias("n_fail")
    ).withColumn("pass_percent", F.expr("(100 * n_pass) div greatest(n_pass + n_fail, 1)"))

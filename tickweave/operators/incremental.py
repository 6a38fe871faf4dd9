"""Observed statistics as mergeable summaries.

A summary holds what the verdicts of ``conformance.py`` need of a stretch of a key's
time line: counts, exact sums, mean, sum of squared deviations, tier tallies, changes of
tier, and its first and last tier. Stretches that do not overlap merge into the summary of
both, so readings are looked at once, however long the history gets. The mean comes from
the sums, so it does not depend on how the readings were cut and merged.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickweave.functions.scalars import exact_sums
from tickweave.operators.conformance import GROUP, KEYS, MIN_EVENTS, judge, mixture_stats, representatives
from tickweave.operators.ordered import with_previous
from tickweave.operators.segments import Segments
from tickweave.schemas import TIER_NAMES

TALLIES = tuple(f"n_{t.lower()}" for t in TIER_NAMES)
_SUMS = ("sum_coarse", "sum_fine")
_ADDED = ("n_events", "n_values", *TALLIES, "n_transitions", "n_out_of_range", *_SUMS)


def tier_of(tier: Column | str = "tier") -> Column:
    """An undeclared tier counts as NORMAL."""
    return F.coalesce(tier, F.lit(TIER_NAMES[0]))


def moves(path: Column) -> Column:
    """Changes between neighbours of an array of tiers in order."""
    earlier = F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))
    later = F.slice(path, F.lit(2), F.size(path))
    return F.size(F.filter(F.zip_with(earlier, later, lambda a, b: a != b), lambda moved: moved)).cast("bigint")


def stretch_columns(range_min: Column, range_max: Column, value: str = "value",
                    order: Sequence[str] = ("tick", "event_id")) -> list[Column]:
    """The aggregates of one stretch, in batch or on a stream; ``finished`` turns them into a summary.

    Transitions need the tiers in order, so a stretch's tiers are gathered (not its rows);
    choose stretches short enough for one group to hold them.
    """
    v = F.col(value)
    outside = F.coalesce(v < range_min, F.lit(False)) | F.coalesce(v > range_max, F.lit(False))
    return [
        F.count(F.lit(1)).alias("n_events"), F.count(v).alias("n_values"), F.avg(v).alias("mean"),
        *[total.alias(c) for c, total in zip(_SUMS, exact_sums(v))],
        (F.var_pop(v) * F.count(v)).alias("m2"), F.count_if(outside).alias("n_out_of_range"),
        *[F.count_if(tier_of() == t).alias(n) for t, n in zip(TIER_NAMES, TALLIES)],
        F.collect_list(F.struct(*order, tier_of().alias("tier"))).alias("_path"),
    ]


def finished(stretches: DataFrame) -> DataFrame:
    """Replace the gathered tiers by their first, last and number of changes."""
    path = F.transform(F.array_sort("_path"), lambda p: p["tier"])
    return (
        stretches.withColumn("_path", path)
        .withColumns({"n_transitions": moves(F.col("_path")), "first_tier": F.get("_path", F.lit(0)),
                      "last_tier": F.element_at("_path", -1)})
        .drop("_path")
    )


def merged(stretches: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ("stretch",),
           segments: Segments | None = None) -> DataFrame:
    """One summary per key from those of its stretches, whose ``order`` is that of time.

    The change of tier between two stretches is found by looking back along the key, which
    splits keys with very many stretches. Squared deviations are taken around the merged
    mean in a second step, which subtracts nothing large. The keys of both aggregates and
    of their join are the same, so unsplit keys are shuffled once.
    """
    back = with_previous(stretches, F.col("last_tier"), "_before", keys, order, segments=segments)
    joint = F.coalesce(F.col("_before") != F.col("first_tier"), F.lit(False)).cast("bigint")
    back = back.withColumn("n_transitions", F.col("n_transitions") + joint)
    mean = back.groupBy(*keys).agg(F.try_divide(sum(F.sum(c) for c in _SUMS), F.sum("n_values")).alias("_mean"))
    same = [back[k].eqNullSafe(mean[k]) for k in keys]
    both = back.join(mean, same).select(back["*"], "_mean")
    off = F.col("mean") - F.col("_mean")
    at = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return both.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in _ADDED],
        F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n_values") * off * off).alias("m2"),
        F.min_by("first_tier", at).alias("first_tier"), F.max_by("last_tier", at).alias("last_tier"),
        *[F.max(c).alias(c) for c in order],
    )


def appended(before: DataFrame, after: DataFrame, keys: Sequence[str] = KEYS,
             order: Sequence[str] = ("stretch",)) -> DataFrame:
    """Summaries of a history and of what follows it, one row per key of either."""
    a, b = before.alias("a"), after.alias("b")
    get = lambda side, c: F.col(f"{side}.{c}")
    whole = lambda side, c: F.coalesce(get(side, c), F.lit(0))
    same = [get("a", k).eqNullSafe(get("b", k)) for k in keys]
    na, nb = whole("a", "n_values"), whole("b", "n_values")
    step = F.coalesce(get("b", "mean") - get("a", "mean"), F.lit(0.0))
    m2 = whole("a", "m2") + whole("b", "m2") + step * step * F.coalesce(F.try_divide(na * nb, na + nb), F.lit(0.0))
    joint = F.coalesce(get("a", "last_tier") != get("b", "first_tier"), F.lit(False)).cast("bigint")
    added = {c: whole("a", c) + whole("b", c) for c in _ADDED}
    added["n_transitions"] = added["n_transitions"] + joint
    mean = F.try_divide(sum(added[c] for c in _SUMS), added["n_values"])
    return a.join(b, same, "full").select(
        *[F.coalesce(get("a", k), get("b", k)).alias(k) for k in keys],
        *[added[c].alias(c) for c in _ADDED], mean.alias("mean"), m2.alias("m2"),
        F.coalesce(get("a", "first_tier"), get("b", "first_tier")).alias("first_tier"),
        F.coalesce(get("b", "last_tier"), get("a", "last_tier")).alias("last_tier"),
        *[F.coalesce(get("b", c), get("a", c)).alias(c) for c in order],
    )


def statistics(summaries: DataFrame) -> DataFrame:
    """The columns of ``observed_stats`` from summaries."""
    return summaries.withColumns({
        "observed_mean": F.col("mean"),
        "observed_std": F.when(F.col("n_values") > 1, F.sqrt(F.col("m2") / (F.col("n_values") - 1))).otherwise(0.0),
    }).drop("mean", "m2", "first_tier", "last_tier", *_SUMS)


def verdicts(summaries: DataFrame, bindings: DataFrame, tiers: DataFrame, devices: str = "all",
             moments: str = "declared") -> DataFrame:
    """``conformance`` of a history that is only there as summaries per device, class, measure and zone."""
    stats = statistics(summaries)
    if devices == "representative":
        stats = stats.join(representatives(bindings), ["device_id", *GROUP], "left_semi")
    elif devices != "all":
        raise ValueError(f"unknown choice of devices {devices!r}")
    gated = stats.filter((F.col("n_events") >= MIN_EVENTS) & (F.col("n_values") >= MIN_EVENTS))
    return judge(gated.join(mixture_stats(tiers, GROUP, moments), list(GROUP)))

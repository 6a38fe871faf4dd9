"""Data and specification checks.

Each check returns violations as rows ``(check, severity, subject, message)``. The
checks on data tables are plain grouped aggregates and anti-joins, so they hold on
large tables; counts are combined map side before the shuffle.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

ERROR, WARN = "ERROR", "WARN"
PROBABILITY_TOLERANCE = 0.001        # fixed value
# Parameters each family must have. Fixed values.
REQUIRED_PARAMS = {
    "NORMAL": ("mean", "std_dev"),
    "UNIFORM": ("low", "high"),
    "EXPONENTIAL": ("mean",),
    "POISSON": ("mean",),
    "BINOMIAL": ("n", "p"),
}


def violations(df: DataFrame, check: str, severity: str, subject: Column, message: Column) -> DataFrame:
    return df.select(
        F.lit(check).alias("check"), F.lit(severity).alias("severity"),
        subject.cast("string").alias("subject"), message.cast("string").alias("message"),
    )


def _key(columns: Sequence[str]) -> Column:
    return F.concat_ws(",", *[F.col(c).cast("string") for c in columns])


def duplicates(df: DataFrame, keys: Sequence[str], check: str = "duplicate",
               severity: str = ERROR) -> DataFrame:
    """Keys that occur more than once."""
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return violations(many, check, severity, _key(keys), F.format_string("%d rows", "n"))


def orphans(child: DataFrame, parent: DataFrame, child_key: Sequence[str],
            parent_key: Sequence[str] | None = None, check: str = "orphan",
            severity: str = ERROR) -> DataFrame:
    """Foreign-key values without a parent, one row each with the number of child rows.

    The child is counted per key before the join, so a hot key is one row in it.
    """
    parent_key = parent_key or child_key
    known = parent.select(*[F.col(p).alias(f"_p_{c}") for p, c in zip(parent_key, child_key)])
    counted = child.groupBy(*child_key).agg(F.count(F.lit(1)).alias("n"))
    for c in child_key:
        counted = counted.filter(F.col(c).isNotNull())
    same = [F.col(c) == F.col(f"_p_{c}") for c in child_key]
    lost = counted.join(known, same, "left_anti")
    return violations(lost, check, severity, _key(child_key), F.format_string("%d rows", "n"))


def functional_dependency(df: DataFrame, left: Sequence[str], right: Sequence[str],
                          check: str = "functional_dependency", severity: str = ERROR) -> DataFrame:
    """``left`` values that do not determine ``right``.

    Compares the least and the greatest of two 64-bit hashes of the right-hand side
    instead of collecting the distinct ones: one map-side-combined hash aggregation.
    """
    side = [*right, *[F.col(c).isNull() for c in right]]        # the hash passes over nulls
    hashes = [F.xxhash64(F.lit(n), *side) for n in range(2)]
    same = [F.min(h) == F.max(h) for h in hashes]
    broken = df.groupBy(*left).agg((same[0] & same[1]).alias("_same")).filter(~F.col("_same")).drop("_same")
    return violations(broken, check, severity, _key(left), F.concat_ws(",", F.lit("several"), *map(F.lit, right)))


def primary_key(df: DataFrame, keys: Sequence[str], check: str = "primary_key",
                severity: str = ERROR) -> DataFrame:
    """Duplicate or null primary keys."""
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    bad = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | missing)
    message = F.when(missing, F.lit("null key")).otherwise(F.format_string("%d rows", "n"))
    return violations(bad, check, severity, _key(keys), message)


def out_of_range(df: DataFrame, value: str, low: Column, high: Column, subject: Column,
                 check: str = "range", severity: str = ERROR) -> DataFrame:
    """Readings outside the declared range; a null bound is open."""
    bad = F.coalesce(F.col(value) < low, F.lit(False)) | F.coalesce(F.col(value) > high, F.lit(False))
    return violations(df.filter(bad), check, severity, subject, F.format_string("%.4f", value))


def off_resolution(df: DataFrame, value: str, resolution: Column, subject: Column, eps: float = 1e-6,
                   check: str = "resolution", severity: str = WARN) -> DataFrame:
    """Readings that are not a multiple of the declared resolution."""
    steps = F.try_divide(F.col(value), resolution)
    return violations(
        df.filter(F.abs(steps - F.round(steps)) >= eps), check, severity, subject,
        F.format_string("%.4f", value),
    )


def schema_references(columns: DataFrame, references: DataFrame) -> DataFrame:
    """References to unknown tables or columns.

    ``columns``: (table_name, column_name); ``references``: (table_name, column_name,
    ref_table, ref_column).
    """
    tables = columns.select(F.col("table_name").alias("ref_table")).distinct()
    cols = columns.select(F.col("table_name").alias("ref_table"), F.col("column_name").alias("ref_column"))
    subject = F.concat_ws(".", "table_name", "column_name")
    # device classes are declared elsewhere, not as a table
    real = references.filter(F.col("ref_table") != "DEVICE_CLASS")
    no_table = violations(
        real.join(tables, "ref_table", "left_anti"), "unknown_table", ERROR, subject, F.col("ref_table"))
    no_column = violations(
        real.join(tables, "ref_table", "left_semi").join(cols, ["ref_table", "ref_column"], "left_anti"),
        "unknown_column", ERROR, subject, F.concat_ws(".", "ref_table", "ref_column"))
    return no_table.unionByName(no_column)


def _tier_subject() -> Column:
    return F.format_string("%s zone=%d", "measure_name", "zone_id")


def probabilities_sum_to_one(tiers: DataFrame) -> DataFrame:
    bad = tiers.groupBy("measure_name", "zone_id").agg(F.sum("probability").alias("total")).filter(
        F.abs(F.col("total") - 1.0) > PROBABILITY_TOLERANCE
    )
    return violations(bad, "probability_sum", ERROR, _tier_subject(), F.format_string("%.4f", "total"))


def one_normal_tier(tiers: DataFrame) -> DataFrame:
    bad = tiers.groupBy("measure_name", "zone_id").agg(
        F.count_if(F.col("tier") == "NORMAL").alias("n")
    ).filter(F.col("n") != 1)
    return violations(bad, "one_normal_tier", ERROR, _tier_subject(), F.format_string("%d NORMAL tiers", "n"))


def missing_parameters(tiers: DataFrame) -> DataFrame:
    required = F.lit(None).cast("array<string>")
    for family, names in REQUIRED_PARAMS.items():
        required = F.when(F.col("family") == family, F.array(*[F.lit(n) for n in names])).otherwise(required)
    present = F.coalesce(F.map_keys("params"), F.array().cast("array<string>"))
    lacking = F.array_sort(F.array_except(required, present))
    bad = tiers.withColumn("_lacking", lacking).filter(F.size("_lacking") > 0)
    return violations(bad, "missing_parameter", ERROR, _tier_subject(),
                      F.concat(F.col("family"), F.lit(": "), F.concat_ws(",", "_lacking")))


def parameter_sanity(tiers: DataFrame) -> DataFrame:
    """A spread must be positive, a range not empty, a probability within [0, 1].

    A parameter that is not there is reported by ``missing_parameters`` only.
    """
    p = lambda name, default: F.coalesce(F.try_element_at("params", F.lit(name)), F.lit(default))
    is_family = lambda name: F.col("family") == name
    problem = (
        F.when(is_family("NORMAL") & (p("std_dev", 1.0) <= 0), "std_dev must be > 0")
        .when(is_family("UNIFORM") & (p("low", 0.0) >= p("high", 1.0)), "low must be < high")
        .when(is_family("BINOMIAL") & ~p("p", 0.5).between(0.0, 1.0), "p must be in [0,1]")
    )
    bad = tiers.withColumn("_problem", problem).filter(F.col("_problem").isNotNull())
    return violations(bad, "parameter_sanity", ERROR, _tier_subject(), F.col("_problem"))


def unknown_measures(declared: DataFrame, measures: DataFrame, check: str, severity: str) -> DataFrame:
    """Distributions (ERROR) or arrivals (WARN) for measures no class declares."""
    names = declared.select("measure_name").distinct()
    unknown = names.join(measures.select("measure_name"), "measure_name", "left_anti")
    return violations(unknown, check, severity, F.col("measure_name"), F.lit("no class declares this measure"))


def unknown_event_types(uses: DataFrame, event_types: DataFrame, check: str, severity: str,
                        user: str = "name", types: str = "event_types") -> DataFrame:
    """Streams (ERROR) or rules (WARN) that refer to undeclared event types.

    ``types`` is an array of event types, or one event type per row.
    """
    is_array = isinstance(uses.schema[types].dataType, T.ArrayType)
    one = F.explode(types) if is_array else F.col(types)
    used = uses.select(F.col(user).alias("_user"), one.alias("event_type")).distinct()
    unknown = used.join(event_types.select("event_type"), "event_type", "left_anti")
    return violations(unknown, check, severity, F.col("_user"), F.col("event_type"))


def arrival_sanity(arrivals: DataFrame) -> DataFrame:
    """Loss probability in [0, 1]; an interval for PERIODIC; a threshold for ON_*."""
    problems = F.array(
        F.when(~F.col("failure_prob").between(0.0, 1.0), "failure must be in [0,1]"),
        F.when((F.col("mode") == "PERIODIC") & F.col("interval_ms").isNull(), "PERIODIC requires an interval"),
        F.when(F.col("mode").isin("ON_CHANGE", "ON_THRESHOLD") & F.col("threshold").isNull(),
               F.concat(F.col("mode"), F.lit(" requires a threshold"))),
    )
    bad = arrivals.withColumn("_problem", F.explode(F.filter(problems, lambda p: p.isNotNull())))
    return violations(bad, "arrival_sanity", ERROR, F.concat_ws(".", "stream", "measure_name"), F.col("_problem"))


def repeated_distributions(tiers: DataFrame) -> DataFrame:
    """Measures with more than one distribution: the last one wins."""
    bad = tiers.groupBy("measure_name").agg(
        F.min("decl_order").alias("lo"), F.max("decl_order").alias("hi")
    ).filter(F.col("lo") != F.col("hi"))
    return violations(bad, "repeated_distribution", WARN, F.col("measure_name"), F.lit("last one wins"))


def zone_without_discriminator(tiers: DataFrame, measures: DataFrame) -> DataFrame:
    """Zone-keyed tiers of a class that does not declare the zone discriminator."""
    zoned = tiers.filter(F.col("zone_id").isNotNull()).select("measure_name").distinct()
    bad = measures.filter(~F.col("zone_enum")).select("device_class", "measure_name").distinct().join(
        zoned, "measure_name", "left_semi"
    )
    return violations(bad, "zone_without_discriminator", ERROR,
                      F.concat_ws(".", "device_class", "measure_name"), F.lit("class does not declare zones"))


def spec_violations(measures: DataFrame, tiers: DataFrame, arrivals: DataFrame) -> DataFrame:
    """All checks of the spec tables in one list."""
    checks = [
        probabilities_sum_to_one(tiers), one_normal_tier(tiers), missing_parameters(tiers),
        parameter_sanity(tiers), arrival_sanity(arrivals), repeated_distributions(tiers),
        unknown_measures(tiers, measures, "unknown_distribution_measure", ERROR),
        unknown_measures(arrivals, measures, "unknown_arrival_measure", WARN),
    ]
    if "zone_enum" in measures.columns:
        checks.append(zone_without_discriminator(tiers, measures))
    return reduce(DataFrame.unionByName, checks)


def roll_up(all_violations: DataFrame) -> DataFrame:
    """Violations per severity; warnings alone still pass."""
    return all_violations.agg(
        F.count_if(F.col("severity") == ERROR).alias("n_errors"),
        F.count_if(F.col("severity") == WARN).alias("n_warnings"),
    ).withColumn("passed", F.col("n_errors") == 0)

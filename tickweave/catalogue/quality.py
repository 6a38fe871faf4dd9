"""Data checks on the star schema, spec checks on derived specs, and summaries."""

from pyspark.sql import functions as F

from tickweave.catalogue import specs
from tickweave.catalogue.base import query, r4, sql_r4, table, with_readings
from tickweave.operators import quality as q
from tickweave.operators.summaries import (
    counts_with_share, scale_vs_first, scaling_exponent, throughput,
)


@query("""
  SELECT 'duplicate' AS "check", 'ERROR' AS severity, l_orderkey || ',' || l_linenumber AS subject,
         count(*) || ' rows' AS message
  FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def dq_duplicates(spark, sf_dir):
    return q.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
  SELECT 'orphan' AS "check", 'ERROR' AS severity, CAST(o_custkey AS VARCHAR) AS subject, count(*) || ' rows' AS message
  FROM orders WHERE o_custkey NOT IN (SELECT CASE WHEN c_acctbal > 0 THEN c_custkey ELSE -c_custkey END FROM customer)
  GROUP BY o_custkey""")
def dq_orphans(spark, sf_dir):
    """Customers without a balance carry a wrong key."""
    key = F.col("c_custkey")
    known = table(spark, sf_dir, "customer").select(F.when(F.col("c_acctbal") > 0, key).otherwise(-key).alias("c_custkey"))
    return q.orphans(table(spark, sf_dir, "orders"), known, ["o_custkey"], ["c_custkey"])


@query("""
  SELECT 'functional_dependency' AS "check", 'ERROR' AS severity, CAST(l_suppkey AS VARCHAR) AS subject,
         'several,l_returnflag,l_linestatus' AS message
  FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT (l_returnflag, l_linestatus)) > 1
  UNION ALL
  SELECT 'functional_dependency', 'ERROR', p_name, 'several,p_type'
  FROM part GROUP BY p_name HAVING count(DISTINCT p_type) > 1""")
def dq_functional_dependency(spark, sf_dir):
    a = q.functional_dependency(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_returnflag", "l_linestatus"])
    b = q.functional_dependency(table(spark, sf_dir, "part"), ["p_name"], ["p_type"])
    return a.unionByName(b)


@query("""
  SELECT 'primary_key' AS "check", 'ERROR' AS severity, coalesce(CAST(k AS VARCHAR), '') AS subject,
         CASE WHEN k IS NULL THEN 'null key' ELSE count(*) || ' rows' END AS message
  FROM (SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey // 2 END AS k FROM orders)
  GROUP BY k HAVING count(*) > 1 OR k IS NULL""")
def dq_primary_key(spark, sf_dir):
    k = F.when(F.col("o_orderpriority") != "5-LOW", F.floor(F.col("o_orderkey") / 2).cast("bigint"))
    return q.primary_key(table(spark, sf_dir, "orders").select(k.alias("k")), ["k"])


@query("""
  SELECT 'range' AS "check", 'ERROR' AS severity, CAST(event_id AS VARCHAR) AS subject, printf('%.4f', value) AS message
  FROM events WHERE value < 0.5 OR (event_type <> 'view' AND value > 200)""")
def dq_range(spark, sf_dir):
    high = F.when(F.col("event_type") != "view", 200.0)
    return q.out_of_range(table(spark, sf_dir, "events"), "value", F.lit(0.5), high, F.col("event_id"))


@query("""
  SELECT 'resolution' AS "check", 'WARN' AS severity, CAST(event_id AS VARCHAR) AS subject, printf('%.4f', value) AS message
  FROM events WHERE abs(value / 0.05 - round(value / 0.05)) >= 1e-6""")
def dq_resolution(spark, sf_dir):
    return q.off_resolution(table(spark, sf_dir, "events"), "value", F.lit(0.05), F.col("event_id"))


_DIRTY_SQL = """dirty AS (
  SELECT measure_name, zone_id, mean, std_dev,
         CASE WHEN zone_id = 2 AND tier = 'BELOW' THEN probability + 0.25 ELSE probability END AS probability,
         CASE WHEN zone_id = 3 AND tier = 'NORMAL' THEN 'BELOW' ELSE tier END AS tier,
         CASE WHEN measure_name = 'click' THEN 'UNIFORM' WHEN measure_name = 'view' THEN 'BINOMIAL'
              WHEN measure_name = 'signup' AND tier = 'ABOVE' THEN 'POISSON' ELSE 'NORMAL' END AS family
  FROM tiers)"""


def _dirty_tiers(spark, sf_dir):
    """Derived tiers with planted mistakes."""
    t = specs.tiers(spark, sf_dir).filter("decl_order = 2").withColumn(
        "mean", F.try_element_at("params", F.lit("mean"))).withColumn(
        "sd", F.try_element_at("params", F.lit("std_dev")))
    name = F.col("measure_name")
    family = (F.when(name == "click", "UNIFORM").when(name == "view", "BINOMIAL")
              .when((name == "signup") & (F.col("tier") == "ABOVE"), "POISSON").otherwise("NORMAL"))
    params = (
        F.when(name == "click", F.create_map(F.lit("low"), F.col("mean"), F.lit("high"), F.col("sd")))
        .when(name == "view", F.create_map(F.lit("n"), F.lit(10.0), F.lit("p"), F.col("sd") / 50))
        .when(name == "signup", F.create_map(F.lit("low"), F.lit(0.0)))
        .otherwise(F.create_map(F.lit("mean"), F.col("mean"), F.lit("std_dev"), F.col("sd") - 5)))
    probability = F.col("probability") + F.when((F.col("zone_id") == 2) & (F.col("tier") == "BELOW"), 0.25).otherwise(0.0)
    tier = F.when((F.col("zone_id") == 3) & (F.col("tier") == "NORMAL"), "BELOW").otherwise(F.col("tier"))
    return t.withColumns({"family": family, "params": params, "probability": probability, "tier": tier})


_TIER_CTES = (specs.TIERS_SQL, _DIRTY_SQL)


@query(with_readings("""
  SELECT 'probability_sum' AS "check", 'ERROR' AS severity, measure_name || ' zone=' || zone_id AS subject,
         printf('%.4f', sum(probability)) AS message
  FROM dirty GROUP BY measure_name, zone_id HAVING abs(sum(probability) - 1) > 0.001""", *_TIER_CTES))
def dq_probability_sum(spark, sf_dir):
    return q.probabilities_sum_to_one(_dirty_tiers(spark, sf_dir))


@query(with_readings("""
  SELECT 'one_normal_tier' AS "check", 'ERROR' AS severity, measure_name || ' zone=' || zone_id AS subject,
         count(*) FILTER (WHERE tier = 'NORMAL') || ' NORMAL tiers' AS message
  FROM dirty GROUP BY measure_name, zone_id HAVING count(*) FILTER (WHERE tier = 'NORMAL') <> 1""", *_TIER_CTES))
def dq_one_normal_tier(spark, sf_dir):
    return q.one_normal_tier(_dirty_tiers(spark, sf_dir))


@query(with_readings("""
  SELECT 'missing_parameter' AS "check", 'ERROR' AS severity, measure_name || ' zone=' || zone_id AS subject,
         CASE WHEN family = 'POISSON' THEN 'POISSON: mean' ELSE 'NORMAL: mean,std_dev' END AS message
  FROM dirty WHERE measure_name = 'signup'""", *_TIER_CTES))
def dq_missing_parameters(spark, sf_dir):
    return q.missing_parameters(_dirty_tiers(spark, sf_dir))


@query(with_readings("""
  SELECT 'parameter_sanity' AS "check", 'ERROR' AS severity, measure_name || ' zone=' || zone_id AS subject,
         CASE family WHEN 'UNIFORM' THEN 'low must be < high' WHEN 'BINOMIAL' THEN 'p must be in [0,1]'
                     ELSE 'std_dev must be > 0' END AS message
  FROM dirty WHERE (family = 'UNIFORM' AND mean >= std_dev) OR (family = 'BINOMIAL' AND std_dev / 50 > 1)
     OR (family = 'NORMAL' AND measure_name <> 'signup' AND std_dev - 5 <= 0)""", *_TIER_CTES))
def dq_parameter_sanity(spark, sf_dir):
    return q.parameter_sanity(_dirty_tiers(spark, sf_dir))


@query(with_readings("""
  SELECT 'unknown_distribution_measure' AS "check", 'ERROR' AS severity, measure_name AS subject,
         'no class declares this measure' AS message
  FROM (SELECT DISTINCT measure_name FROM tiers) WHERE measure_name NOT IN
       (SELECT CASE WHEN measure_name < 'q' THEN measure_name ELSE upper(measure_name) END FROM measures)
  UNION ALL
  SELECT 'unknown_arrival_measure', 'WARN', measure_name, 'no class declares this measure'
  FROM (SELECT DISTINCT measure_name FROM arrivals) WHERE measure_name NOT IN
       (SELECT CASE WHEN measure_name < 'q' THEN measure_name ELSE upper(measure_name) END FROM measures)""",
                     specs.TIERS_SQL, specs.MEASURES_SQL, specs.ARRIVALS_SQL))
def dq_unknown_measures(spark, sf_dir):
    """The later half of the measures is declared in other letters than it is used in."""
    name = F.col("measure_name")
    known = specs.measures(spark, sf_dir).withColumn("measure_name", F.when(name < "q", name).otherwise(F.upper(name)))
    a = q.unknown_measures(specs.tiers(spark, sf_dir), known, "unknown_distribution_measure", q.ERROR)
    b = q.unknown_measures(specs.arrivals(spark, sf_dir), known, "unknown_arrival_measure", q.WARN)
    return a.unionByName(b)


@query("""
  SELECT DISTINCT 'unknown_stream_event_type' AS "check", 'ERROR' AS severity, 'user_' || user_id AS subject,
         event_type AS message
  FROM events WHERE event_type NOT IN (SELECT event_type FROM events GROUP BY event_type HAVING max(value) > 340)""")
def dq_unknown_event_types(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    declared = e.groupBy("event_type").agg(F.max("value").alias("m")).filter("m > 340")
    streams = e.select(F.concat(F.lit("user_"), F.col("user_id")).alias("name"), "event_type")
    return q.unknown_event_types(streams, declared, "unknown_stream_event_type", q.ERROR, types="event_type")


def _dirty_arrivals(spark, sf_dir):
    a = specs.arrivals(spark, sf_dir)
    return (a.withColumn("failure_prob", F.col("failure_prob") * 4)
            .withColumn("interval_ms", F.when(F.col("decl_order") != 2, F.col("interval_ms")))
            .withColumn("threshold", F.when(F.col("decl_order") != 1, F.col("threshold"))))


_ARRIVAL_SQL = """raw AS (
  SELECT DISTINCT measure_name, zone_id, CASE length(measure_name) % 3 WHEN 0 THEN 'ON_THRESHOLD' WHEN 1 THEN 'ON_CHANGE'
         ELSE 'PERIODIC' END AS mode FROM readings)"""


@query(with_readings("""
  SELECT 'arrival_sanity' AS "check", 'ERROR' AS severity, 'stream_' || zone_id || '.' || measure_name AS subject, message
  FROM (SELECT *, 'failure must be in [0,1]' AS message FROM raw WHERE zone_id / 10.0 * 4 > 1
        UNION ALL SELECT *, 'PERIODIC requires an interval' FROM raw WHERE mode = 'PERIODIC' AND zone_id = 2
        UNION ALL SELECT *, mode || ' requires a threshold' FROM raw WHERE mode <> 'PERIODIC' AND zone_id = 1)""",
                     _ARRIVAL_SQL))
def dq_arrival_sanity(spark, sf_dir):
    return q.arrival_sanity(_dirty_arrivals(spark, sf_dir))


@query("""
  SELECT DISTINCT 'repeated_distribution' AS "check", 'WARN' AS severity, event_type AS subject, 'last one wins' AS message
  FROM events WHERE event_type < 'f'""")
def dq_repeated_distributions(spark, sf_dir):
    return q.repeated_distributions(specs.tiers(spark, sf_dir))


@query(with_readings("""
  SELECT 'zone_without_discriminator' AS "check", 'ERROR' AS severity, device_class || '.' || measure_name AS subject,
         'class does not declare zones' AS message
  FROM measures WHERE device_class = 'MACHINERY'""", specs.MEASURES_SQL))
def dq_zone_discriminator(spark, sf_dir):
    m = specs.measures(spark, sf_dir).withColumn("zone_enum", F.col("device_class") != "MACHINERY")
    return q.zone_without_discriminator(specs.tiers(spark, sf_dir), m)


@query("""
  SELECT 'unknown_table' AS "check", 'ERROR' AS severity, p_name || '.' || p_partkey AS subject, p_type AS message
  FROM part WHERE p_type NOT IN ('ECONOMY', 'SMALL', 'PROMO', 'LARGE')
  UNION ALL
  SELECT 'unknown_column', 'ERROR', p_name || '.' || p_partkey, p_type || '.' || p_brand
  FROM part WHERE p_type IN ('ECONOMY', 'SMALL', 'PROMO', 'LARGE') AND (p_type, p_brand) NOT IN (
    SELECT (p_type, CASE WHEN p_size > 40 THEN p_brand ELSE 'old ' || p_brand END) FROM part)""")
def dq_schema_references(spark, sf_dir):
    """Parts as columns: type and brand name the table and column that are referred to.

    Some types are declared under another name, and so are the brands of smaller parts.
    """
    part = table(spark, sf_dir, "part")
    name = F.when(F.col("p_type").isin("ECONOMY", "SMALL", "PROMO", "LARGE"), F.col("p_type")).otherwise(
        F.concat(F.lit("old "), "p_type"))
    brand = F.when(F.col("p_size") > 40, F.col("p_brand")).otherwise(F.concat(F.lit("old "), "p_brand"))
    columns = part.select(name.alias("table_name"), brand.alias("column_name")).distinct()
    refs = part.select(
        F.col("p_name").alias("table_name"), F.col("p_partkey").cast("string").alias("column_name"),
        F.col("p_type").alias("ref_table"), F.col("p_brand").alias("ref_column"))
    return q.schema_references(columns, refs)


@query(with_readings("""
  SELECT (SELECT count(*) FROM (SELECT 1 FROM dirty GROUP BY measure_name, zone_id HAVING abs(sum(probability) - 1) > 0.001))
       + (SELECT count(*) FROM (SELECT 1 FROM dirty GROUP BY measure_name, zone_id HAVING count(*) FILTER (WHERE tier = 'NORMAL') <> 1))
       + (SELECT count(*) FROM dirty WHERE measure_name = 'signup')
       + (SELECT count(*) FROM dirty WHERE (family = 'UNIFORM' AND mean >= std_dev) OR (family = 'BINOMIAL' AND std_dev / 50 > 1)
             OR (family = 'NORMAL' AND measure_name <> 'signup' AND std_dev - 5 <= 0))
       + (SELECT count(*) FROM raw WHERE zone_id / 10.0 * 4 > 1)
       + (SELECT count(*) FROM raw WHERE mode = 'PERIODIC' AND zone_id = 2)
       + (SELECT count(*) FROM raw WHERE mode <> 'PERIODIC' AND zone_id = 1) AS n_errors,
       CAST(0 AS BIGINT) AS n_warnings, false AS passed""", *_TIER_CTES, _ARRIVAL_SQL))
def dq_spec_roll_up(spark, sf_dir):
    found = q.spec_violations(specs.measures(spark, sf_dir), _dirty_tiers(spark, sf_dir), _dirty_arrivals(spark, sf_dir))
    return q.roll_up(found)


@query("""
  SELECT c_mktsegment AS device_class, count(*) AS n, 100 * count(*) // (SELECT count(*) FROM customer) AS percent
  FROM customer GROUP BY c_mktsegment""")
def resource_summary(spark, sf_dir):
    return counts_with_share(specs.devices(spark, sf_dir), "device_class")


@query("""
  SELECT r_name AS zone, count(*) AS n, 100 * count(*) // (SELECT count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey) AS percent
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""")
def zone_summary(spark, sf_dir):
    located = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return counts_with_share(located.withColumnRenamed("r_name", "zone"), "zone")


def _runs(spark, sf_dir):
    """Line items as a run history: a supplier's items under one flag are one run of that workload."""
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_returnflag").alias("workload"), F.col("l_suppkey").alias("run")
    ).agg(F.count(F.lit(1)).alias("n_devices"), r4(F.sum("l_quantity")).alias("n_events"),
          r4(F.sum("l_extendedprice") / 1000).alias("wall_seconds"), F.max("l_linenumber").alias("n_ticks"))


_RUNS_SQL = f"""WITH runs AS (
  SELECT l_returnflag AS workload, l_suppkey AS run, count(*) AS n_devices, {sql_r4('sum(l_quantity)')} AS n_events,
         {sql_r4('sum(l_extendedprice) / 1000')} AS wall_seconds, max(l_linenumber) AS n_ticks
  FROM lineitem GROUP BY l_returnflag, l_suppkey)"""


@query(f"""{_RUNS_SQL} SELECT workload, run, {sql_r4('n_events / wall_seconds')} AS events_per_second,
  {sql_r4('wall_seconds * 1000.0 / (n_ticks / 1000.0)')} AS ms_per_1k_ticks FROM runs""")
def run_throughput(spark, sf_dir):
    return throughput(_runs(spark, sf_dir)).select(
        "workload", "run", r4("events_per_second").alias("events_per_second"), r4("ms_per_1k_ticks").alias("ms_per_1k_ticks"))


@query(f"""{_RUNS_SQL} SELECT workload, run, {sql_r4('''wall_seconds / first_value(wall_seconds)
         OVER (PARTITION BY workload ORDER BY run)''')} AS scale_vs_first FROM runs""")
def run_scale(spark, sf_dir):
    return scale_vs_first(_runs(spark, sf_dir)).select("workload", "run", r4("scale_vs_first").alias("scale_vs_first"))


@query(f"""{_RUNS_SQL} SELECT workload, count(*) AS n_runs, {sql_r4('regr_slope(ln(wall_seconds), ln(n_devices))')} AS exponent,
  CASE WHEN regr_slope(ln(wall_seconds), ln(n_devices)) < 1.15 THEN 'near-linear'
       WHEN regr_slope(ln(wall_seconds), ln(n_devices)) < 1.5 THEN 'mild superlinear' ELSE 'superlinear' END AS scaling
  FROM runs GROUP BY workload HAVING count(*) >= 2""")
def run_scaling_exponent(spark, sf_dir):
    return scaling_exponent(_runs(spark, sf_dir)).select("workload", "n_runs", r4("exponent").alias("exponent"), "scaling")
